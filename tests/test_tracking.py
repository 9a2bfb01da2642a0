"""Tracking queries against DuckDB on the smallest tables, and the rules for missing evidence."""

from __future__ import annotations

import itertools
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playlake.functions import geometry
from playlake.operators import assignment, evidence, kinematics, reports, routes
from playlake.plans import all_queries, all_sql
from playlake.sources import labels

SF = "/root/testdata/sf0.001"


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v

    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    ours, theirs = all_queries()[name](spark, SF).toPandas(), connection.sql(all_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    for a, b in zip(_rows(ours), _rows(theirs), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == (pytest.approx(y, abs=2e-6) if isinstance(y, float) else y)


def _samples(spark, rows):
    """Rows of (track, frame, x, y) and overrides."""
    full = []
    for track, frame, x, y, *more in rows:
        full.append({"run_id": 0, "track_id": track, "frame_id": frame, "timestamp_s": frame / 10, "x_yd": x, "y_yd": y, "speed_yd_s": 0.0, "track_state": "observed", "is_outlier_rejected": False, "position_source": "measured_smoothed", "coordinate_frame_id": "c", "x_coord_mode": "absolute", "geometry_state": "calibrated", "is_measurement_used": True, "cov_xx": 0.01, "cov_xy": 0.0, "cov_yy": 0.01, "coordinate_segment": 0, "team": "TEAM_A"} | (more[0] if more else {}))
    schema = "run_id int, track_id long, frame_id long, timestamp_s double, x_yd double, y_yd double, speed_yd_s double, track_state string, is_outlier_rejected boolean, position_source string, coordinate_frame_id string, x_coord_mode string, geometry_state string, is_measurement_used boolean, cov_xx double, cov_xy double, cov_yy double, coordinate_segment int, team string"
    return spark.createDataFrame([tuple(r.values()) for r in full], schema)


def test_route_breaks_at_gaps_and_epochs(spark):
    s = _samples(spark, [(1, 0, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 6.0, 8.0, {"coordinate_segment": 1})])
    got = routes.route_segments(routes.route_islands(s), 5).collect()
    assert [(r["n_observations"], r["distance"], r["stem"]) for r in sorted(got, key=lambda r: r["island"])] == [(1, 0.0, "unknown")] * 3


def test_coasted_sample_breaks_a_route(spark):
    s = _samples(spark, [(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0, {"track_state": "coasted"}), (1, 2, 2.0, 0.0)])
    assert routes.route_segments(routes.route_islands(s), 5).count() == 2


def test_separation_needs_the_same_frame_of_reference(spark):
    s = _samples(spark, [(1, 0, 0.0, 0.0), (2, 0, 3.0, 4.0, {"team": "TEAM_B"}), (3, 0, 0.0, 0.0, {"team": "TEAM_B", "coordinate_frame_id": "other"}), (1, 1, 0.0, 0.0)])
    got = {r["frame_id"]: (r["separation"], r["defender_id"]) for r in routes.nearest_defender(s).collect()}
    assert got == {0: (5.0, 2), 1: (None, None)}


def test_touching_a_line_is_no_crossing(spark):
    s = _samples(spark, [(1, 0, 0.0, -2.0), (1, 1, 0.0, 0.0), (1, 2, 0.0, -2.0), (1, 3, 0.0, 3.0)])
    assert [r["frame_id"] for r in routes.line_crossings(routes.route_islands(s), 0.0).collect()] == [3]


def test_snap_is_found_after_quiet_and_refused_without_tracks(spark):
    rows = [(t, f, 1.0, 1.0, {"speed_yd_s": 5.0 if f >= 12 else 0.0}) for t in range(1, 8) for f in range(20)]
    windows = spark.createDataFrame([(0, "p", 0, 19), (0, "short", 5, 9)], "run_id int, play_id string, start_frame long, end_frame long")
    for tracks, expected in ((8, (12, None)), (4, (None, "insufficient_tracks"))):
        s = _samples(spark, [r for r in rows if r[0] < tracks])
        got = {r["play_id"]: (r["snap_frame"], r["reason"]) for r in evidence.snap_onset(s, windows, evidence.motion_evidence(s, windows)).collect()}
        assert got == {"p": expected, "short": (None, "window_too_short")}


def test_coverage_of_nothing_is_null(spark):
    none = spark.createDataFrame([], "run_id int, track_id long, frame_id long, observed int, confidence double, x_yd double, y_yd double")
    assert tuple(reports.coverage_report(none).collect()[0]) == (0, 0, 0, None)


def test_horizon_is_null_at_any_scale(spark):
    row = spark.range(1).select(F.lit(1.0).alias("u"), F.lit(-1.0).alias("v"))
    for scale in (1e-9, 1.0, 1e9):
        h = [F.lit(v * scale) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0)]
        x, y = geometry.project(h, F.col("u"), F.col("v"))
        assert tuple(row.select(x, y).collect()[0]) == (None, None)


def test_angles_wrap(spark):
    got = spark.createDataFrame([(4.0,), (-4.0,), (1.0,)], "a double").select(geometry.wrap_angle(F.col("a"))).collect()
    assert [round(r[0], 6) for r in got] == [-2.283185, 2.283185, 1.0]


def test_assignment_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(150):
        shape = (rng.integers(1, 5), rng.integers(1, 5))
        score = np.where(rng.random(shape) < 0.6, rng.random(shape), np.nan)
        got = assignment.assign(score)
        assert len({r for r, _ in got}) == len(got) == len({c for _, c in got})
        best = (0, 0.0)
        small = score if score.shape[0] <= score.shape[1] else score.T
        for order in itertools.permutations(range(small.shape[1]), small.shape[0]):
            taken = [small[r, c] for r, c in enumerate(order) if not np.isnan(small[r, c])]
            best = max(best, (len(taken), sum(taken)))
        assert (len(got), sum(score[r, c] for r, c in got)) == pytest.approx(best)


def test_helmet_labels_count_frames_from_zero_and_refuse(spark, tmp_path):
    head = "video,frame,label,left,width,top,height,isSidelinePlayer\n".replace("left,width,top,height", "left,top,width,height")
    (tmp_path / "good.csv").write_text(head + "a,1,H1,0,0,10,20,FALSE\nb,0,H1,0,0,0,0,maybe\n")
    videos = spark.createDataFrame([("a",)], "video string")
    assert [tuple(r) for r in labels.read_helmet_labels(spark, str(tmp_path / "good.csv"), videos).collect()] == [("a", 0, "H1", 0.0, 0.0, 10.0, 20.0, False)]
    for bad in ("a,0,H1,0,0,10,20,FALSE", "a,1,H1,0,0,10,20,maybe", "a,1,H1,0,0,0,20,TRUE", "a,1,H1,0,0,1,1,TRUE\na,1,H1,0,0,1,1,TRUE"):
        (tmp_path / "bad.csv").write_text(head + bad + "\n")
        with pytest.raises(ValueError, match="helmet labels"):
            labels.read_helmet_labels(spark, str(tmp_path / "bad.csv"), videos)


def test_play_labels(spark, tmp_path):
    good = '{"game_id": "g", "plays": [{"play_id": "p", "start_frame": 0, "snap_frame": 3, "end_frame": 9}]}'
    (tmp_path / "good.json").write_text(good)
    assert [tuple(r) for r in labels.read_play_labels(spark, str(tmp_path / "good.json")).collect()] == [("g", "p", 0, 3, 9)]
    for old, new in (('"p"', '""'), ("0,", "-1,"), ("3,", "-2,"), ("9}", "null}"), ("9}", "2}")):
        (tmp_path / "bad.json").write_text(good.replace(old, new, 1))
        with pytest.raises(ValueError, match="play labels"):
            labels.read_play_labels(spark, str(tmp_path / "bad.json"))


def test_metrics_csv_guards_formulas(spark, tmp_path):
    labels.write_metrics_csv(spark.createDataFrame([("=1+1", None), ("ok", 2.0)], "metric string, value double").coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ["metric,value", "'=1+1,", "ok,2.0"]


def test_acceleration_rounds_as_sql_does(spark):
    for vx, vy, wx, wy, gap in ((0.3606, 0.4808, 0.088425, 0.1179, 4), (0.04731, 0.06308000000000001, 0.168765, 0.22502, 4), (0.042945, 0.057260000000000005, 0.17697, 0.23596, 4)):
        s = spark.createDataFrame([(0, 1, 0, vx, vy), (0, 1, gap, wx, wy)], "run_id int, track_id long, frame_id long, vx double, vy double")
        got = kinematics.acceleration(s, 10.0).where("frame_id > 0").collect()[0]["acceleration"]
        a = f"({vx}::DOUBLE - {wx}::DOUBLE), ({vy}::DOUBLE - {wy}::DOUBLE)".split(", ")
        assert got == duckdb.sql(f"SELECT round(sqrt(pow({a[0]}, 2) + pow({a[1]}, 2)) * 10 / {gap}, 6)").fetchall()[0][0]
