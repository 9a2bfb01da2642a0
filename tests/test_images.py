"""Rules of boxes, footpoints, projection and teams, the record rules, and the review folder."""

from __future__ import annotations

import json
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from playlake import domain
from playlake.functions import geometry
from playlake.operators import benchmarks, detections, projection, records, scoring
from playlake.plans import image_queries
from playlake.review import guarded, markdown_table, write_review

SF = "/root/testdata/sf0.001"
BOXES = "run_id int, frame_id long, box_id long, x1 double, y1 double, x2 double, y2 double, confidence double, sideline_occluded boolean, lower_body_occluded boolean, player_crossing boolean"


def _boxes(spark, *boxes, **flags):
    extra = [flags.get(f) for f in ("sideline_occluded", "lower_body_occluded", "player_crossing")]
    return spark.createDataFrame([(0, 0, i, *map(float, b[:4]), b[4] if len(b) > 4 else 0.9, *extra) for i, b in enumerate(boxes)], BOXES)


def _foot(spark, *boxes, **flags):
    r = detections.footpoints(_boxes(spark, *boxes, **flags), 900, 506).orderBy("box_id").collect()[0]
    return r["unreliable_reason"], r["foot_confidence"]


def test_first_reason_against_a_footpoint_wins(spark):
    assert _foot(spark, (100, 200, 130, 280)) == (None, 0.9)
    assert _foot(spark, (100, 430, 130, 504)) == ("bottom_border_truncated", 0.243)  # and near the sideline
    assert _foot(spark, (0, 200, 15, 280)) == ("lateral_border_truncated", 0.35)
    assert _foot(spark, (0, 200, 40, 280)) == (None, 0.792)
    assert _foot(spark, (100, 20, 130, 60), sideline_occluded=True) == ("sideline_bench_occlusion", 0.333)
    assert _foot(spark, (100, 200, 130, 230)) == ("lower_body_occluded_aspect_ratio", 0.35)
    assert _foot(spark, (100, 200, 130, 280), (102, 205, 132, 285))[0] == "player_crossing_lower_body_occluded"
    assert _foot(spark, (100, 200, 130, 280), (100, 200, 130, 280)) == (None, 0.9)  # the same box again isn't another player
    assert _foot(spark, (100, 200, 130, 280), lower_body_occluded=True)[0] == "lower_body_occluded"


def test_suppression_equals_a_plain_loop(spark):
    rng = np.random.default_rng(8)
    boxes = [(x, y, x + 40, y + 60, round(float(c), 2)) for x, y, c in zip(rng.integers(0, 120, 25), rng.integers(0, 80, 25), rng.random(25), strict=True)]
    kept = []
    for i in sorted(range(25), key=lambda i: (-boxes[i][4], boxes[i][0], boxes[i][1])):
        a = np.array(boxes[i][:4], float)
        if all(_iou(a, np.array(boxes[j][:4], float)) <= 0.35 for j in kept):
            kept.append(i)
    assert {r["box_id"] for r in detections.suppress(_boxes(spark, *boxes), 0.35).collect()} == set(kept)


def _iou(a, b):
    inter = np.clip(np.minimum(a[2:], b[2:]) - np.maximum(a[:2], b[:2]), 0, None).prod()
    return inter / ((a[2:] - a[:2]).prod() + (b[2:] - b[:2]).prod() - inter)


def test_inner_edges_of_tiles_cut(spark):
    tile = detections.merge_tiles(_boxes(spark, (1, 50, 30, 90), (50, 50, 80, 90), (500, 50, 539, 90)), (360, 0, 900, 304), (900, 506), 0.3)
    assert [(r["box_id"], r["x1"]) for r in tile.orderBy("box_id").collect()] == [(1, 410.0), (2, 860.0)]


def _value(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0]["v"]


def test_rank_and_plausibility_do_not_depend_on_scale(spark):
    view = [0.05, 0.0, 5.0, 0.0, -0.06, 40.0, 0.0, 0.0, 1.0]
    for scale in (1e-6, 1.0, 1e6):
        h = [F.lit(v * scale) for v in view]
        assert _value(spark, geometry.is_homography(h))
        assert not _value(spark, geometry.is_homography([*h[:6], *h[:3]]))
    assert _value(spark, geometry.is_plausible_homography([F.lit(v) for v in view]))
    mirrored = [0.05, 0.0, 5.0, 0.0, 0.06, 10.0, 0.0, 0.0, 1.0]
    assert not _value(spark, geometry.is_plausible_homography([F.lit(v) for v in mirrored]))
    assert not _value(spark, geometry.is_homography([F.lit(None).cast("double"), *[F.lit(v) for v in view[1:]]]))


def test_covariance_floor_equals_an_eigenvalue_one(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        a, b, c = (float(v) for v in rng.normal(0, 0.02, 3))
        got = spark.range(1).select(*geometry.with_least_variance((F.lit(a), F.lit(b), F.lit(c)), 1e-3)).collect()[0]
        values, axes = np.linalg.eigh([[a, b], [b, c]])
        want = (axes * np.maximum(values, 1e-3)) @ axes.T
        assert np.allclose(tuple(got), (want[0, 0], want[0, 1], want[1, 1]))
    major, minor, angle = spark.range(1).select(*geometry.ellipse((F.lit(4.0), F.lit(0.0), F.lit(1.0)))).collect()[0]
    assert (major, minor, angle) == (2.0, 1.0, 0.0)


def test_projection_refuses_in_order(spark):
    cal = domain.calibrations(domain.samples(spark, SF)).limit(1).withColumns({"run_id": F.lit(0), "frame_id": F.lit(0).cast("long"), "success": F.lit(True), "is_plausible": F.lit(True), "x_coord_mode": F.lit("absolute"), "confidence": F.lit(0.9), "failure_reason": F.lit(None).cast("string")})
    cal = cal.withColumns({f"h{i}": F.lit(v) for i, v in enumerate((0.05, 0.0, 5.0, 0.0, -0.06, 40.0, 0.0, 0.0, 1.0))})
    feet = [(0, 0, 1, 100.0, 200.0, True, None, 0.9, 0), (0, 0, 2, 100.0, 200.0, True, None, 0.9, 2), (0, 0, 3, 100.0, 200.0, False, "x", 0.9, 0), (0, 0, 4, 100.0, 200.0, True, None, 0.39, 0), (0, 0, 5, 9e5, 200.0, True, None, 0.9, 0), (0, 1, 6, 1.0, 1.0, True, None, 0.9, 0), (0, 0, 7, 100.0, 200.0, True, None, float("nan"), 0)]
    table = spark.createDataFrame(feet, "run_id int, frame_id long, box_id long, u double, v double, is_reliable boolean, unreliable_reason string, foot_confidence double, missed_frames int")
    got = {r["box_id"]: (r["projection_status"], r["x_yd"], r["x_coord_mode"]) for r in projection.project_footpoints(table, cal).collect()}
    assert got == {
        1: ("projected", 10.0, "absolute"), 2: ("footpoint_unreliable:track_occluded_unobserved", None, "absolute"), 3: ("footpoint_unreliable:x", None, "absolute"), 4: ("footpoint_unreliable:low_footpoint_confidence", None, "absolute"),
        5: ("projection_refused:out_of_stadium_bounds", None, "absolute"), 6: ("calibration_refused:no_calibration", None, "uncalibrated"), 7: ("footpoint_unreliable:low_footpoint_confidence", None, "absolute"),
    }


def test_duplicate_pairs_are_refused():
    import pandas as pd

    from playlake.operators.assignment import solve_frames

    with pytest.raises(ValueError, match="twice"):
        solve_frames(pd.DataFrame({"run_id": [0, 0], "frame_id": [0, 0], "gt_id": [1, 1], "pred_id": [2, 2], "iou": [0.9, 0.8]}))


def test_a_bound_without_a_value_is_missed(spark):
    rows = spark.createDataFrame([(1, 2), (3, 2), (None, 2), (1, None)], "a int, b int")
    assert [r[0] for r in rows.select(benchmarks.within(F.col("a"), F.col("b"))).collect()] == [True, False, False, None]


def test_rates_of_nothing(spark):
    none = domain.scored_boxes(domain.samples(spark, SF))[1].where("false")
    truth = domain.scored_boxes(domain.samples(spark, SF))[0]
    matches = scoring.match_boxes(spark, truth, none)
    r = scoring.detection_rates(truth.select("run_id", "frame_id").distinct(), truth, none, matches)
    assert [(x["precision"], x["recall"]) for x in r.collect()] == [(None, 0.0)]
    assert [(x["precision"], x["recall"], x["f1"]) for x in scoring.detection_rates_or_zero(r).collect()] == [(0.0, 0.0, 0.0)]


def test_duplicates_are_refused(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    with pytest.raises(ValueError, match="samples"):
        records.refuse_duplicates(rows, ["a", "b"], "samples")


def test_review_folder(spark, tmp_path):
    s = domain.samples(spark, SF)
    made = write_review(spark, s, domain.labels(s), 0, str(tmp_path / "r"), 10.0, automatic_end=True)
    names = {"analysis.json", "metrics.csv", "report.md", "report.html", "manifest.json", "bundle.zip"}
    assert {p.name for p in (tmp_path / "r").iterdir()} == names
    assert json.loads((tmp_path / "r" / "analysis.json").read_text())["metrics"] == made["metrics"]
    assert set(zipfile.ZipFile(tmp_path / "r" / "bundle.zip").namelist()) == names - {"bundle.zip"}
    with pytest.raises(FileExistsError):
        write_review(spark, s, domain.labels(s), 0, str(tmp_path / "r"), 10.0, automatic_end=True)
    with pytest.raises(ValueError, match="no end_frame"):
        write_review(spark, s, domain.labels(s), 0, str(tmp_path / "q"), 10.0)
    assert not (tmp_path / "q").exists()
    assert guarded(" =1") == "' =1" and guarded(2.0) == 2.0
    assert markdown_table(("a",), [{"a": "x|<y>\n"}, {"a": None}]).splitlines()[2:] == ["| x\\|&lt;y&gt;  |", "| Unavailable |"]


def test_covariances_equal_sql_where_rounding_halves(spark, tmp_path):
    # each k in turn, so with those boxes whose covariance in pixels is just half of the last place
    events = f"SELECT * REPLACE ((event_id % 100)::BIGINT AS user_id, '{{\"k\": ' || event_id % 100 || '}}' AS props) FROM '{SF}/events.parquet' WHERE event_id < 1000"
    duckdb.sql(f"COPY ({events}) TO '{tmp_path}/events.parquet'")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    columns = "run_id, frame_id, box_id, pxx, pxy, pyy, cov_xx, cov_xy, cov_yy, inflated_xx, sigma_major, sigma_minor, angle"
    theirs = {r[:3]: r[3:] for r in connection.sql(f"SELECT {columns} FROM ({image_queries.SQL['field_covariances']})").fetchall()}
    ours = {tuple(r)[:3]: tuple(r)[3:] for r in image_queries.field_covariances(spark, str(tmp_path)).select(*columns.split(", ")).collect()}
    assert len(ours) > 100
    assert ours == theirs
