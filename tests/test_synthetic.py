"""Synthetic plays whose boundaries must be found, team centroids, sweeps and the command line."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from playlake import __main__ as cli
from playlake.folds import teams
from playlake.operators import benchmarks, evidence, segments
from playlake.sources import synthetic
from playlake.storage.store import run_id_of
from tests.test_documents import DOCUMENT

SEQUENCES = "run_id int, fps double, n_frames int, n_tracks int, quiet_speed double, active_speed double, gap_first int, gap_last int, gap_tracks int, cut_frame int"
PLAYS = "run_id int, snap_frame int, end_frame int, active_fraction double, ramp_frames int"


def _sequences(spark):
    rows = [(0, None, None, None, None), (1, None, None, None, None), (2, 5, 8, 20, None), (3, None, None, None, 15), (4, None, None, None, None), (5, None, None, None, None)]
    s = spark.createDataFrame([(r, 30.0, 70, 22, 0.2, 3.5, a, b, c, d) for r, a, b, c, d in rows], SEQUENCES)
    p = spark.createDataFrame([(0, 20, 50, 1.0, 0), (1, 20, 50, 0.8, 6), (2, 20, 50, 1.0, 0), (3, 20, 50, 1.0, 0), (4, 5, 50, 1.0, 0), (5, 20, 50, 0.3, 0)], PLAYS)
    return s, p


def test_boundaries_of_synthetic_plays(spark):
    s, p = _sequences(spark)
    samples = synthetic.synthetic_samples(s, p)
    labels = s.select("run_id", F.lit("p").alias("play_id"), F.lit(0).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("snap_frame"), F.lit(None).cast("long").alias("end_frame"))
    found = segments.segment_plays(samples, labels, automatic_end=True)
    got = {r["run_id"]: (r["snap_frame"], r["end_frame"], r["snap_reason"]) for r in found.collect()}
    assert got[0] == (20, 50, None)
    assert got[1][0] in (22, 23) and got[1][1] == 50  # half of the team moves some frames after the first
    assert got[2] == (None, None, "baseline_evidence_gaps")
    assert got[3] == (None, None, "coordinate_frame_change")
    assert got[4] == (None, None, "no_quiescent_baseline")
    assert got[5] == (None, None, "no_sustained_onset")
    truth = p.select("run_id", F.lit("p").alias("play_id"), F.col("snap_frame").alias("gt_snap"), F.col("end_frame").alias("gt_end"))
    accuracy = benchmarks.phase_accuracy(segments.frame_phases(found, samples), synthetic.true_phases(labels, truth, s))
    assert {r["run_id"]: (r["n_frames"], r["n_matched"]) for r in accuracy.collect()}[0] == (51, 51)
    assert evidence.evidence_buckets(samples).where("run_id = 2 and bucket = 'dead_reckoning'").first()["n"] == 80


def test_positions_add_speeds_up(spark):
    s, p = _sequences(spark)
    last = synthetic.synthetic_samples(s, p).where("run_id = 0 and track_id = 22 and frame_id = 69").first()
    assert (last["x_yd"], last["y_yd"]) == (pytest.approx(20 + (40 * 0.2 + 30 * 3.5) / 30, abs=1e-4), 48.3333)


def test_centroids_follow_the_darker_and_the_lighter_team(spark):
    rng = np.random.default_rng(1)
    dark, light = rng.normal(40, 2, (8, 3)), rng.normal(200, 2, (8, 3))
    a, b = teams.two_medians(np.vstack([light, dark]))
    assert np.allclose(a, np.median(dark, axis=0)) and np.allclose(b, np.median(light, axis=0))
    fold = teams.Centroids()
    frame = lambda f, rows: pd.DataFrame({"frame_id": f, "feature": list(rows), "is_usable": True})
    assert fold.step(frame(0, dark))[0]["centroid_a"] is None  # one team alone isn't told apart
    first = fold.step(frame(1, np.vstack([dark, light])))[0]
    second = fold.step(frame(2, np.vstack([dark + 8, light])))[0]
    assert np.allclose(second["centroid_a"], 0.75 * np.array(first["centroid_a"]) + 0.25 * np.median(dark + 8, axis=0))
    rows = [(0, f, i, v.tolist(), True) for f in range(2) for i, v in enumerate(np.vstack([dark, light]))]
    got = teams.session_centroids(spark.createDataFrame(rows, "run_id int, frame_id long, box_id int, feature array<double>, is_usable boolean"))
    assert [r["centroid_a"] for r in got.orderBy("frame_id").collect()] == [pytest.approx(first["centroid_a"])] * 2


def test_sweeps_put_variants_side_by_side(spark):
    swept = benchmarks.sweep(lambda least: spark.range(10).where(F.col("id") >= least).agg(F.count("*").alias("n")), [{"least": 3}, {"least": 8}])
    assert sorted((r["p_least"], r["n"]) for r in swept.collect()) == [(3, 7), (8, 2)]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text(json.dumps(DOCUMENT))
    for expected in ("inserted", "known"):
        cli.main(["import", str(tmp_path / "store"), str(tmp_path / "d.json")])
        assert capsys.readouterr().out.split() == [run_id_of(DOCUMENT), expected]
    cli.main(["report", str(tmp_path / "store"), run_id_of(DOCUMENT), "coverage"])
    assert json.loads(capsys.readouterr().out)["n_observed"] == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["report", "a", "b", "others"])
