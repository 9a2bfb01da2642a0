"""The ordered folds: rules of the tracker, the trajectory filter and the calibration, in batch and streaming."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from playlake.folds import calibration, ordered, tracker, trajectory
from playlake.streaming import count_observed, read_table, track_stream


def _detections(frame, *boxes, cut=False):
    """Rows of one frame: (x, confidence) or (x, confidence, team) of boxes 20 wide."""
    rows = [
        {"frame_id": frame, "is_cut": cut, "box_id": i, "x1": x, "y1": 100.0, "x2": x + 20, "y2": 150.0, "u": x + 10, "v": 150.0, "confidence": c, "team": t[0] if t else None, "team_confidence": 0.9 if t else None}
        for i, (x, c, *t) in enumerate(boxes)
    ]
    return pd.DataFrame(rows or [{"frame_id": frame, "is_cut": cut, "box_id": None, "x1": None, "y1": None, "x2": None, "y2": None, "u": None, "v": None, "confidence": None, "team": None, "team_confidence": None}])


def _run(frames, **config):
    t = tracker.Tracker(tracker.TrackerConfig(**config))
    return [t.step(f) for f in frames], t


def test_tracks_are_born_from_the_left_and_persist():
    out, _ = _run([_detections(0, (300.0, 0.9), (100.0, 0.9), (500.0, 0.2)), _detections(1, (104.0, 0.9), (303.0, 0.9))])
    assert [[(r["track_id"], r["x1"], r["hits"]) for r in f] for f in out] == [[(1, 100.0, 1), (2, 300.0, 1)], [(1, 104.0, 2), (2, 303.0, 2)]]
    assert (out[1][0]["vu"], out[1][0]["vv"]) == (4.0, 0.0)


def test_short_occlusion_is_recovered_and_a_long_one_expires():
    seen = [_detections(f, (100.0 + 4 * f, 0.9)) for f in range(3)]
    out, t = _run([*seen, _detections(3), _detections(4), _detections(5, (118.0, 0.9))])
    assert [f[0]["missed_frames"] for f in out] == [0, 0, 0, 1, 2, 0] and out[5][0]["recovered"] and t.recoveries == 1
    assert out[3][0]["confidence"] == pytest.approx(0.675) and out[3][0]["x1"] == 112.0  # the first step isn't damped
    out, _ = _run([*seen, *(_detections(f) for f in range(3, 7)), _detections(7, (128.0, 0.9))])
    assert out[6] == [] and [r["track_id"] for r in out[7]] == [2]
    out, _ = _run([*seen, _detections(8, (132.0, 0.9))])  # frames may be left out altogether
    assert [r["track_id"] for r in out[3]] == [2]


def test_a_cut_ends_identities_but_not_their_numbers():
    out, _ = _run([_detections(0, (100.0, 0.9)), _detections(1, (100.0, 0.9), cut=True)])
    assert [r["track_id"] for r in out[1]] == [2]


def test_weak_boxes_recover_proven_tracks_only():
    frames = [_detections(f, (100.0, 0.9)) for f in range(3)] + [_detections(3, (102.0, 0.2))]
    assert [r["missed_frames"] for r in _run(frames, strong_confidence=0.6)[0][3]] == [0]
    assert [r["missed_frames"] for r in _run(frames[1:], strong_confidence=0.6)[0][2]] == [1]
    far = frames[:3] + [_detections(3, (118.0, 0.2))]  # near, but without overlap
    assert [r["missed_frames"] for r in _run(far, strong_confidence=0.6)[0][3]] == [1]


def test_teams_are_voted():
    out, _ = _run([_detections(0, (100.0, 0.9, "TEAM_A")), _detections(1, (100.0, 0.9, "TEAM_A")), _detections(2, (100.0, 0.9, "TEAM_B")), _detections(3, (100.0, 0.9))])
    assert [f[0]["team"] for f in out] == ["TEAM_A"] * 4
    assert out[0][0]["team_confidence"] == 0.955
    assert tracker.Votes().add(None, None) == ("UNKNOWN", 0.0)


def test_tracker_refuses_wrong_parameters():
    for bad in ({"min_iou": 1.5}, {"max_distance_px": 0}, {"max_missed": -1}, {"strong_confidence": 0.1}, {"recovery_hits": 0}):
        with pytest.raises(ValueError, match="tracker"):
            tracker.TrackerConfig(**bad)


def _plain_tracks(rows):
    out = []
    for run, frames in rows.groupby("run_id"):
        t = tracker.Tracker()
        for _, f in frames.groupby("frame_id"):
            out += [(run, r["frame_id"], r["track_id"], r["x1"]) for r in t.step(f)]
    return sorted(out)


def _runs():
    rng, parts = np.random.default_rng(2), []
    for run in range(3):
        for f in range(40):
            d = _detections(f, *((100.0 * k + 3 * f + rng.integers(0, 4), 0.9) for k in range(1, 5) if rng.random() < 0.85))
            parts.append(d.assign(run_id=run))
    return pd.concat(parts, ignore_index=True)


SCHEMA = "run_id int, frame_id long, is_cut boolean, box_id long, x1 double, y1 double, x2 double, y2 double, u double, v double, confidence double, team string, team_confidence double"


def _table(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    plain = rows[names].astype(object).where(rows[names].notna(), None)
    return spark.createDataFrame([tuple(r) for r in plain.itertuples(index=False)], SCHEMA)


def test_batch_tracks_equal_plain_ones_across_batches(spark):
    rows = _runs()
    table = _table(spark, rows)
    frames, found = table.select("run_id", "frame_id", "is_cut").distinct(), table.where("x1 is not null").drop("is_cut")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r["run_id"], r["frame_id"], r["track_id"], r["x1"]) for r in tracker.track(frames, found).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _plain_tracks(rows)


def _drain(stream, folder):
    """Rows that a stream has written so far, after all of its input."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(str(folder / "out")).collect()


def test_streamed_tracks_equal_batch_ones_and_late_frames_fail(spark, tmp_path):
    rows = _runs()
    rows = rows[rows["run_id"] < 2]
    for part in range(3):
        _table(spark, rows[rows["frame_id"] // 14 == part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        got = _drain(track_stream(read_table(spark, str(tmp_path / "in"), SCHEMA)), tmp_path)
        return sorted((r["run_id"], r["frame_id"], r["track_id"], r["x1"]) for r in got)

    assert run() == _plain_tracks(rows)
    _table(spark, rows[rows["frame_id"] == 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="increase strictly"):
        run()


def test_windows_of_play_time_drop_late_rows(spark, tmp_path):
    schema = "run_id int, timestamp_s double, track_state string, x_yd double"
    for rows in ([(0, t / 10, "observed", 1.0) for t in range(300)], [(0, 0.05, "observed", 1.0), (0, 45.0, "coasted", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = _drain(count_observed(read_table(spark, str(tmp_path / "in"), schema)), tmp_path)
    counts = {r["window"]["start"].timestamp(): r["n_observed"] for r in got}
    assert counts[0.0] == 10 and max(counts) <= 45


def _measured(frame, x=None, cuts=0, cid="c", mode="absolute", state="calibrated", missed=0, cov=0.01):
    return pd.DataFrame([{"frame_id": frame, "geometry_state": state, "x_coord_mode": mode, "coordinate_frame_id": cid, "n_cuts": cuts, "x_yd": x, "y_yd": None if x is None else 10.0, "mxx": cov, "mxy": 0.0, "myy": cov, "missed_frames": missed, "projection_status": "projected"}])


def _trajectory(rows):
    t = trajectory.Trajectory()
    return [t.step(r)[0] for r in rows]


def test_filter_follows_steady_motion():
    out = _trajectory([_measured(f, 10 + 0.2 * f) for f in range(30)])
    assert all(r["position_source"] == "measured_smoothed" and r["is_measurement_used"] for r in out)
    assert abs(out[-1]["x_yd"] - 15.8) < 0.02 and abs(out[-1]["vx"] - 6.0) < 0.2 and out[-1]["gate_statistic"] < 1
    assert out[0]["gate_statistic"] is None and out[2]["gate_statistic"] is None  # the filter is still warming up
    assert out[-1]["distance_cum_yd"] == pytest.approx(5.8, abs=0.15)


def test_filter_equals_a_textbook_one():
    """Two updates against the equations written out with plain matrices."""
    c, r = trajectory.TrajectoryConfig(), np.diag([0.04, 0.04])
    k = trajectory.Kalman(np.array([1.0, 2.0]), r, 0.0, c)
    k.predict(0.1)
    f = np.array([[1, 0, 0.1, 0], [0, 1, 0, 0.1], [0, 0, 1, 0], [0, 0, 0, 1]])
    g = np.array([[0.005, 0], [0, 0.005], [0.1, 0], [0, 0.1]])
    p = f @ np.diag([0.04, 0.04, 4, 4]) @ f.T + g @ g.T * 25
    assert np.allclose(k.cov, p)
    h, z = np.eye(4)[:2], np.array([1.3, 2.1])
    gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
    k.update(z, r)
    assert np.allclose(k.mean, f @ [1, 2, 0, 0] + gain @ (z - [1, 2])) and np.allclose(k.cov, (np.eye(4) - gain @ h) @ p)


def test_outliers_are_rejected_then_believed_if_they_persist():
    rows = [_measured(f, 10.0) for f in range(6)] + [_measured(f, 40.0) for f in range(6, 10)]
    out = _trajectory(rows)
    assert [r["is_outlier_rejected"] for r in out[6:]] == [True, True, True, False]
    assert out[6]["x_yd"] is None and abs(out[6]["predicted_x"] - 10) < 0.1 and out[6]["position_source"] == "predicted_dead_reckoning"
    assert out[8]["reinit_after_rejections"] and out[8]["x_yd"] == 40.0


def test_dead_reckoning_lasts_three_frames_and_travels_nothing():
    out = _trajectory([_measured(f, 10 + 0.2 * f) for f in range(5)] + [_measured(f, missed=f - 4) for f in range(5, 10)] + [_measured(10, 14.0)])
    assert [r["position_source"] for r in out[5:]] == ["predicted_dead_reckoning"] * 3 + ["none"] * 2 + ["measured_smoothed"]
    assert out[9]["distance_cum_yd"] == out[4]["distance_cum_yd"] == out[10]["distance_cum_yd"] and out[10]["reinit_after_gap"]
    assert (out[8]["vx"], out[8]["speed_yd_s"], out[8]["cov_xx"]) == (0.0, 0.0, None)


def test_cuts_and_new_axes_count_segments_up():
    out = _trajectory([_measured(0, 10.0), _measured(1, 10.2), _measured(2, 10.4, cuts=2), _measured(3, 10.6, cuts=2, cid="d"), _measured(4, None, cuts=2, state="unknown", mode="uncalibrated")])
    assert [r["coordinate_segment"] for r in out] == [0, 0, 2, 3, 3] and out[3]["distance_cum_yd"] == out[1]["distance_cum_yd"]
    assert [r["coordinate_frame_id"] for r in out] == ["c", "c", "c", "d", "d"]


GOOD = [0.05, 0.0, 5.0, 0.0, -0.06, 40.0, 0.0, 0.0, 1.0]


def _frame(f, ok=True, conf=0.8, h=GOOD, cut=False, d=None, cid=None, mode="absolute"):
    row = {"frame_id": f, "is_cut": cut, "can_project": ok, "x_coord_mode": mode, "confidence": conf, "failure_reason": None if ok else "few_lines", "coordinate_frame_id": cid}
    row |= {f"h{i}": v for i, v in enumerate(h)} | {f"d{i}": None if d is None else d[i] for i in range(9)}
    return pd.DataFrame([row])


def test_calibration_decays_and_expires():
    c = calibration.Calibration()
    out = [c.step(_frame(0))[0]] + [c.step(_frame(f, ok=False))[0] for f in range(1, 5)]
    assert [r["confidence"] for r in out] == [0.8, 0.64, 0.512, 0.4096, 0.0]
    assert [r["success"] for r in out] == [True, True, True, False, False] and [r["propagation_age"] for r in out] == [0, 1, 2, 3, 0]
    assert out[3]["failure_reason"] == "confidence_expired" and out[4]["failure_reason"] == "few_lines" and out[1]["is_propagated"]


def test_calibration_blends_near_priors_and_starts_epochs_at_jumps():
    c = calibration.Calibration()
    near, far = [0.05, 0.0, 6.0, *GOOD[3:]], [0.05, 0.0, 25.0, *GOOD[3:]]
    out = [c.step(f)[0] for f in (_frame(0), _frame(1, h=near), _frame(2, h=far), _frame(3, ok=False, cut=True), _frame(4))]
    assert out[1]["h2"] == pytest.approx(0.25 * 5 + 0.75 * 6) and out[1]["coordinate_frame_id"] == "calibration:1"
    assert out[2]["h2"] == 25.0 and out[2]["coordinate_frame_id"] == "calibration:2"
    assert out[3]["failure_reason"] == "camera_cut_uncalibrated" and out[4]["coordinate_frame_id"] == "calibration:3"


def test_prior_moves_with_the_camera():
    c = calibration.Calibration()
    shift = [1.0, 0.0, 20.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    out = [c.step(f)[0] for f in (_frame(0), _frame(1, ok=False, d=shift))]
    assert out[1]["h2"] == pytest.approx(5.0 - 0.05 * 20) and out[1]["is_propagated"]


def test_steps_are_whole_across_batches():
    rows = pd.DataFrame({"run_id": [0, 0, 0, 1, 1], "frame_id": [1, 1, 2, 1, 1]})
    for n in range(1, 6):
        batches = [rows[i : i + n].reset_index(drop=True) for i in range(0, 5, n)]
        assert [(k, len(g)) for k, g in ordered._steps(iter(batches), ["run_id", "frame_id"])] == [((0, 1), 2), ((0, 2), 1), ((1, 1), 2)]
