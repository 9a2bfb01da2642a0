"""Synthetic plays with known boundaries: quiet players who set off together, and stop together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Players stand between these lines, evenly.
Y_FIRST, Y_SPAN, X_START = 5.0, 43.3333, 20.0


def synthetic_samples(sequences: DataFrame, plays: DataFrame) -> DataFrame:
    """Trajectory samples of sequences, one row per sequence, track and frame.

    `sequences` has run_id, fps, n_frames, n_tracks, quiet_speed and active_speed, and all of gap_first, gap_last and gap_tracks
    (frames in which the first tracks are dead reckoned) and cut_frame (from which on the axes are others), which
    may be NULL. `plays` has run_id, snap_frame, end_frame (NULL: none), active_fraction and ramp_frames: so many of the first tracks
    move from the snap on, one after the other during the ramp.
    """
    s = sequences.withColumn("track_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_tracks").cast("long"))))
    n_active = F.round(F.col("active_fraction") * F.col("n_tracks"))
    late = F.when((F.col("ramp_frames") > 0) & (n_active > 1), F.floor((F.col("track_id") - 1) * F.col("ramp_frames") / n_active)).otherwise(0)
    moves = s.join(plays, "run_id").where(F.col("track_id") <= n_active)
    onset, stop = F.greatest(F.lit(0), F.col("snap_frame") + late), F.coalesce("end_frame", F.col("n_frames")) - 1
    active = moves.withColumns({"a": onset, "z": F.least(stop, F.col("n_frames") - 1)}).where("a <= z")
    active = active.select("run_id", "track_id", F.explode(F.sequence(F.col("a").cast("long"), F.col("z").cast("long"))).alias("frame_id")).distinct().withColumn("moves", F.lit(True))
    f = s.withColumn("frame_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)))
    f = f.join(active, ["run_id", "track_id", "frame_id"], "left").withColumn("speed_yd_s", F.when(F.col("moves"), F.col("active_speed")).otherwise(F.col("quiet_speed")))
    travelled = F.sum(F.col("speed_yd_s") / F.col("fps")).over(Window.partitionBy("run_id", "track_id").orderBy("frame_id"))
    dead = F.coalesce((F.col("track_id") <= F.col("gap_tracks")) & F.col("frame_id").between(F.col("gap_first"), F.col("gap_last")), F.lit(False))
    after = F.coalesce(F.col("frame_id") >= F.col("cut_frame"), F.lit(False))
    return f.select(
        "run_id", "track_id", "frame_id", (F.col("frame_id") / F.col("fps")).alias("timestamp_s"), F.round(X_START + travelled, 4).alias("x_yd"),
        F.round(Y_FIRST + Y_SPAN * (F.col("track_id") - 1) / F.greatest(F.lit(1), F.col("n_tracks") - 1), 4).alias("y_yd"), "speed_yd_s", F.when(dead, "coasted").otherwise("observed").alias("track_state"),
        F.lit(False).alias("is_outlier_rejected"), F.when(dead, "predicted_dead_reckoning").otherwise("measured_smoothed").alias("position_source"), (~dead).alias("is_measurement_used"),
        F.when(dead, "propagated").otherwise("calibrated").alias("geometry_state"), F.lit("relative_10yd").alias("x_coord_mode"), F.concat(F.lit("synthetic:"), F.col("run_id"), F.when(after, "#after").otherwise("")).alias("coordinate_frame_id"),
        after.cast("int").alias("coordinate_segment"),
    )


def true_phases(labels: DataFrame, truth: DataFrame, sequences: DataFrame) -> DataFrame:
    """(run_id, play_id, frame_id, phase) by the true boundaries; without a true snap it is unknown throughout.

    `labels` has run_id, play_id, start_frame and end_frame, `truth` run_id, play_id, gt_snap and gt_end.
    """
    j = labels.select("run_id", "play_id", "start_frame", "end_frame").join(truth, ["run_id", "play_id"]).join(sequences.select("run_id", "n_frames"), "run_id")
    last = F.when(F.col("gt_snap").isNull(), F.coalesce("end_frame", F.col("n_frames") - 1)).otherwise(F.coalesce("gt_end", F.col("n_frames") - 1))
    f = j.withColumn("frame_id", F.explode(F.sequence(F.col("start_frame").cast("long"), last.cast("long"))))
    at, snap = F.col("frame_id"), F.col("gt_snap")
    phase = F.when(snap.isNull(), "snap_unknown").when(at < snap, "pre_snap").when(at == snap, "snap").when(at == F.col("gt_end"), "play_end").otherwise("play")
    return f.select("run_id", "play_id", "frame_id", phase.alias("phase"))
