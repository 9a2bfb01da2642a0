"""Samples within play windows, joined by buckets of frames so that a run's plays don't multiply its samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["run_id", "play_id"]
#: Frames that a bucket spans; a sample meets the windows that touch its bucket only.
BUCKET_FRAMES = 256


def closed_windows(plays: DataFrame, samples: DataFrame) -> DataFrame:
    """Plays with an end: an open play ends with its run's last frame, at its own start at the earliest."""
    last = samples.groupBy("run_id").agg(F.max("frame_id").alias("last_frame"))
    return plays.join(last, "run_id", "left").withColumn("end_frame", F.coalesce("end_frame", F.greatest("start_frame", "last_frame"))).drop("last_frame")


def in_windows(samples: DataFrame, plays: DataFrame) -> DataFrame:
    """Samples with the columns of each play whose window, both ends included, holds them.

    A play without an end is open; it meets all samples from its start on.
    """
    own = [c for c in plays.columns if c != "run_id"]
    closed = closed_windows(plays.withColumn("_end", F.col("end_frame")), samples.select("run_id", "frame_id"))
    spans = closed.where("end_frame >= start_frame").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_frame") / BUCKET_FRAMES), F.floor(F.col("end_frame") / BUCKET_FRAMES))))
    spans = spans.withColumn("end_frame", F.col("_end")).select("run_id", "_bucket", *own)
    inside = (F.col("frame_id") >= F.col("start_frame")) & (F.col("end_frame").isNull() | (F.col("frame_id") <= F.col("end_frame")))
    return samples.withColumn("_bucket", F.floor(F.col("frame_id") / BUCKET_FRAMES)).join(spans, ["run_id", "_bucket"]).where(inside).drop("_bucket")


def tracks_in_windows(samples: DataFrame, plays: DataFrame) -> DataFrame:
    """How many tracks have a sample in each play's window; plays without any are absent."""
    return in_windows(samples.select("run_id", "track_id", "frame_id"), plays).groupBy(*KEYS).agg(F.countDistinct("track_id").alias("n_tracks"))
