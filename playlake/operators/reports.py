"""Fixed reports over stored observations: tracks, coverage, runs, and consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def track_report(observations: DataFrame) -> DataFrame:
    """Per track: life span, observed and other frames, and mean confidence while observed."""
    observed = F.col("observed") == 1
    return observations.groupBy("run_id", "track_id").agg(
        F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame"),
        F.sum("observed").alias("n_observed"),
        (F.count("*") - F.sum("observed")).alias("n_coasted"),
        (F.max("frame_id") - F.min("frame_id") + 1 - F.sum("observed")).alias("n_unobserved"),
        F.round(F.avg(F.when(observed, F.col("confidence"))), 6).alias("mean_confidence"),
    )


def coverage_report(observations: DataFrame) -> DataFrame:
    """One row over all: observations, observed ones, positioned ones, and their share (NULL of none)."""
    observed, positioned = F.col("observed") == 1, F.col("x_yd").isNotNull()
    n = F.coalesce(F.sum("observed"), F.lit(0))
    return observations.agg(
        F.count("*").alias("n_rows"),
        n.alias("n_observed"),
        F.count_if(observed & positioned).alias("n_positioned"),
        F.round(F.try_divide(F.count_if(observed & positioned).cast("double"), n.cast("double")), 6).alias("coverage"),
    )


def run_report(runs: DataFrame, frames: DataFrame, tracks: DataFrame, run_id=None) -> DataFrame:
    """Runs with their counts of frames and tracks; with a run_id only those of the same video, by run_id."""
    if run_id is not None:
        runs = runs.join(runs.where(F.col("run_id") == run_id).select("video_sha256"), "video_sha256", "left_semi")
    n = [t.groupBy("run_id").agg(F.count("*").alias(name)) for t, name in ((frames, "frames_processed"), (tracks, "track_count"))]
    keep = [c for c in ("run_id", "video_sha256", "fps", "source_kind", "pipeline_sha256") if c in runs.columns]
    counted = runs.select(*keep).join(n[0], "run_id", "left").join(n[1], "run_id", "left").fillna(0, ["frames_processed", "track_count"])
    return counted.orderBy("run_id")


def missing_frames(observations: DataFrame) -> DataFrame:
    """Frames within a track's life at which it isn't observed."""
    span = observations.groupBy("run_id", "track_id").agg(F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"))
    every = span.select("run_id", "track_id", F.explode(F.sequence("lo", "hi")).alias("frame_id"))
    seen = observations.where("observed = 1").select("run_id", "track_id", "frame_id")
    return every.join(seen, ["run_id", "track_id", "frame_id"], "left_anti")


def label_overlaps(plays: DataFrame) -> DataFrame:
    """Plays that break the rules for labels: overlap with the one before, or open but not last."""
    at = Window.partitionBy("run_id").orderBy("start_frame", "play_id")
    p = plays.withColumns({"before_end": F.lag("end_frame").over(at), "next_start": F.lead("start_frame").over(at)})
    broken = F.when(F.col("before_end") >= F.col("start_frame"), "overlap").when(F.col("end_frame").isNull() & F.col("next_start").isNotNull(), "open_not_last")
    return p.withColumn("violation", broken).where("violation is not null").select("run_id", "play_id", "violation")


def longest_observed_runs(observations: DataFrame) -> DataFrame:
    """Longest run of consecutive observed frames of each track."""
    at = Window.partitionBy("run_id", "track_id").orderBy("frame_id")
    runs = observations.where("observed = 1").withColumn("island", F.col("frame_id") - F.row_number().over(at))
    n = runs.groupBy("run_id", "track_id", "island").agg(F.count("*").alias("n"))
    return n.groupBy("run_id", "track_id").agg(F.max("n").alias("longest_run"))


def recovery_latency(observations: DataFrame) -> DataFrame:
    """Frames lost before each observation that follows a gap."""
    at = Window.partitionBy("run_id", "track_id").orderBy("frame_id")
    seen = observations.where("observed = 1").withColumn("latency", F.col("frame_id") - F.lag("frame_id").over(at) - 1)
    return seen.where("latency > 0").select("run_id", "track_id", "frame_id", "latency")


def guard_csv(text_column: str) -> Column:
    """A text that a spreadsheet won't read as a formula."""
    c = F.col(text_column)
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
