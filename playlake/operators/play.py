"""Metrics of a play, as a long table: one row per play and metric, NULL where evidence is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlake.operators.predicates import is_usable
from playlake.operators.routes import nearest_defender, route_islands
from playlake.operators.windows import in_windows

PRESNAP_MOTION_YD = 1.0
#: Names of the metrics.
METRICS = (
    "observed_track_count", "measured_track_count", "measured_sample_count", "position_sample_coverage", "play_duration_s",
    "post_snap_duration_s", "observed_path_length_sum_yd", "presnap_motion_track_count", "mean_observed_defender_separation_yd",
)


def play_metrics(samples: DataFrame, plays: DataFrame, fps: float, offense: str = "TEAM_A", defense: str = "TEAM_B") -> DataFrame:
    """(run_id, play_id, metric, value) of all plays, with run_id, play_id, start, snap and end.

    Routes, hence path lengths, pre-snap motion and separation, need a snap and an end. A track moves
    before the snap if one of its islands has a yard of path there.
    """
    s = in_windows(samples, plays.select("run_id", "play_id", "start_frame", "snap_frame", "end_frame"))
    timed = F.col("snap_frame").isNotNull() & F.col("end_frame").isNotNull()
    observed, usable = F.col("track_state") == "observed", is_usable()
    base = s.groupBy("run_id", "play_id").agg(
        F.countDistinct(F.when(observed, F.col("track_id"))).cast("double").alias("observed_track_count"),
        F.countDistinct(F.when(usable, F.col("track_id"))).cast("double").alias("measured_track_count"),
        F.count_if(usable).cast("double").alias("measured_sample_count"),
        (F.count_if(usable) / F.count("*")).alias("position_sample_coverage"),
    )
    islands = route_islands(s.where(timed), ["run_id", "play_id", "track_id"])
    edges = islands.groupBy("run_id", "play_id").agg(F.sum("edge_yd").alias("observed_path_length_sum_yd"))
    before = islands.where(F.col("frame_id") < F.col("snap_frame")).groupBy("run_id", "play_id", "track_id", "island").agg(F.sum("edge_yd").alias("d"))
    moved = before.where("d is not null").groupBy("run_id", "play_id").agg(F.countDistinct(F.when(F.col("d") >= PRESNAP_MOTION_YD, F.col("track_id"))).cast("double").alias("presnap_motion_track_count"))
    apart = nearest_defender(s.where(timed), offense, defense, ("run_id", "play_id")).groupBy("run_id", "play_id").agg(F.avg("separation").alias("mean_observed_defender_separation_yd"))
    wide = plays.withColumns({"play_duration_s": (F.col("end_frame") - F.col("start_frame")) / fps, "post_snap_duration_s": (F.col("end_frame") - F.col("snap_frame")) / fps})
    for part in (base, edges, moved, apart):
        wide = wide.join(part, ["run_id", "play_id"], "left")
    counts = {m: F.coalesce(m, F.lit(0.0)) for m in METRICS[:3]}  # counts of no samples are 0, not NULL
    long = wide.withColumns(counts).select("run_id", "play_id", *METRICS).unpivot(["run_id", "play_id"], list(METRICS), "metric", "value")
    return long.withColumn("value", F.round("value", 4))
