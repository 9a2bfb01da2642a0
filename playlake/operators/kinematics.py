"""Distance and acceleration over the accepted or reported samples of a track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlake.functions import geometry
from playlake.operators.predicates import TEMPORAL, is_usable

TRACK = ["run_id", "track_id"]


def cumulative_distance(samples: DataFrame, max_gap: int = 3) -> DataFrame:
    """Distance travelled up to each accepted sample of a track.

    A step over more frames than `max_gap`, or into another frame of reference, adds nothing, but what was travelled
    before stays.
    """
    at = Window.partitionBy(*TRACK).orderBy("frame_id")
    s = samples.where(is_usable())
    joined = F.col("frame_id") - F.lag("frame_id").over(at) <= max_gap
    for c in TEMPORAL:
        joined = joined & (F.lag(c).over(at) == F.col(c))
    step = F.hypot(F.col("x_yd") - F.lag("x_yd").over(at), F.col("y_yd") - F.lag("y_yd").over(at))
    s = s.withColumn("step", F.when(joined, step).otherwise(0.0))
    total = F.sum("step").over(at.rowsBetween(Window.unboundedPreceding, 0))
    return s.select(*TRACK, "frame_id", F.round(total, 6).alias("distance"))


def total_distance(distances: DataFrame) -> DataFrame:
    """Distance of each track at its last sample."""
    return distances.groupBy(*TRACK).agg(F.max_by("distance", "frame_id").alias("distance"))


def acceleration(samples: DataFrame, fps: float, most: float = 25.0) -> DataFrame:
    """Change of velocity (vx, vy) per second since the reported sample before, cut off at a most.

    `samples` are those with a position, measured or predicted; a track's first one has 0.
    """
    at = Window.partitionBy(*TRACK).orderBy("frame_id")
    gap = F.col("frame_id") - F.lag("frame_id").over(at)
    change = geometry.length(F.col("vx") - F.lag("vx").over(at), F.col("vy") - F.lag("vy").over(at)) * fps / gap
    s = samples.withColumn("a", F.coalesce(change, F.lit(0.0)))
    return s.select(*TRACK, "frame_id", geometry.rounded(F.least("a", F.lit(most)), 6).alias("acceleration"), (F.col("a") > most).alias("clipped"))
