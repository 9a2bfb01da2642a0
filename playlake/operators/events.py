"""Timeline events of a play: resolved boundaries and sideline exit candidates, nothing about the ball."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlake.operators.predicates import TEMPORAL, is_finite, is_usable

TRACK = ["run_id", "track_id"]
FIELD_WIDTH_YD = 160 / 3
#: Kinds that are never reported, as they need the ball.
UNAVAILABLE = ("pass", "run", "catch", "incomplete", "tackle")


def has_covariance() -> Column:
    """Whether the position's covariance is given, finite and positive semi-definite."""
    finite = is_finite("cov_xx") & is_finite("cov_xy") & is_finite("cov_yy")
    return finite & (F.col("cov_xx") >= 0) & (F.col("cov_yy") >= 0) & (F.col("cov_xx") * F.col("cov_yy") >= F.col("cov_xy") * F.col("cov_xy"))


def sideline_exits(samples: DataFrame, keys: list[str] | None = None, width: float = FIELD_WIDTH_YD) -> DataFrame:
    """Adjacent samples of which the first is inside the field and the second outside, by two sigma each.

    Bounds are strict. The neighbour is taken among all samples, so an unusable one between them blocks
    the event; so does a covariance that is missing, infinite or indefinite.
    """
    at = Window.partitionBy(*(keys or TRACK)).orderBy("frame_id")
    s = samples.withColumn("ok", is_usable() & has_covariance())
    s = s.withColumn("margin", F.when(F.col("ok"), 2 * F.sqrt("cov_yy")))
    s = s.withColumns({f"before_{c}": F.lag(c).over(at) for c in ("frame_id", "y_yd", "ok", "margin", "timestamp_s", *TEMPORAL)})
    adjacent = (F.col("before_frame_id") + 1 == F.col("frame_id")) & (F.col("before_timestamp_s") < F.col("timestamp_s"))
    for c in TEMPORAL:
        adjacent = adjacent & (F.col(f"before_{c}") == F.col(c))
    inside = (F.col("before_y_yd") - F.col("before_margin") > 0) & (F.col("before_y_yd") + F.col("before_margin") < width)
    low, high = F.col("y_yd") + F.col("margin") < 0, F.col("y_yd") - F.col("margin") > width
    hits = s.where(F.col("ok") & F.col("before_ok") & adjacent & inside & (low | high))
    return hits.withColumn("sideline", F.when(low, "low").otherwise("high"))


def timeline(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """Events of all plays: (run_id, play_id, place, kind, frame_id, source, confidence, track_id).

    `segments` has run_id, play_id, start_frame and snap and end with their sources and confidences. Events
    are placed by frame, kind and track; events of no track, and of track 0, come before others.
    """
    keys = ["run_id", "play_id"]
    none = F.lit(None).cast("long")
    marks = [
        segments.where(F.col(f"{b}_frame").isNotNull()).select(
            *keys, F.lit(kind).alias("kind"), F.col(f"{b}_frame").alias("frame_id"), F.col(f"{b}_source").alias("source"), F.col(f"{b}_confidence").alias("confidence"), none.alias("track_id")
        )
        for b, kind in (("snap", "snap"), ("end", "play_end"))
    ]
    inside = (F.col("frame_id") >= F.col("start_frame")) & (F.col("end_frame").isNull() | (F.col("frame_id") <= F.col("end_frame")))
    within = samples.join(segments.select(*keys, "start_frame", "end_frame"), "run_id").where(inside)
    exits = sideline_exits(within, ["run_id", "play_id", "track_id"]).select(
        *keys, F.lit("sideline_exit_candidate").alias("kind"), "frame_id", F.lit("observed_footpoint_geometry").alias("source"), F.lit(None).cast("double").alias("confidence"), "track_id"
    )
    order = Window.partitionBy(*keys).orderBy("frame_id", "kind", F.when(F.col("track_id") != 0, F.col("track_id")).otherwise(-1), F.col("track_id").asc_nulls_first())
    return marks[0].unionByName(marks[1]).unionByName(exits).withColumn("place", F.row_number().over(order))


def unavailable_kinds(segments: DataFrame) -> DataFrame:
    """The kinds of events that are not claimed for any play, with the reason."""
    kinds = F.explode(F.array(*map(F.lit, UNAVAILABLE))).alias("kind")
    return segments.select("run_id", "play_id", kinds, F.lit("requires validated ball/possession evidence").alias("reason"))
