"""Formations at one frame: extent of each team, nearest teammates, players in the box.

A frame whose usable samples don't share one identified frame of reference has no formation, as distances
between its players mean nothing; the reason is reported instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlake.operators.predicates import is_formation_usable

FRAME = ["run_id", "frame_id"]


def _ids(test: Column) -> Column:
    """Tracks that pass a test, ascending, as text."""
    return F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("track_id")))).cast("array<string>"), ",")


def assigned() -> Column:
    """Whether a sample's track has a team."""
    return F.coalesce(F.col("team") != "UNKNOWN", F.lit(False))


def formation_status(samples: DataFrame) -> DataFrame:
    """Per frame: status, the first reason against a formation, its frame of reference, and who is left out."""
    ok = is_formation_usable()
    # a missing frame of reference is one of its own, which no formation can stand on
    reference = F.struct(F.coalesce("coordinate_frame_id", F.lit("")).alias("id"), F.col("x_coord_mode").alias("mode"))
    seen = samples.groupBy(*FRAME).agg(
        F.count_if(ok).alias("n_usable"),
        F.min(F.when(ok, reference)).alias("least"),
        F.max(F.when(ok, reference)).alias("most"),
        F.min(F.when(ok, F.col("coordinate_segment"))).alias("least_segment"),
        F.max(F.when(ok, F.col("coordinate_segment"))).alias("most_segment"),
        F.count_if(ok & assigned()).alias("n_assigned"),
        _ids(~ok).alias("excluded"),
        _ids(ok & ~assigned()).alias("unassigned"),
    )
    reason = (
        F.when(F.col("n_usable") == 0, "no_measured_positions")
        .when((F.col("least") != F.col("most")) | (F.col("least.id") == ""), "ambiguous_coordinate_frame")
        .when(F.col("n_assigned") == 0, "no_team_assignments")
    )
    one = F.col("n_usable").isNotNull() & (F.col("reason").isNull() | (F.col("reason") == "no_team_assignments"))
    return seen.withColumn("reason", reason).select(
        *FRAME,
        F.when(F.col("reason").isNull(), "available").otherwise("unavailable").alias("status"),
        "reason",
        F.when(one, F.col("least.id")).alias("coordinate_frame_id"),
        F.when(one, F.col("least.mode")).alias("x_coord_mode"),
        F.when(one & (F.col("least_segment") == F.col("most_segment")), F.col("least_segment")).alias("coordinate_segment"),
        "excluded",
        F.when(one, F.col("unassigned")).otherwise("").alias("unassigned"),
    )


def _players(samples: DataFrame) -> DataFrame:
    """Usable samples of teams at frames that have a formation."""
    available = formation_status(samples).where("status = 'available'").select(*FRAME)
    return samples.where(is_formation_usable() & assigned()).join(available, FRAME, "left_semi")


def nearest_teammates(samples: DataFrame) -> DataFrame:
    """Distance of each player to the nearest one of the same team; NULL for a lone player."""
    s = _players(samples).select(*FRAME, "team", "track_id", "x_yd", "y_yd")
    o = s.select(*FRAME, "team", F.col("track_id").alias("o"), F.col("x_yd").alias("ox"), F.col("y_yd").alias("oy"))
    dx, dy = F.col("x_yd") - F.col("ox"), F.col("y_yd") - F.col("oy")
    pairs = s.join(o, [*FRAME, "team"])
    return pairs.groupBy(*FRAME, "team", "track_id").agg(F.round(F.min(F.when(F.col("track_id") != F.col("o"), F.sqrt(dx * dx + dy * dy))), 6).alias("nearest"))


def formation_shapes(samples: DataFrame) -> DataFrame:
    """Count, players, width, depth, centre and mean nearest distance of each team at each frame."""
    shape = _players(samples).groupBy(*FRAME, "team").agg(
        F.count("*").alias("n_players"),
        _ids(F.lit(True)).alias("track_ids"),
        F.round(F.max("y_yd") - F.min("y_yd"), 6).alias("width"),
        F.round(F.max("x_yd") - F.min("x_yd"), 6).alias("depth"),
        F.round(F.avg("x_yd"), 6).alias("centre_x"),
        F.round(F.avg("y_yd"), 6).alias("centre_y"),
    )
    near = nearest_teammates(samples).groupBy(*FRAME, "team").agg(F.round(F.avg("nearest"), 4).alias("mean_nearest"))
    return shape.join(near, [*FRAME, "team"], "left")


def box_counts(samples: DataFrame, defense: str, los_x: float | None, centre_y: float | None, depth: float = 5.0, half_width: float = 5.0, direction: int | None = 1) -> DataFrame:
    """Defenders in the box beyond the line of scrimmage at frames with a formation, edges included.

    NULL where no defender is observed, and everywhere if an annotation is missing.
    """
    s = _players(samples)
    if los_x is None or centre_y is None or direction is None:
        return s.select(*FRAME).distinct().withColumn("box_count", F.lit(None).cast("long"))
    ahead = direction * (F.col("x_yd") - los_x)
    inside = (F.col("team") == defense) & (ahead >= 0) & (ahead <= depth) & (F.abs(F.col("y_yd") - centre_y) <= half_width)
    seen = F.count_if(F.col("team") == defense)
    return s.groupBy(*FRAME).agg(F.when(seen > 0, F.count_if(inside)).alias("box_count"))
