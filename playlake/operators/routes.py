"""Routes: continuity islands of a track's usable samples, and what is measured on them.

Islands break where a usable sample is missing, the coordinate epoch changes or time doesn't advance.
Distances over time need equal (frame id, segment, mode); between tracks at one frame, equal (frame id, mode).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlake.operators.predicates import SHARED, TEMPORAL, is_usable

TRACK = ["run_id", "track_id"]
STATIONARY_YD, DOMINANCE = 1.0, 2.0
#: Seconds that two tracks' samples of one frame may lie apart.
SAME_TIME_S = 1e-6


def route_islands(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Usable samples with their island's number within the track, and the edge from the one before.

    `keys` names what a track's samples are taken together by, the track itself unless given.
    """
    at = Window.partitionBy(*(keys or TRACK)).orderBy("frame_id")
    s = samples.where(is_usable())
    same = (F.lag("frame_id").over(at) + 1 == F.col("frame_id")) & (F.lag("timestamp_s").over(at) < F.col("timestamp_s"))
    for c in TEMPORAL:
        same = same & (F.lag(c).over(at) == F.col(c))
    dx, dy = (F.col(c) - F.lag(c).over(at) for c in ("x_yd", "y_yd"))
    s = s.withColumn("joined", F.coalesce(same, F.lit(False))).withColumn("edge_yd", F.when(F.col("joined"), F.sqrt(dx * dx + dy * dy)))
    return s.withColumn("island", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(at))


def route_segments(islands: DataFrame, snap_frame: int, crossing_y: float | None = None, direction: int | None = 1) -> DataFrame:
    """Per island: extent, duration, displacements, depth, stem, length, pre-snap part and crossings.

    Forward displacement and depth are NULL without a direction of play, crossings without a line.
    """
    first, last = (lambda c: F.min_by(c, "frame_id")), (lambda c: F.max_by(c, "frame_id"))
    forward = F.lit(None).cast("double") if direction is None else F.col("x_yd") * direction
    before = (F.col("frame_id") < snap_frame) & F.col("edge_yd").isNotNull()
    islands = islands.withColumn("forward", forward)
    whole = islands.groupBy(*TRACK, "island").agg(
        F.count("*").alias("n_observations"),
        F.count("edge_yd").alias("n_edges"),
        F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame"),
        *(first(c).alias(c) for c in TEMPORAL),
        (last("timestamp_s") - first("timestamp_s")).alias("duration"),
        (last("x_yd") - first("x_yd")).alias("dx"),
        (last("y_yd") - first("y_yd")).alias("dy"),
        (last("forward") - first("forward")).alias("forward"),
        (F.max("forward") - first("forward")).alias("depth"),
        F.coalesce(F.sum("edge_yd"), F.lit(0.0)).alias("distance"),
        F.count_if(before).alias("presnap_n_edges"),
        F.coalesce(F.sum(F.when(before, F.col("edge_yd"))), F.lit(0.0)).alias("presnap_distance"),
    )
    ax, ay = F.abs("dx"), F.abs("dy")
    stem = (
        F.when(F.col("n_observations") < 2, "unknown")
        .when(F.greatest(ax, ay) < STATIONARY_YD, "stationary")
        .when(ax >= DOMINANCE * ay, "longitudinal")
        .when(ay >= DOMINANCE * ax, "lateral")
        .otherwise("mixed")
    )
    rounded = {c: F.round(F.col(c), 6) + 0.0 for c in ("duration", "dx", "dy", "forward", "depth", "distance", "presnap_distance")}
    whole = whole.withColumn("stem", stem).withColumns(rounded)
    if crossing_y is None:
        return whole.withColumn("crossings", F.lit(None).cast("string"))
    crossed = line_crossings(islands, crossing_y).groupBy(*TRACK, "island").agg(F.array_join(F.array_sort(F.collect_list("frame_id")).cast("array<string>"), ",").alias("crossings"))
    return whole.join(crossed, [*TRACK, "island"], "left").withColumn("crossings", F.coalesce("crossings", F.lit("")))


def route_status(segments: DataFrame) -> DataFrame:
    """Whether each track has a route: one of its islands must have an edge."""
    has = F.max("n_edges") > 0
    return segments.groupBy(*TRACK).agg(F.when(has, "available").otherwise("unavailable").alias("status"), F.when(~has, "no_consecutive_measured_positions").alias("reason"), F.count("*").alias("n_islands"))


def line_crossings(islands: DataFrame, y_line: float) -> DataFrame:
    """Frames at which a track has changed sides of a line along the field; touching isn't crossing."""
    off = islands.withColumn("side", F.signum(F.col("y_yd") - y_line)).where("side <> 0")
    at = Window.partitionBy(*TRACK, "island").orderBy("frame_id")
    return off.withColumn("before", F.lag("side").over(at)).where("before <> side").select(*TRACK, "island", "frame_id")


def presnap_motion(islands: DataFrame, snap_frame: int) -> DataFrame:
    """Edges that end before the snap, per track, and their length; tracks without any are absent."""
    return islands.where((F.col("frame_id") < snap_frame) & F.col("edge_yd").isNotNull()).groupBy(*TRACK).agg(F.count("*").alias("n_edges"), F.round(F.sum("edge_yd"), 6).alias("distance"))


def nearest_defender(samples: DataFrame, offense: str = "TEAM_A", defense: str = "TEAM_B", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Nearest usable defender of each usable offense sample at the same frame and time and in the same
    frame of reference; ties go to the lower track. NULL where there is none. `keys` hold samples apart."""
    s = samples.where(is_usable())
    at = [*keys, "frame_id", *SHARED]
    target = s.where(F.col("team") == offense).select(*at, "track_id", "timestamp_s", "x_yd", "y_yd")
    other = s.where(F.col("team") == defense).select(*at, F.struct("track_id", "timestamp_s", "x_yd", "y_yd").alias("o"))
    dx, dy = F.col("x_yd") - F.col("o.x_yd"), F.col("y_yd") - F.col("o.y_yd")
    near = F.when(F.abs(F.col("timestamp_s") - F.col("o.timestamp_s")) <= SAME_TIME_S, F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), F.col("o.track_id").alias("defender_id")))
    best = target.join(other, at, "left").groupBy(*keys, "frame_id", "track_id").agg(F.min(near).alias("b"))
    return best.select(*keys, "frame_id", "track_id", F.round("b.d", 6).alias("separation"), F.col("b.defender_id").alias("defender_id"))
