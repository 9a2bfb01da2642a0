"""Boxes of players in a frame: footpoints and how far they can be trusted, suppression, order, teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlake.functions import geometry

FRAME = ["run_id", "frame_id"]
CORNERS = ("x1", "y1", "x2", "y2")
BORDER_PX = 4.0
MIN_ASPECT = 1.05
UNRELIABLE_MOST = 0.35


def _box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in CORNERS)  # type: ignore[return-value]


def crossings(boxes: DataFrame, low_share: float = 0.45) -> DataFrame:
    """Per box: whether others of its frame cross it, whether one hides its feet, and the penalty for both.

    Boxes with the very same corners are not compared. Boxes that nothing crosses are absent.
    """
    mine = boxes.select(*FRAME, "box_id", *CORNERS)
    other = boxes.select(*FRAME, F.col("box_id").alias("o_id"), *(F.col(c).alias(f"o_{c}") for c in CORNERS))
    same = F.lit(True)
    for c in CORNERS:
        same = same & (F.col(c) == F.col(f"o_{c}"))
    pairs = mine.join(other, FRAME).where((F.col("box_id") != F.col("o_id")) & ~same)
    across, low = geometry.lower_body_overlap(_box(), _box("o_"))
    pairs = pairs.withColumns({"iou": geometry.box_iou(_box(), _box("o_")), "across": across, "low": low})
    met = pairs.where((F.col("iou") >= 0.15) | ((F.col("across") >= 0.35) & (F.col("low") >= 0.25)))
    hides = (F.col("low") >= low_share) & (F.col("o_y2") >= F.col("y2") - 2.0)
    return met.groupBy(*FRAME, "box_id").agg(F.max(hides).alias("hidden"), F.sum(F.when(hides, 0.60).otherwise(0.10)).alias("crossing_penalty"))


def footpoints(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Bottom centre of each box, whether it can be trusted, the first reason if not, and a confidence.

    Boxes have run_id, frame_id, box_id, corners, confidence, and the flags sideline_occluded,
    lower_body_occluded and player_crossing, which may be NULL. Penalties add up.
    """
    b = boxes.join(crossings(boxes), [*FRAME, "box_id"], "left")
    x1, y1, x2, y2 = _box()
    w, h = F.greatest(x2 - x1, F.lit(1e-3)), F.greatest(y2 - y1, F.lit(1e-3))
    flag = lambda c: F.coalesce(c, F.lit(False))
    bottom, top, side = y2 >= height - BORDER_PX, y1 <= BORDER_PX, (x1 <= BORDER_PX) | (x2 >= width - BORDER_PX)
    lateral = side & (w / F.greatest(F.lit(1.0), h) < 0.25)
    by_line = (y2 <= 0.14 * height) | (y2 >= 0.94 * height)
    bench = by_line & flag("sideline_occluded")
    hidden, flat, low = flag("hidden"), h / w < MIN_ASPECT, flag("lower_body_occluded")
    reason = (
        F.when(bottom, "bottom_border_truncated")
        .when(lateral, "lateral_border_truncated")
        .when(bench, "sideline_bench_occlusion")
        .when(hidden, "player_crossing_lower_body_occluded")
        .when(flat, "lower_body_occluded_aspect_ratio")
        .when(low, "lower_body_occluded")
    )
    penalty = (
        F.when(bottom, 0.65).when(lateral, 0.55).when(top | side, 0.12).otherwise(0.0)
        + F.when(by_line, 0.08).otherwise(0.0)
        + F.when(bench, 0.55).otherwise(0.0)
        + F.coalesce("crossing_penalty", F.lit(0.0))
        + F.when(flat, 0.60).otherwise(0.0)
        + F.when(low, 0.60).otherwise(0.0)
    )
    b = b.withColumn("reason", reason).withColumn("raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") * (1 - penalty))))
    reliable = F.col("reason").isNull()
    return b.select(
        *FRAME,
        "box_id",
        *CORNERS,
        F.round((x1 + x2) / 2, 3).alias("u"),
        F.round(y2, 3).alias("v"),
        reliable.alias("is_reliable"),
        F.round(F.when(reliable, F.col("raw")).otherwise(F.least("raw", F.lit(UNRELIABLE_MOST))), 4).alias("foot_confidence"),
        (bottom | top | side).alias("is_partially_truncated"),
        by_line.alias("is_near_sideline"),
        (F.col("hidden").isNotNull() | flag("player_crossing")).alias("is_player_crossing"),
        (hidden | flat | low).alias("is_temporarily_occluded"),
        F.col("reason").alias("unreliable_reason"),
        F.col("confidence").alias("detection_confidence"),
    )


def suppress(boxes: DataFrame, most_iou: float) -> DataFrame:
    """Boxes that greedy suppression keeps: the surest first, each unless it overlaps one that is kept.

    Ties go to the left, then to the top, then to the lower box_id. A frame's boxes are folded in order in one array
    expression; a frame holds some hundreds at most.
    """
    rank = F.struct((-F.col("confidence")).alias("d"), *CORNERS[:2], "box_id", *CORNERS[2:])
    frames = boxes.groupBy(*FRAME).agg(F.array_sort(F.collect_list(rank)).alias("all"))
    empty = F.array().cast(frames.schema["all"].dataType)

    def corners(b: Column) -> tuple[Column, Column, Column, Column]:
        return tuple(b[c] for c in CORNERS)  # type: ignore[return-value]

    def add(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: geometry.box_iou(corners(k), corners(b)) > most_iou), kept).otherwise(F.concat(kept, F.array(b)))

    kept = frames.select(*FRAME, F.explode(F.aggregate("all", empty, add)).alias("b"))
    return boxes.join(kept.select(*FRAME, F.col("b.box_id").alias("box_id")), [*FRAME, "box_id"], "left_semi")


def merge_tiles(boxes: DataFrame, tile: tuple[float, float, float, float], image: tuple[float, float], least_confidence: float, edge_px: float = 2.0) -> DataFrame:
    """A tile's boxes in the image's coordinates, without unsure ones and those cut by an inner edge of the tile.

    `tile` has the tile's corners; its outer edges, which are the image's, don't cut. Unite the results of all
    tiles and the whole image, then `suppress`.
    """
    left, top, right, bottom = tile
    b = boxes.withColumns({"x1": F.col("x1") + left, "x2": F.col("x2") + left, "y1": F.col("y1") + top, "y2": F.col("y2") + top})
    cut = F.lit(False)
    if left > 0:
        cut = cut | (F.col("x1") <= left + edge_px)
    if top > 0:
        cut = cut | (F.col("y1") <= top + edge_px)
    if right < image[0]:
        cut = cut | (F.col("x2") >= right - edge_px)
    if bottom < image[1]:
        cut = cut | (F.col("y2") >= bottom - edge_px)
    return b.where((F.col("confidence") >= least_confidence) & ~cut)


def name_detections(boxes: DataFrame) -> DataFrame:
    """Boxes with a detection_id by their place in the frame, from left to right."""
    at = Window.partitionBy(*FRAME).orderBy("x1", "y1", "box_id")
    return boxes.withColumn("detection_id", F.format_string("f%04d_det%03d", F.col("frame_id").cast("long"), (F.row_number().over(at) - 1).cast("long")))


def decide_teams(
    features: DataFrame, least_confidence: float = 0.45, least_torso: float = 0.18, least_margin: float = 0.14, most_distance: float = 75.0
) -> DataFrame:
    """Team of each box by its torso's distance to the two session centroids, or why it has none.

    `features` has is_valid, non_turf_ratio, is_striped, feature, centroid_a and centroid_b (arrays of
    doubles of equal length; NULL centroids aren't initialised yet).
    """
    def distance(c: str) -> Column:
        return F.sqrt(F.aggregate(F.zip_with("feature", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))

    f = features.withColumns({"d_a": distance("centroid_a"), "d_b": distance("centroid_b")})
    f = f.withColumn("margin", F.abs(F.col("d_b") - F.col("d_a")) / F.greatest(F.lit(1e-6), F.col("d_a") + F.col("d_b"))).withColumn("near", F.least("d_a", "d_b"))
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    sure = clip(
        0.45 * clip(F.col("margin") / 0.65, 0.0, 1.0) + 0.35 * clip(1 - F.col("near") / most_distance, 0.0, 1.0) + 0.20 * clip(F.col("non_turf_ratio") / 0.65, 0.35, 1.0), 0.0, 0.99
    )
    f = f.withColumn("sure", sure)
    reason = (
        F.when(~F.coalesce("is_valid", F.lit(False)) | (F.col("non_turf_ratio") < least_torso), "insufficient_non_turf_torso_pixels")
        .when(F.col("is_striped"), "striped_official_pattern")
        .when(F.col("centroid_a").isNull() | F.col("centroid_b").isNull(), "uninitialized_team_centroids")
        .when(F.col("margin") < least_margin, "ambiguous_cluster_margin")
        .when(F.col("near") > most_distance, "appearance_outlier_distance")
        .when(F.col("sure") < least_confidence, "low_team_confidence")
    )
    f = f.withColumn("reason", reason)
    why = F.col("reason")
    confidence = (
        F.when(why == "ambiguous_cluster_margin", F.round(F.col("margin") / least_margin * 0.40, 4))
        .when(why == "appearance_outlier_distance", F.round(F.greatest(F.lit(0.0), 0.30 * (1 - F.col("near") / 150.0)), 4))
        .when(why.isNull() | (why == "low_team_confidence"), F.round("sure", 4))
        .otherwise(0.0)
    )
    team = F.when(why.isNotNull(), "UNKNOWN").when(F.col("d_a") < F.col("d_b"), "TEAM_A").otherwise("TEAM_B")
    return f.select(*FRAME, "box_id", team.alias("team"), confidence.alias("confidence"), "reason")


def six_frames(videos: DataFrame) -> DataFrame:
    """Frames to look at, for each of videos (video_id, n_frames): ends, quarters and the tenth, ascending."""
    n = F.col("n_frames")
    quarter = lambda k: F.floor(n * k / 4)
    picked = F.array(F.lit(0).cast("long"), F.least(F.lit(10).cast("long"), n - 1), quarter(1), quarter(2), quarter(3), n - 1)
    return videos.where(n > 0).select("video_id", F.explode(F.array_sort(F.array_distinct(picked))).alias("frame_id"))


def contact_sheet(videos: DataFrame, most: int = 6) -> DataFrame:
    """At most six evenly spaced frames of each of videos (video_id, n_frames), both ends included."""
    m = F.least(F.col("n_frames"), F.lit(most))
    place = F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("place")
    placed = videos.where("n_frames > 0").select("video_id", "n_frames", m.alias("m"), place)
    at = F.when(F.col("m") > 1, F.floor(F.col("place") * (F.col("n_frames") - 1) / (F.col("m") - 1))).otherwise(0)
    return placed.select("video_id", "place", at.cast("long").alias("frame_id"))


def plot_ranges(samples: DataFrame, margin_yd: float = 5.0) -> DataFrame:
    """Fixed horizontal range to draw each frame of reference in."""
    return samples.where(F.col("x_yd").isNotNull() & F.col("coordinate_frame_id").isNotNull()).groupBy("run_id", "coordinate_frame_id", "x_coord_mode").agg(
        F.round(F.min("x_yd") - margin_yd, 6).alias("x_min"), F.round(F.max("x_yd") + margin_yd, 6).alias("x_max")
    )
