"""From image to field: when a calibration may project, and why a footpoint wasn't projected.

A calibration has columns success, h0 to h8 (image to field, row-major), is_plausible, x_coord_mode,
confidence, failure_reason, is_propagated and propagation_age. A footpoint has u, v, is_reliable,
unreliable_reason, foot_confidence and missed_frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlake.functions import geometry

FRAME = ["run_id", "frame_id"]
MIN_CONFIDENCE = 0.45
MIN_FOOTPOINT_CONFIDENCE = 0.40
X_BOUNDS, Y_BOUNDS = (-15.0, 135.0), (-10.0, 63.333333333333336)
PARITY_MIN_SCORE, PARITY_MIN_RATIO = 0.05, 2.0

# Metrics that each mode allows, each list continuing with the next mode's
_FIVE = (
    "five_yard_grid_offset_yd", "yards_gained_dx_yd", "lateral_position_y_yd", "distance_to_sidelines_yd", "distance_to_hashes_yd",
    "player_velocity_and_speed_yd_s", "player_acceleration_yd_s2", "player_distance_covered_yd", "player_separation_yd",
    "formation_width_and_depth_yd", "box_count_and_alignment", "route_depth_and_stem_geometry_yd",
)
_TEN = ("ten_yard_grid_offset_yd", *_FIVE)
METRICS_BY_MODE = {
    "absolute": ("absolute_yard_line_x", "field_territory_own_vs_opp", "red_zone_indicator", "distance_to_goal_line_yd", *_TEN),
    "relative_10yd": _TEN,
    "relative_5yd": _FIVE,
    "uncalibrated": (),
}


def homography(prefix: str = "h") -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(9)]


def can_project(least: float = MIN_CONFIDENCE) -> Column:
    """Whether a calibration supports projection at all; never NULL."""
    known = F.col("x_coord_mode").isin(*(m for m in METRICS_BY_MODE if m != "uncalibrated"))
    confident = ~F.isnan("confidence") & F.col("confidence").between(least, 1.0)
    return F.coalesce(F.col("success") & F.col("is_plausible") & known & confident, F.lit(False)) & geometry.is_homography(homography())


def geometry_state(least: float = MIN_CONFIDENCE) -> Column:
    """calibrated, propagated or unknown; a missing calibration is unknown."""
    return F.when(~can_project(least), "unknown").when(F.coalesce("is_propagated", F.lit(False)), "propagated").otherwise("calibrated")


def is_projectable(state: Column) -> Column:
    return state.isin("calibrated", "propagated")


def propagation_age() -> Column:
    """Frames since the geometry was measured; 0 unless it is propagated."""
    return F.when(F.coalesce("is_propagated", F.lit(False)), F.greatest(F.lit(0), F.col("propagation_age"))).otherwise(0)


def valid_metrics(least: float = MIN_CONFIDENCE) -> Column:
    """Names of the metrics that a calibration's mode allows; none if it can't project."""
    names = F.array().cast("array<string>")
    for mode, metrics in METRICS_BY_MODE.items():
        if metrics:
            names = F.when(F.col("x_coord_mode") == mode, F.array(*map(F.lit, metrics))).otherwise(names)
    return F.when(can_project(least), names).otherwise(F.array().cast("array<string>"))


def project_footpoints(footpoints: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Footpoints with x_yd, y_yd, projection_status, mode, confidences and yard line.

    The status is the first reason against a projection. Positions are rounded to a thousandth. Where a
    footpoint isn't projected its mode is the calibration's if that can project, else uncalibrated.
    """
    found = calibrations.withColumn("has_calibration", F.lit(True))
    j = footpoints.join(found, FRAME, "left").withColumn("ok", can_project())
    x, y = geometry.project(homography(), F.col("u"), F.col("v"))
    # a conditional keeps refused geometry, which may be singular, from being evaluated
    j = j.withColumn("at", F.when(F.col("ok"), F.struct(x.alias("x"), y.alias("y"))))
    x, y = F.col("at.x"), F.col("at.y")
    sure = ~F.isnan("foot_confidence") & F.col("foot_confidence").between(MIN_FOOTPOINT_CONFIDENCE, 1.0)
    finite = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    status = (
        F.when(F.col("has_calibration").isNull(), "calibration_refused:no_calibration")
        .when(~F.col("ok"), F.concat(F.lit("calibration_refused:"), F.coalesce("failure_reason", F.lit("calibration_invalid_or_expired"))))
        .when(F.col("missed_frames") > 0, "footpoint_unreliable:track_occluded_unobserved")
        .when(~F.col("is_reliable"), F.concat(F.lit("footpoint_unreliable:"), F.coalesce("unreliable_reason", F.lit("unreliable_footpoint"))))
        .when(~F.coalesce(sure, F.lit(False)), "footpoint_unreliable:low_footpoint_confidence")
        .when(~F.coalesce(finite, F.lit(False)), "calibration_refused:projection_failed")
        .when(~(x.between(*X_BOUNDS) & y.between(*Y_BOUNDS)), "projection_refused:out_of_stadium_bounds")
        .otherwise("projected")
    )
    j = j.withColumn("projection_status", status)
    done = F.col("projection_status") == "projected"
    return j.select(
        *footpoints.columns,
        "projection_status",
        F.when(done, F.round("at.x", 3)).alias("x_yd"),
        F.when(done, F.round("at.y", 3)).alias("y_yd"),
        F.when(F.col("ok"), F.col("x_coord_mode")).otherwise("uncalibrated").alias("x_coord_mode"),
        F.when(done, F.round("confidence", 4)).alias("calibration_confidence"),
        F.when(done, F.round("foot_confidence", 4)).alias("footpoint_confidence"),
        F.when(done & (F.col("x_coord_mode") == "absolute"), F.round("at.x", 3)).alias("absolute_yardline"),
        F.when(done, F.size(valid_metrics())).otherwise(0).alias("n_valid_metrics"),
    )


def field_covariances(footpoints: DataFrame, calibrations: DataFrame, drift_yd: float = 0.25) -> DataFrame:
    """Covariance of each projectable footpoint's field position, inflated for doubt and drift, and its ellipse.

    Propagated geometry adds its drift for each frame of its age. `footpoints` also has the box's y1, y2 and
    detection_confidence.
    """
    j = footpoints.join(calibrations, FRAME).where(can_project())
    px = geometry.footpoint_covariance(F.col("y1"), F.col("y2"), F.col("detection_confidence"))
    j = j.withColumns(dict(zip(("pxx", "pxy", "pyy"), px, strict=True)))
    j = j.withColumns(dict(zip(("ja", "jb", "jc", "jd"), geometry.jacobian(homography(), F.col("u"), F.col("v")), strict=True)))
    moved = geometry.propagate(tuple(F.col(c) for c in ("ja", "jb", "jc", "jd")), (F.col("pxx"), F.col("pxy"), F.col("pyy")), geometry.confidence_inflation(F.col("confidence")), 0.0)
    drift = F.pow(drift_yd * propagation_age(), F.lit(2))
    j = j.withColumns(dict(zip(("mxx", "mxy", "myy"), (moved[0] + drift, moved[1], moved[2] + drift), strict=True)))
    j = j.withColumns(dict(zip(("cov_xx", "cov_xy", "cov_yy"), geometry.with_least_variance((F.col("mxx"), F.col("mxy"), F.col("myy"))), strict=True)))
    return j.withColumns(dict(zip(("sigma_major", "sigma_minor", "angle"), geometry.ellipse((F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy"))), strict=True)))


def calibration_confidence() -> tuple[Column, dict[str, Column]]:
    """Confidence of a fit and its four parts, from n_yard_lines, ridge_px, n_hash and hash_rmse_px.

    All are 0 below three lines or ten marks, or if a residual is missing.
    """
    def clip(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    poor = (F.col("n_yard_lines") < 3) | (F.col("n_hash") < 10) | F.col("ridge_px").isNull() | F.isnan("ridge_px") | F.col("hash_rmse_px").isNull() | F.isnan("hash_rmse_px")
    parts = {
        "line_support": clip((F.col("n_yard_lines") - 2) / 3.0),
        "ridge_residual": clip(1 - F.col("ridge_px") / 4.0),
        "hash_support": clip(F.col("n_hash") / 20.0),
        "hash_residual": clip(1 - F.col("hash_rmse_px") / 4.0),
    }
    parts = {k: F.when(poor, 0.0).otherwise(v) for k, v in parts.items()}
    return F.round(sum(parts.values(), F.lit(0.0)) / 4, 4), {k: F.round(v, 4) for k, v in parts.items()}


def parity_and_mode(even: Column, odd: Column, verified: Column) -> tuple[Column, Column]:
    """Which grid lines are ten-yard lines (0 or 1, NULL if unclear), and the mode that follows."""
    high, low = F.greatest(even, odd), F.least(even, odd)
    missing = even.isNull() | odd.isNull() | F.isnan(even) | F.isnan(odd)
    clear = ~missing & (high >= PARITY_MIN_SCORE) & (high >= PARITY_MIN_RATIO * F.greatest(low, F.lit(1e-6)))
    parity = F.when(clear, F.when(even >= odd, 0).otherwise(1))
    return parity, F.when(~clear, "relative_5yd").when(verified, "absolute").otherwise("relative_10yd")


def homography_jumps(calibrations: DataFrame, width: float = 900.0, height: float = 506.0) -> DataFrame:
    """How far each usable calibration moves the field against the run's usable one before, in yards."""
    at = Window.partitionBy("run_id").orderBy("frame_id")
    usable = calibrations.where(can_project()).withColumns({f"p{i}": F.lag(f"h{i}").over(at) for i in range(9)})
    jump = geometry.homography_jump(homography("p"), homography(), width, height)
    return usable.where("p8 is not null").select(*FRAME, F.round(jump, 6).alias("jump_yd"))


def image_jumps(tracks: DataFrame, calibrations: DataFrame, px_per_frame: float = 22.0) -> DataFrame:
    """Observed footpoints that moved further in the image than a player can, at frames of unknown geometry.

    `tracks` has run_id, track_id, frame_id, u and v of observed footpoints. The ratio is of the distance
    to what is plausible over the frames in between.
    """
    at = Window.partitionBy("run_id", "track_id").orderBy("frame_id")
    state = calibrations.select(*FRAME, geometry_state().alias("state"))
    moved = tracks.withColumns({"frames": F.col("frame_id") - F.lag("frame_id").over(at), "d": F.hypot(F.col("u") - F.lag("u").over(at), F.col("v") - F.lag("v").over(at))})
    rated = moved.where("frames > 0").withColumn("ratio", F.col("d") / (px_per_frame * F.col("frames")))
    unknown = F.coalesce("state", F.lit("unknown")) == "unknown"
    return rated.join(state, FRAME, "left").select("run_id", "track_id", "frame_id", F.round("ratio", 6).alias("ratio"), ((F.col("ratio") > 1) & unknown).alias("flagged"))


def crowding(positions: DataFrame, least_players: int = 4, spread_yd: float = 3.0) -> DataFrame:
    """Per frame: how far positions (x_yd, y_yd) spread about their centre, and whether players are clustered."""
    spread = F.sqrt(F.var_pop("x_yd") + F.var_pop("y_yd"))
    per_frame = positions.groupBy(*FRAME).agg(F.count("*").alias("n_players"), spread.alias("spread"))
    return per_frame.select(*FRAME, "n_players", F.round("spread", 6).alias("spread_yd"), ((F.col("n_players") >= least_players) & (F.col("spread") < spread_yd)).alias("clustered"))


def implied_heights(boxes: DataFrame, calibrations: DataFrame, least_boxes: int = 3) -> DataFrame:
    """Per frame: the median height of boxes in feet, by the field's scale at their feet; NULL of few boxes."""
    j = boxes.join(calibrations, FRAME).where(geometry.is_homography(homography()))
    centre = (F.col("x1") + F.col("x2")) / 2
    (x0, y0), (x1, y1) = (geometry.project(homography(), centre + d, F.col("y2")) for d in (-20.0, 20.0))
    feet = (F.col("y2") - F.col("y1")) * F.hypot(x1 - x0, y1 - y0) / 40.0 * 3.0
    per_frame = j.withColumn("feet", feet).groupBy(*FRAME).agg(F.count("*").alias("n_boxes"), F.median("feet").alias("feet"))
    return per_frame.select(*FRAME, "n_boxes", F.when(F.col("n_boxes") >= least_boxes, F.round("feet", 4)).alias("height_ft"))
