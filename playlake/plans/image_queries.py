"""Registered queries of boxes, calibrations and projection, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake import domain
from playlake.domain import BOXES_SQL, CALIBRATIONS_SQL, SAMPLES_SQL
from playlake.functions import geometry
from playlake.operators import detections, projection

Query = Callable[[SparkSession, str], DataFrame]
WIDTH, HEIGHT = 900, 506


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) + 0.0 for n in names})


def _calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.calibrations(domain.samples(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.boxes(domain.samples(spark, sf_dir))


def _footpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.footpoints(_boxes(spark, sf_dir), WIDTH, HEIGHT)


def geometry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = projection.geometry_state()
    return _calibrations(spark, sf_dir).select(
        "run_id", "frame_id", projection.can_project().alias("can_project"), state.alias("state"), projection.is_projectable(state).alias("projectable"), projection.propagation_age().cast("int").alias("age"),
        geometry.is_homography(projection.homography()).alias("full_rank"), geometry.is_plausible_homography(projection.homography()).alias("plausible"), F.size(projection.valid_metrics()).alias("n_metrics"),
    )


def valid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _calibrations(spark, sf_dir).select("run_id", F.explode(projection.valid_metrics()).alias("metric"))
    return names.groupBy("run_id", "metric").agg(F.count("*").alias("n_frames"))


def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence, parts = projection.calibration_confidence()
    parity, mode = projection.parity_and_mode(F.col("even_score"), F.col("odd_score"), F.col("start_verified"))
    return _calibrations(spark, sf_dir).select("run_id", "frame_id", confidence.alias("fit_confidence"), *(c.alias(n) for n, c in parts.items()), parity.alias("parity"), mode.alias("mode"))


def homography_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.homography_jumps(_calibrations(spark, sf_dir), WIDTH, HEIGHT)


def box_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(detections.crossings(_boxes(spark, sf_dir)), 6, "crossing_penalty")


def footpoint_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _footpoints(spark, sf_dir).drop("x1", "y1", "x2", "y2", "detection_confidence")


def project_footpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = _footpoints(spark, sf_dir).withColumn("missed_frames", F.when(F.col("box_id") % 9 == 0, 1).otherwise(0))
    made = projection.project_footpoints(feet, _calibrations(spark, sf_dir))
    return made.select("run_id", "frame_id", "box_id", "projection_status", "x_yd", "y_yd", "x_coord_mode", "calibration_confidence", "footpoint_confidence", "absolute_yardline", "n_valid_metrics")


def field_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = projection.field_covariances(_footpoints(spark, sf_dir), _calibrations(spark, sf_dir))
    twice = geometry.inflate((F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy")), F.lit(2.0))
    made = made.withColumn("inflated_xx", twice[0]).select("run_id", "frame_id", "box_id", "pxx", "pxy", "pyy", "cov_xx", "cov_xy", "cov_yy", "inflated_xx", "sigma_major", "sigma_minor", "angle")
    return made.withColumns({n: geometry.rounded(F.col(n), 6) + 0.0 for n in made.columns[3:]})


def image_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = _footpoints(spark, sf_dir).select("run_id", F.col("box_id").alias("track_id"), "frame_id", "u", "v")
    return projection.image_jumps(feet, _calibrations(spark, sf_dir))


def implied_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.implied_heights(_boxes(spark, sf_dir), _calibrations(spark, sf_dir))


def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.crowding(domain.samples(spark, sf_dir).where("x_yd is not null"))


def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.suppress(_boxes(spark, sf_dir), 0.1).select("run_id", "frame_id", "box_id")


def tile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    tiles = [(x, y, x + 540.0, y + 304.0) for x in (0.0, 360.0) for y in (0.0, 202.0)]
    local = [b.where(F.col("k") % 4 == i).withColumns({"x1": F.col("x1") * 0.6, "x2": F.col("x2") * 0.6, "y1": F.col("y1") * 0.6, "y2": F.col("y2") * 0.6}) for i in range(4)]
    merged = b
    for part, tile in zip(local, tiles, strict=True):
        merged = merged.unionByName(detections.merge_tiles(part, tile, (WIDTH, HEIGHT), 0.3))
    return _rounded(merged.select("run_id", "frame_id", "box_id", "x1", "y1", "x2", "y2"), 6, "x1", "y1", "x2", "y2")


def detection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.name_detections(_boxes(spark, sf_dir)).select("run_id", "frame_id", "box_id", "detection_id")


def team_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torso features from `embeddings`, whose labels form the frames; each frame's centroids are fixed vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    feature = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 60)
    centroid = lambda s: F.when(F.col("label") % 5 != 4, F.array(F.lit(s * 40.0), F.lit(s * 10.0), F.lit(0.0)))
    f = e.select(
        F.lit(0).alias("run_id"), F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("box_id"), (F.col("vec_id") % 11 != 0).alias("is_valid"), ((F.col("vec_id") % 50).cast("double") / 60).alias("non_turf_ratio"),
        (F.col("vec_id") % 13 == 0).alias("is_striped"), feature.alias("feature"), centroid(-1.0).alias("centroid_a"), centroid(1.0).alias("centroid_b"),
    )
    return detections.decide_teams(f)


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.samples(spark, sf_dir).groupBy(F.col("track_id").alias("video_id")).agg(F.count("*").alias("n_frames"))


def six_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.six_frames(_videos(spark, sf_dir))


def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.contact_sheet(_videos(spark, sf_dir))


def plot_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.plot_ranges(domain.samples(spark, sf_dir))


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on velocities that are made up from positions."""
    s = domain.samples(spark, sf_dir).where("x_yd is not null")
    vx, vy = F.when(F.col("k") == 0, 0.0).otherwise(F.col("x_yd") - 35), F.when(F.col("k") == 0, 0.0).otherwise(F.col("y_yd") - 26)
    s = s.withColumns({"vx": vx, "vy": vy})
    speed, heading = geometry.speed_and_heading(F.col("vx"), F.col("vy"))
    cx, cy, clipped = geometry.clip_speed(F.col("vx"), F.col("vy"), 12.0)
    out = s.select(
        "run_id", "track_id", "frame_id", speed.alias("speed"), heading.alias("heading"), cx.alias("cx"), cy.alias("cy"), clipped.alias("clipped"), geometry.yards_to_feet(F.col("x_yd")).alias("x_ft"),
        geometry.feet_to_yards(F.col("y_yd")).alias("y_third"), geometry.fixed_noise(F.col("track_id"), F.col("frame_id"), 1).alias("noise"), geometry.wrap_angle(heading * 3).alias("wrapped"),
    )
    return _rounded(out, 5, "speed", "heading", "cx", "cy", "x_ft", "y_third", "noise", "wrapped")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        geometry_states, valid_metrics, calibration_fit, homography_jumps, box_crossings, footpoint_reliability, project_footpoints, field_covariances, image_jumps, implied_heights, crowding,
        suppress, tile_union, detection_names, team_decisions, six_frames, contact_sheet, plot_ranges, kinematics,
    )
}

_S = f"WITH RECURSIVE {SAMPLES_SQL}"
_C = f"{_S}, {CALIBRATIONS_SQL}"
_B = f"{_S}, {BOXES_SQL}"
_AREA = lambda p: f"greatest(({p}.x2 - {p}.x1) * ({p}.y2 - {p}.y1), 1e-6)"
_INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
_CROSSINGS = f"""pairs AS (
    SELECT a.run_id, a.frame_id, a.box_id, a.y2, b.y2 AS oy2, {_INTER} / ({_AREA('a')} + {_AREA('b')} - {_INTER}) AS iou, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) / greatest(a.x2 - a.x1, 1e-6) AS across,
           greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1 + (a.y2 - a.y1) * (2.0::DOUBLE / 3), b.y1)) / ((a.x2 - a.x1) * (a.y2 - (a.y1 + (a.y2 - a.y1) * (2.0::DOUBLE / 3)))) AS low
    FROM boxes a JOIN boxes b ON a.run_id = b.run_id AND a.frame_id = b.frame_id AND a.box_id <> b.box_id AND NOT (a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2)
), crossed AS (
    SELECT run_id, frame_id, box_id, bool_or(low >= 0.45 AND oy2 >= y2 - 2) AS hidden, sum(CASE WHEN low >= 0.45 AND oy2 >= y2 - 2 THEN 0.60::DOUBLE ELSE 0.10::DOUBLE END) AS crossing_penalty
    FROM pairs WHERE iou >= 0.15 OR (across >= 0.35 AND low >= 0.25) GROUP BY ALL
)"""
_FEET = f"""{_CROSSINGS}, judged AS (
    SELECT b.*, coalesce(hidden, false) AS hid, hidden IS NOT NULL AS crosses, coalesce(crossing_penalty, 0) AS cp, y2 >= 502 AS bottom, y1 <= 4 AS top, x1 <= 4 OR x2 >= 896 AS side, y2 <= 0.14 * 506 OR y2 >= 0.94 * 506 AS line,
           (y2 - y1) / (x2 - x1) < 1.05 AS flat FROM boxes b LEFT JOIN crossed USING (run_id, frame_id, box_id)
), reasoned AS (
    SELECT *, CASE WHEN bottom THEN 'bottom_border_truncated' WHEN side AND (x2 - x1) / greatest(1, y2 - y1) < 0.25 THEN 'lateral_border_truncated' WHEN line AND sideline_occluded THEN 'sideline_bench_occlusion'
                   WHEN hid THEN 'player_crossing_lower_body_occluded' WHEN flat THEN 'lower_body_occluded_aspect_ratio' WHEN lower_body_occluded THEN 'lower_body_occluded' END AS reason,
           greatest(0, least(1, confidence * (1 - (CASE WHEN bottom THEN 0.65::DOUBLE WHEN side AND (x2 - x1) / greatest(1, y2 - y1) < 0.25 THEN 0.55::DOUBLE WHEN top OR side THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN line THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN line AND sideline_occluded THEN 0.55::DOUBLE ELSE 0 END + cp + CASE WHEN flat THEN 0.60::DOUBLE ELSE 0 END + CASE WHEN lower_body_occluded THEN 0.60::DOUBLE ELSE 0 END)))) AS raw
    FROM judged
), feet AS (
    SELECT *, round((x1 + x2) / 2, 3) AS u, round(y2, 3) AS v, reason IS NULL AS is_reliable, round(CASE WHEN reason IS NULL THEN raw ELSE least(raw, 0.35::DOUBLE) END, 4) AS foot_confidence FROM reasoned
)"""
_PX, _PY, _PW = "(h0 * {u} + h1 * {v} + h2)", "(h3 * {u} + h4 * {v} + h5)", "(h6 * {u} + h7 * {v} + h8)"


def _projected(u: str, v: str, p: str = "h") -> tuple[str, str]:
    x, y, w = (t.format(u=u, v=v).replace("h", p) for t in (_PX, _PY, _PW))
    return f"({x} / {w})", f"({y} / {w})"


_FX, _FY = _projected("u", "v")
_PLAUSIBLE = " AND ".join(
    ["m % 23 <> 0"]
    + [f"((({_projected('550', '253')[0]} - {_projected('450', '253')[0]}) * ({_projected('450', '153')[1]} - {_projected('450', '253')[1]})) - (({_projected('550', '253')[1]} - {_projected('450', '253')[1]}) * ({_projected('450', '153')[0]} - {_projected('450', '253')[0]}))) > 0"]
    + [f"sqrt(pow({_projected(u, v)[0]} - {_projected('450', '253')[0]}, 2) + pow({_projected(u, v)[1]} - {_projected('450', '253')[1]}, 2)) BETWEEN 0.5000000001 AND 34.9999999999" for u, v in (("550", "253"), ("450", "153"))]
)
_METRICS = "[" + ", ".join(f"'{m}'" for m in projection.METRICS_BY_MODE["absolute"]) + "]"
_CLIP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"
_POOR = "n_yard_lines < 3 OR n_hash < 10 OR ridge_px IS NULL OR hash_rmse_px IS NULL"
_PARTS = {"line_support": "(n_yard_lines - 2) / 3.0::DOUBLE", "ridge_residual": "1 - ridge_px / 4", "hash_support": "n_hash / 20.0::DOUBLE", "hash_residual": "1 - hash_rmse_px / 4"}
_PART = {k: f"CASE WHEN {_POOR} THEN 0.0::DOUBLE ELSE {_CLIP.format(v)} END" for k, v in _PARTS.items()}
_CLEAR = "coalesce(greatest(even_score, odd_score) >= 0.05 AND greatest(even_score, odd_score) >= 2.0 * greatest(least(even_score, odd_score), 1e-6) AND even_score IS NOT NULL, false)"
_JUMP = ", ".join(
    f"sqrt(pow({_projected(u, '253.0')[0]} - {_projected(u, '253.0', 'p')[0]}, 2) + pow({_projected(u, '253.0')[1]} - {_projected(u, '253.0', 'p')[1]}, 2))" for u in ("450.0", "225.0", "675.0")
)
_PSD = """SELECT *, (c_xx + c_yy) / 2 AS mean, sqrt(pow((c_xx - c_yy) / 2, 2) + c_xy * c_xy) AS root FROM {}"""

SQL: dict[str, str] = {
    "geometry_states": f"""{_C} SELECT run_id, frame_id, ok AS can_project, CASE WHEN NOT ok THEN 'unknown' WHEN is_propagated THEN 'propagated' ELSE 'calibrated' END AS state, ok AS projectable,
        CASE WHEN is_propagated THEN propagation_age ELSE 0 END AS age, m % 23 <> 0 AS full_rank, {_PLAUSIBLE} AS plausible,
        CASE WHEN NOT ok THEN 0 ELSE CASE x_coord_mode WHEN 'absolute' THEN 17 WHEN 'relative_10yd' THEN 13 ELSE 12 END END AS n_metrics FROM gated""",
    "valid_metrics": f"""{_C} SELECT run_id, metric, count(*) AS n_frames FROM (SELECT run_id, unnest(CASE x_coord_mode WHEN 'absolute' THEN {_METRICS} WHEN 'relative_10yd' THEN {_METRICS}[5:] ELSE {_METRICS}[6:] END) AS metric FROM gated WHERE ok) GROUP BY ALL""",
    "calibration_fit": f"""{_C} SELECT run_id, frame_id, round(({' + '.join(f'({v})' for v in _PART.values())}) / 4, 4) AS fit_confidence, {', '.join(f'round({v}, 4) AS {k}' for k, v in _PART.items())},
        CASE WHEN {_CLEAR} THEN CASE WHEN even_score >= odd_score THEN 0 ELSE 1 END END AS parity, CASE WHEN NOT {_CLEAR} THEN 'relative_5yd' WHEN start_verified THEN 'absolute' ELSE 'relative_10yd' END AS mode FROM cals""",
    "homography_jumps": f"""{_C}, l AS (SELECT *, {', '.join(f'lag(h{i}) OVER w AS p{i}' for i in range(9))} FROM gated WHERE ok WINDOW w AS (PARTITION BY run_id ORDER BY frame_id))
        SELECT run_id, frame_id, round(greatest({_JUMP}), 6) AS jump_yd FROM l WHERE p8 IS NOT NULL""",
    "box_crossings": f"{_B}, {_CROSSINGS} SELECT run_id, frame_id, box_id, hidden, round(crossing_penalty, 6) + 0.0 AS crossing_penalty FROM crossed",
    "footpoint_reliability": f"""{_B}, {_FEET} SELECT run_id, frame_id, box_id, u, v, is_reliable, foot_confidence, bottom OR top OR side AS is_partially_truncated, line AS is_near_sideline,
        crosses OR player_crossing AS is_player_crossing, hid OR flat OR lower_body_occluded AS is_temporarily_occluded, reason AS unreliable_reason FROM feet""",
    "project_footpoints": f"""{_C}, {BOXES_SQL}, {_FEET}, j AS (SELECT f.*, c.* EXCLUDE (run_id, frame_id, confidence), c.confidence AS cc, c.run_id IS NOT NULL AS has, CASE WHEN ok THEN {_FX} END AS x, CASE WHEN ok THEN {_FY} END AS y
            FROM feet f LEFT JOIN gated c ON f.run_id = c.run_id AND f.frame_id = c.frame_id), s AS (
            SELECT *, CASE WHEN NOT has THEN 'calibration_refused:no_calibration' WHEN NOT ok THEN 'calibration_refused:' || coalesce(failure_reason, 'calibration_invalid_or_expired')
                WHEN box_id % 9 = 0 THEN 'footpoint_unreliable:track_occluded_unobserved' WHEN NOT is_reliable THEN 'footpoint_unreliable:' || reason
                WHEN foot_confidence < 0.40 THEN 'footpoint_unreliable:low_footpoint_confidence' WHEN x IS NULL OR y IS NULL THEN 'calibration_refused:projection_failed'
                WHEN NOT (x BETWEEN -15 AND 135 AND y BETWEEN -10 AND 190.0::DOUBLE / 3) THEN 'projection_refused:out_of_stadium_bounds' ELSE 'projected' END AS projection_status FROM j)
        SELECT run_id, frame_id, box_id, projection_status, CASE WHEN projection_status = 'projected' THEN round(x, 3) END AS x_yd, CASE WHEN projection_status = 'projected' THEN round(y, 3) END AS y_yd,
               CASE WHEN ok THEN x_coord_mode ELSE 'uncalibrated' END AS x_coord_mode, CASE WHEN projection_status = 'projected' THEN round(cc, 4) END AS calibration_confidence,
               CASE WHEN projection_status = 'projected' THEN round(foot_confidence, 4) END AS footpoint_confidence, CASE WHEN projection_status = 'projected' AND x_coord_mode = 'absolute' THEN round(x, 3) END AS absolute_yardline,
               CASE WHEN projection_status <> 'projected' THEN 0 ELSE CASE x_coord_mode WHEN 'absolute' THEN 17 WHEN 'relative_10yd' THEN 13 ELSE 12 END END AS n_valid_metrics FROM s""",
    "field_covariances": f"""{_C}, {BOXES_SQL}, {_FEET}, j AS (SELECT f.run_id, f.frame_id, box_id, u, v, c.*, {_FX} AS fx, {_FY} AS fy, h6 * u + h7 * v + h8 AS w, 1 + 2.5::DOUBLE * (1 - c.confidence) AS infl, CASE WHEN is_propagated THEN propagation_age ELSE 0 END * 0.25::DOUBLE AS drift,
            greatest(0.30::DOUBLE, greatest(0.5::DOUBLE, greatest(1.0::DOUBLE, y2 - y1) / 50) * (1 + 1.5::DOUBLE * greatest(0.0::DOUBLE, 1 - f.confidence))) AS sg FROM feet f JOIN gated c ON f.run_id = c.run_id AND f.frame_id = c.frame_id WHERE ok
        ), q AS (SELECT *, 0.49::DOUBLE * sg * sg AS c_xx, 0.14::DOUBLE * sg * sg AS c_xy, sg * sg AS c_yy FROM j
        ), p AS (SELECT *, greatest(mean + root, 0.0225::DOUBLE) AS hi, greatest(mean - root, 0.0225::DOUBLE) AS lo FROM ({_PSD.format('q')})
        ), r AS (SELECT * EXCLUDE (c_xx, c_xy, c_yy, mean, root, hi, lo), (hi + lo) / 2 + (hi - lo) / 2 * ((c_xx - c_yy) / 2 / root) AS pxx, (hi - lo) / 2 * (c_xy / root) AS pxy, (hi + lo) / 2 - (hi - lo) / 2 * ((c_xx - c_yy) / 2 / root) AS pyy FROM p
        ), d AS (SELECT *, (h0 - fx * h6) / w AS a, (h1 - fx * h7) / w AS b, (h3 - fy * h6) / w AS e, (h4 - fy * h7) / w AS g FROM r
        ), t AS (SELECT run_id, frame_id, box_id, pxx, pxy, pyy, (a * a * pxx + 2 * a * b * pxy + b * b * pyy) * infl * infl + drift * drift AS c_xx, (a * e * pxx + (a * g + b * e) * pxy + b * g * pyy) * infl * infl AS c_xy,
                   (e * e * pxx + 2 * e * g * pxy + g * g * pyy) * infl * infl + drift * drift AS c_yy FROM d
        ), x AS (SELECT *, greatest(mean + root, 1e-4) AS hi, greatest(mean - root, 1e-4) AS lo FROM ({_PSD.format('t')})
        ), z AS (SELECT *, (hi + lo) / 2 + (hi - lo) / 2 * ((c_xx - c_yy) / 2 / root) AS cov_xx, (hi - lo) / 2 * (c_xy / root) AS cov_xy, (hi + lo) / 2 - (hi - lo) / 2 * ((c_xx - c_yy) / 2 / root) AS cov_yy FROM x)
        SELECT run_id, frame_id, box_id, round(pxx, 6) + 0.0 AS pxx, round(pxy, 6) + 0.0 AS pxy, round(pyy, 6) + 0.0 AS pyy, round(cov_xx, 6) + 0.0 AS cov_xx, round(cov_xy, 6) + 0.0 AS cov_xy, round(cov_yy, 6) + 0.0 AS cov_yy, round(4 * cov_xx, 6) + 0.0 AS inflated_xx,
               round(sqrt(hi), 6) + 0.0 AS sigma_major, round(sqrt(lo), 6) + 0.0 AS sigma_minor, round(atan2(2 * cov_xy, cov_xx - cov_yy) / 2, 6) + 0.0 AS angle FROM z""",
    "image_jumps": f"""{_C}, {BOXES_SQL}, {_FEET}, l AS (SELECT run_id, box_id AS track_id, frame_id, frame_id - lag(frame_id) OVER w AS n, sqrt(pow(u - lag(u) OVER w, 2) + pow(v - lag(v) OVER w, 2)) AS d FROM feet WINDOW w AS (PARTITION BY run_id, box_id ORDER BY frame_id))
        SELECT run_id, track_id, frame_id, round(d / (22.0::DOUBLE * n), 6) AS ratio, d / (22.0::DOUBLE * n) > 1 AND NOT coalesce(ok, false) AS flagged FROM l LEFT JOIN gated USING (run_id, frame_id) WHERE n > 0""",
    "implied_heights": f"""{_C}, {BOXES_SQL}, h AS (SELECT b.run_id, b.frame_id, (y2 - y1) * sqrt(pow({_projected('((x1 + x2) / 2 + 20)', 'y2')[0]} - {_projected('((x1 + x2) / 2 - 20)', 'y2')[0]}, 2) + pow({_projected('((x1 + x2) / 2 + 20)', 'y2')[1]} - {_projected('((x1 + x2) / 2 - 20)', 'y2')[1]}, 2)) / 40 * 3 AS feet
            FROM boxes b JOIN cals c ON b.run_id = c.run_id AND b.frame_id = c.frame_id WHERE m % 23 <> 0) SELECT run_id, frame_id, count(*) AS n_boxes, CASE WHEN count(*) >= 3 THEN round(median(feet), 4) END AS height_ft FROM h GROUP BY ALL""",
    "crowding": f"""{_S} SELECT run_id, frame_id, count(*) AS n_players, round(sqrt(var_pop(x_yd) + var_pop(y_yd)), 6) AS spread_yd, count(*) >= 4 AND sqrt(var_pop(x_yd) + var_pop(y_yd)) < 3 AS clustered FROM samples WHERE x_yd IS NOT NULL GROUP BY ALL""",
    "suppress": f"""{_B}, ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame_id ORDER BY confidence DESC, x1, y1, box_id) AS r FROM boxes), kept AS (
            SELECT run_id, frame_id, 1::BIGINT AS r, [struct_pack(id := box_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] AS ks FROM ranked WHERE r = 1
            UNION ALL SELECT k.run_id, k.frame_id, b.r, CASE WHEN len(list_filter(k.ks, lambda a: {_INTER} / ({_AREA('a')} + {_AREA('b')} - {_INTER}) > 0.1)) > 0 THEN k.ks ELSE list_append(k.ks, struct_pack(id := b.box_id, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2)) END
            FROM kept k JOIN ranked b ON b.run_id = k.run_id AND b.frame_id = k.frame_id AND b.r = k.r + 1)
        SELECT run_id, frame_id, unnest(ks).id AS box_id FROM (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY run_id, frame_id ORDER BY r DESC) = 1)""",
    "tile_union": f"""{_B}, tiled AS (SELECT run_id, frame_id, box_id, confidence, x1 * 0.6 + k % 4 // 2 * 360 AS x1, x2 * 0.6 + k % 4 // 2 * 360 AS x2, y1 * 0.6 + k % 2 * 202 AS y1, y2 * 0.6 + k % 2 * 202 AS y2, k % 4 // 2 AS far, k % 2 AS low FROM boxes)
        SELECT run_id, frame_id, box_id, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1, round(x2, 6) + 0.0 AS x2, round(y2, 6) + 0.0 AS y2 FROM (SELECT run_id, frame_id, box_id, x1, y1, x2, y2 FROM boxes UNION ALL
            SELECT run_id, frame_id, box_id, x1, y1, x2, y2 FROM tiled WHERE confidence >= 0.3 AND CASE WHEN far = 1 THEN x1 > 362 ELSE x2 < 538 END AND CASE WHEN low = 1 THEN y1 > 204 ELSE y2 < 302 END)""",
    "detection_names": f"""{_B} SELECT run_id, frame_id, box_id, printf('f%04d_det%03d', frame_id, row_number() OVER (PARTITION BY run_id, frame_id ORDER BY x1, y1, box_id) - 1) AS detection_id FROM boxes""",
    "team_decisions": """WITH f AS (
            SELECT label::BIGINT AS frame_id, vec_id AS box_id, vec_id % 11 <> 0 AS ok, (vec_id % 50)::DOUBLE / 60 AS r, vec_id % 13 = 0 AS striped, label % 5 <> 4 AS has,
                   embedding[1]::DOUBLE * 60 AS x, embedding[2]::DOUBLE * 60 AS y, embedding[3]::DOUBLE * 60 AS z FROM embeddings
        ), d AS (SELECT *, sqrt((x + 40) * (x + 40) + (y + 10) * (y + 10) + z * z) AS da, sqrt((x - 40) * (x - 40) + (y - 10) * (y - 10) + z * z) AS db FROM f
        ), m AS (SELECT *, abs(db - da) / greatest(1e-6, da + db) AS mg, least(da, db) AS near FROM d
        ), c AS (SELECT *, greatest(0, least(0.99::DOUBLE, 0.45::DOUBLE * least(1, mg / 0.65::DOUBLE) + 0.35::DOUBLE * greatest(0, 1 - near / 75) + 0.20::DOUBLE * greatest(0.35::DOUBLE, least(1, r / 0.65::DOUBLE)))) AS sure FROM m
        ), w AS (SELECT *, CASE WHEN NOT ok OR r < 0.18 THEN 'insufficient_non_turf_torso_pixels' WHEN striped THEN 'striped_official_pattern' WHEN NOT has THEN 'uninitialized_team_centroids' WHEN mg < 0.14 THEN 'ambiguous_cluster_margin'
            WHEN near > 75 THEN 'appearance_outlier_distance' WHEN sure < 0.45 THEN 'low_team_confidence' END AS reason FROM c)
        SELECT 0 AS run_id, frame_id, box_id, CASE WHEN reason IS NOT NULL THEN 'UNKNOWN' WHEN da < db THEN 'TEAM_A' ELSE 'TEAM_B' END AS team, reason,
               CASE WHEN reason = 'ambiguous_cluster_margin' THEN round(mg / 0.14::DOUBLE * 0.40::DOUBLE, 4) WHEN reason = 'appearance_outlier_distance' THEN round(greatest(0, 0.30::DOUBLE * (1 - near / 150)), 4)
                    WHEN reason IS NULL OR reason = 'low_team_confidence' THEN round(sure, 4) ELSE 0.0::DOUBLE END AS confidence FROM w""",
    "six_frames": f"""{_S}, v AS (SELECT track_id AS video_id, count(*) AS n FROM samples GROUP BY 1), p AS (SELECT video_id, unnest([0, least(10, n - 1), n // 4, n // 2, 3 * n // 4, n - 1]) AS frame_id FROM v) SELECT DISTINCT video_id, frame_id::BIGINT AS frame_id FROM p""",
    "contact_sheet": f"""{_S}, v AS (SELECT track_id AS video_id, count(*) AS n FROM samples GROUP BY 1), p AS (SELECT video_id, n, least(n, 6) AS m, unnest(range(least(n, 6))) AS place FROM v)
        SELECT video_id, place, CASE WHEN m > 1 THEN place * (n - 1) // (m - 1) ELSE 0 END::BIGINT AS frame_id FROM p""",
    "plot_ranges": f"""{_S} SELECT run_id, coordinate_frame_id, x_coord_mode, round(min(x_yd) - 5, 6) AS x_min, round(max(x_yd) + 5, 6) AS x_max FROM samples WHERE x_yd IS NOT NULL AND coordinate_frame_id IS NOT NULL GROUP BY ALL""",
    "kinematics": f"""{_S}, v AS (SELECT *, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE x_yd - 35 END AS vx, CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE y_yd - 26 END AS vy FROM samples WHERE x_yd IS NOT NULL
        ), h AS (SELECT *, sqrt(vx * vx + vy * vy) AS sp, CASE WHEN abs(vx) < 1e-9 AND abs(vy) < 1e-9 THEN 0.0::DOUBLE ELSE atan2(vy, vx) END AS hd, sin(track_id * 12.9898::DOUBLE + frame_id * 78.233::DOUBLE + 37.719::DOUBLE) * 43758.5453::DOUBLE AS wv FROM v)
        SELECT run_id, track_id, frame_id, round(sp, 5) + 0.0 AS speed, round(hd, 5) + 0.0 AS heading, round(CASE WHEN sp > 12 THEN vx * 12 / sp ELSE vx END, 5) + 0.0 AS cx, round(CASE WHEN sp > 12 THEN vy * 12 / sp ELSE vy END, 5) + 0.0 AS cy, sp > 12 AS clipped,
               round(x_yd * 3, 5) + 0.0 AS x_ft, round(y_yd / 3, 5) + 0.0 AS y_third, round((wv - floor(wv)) * 2 - 1, 5) + 0.0 AS noise, round(hd * 3 - 2 * pi() * floor((hd * 3 + pi()) / (2 * pi())), 5) + 0.0 AS wrapped FROM h""",
}
