"""Registered queries of the ordered folds and of the rules that records keep, with DuckDB equivalents where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake import domain
from playlake.domain import BENCHMARK_SQL, LABELS_SQL, SAMPLES_SQL
from playlake.folds import calibration, tracker, trajectory
from playlake.operators import detections, kinematics, projection, records, segments

Query = Callable[[SparkSession, str], DataFrame]


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's frames; some begin a new shot."""
    s = domain.samples(spark, sf_dir).select("run_id", "frame_id").distinct()
    return s.withColumn("is_cut", (F.col("run_id") * 5 + F.col("frame_id")) % 37 == 36)


def _feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections.footpoints(domain.boxes(domain.samples(spark, sf_dir)), 900, 506)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities found in the boxes of each run."""
    found = _feet(spark, sf_dir).withColumnRenamed("detection_confidence", "confidence").withColumns({"team": F.when(F.col("box_id") % 2 == 0, "TEAM_A").otherwise("TEAM_B"), "team_confidence": F.lit(0.8)})
    return tracker.track(_frames(spark, sf_dir), found)


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrations after the frames before them; the camera moves by a pixel at every fourth frame."""
    own = domain.calibrations(domain.samples(spark, sf_dir)).withColumns({"can_project": projection.can_project(), "coordinate_frame_id": F.lit(None).cast("string")})
    pan = F.when(F.col("frame_id") % 4 == 0, 1.0)
    one, none = F.when(pan.isNotNull(), 1.0), F.when(pan.isNotNull(), 0.0)
    moved = {f"d{i}": c for i, c in enumerate((one, none, pan, none, one, none, none, none, one))}
    frames = _frames(spark, sf_dir).join(own, ["run_id", "frame_id"], "left").withColumns(moved).fillna({"can_project": False})
    return calibration.propagate_calibrations(frames.withColumn("failure_reason", F.coalesce("failure_reason", F.lit("no_calibration"))))


def calibration_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir)


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories of the boxes, each taken as its own track."""
    feet = _feet(spark, sf_dir).withColumn("missed_frames", F.lit(0))
    return trajectory.build_trajectories(trajectory.measurements(feet, _calibrated(spark, sf_dir)))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trajectories(spark, sf_dir)


def trajectory_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.trajectory_modes(_trajectories(spark, sf_dir))


def trajectory_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of trajectories that break a rule; there must be none."""
    return records.check_samples(_trajectories(spark, sf_dir))


def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.cumulative_distance(domain.samples(spark, sf_dir))


def total_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinematics.total_distance(kinematics.cumulative_distance(domain.samples(spark, sf_dir)))


def acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.benchmark(domain.samples(spark, sf_dir))[0]
    return kinematics.acceleration(s.where("coalesce(x_yd, predicted_x) is not null"), 10.0)


def sample_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.check_samples(domain.benchmark(domain.samples(spark, sf_dir))[0])


def segment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays of manual labels, with something wrong in most runs."""
    s = domain.samples(spark, sf_dir)
    good = segments.segment_plays(s, domain.labels(s).where("play_id = 'p1'"), automatic_snap=False)
    case = F.col("run_id") % 6
    return records.check_segments(
        good.withColumns(
            {
                "start_frame": F.when(case == 1, -1).otherwise(F.col("start_frame")),
                "end_frame": F.when(case == 2, F.lit(None)).when(case == 3, -5).otherwise(F.col("end_frame")),
                "snap_reason": F.when(case == 4, "").otherwise(F.col("snap_reason")),
                "end_confidence": F.when(case == 5, 1.5).otherwise(F.col("end_confidence")),
            }
        )
    )


def player_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir)
    t = s.where("k % 10 <> 1").select("run_id", "track_id", "frame_id", (F.col("track_state") == "observed").alias("observed"))
    return records.player_records(t, s.where("k % 7 <> 1"))


def exported_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read back from each run's exchange form."""
    s = domain.samples(spark, sf_dir)
    o = s.join(domain.boxes(s).select("run_id", F.col("box_id").alias("track_id"), "frame_id", "x1", "y1", "x2", "y2", "confidence"), ["run_id", "track_id", "frame_id"])
    made = records.documents(o.withColumn("observed", F.when(F.col("track_state") == "observed", 1).otherwise(0)))
    shape = "array<struct<frame_id: bigint, players: array<struct<track_id: bigint, observed: boolean, field_position: array<double>>>>>"
    read = made.select("run_id", F.explode(F.from_json("frames", shape)).alias("f")).select("run_id", F.explode("f.players").alias("p"))
    return read.groupBy("run_id").agg(F.count("*").alias("n_players"), F.count_if("p.observed").alias("n_observed"), F.count("p.field_position").alias("n_positioned"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        tracks, calibration_propagation, trajectories, trajectory_modes, trajectory_violations, cumulative_distance, total_distance, acceleration, sample_violations, segment_violations, player_records, exported_runs,
    )
}

_S = f"WITH {SAMPLES_SQL}"
_USABLE = """position_source = 'measured_smoothed' AND is_measurement_used AND NOT is_outlier_rejected AND track_state = 'observed' AND x_yd IS NOT NULL AND geometry_state <> 'unknown'
    AND x_coord_mode <> 'uncalibrated' AND coordinate_frame_id IS NOT NULL"""
_DISTANCE = f"""{_S}, steps AS (SELECT run_id, track_id, frame_id, CASE WHEN frame_id - lag(frame_id) OVER w <= 3 AND lag(coordinate_frame_id) OVER w = coordinate_frame_id AND lag(coordinate_segment) OVER w = coordinate_segment
        AND lag(x_coord_mode) OVER w = x_coord_mode THEN sqrt(pow(x_yd - lag(x_yd) OVER w, 2) + pow(y_yd - lag(y_yd) OVER w, 2)) ELSE 0.0::DOUBLE END AS d
        FROM samples WHERE {_USABLE} WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame_id)
), travelled AS (SELECT run_id, track_id, frame_id, round(sum(d) OVER (PARTITION BY run_id, track_id ORDER BY frame_id), 6) AS distance FROM steps)"""

SQL: dict[str, str] = {
    "trajectory_violations": f"{_S} SELECT run_id, track_id, frame_id, '' AS violation FROM samples WHERE false",
    "cumulative_distance": f"{_DISTANCE} SELECT * FROM travelled",
    "total_distance": f"{_DISTANCE} SELECT run_id, track_id, arg_max(distance, frame_id) AS distance FROM travelled GROUP BY ALL",
    "acceleration": f"""{_S}, {BENCHMARK_SQL}, a AS (SELECT run_id, track_id, frame_id, coalesce(sqrt(pow(vx - lag(vx) OVER w, 2) + pow(vy - lag(vy) OVER w, 2)) * 10 / (frame_id - lag(frame_id) OVER w), 0.0::DOUBLE) AS a
        FROM bench WHERE coalesce(x_yd, predicted_x) IS NOT NULL WINDOW w AS (PARTITION BY run_id, track_id ORDER BY frame_id)) SELECT run_id, track_id, frame_id, round(least(a, 25), 6) AS acceleration, a > 25 AS clipped FROM a""",
    "sample_violations": f"""{_S}, {BENCHMARK_SQL}, v AS (SELECT run_id, track_id, frame_id, CASE WHEN x_yd IS NOT NULL AND geometry_state = 'unknown' THEN 'position_in_unknown_geometry' WHEN x_yd IS NOT NULL AND position_source = 'none' THEN 'position_without_source'
        WHEN position_source <> 'none' AND x_yd IS NULL AND predicted_x IS NULL THEN 'source_without_position' WHEN predicted_x IS NOT NULL AND position_source <> 'predicted_dead_reckoning' THEN 'unnamed_prediction' END AS violation FROM bench)
        SELECT * FROM v WHERE violation IS NOT NULL""",
    "segment_violations": f"""{_S}, {LABELS_SQL}, v AS (SELECT run_id, play_id, CASE run_id % 6 WHEN 1 THEN 'negative_start' WHEN 2 THEN 'end_and_source_disagree' WHEN 3 THEN 'end_before_start' WHEN 5 THEN 'end_confidence_out_of_range'
        WHEN 4 THEN CASE WHEN snap_frame IS NULL THEN 'snap_refused_without_reason' END END AS violation FROM labels WHERE play_id = 'p1') SELECT * FROM v WHERE violation IS NOT NULL""",
    "player_records": f"""{_S} SELECT t.run_id, t.track_id, t.frame_id, t.track_state = 'observed' AS observed, s.x_yd, s.y_yd, s.x_coord_mode, s.coordinate_frame_id, s.coordinate_segment FROM samples t
        LEFT JOIN (SELECT * FROM samples WHERE k % 7 <> 1) s ON s.run_id = t.run_id AND s.track_id = t.track_id AND s.frame_id = t.frame_id WHERE t.k % 10 <> 1""",
    "exported_runs": f"{_S} SELECT run_id, count(*) AS n_players, count(*) FILTER (track_state = 'observed') AS n_observed, count(x_yd) AS n_positioned FROM samples GROUP BY run_id",
}
