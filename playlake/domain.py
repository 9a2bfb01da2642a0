"""Tracking tables derived from the generic test tables, for queries and their SQL equivalents.

`events` becomes trajectory samples: 22 users form a run, a user is a track, and a user's events in
time order are its frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (run_id, track_id, frame_id)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("frame_id", (F.row_number().over(order) - 1).cast("long")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    coasted = F.col("event_type") == "signup"
    rejected = (F.col("event_type") == "error") & (F.col("k") < 20)
    source = F.when(coasted | rejected, "predicted_dead_reckoning").when((F.col("event_type") == "view") & (F.col("k") < 5), "none").otherwise("measured_smoothed")
    track = F.col("user_id") + 1
    e = e.withColumn("position_source", source)
    placed = F.col("position_source") != "none"
    k, cut = F.col("k"), 70 + track % 3  # tracks change their frame of reference up to two frames apart
    after = F.col("frame_id") >= cut
    unknown = k % 19 == 0
    return e.select(
        F.floor(F.col("user_id") / 22).cast("int").alias("run_id"),
        track.cast("long").alias("track_id"),
        "frame_id",
        "k",
        (F.col("frame_id").cast("double") / 10).alias("timestamp_s"),
        F.when(placed, F.lit(30.0) + F.lit(0.3) * F.col("frame_id") + (F.col("k") - 50).cast("double") / 100).alias("x_yd"),
        F.when(placed, (F.col("user_id") * 7 % 54).cast("double") + (F.col("k") - 50).cast("double") / 20).alias("y_yd"),
        F.when(F.col("frame_id").between(20, 59), F.col("value") / 10).otherwise(F.col("value") / 400).alias("speed_yd_s"),
        F.when(coasted, "coasted").otherwise("observed").alias("track_state"),
        rejected.alias("is_outlier_rejected"),
        "position_source",
        (~coasted & ~rejected & (k % 23 != 0)).alias("is_measurement_used"),
        F.when(unknown, "unknown").when(F.col("frame_id") % 7 == 0, "propagated").otherwise("calibrated").alias("geometry_state"),
        F.when(unknown, "uncalibrated").when(after, "relative_10yd").otherwise("absolute").alias("x_coord_mode"),
        F.when(k != 41, F.when(after, "cal:1").otherwise("cal:0")).alias("coordinate_frame_id"),
        (after.cast("int") + (track % 2).cast("int")).alias("coordinate_segment"),
        F.when(k % 10 != 3, (1 + k % 3).cast("double") / 100).alias("cov_xx"),
        F.when(k % 10 != 3, F.when(k == 77, 1.0).otherwise(0.001)).alias("cov_xy"),
        F.when(k % 10 != 3, (1 + k % 4).cast("double") / 100).alias("cov_yy"),
        F.when(track % 11 == 0, "UNKNOWN").when(track % 2 == 0, "TEAM_A").otherwise("TEAM_B").alias("team"),
    )


def plays(sampled: DataFrame) -> DataFrame:
    """Play windows of each run; an open play has no end. Variants exercise the refusals."""
    runs = sampled.select("run_id").distinct()
    start = F.when(F.col("run_id") % 3 == 1, 5).when(F.col("run_id") % 3 == 2, 30).otherwise(0)
    p1 = runs.select("run_id", F.lit("p1").alias("play_id"), start.cast("long").alias("start_frame"), F.lit(66).cast("long").alias("end_frame"))
    p2 = runs.select("run_id", F.lit("p2").alias("play_id"), F.lit(70).cast("long").alias("start_frame"), F.lit(80).cast("long").alias("end_frame"))
    p3 = runs.select("run_id", F.lit("p3").alias("play_id"), F.lit(0).cast("long").alias("start_frame"), F.lit(None).cast("long").alias("end_frame"))
    return p1.unionByName(p2).unionByName(p3)


def labels(sampled: DataFrame) -> DataFrame:
    """Manual labels of each run that don't overlap: one closed play, with a snap in some runs, and an open one."""
    runs = sampled.select("run_id").distinct()
    none = F.lit(None).cast("long")
    start = F.when(F.col("run_id") % 3 == 1, 5).when(F.col("run_id") % 3 == 2, 30).otherwise(0).cast("long")
    p1 = runs.select("run_id", F.lit("p1").alias("play_id"), start.alias("start_frame"), F.when(F.col("run_id") % 4 == 1, 40).cast("long").alias("snap_frame"), F.lit(60).cast("long").alias("end_frame"))
    p2 = runs.select("run_id", F.lit("p2").alias("play_id"), F.lit(61).cast("long").alias("start_frame"), F.when(F.col("run_id") % 2 == 0, 62).cast("long").alias("snap_frame"), none.alias("end_frame"))
    return p1.unionByName(p2)


#: The same tables in DuckDB's dialect, as heads of WITH clauses.
SAMPLES_SQL = """numbered_events AS (
    SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame_id,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
), sourced AS (
    SELECT *, CASE WHEN event_type = 'signup' OR (event_type = 'error' AND k < 20) THEN 'predicted_dead_reckoning'
                   WHEN event_type = 'view' AND k < 5 THEN 'none' ELSE 'measured_smoothed' END AS position_source FROM numbered_events
), samples AS (
    SELECT CAST(floor(user_id / 22.0::DOUBLE) AS INT) AS run_id, (user_id + 1)::BIGINT AS track_id, frame_id, k,
           frame_id::DOUBLE / 10 AS timestamp_s,
           CASE WHEN position_source <> 'none' THEN 30.0::DOUBLE + 0.3::DOUBLE * frame_id + (k - 50)::DOUBLE / 100 END AS x_yd,
           CASE WHEN position_source <> 'none' THEN (user_id * 7 % 54)::DOUBLE + (k - 50)::DOUBLE / 20 END AS y_yd,
           CASE WHEN frame_id BETWEEN 20 AND 59 THEN value / 10 ELSE value / 400 END AS speed_yd_s,
           CASE WHEN event_type = 'signup' THEN 'coasted' ELSE 'observed' END AS track_state,
           event_type = 'error' AND k < 20 AS is_outlier_rejected, position_source,
           NOT (event_type = 'signup' OR (event_type = 'error' AND k < 20) OR k % 23 = 0) AS is_measurement_used,
           CASE WHEN k % 19 = 0 THEN 'unknown' WHEN frame_id % 7 = 0 THEN 'propagated' ELSE 'calibrated' END AS geometry_state,
           CASE WHEN k % 19 = 0 THEN 'uncalibrated' WHEN frame_id >= 70 + (user_id + 1) % 3 THEN 'relative_10yd' ELSE 'absolute' END AS x_coord_mode,
           CASE WHEN k <> 41 THEN CASE WHEN frame_id >= 70 + (user_id + 1) % 3 THEN 'cal:1' ELSE 'cal:0' END END AS coordinate_frame_id,
           ((frame_id >= 70 + (user_id + 1) % 3)::INT + (user_id + 1) % 2)::INT AS coordinate_segment,
           CASE WHEN k % 10 <> 3 THEN (1 + k % 3)::DOUBLE / 100 END AS cov_xx, CASE WHEN k % 10 <> 3 THEN CASE WHEN k = 77 THEN 1.0::DOUBLE ELSE 0.001::DOUBLE END END AS cov_xy,
           CASE WHEN k % 10 <> 3 THEN (1 + k % 4)::DOUBLE / 100 END AS cov_yy,
           CASE WHEN (user_id + 1) % 11 = 0 THEN 'UNKNOWN' WHEN (user_id + 1) % 2 = 0 THEN 'TEAM_A' ELSE 'TEAM_B' END AS team
    FROM sourced
)"""
PLAYS_SQL = """plays AS (
    SELECT DISTINCT run_id, 'p1' AS play_id, (CASE run_id % 3 WHEN 1 THEN 5 WHEN 2 THEN 30 ELSE 0 END)::BIGINT AS start_frame, 66::BIGINT AS end_frame FROM samples
    UNION ALL SELECT DISTINCT run_id, 'p2', 70, 80 FROM samples
    UNION ALL SELECT DISTINCT run_id, 'p3', 0, NULL FROM samples
)"""
LABELS_SQL = """labels AS (
    SELECT DISTINCT run_id, 'p1' AS play_id, (CASE run_id % 3 WHEN 1 THEN 5 WHEN 2 THEN 30 ELSE 0 END)::BIGINT AS start_frame, CASE WHEN run_id % 4 = 1 THEN 40::BIGINT END AS snap_frame, 60::BIGINT AS end_frame FROM samples
    UNION ALL SELECT DISTINCT run_id, 'p2', 61, CASE WHEN run_id % 2 = 0 THEN 62 END, NULL FROM samples
)"""


def calibrations(sampled: DataFrame) -> DataFrame:
    """One calibration per run and frame, with every way to refuse; some frames have none."""
    f = sampled.select("run_id", "frame_id").distinct()
    m = ((F.col("run_id") * 31 + F.col("frame_id") * 7) % 97).cast("int")
    f = f.withColumn("m", m).where("m % 41 <> 40")
    m = F.col("m")
    d = m.cast("double")
    h = [0.05 + d / 10007, (m % 3).cast("double") / 503, F.lit(5.017), (m % 2).cast("double") / 1009, F.lit(-0.0613), F.lit(40.0071), F.lit(0.0), (m % 7).cast("double") / 100000, F.lit(1.0)]
    twice = m % 23 == 0  # the third row repeats the first
    h = [F.when(twice, h[i % 3] * 2).otherwise(c) if i >= 6 else c for i, c in enumerate(h)]
    return f.select(
        "run_id",
        "frame_id",
        (m % 11 != 0).alias("success"),
        *(c.alias(f"h{i}") for i, c in enumerate(h)),
        (m % 17 != 0).alias("is_plausible"),
        F.when(m % 13 == 0, "uncalibrated").when(m % 13 == 1, "relative_5yd").when(m % 13 == 2, "relative_10yd").otherwise("absolute").alias("x_coord_mode"),
        F.when(m % 29 != 0, 0.30 + (m % 71).cast("double") / 100).alias("confidence"),
        F.when((m % 11 == 0) & (m % 2 == 0), "insufficient_yard_lines").alias("failure_reason"),
        (m % 5 == 0).alias("is_propagated"),
        (m % 4).cast("int").alias("propagation_age"),
        (m % 6 + 1).cast("int").alias("n_yard_lines"),
        F.when(m % 19 != 0, (m % 9).cast("double") / 2).alias("ridge_px"),
        (m % 25).cast("int").alias("n_hash"),
        F.when(m % 31 != 0, (m % 10).cast("double") / 2).alias("hash_rmse_px"),
        F.when(m % 37 != 0, (m % 14).cast("double") / 100).alias("even_score"),
        ((m % 9).cast("double") / 100).alias("odd_score"),
        (m % 3 == 0).alias("start_verified"),
    )


def boxes(sampled: DataFrame) -> DataFrame:
    """One box per sample in a crowded picture of 900 by 506 pixels, with the flags of a detector."""
    k, t = F.col("k"), F.col("track_id")
    x1, y1 = (t % 22 * 14 + k % 7 * 3).cast("double"), (t % 2 * 60 + k % 10 * 12 + F.when(k % 16 == 0, 330).otherwise(0)).cast("double")
    flag = lambda n: F.when(k % n == 0, True)
    return sampled.select(
        "run_id", "frame_id", t.alias("box_id"), x1.alias("x1"), y1.alias("y1"), (x1 + 15 + k % 25).alias("x2"), (y1 + 30 + k % 41).alias("y2"), (F.lit(0.2) + (k % 80).cast("double") / 100).alias("confidence"),
        flag(5).alias("sideline_occluded"), flag(37).alias("lower_body_occluded"), flag(31).alias("player_crossing"), "k",
    )


CALIBRATIONS_SQL = """cals AS (
    SELECT run_id, frame_id, m, m % 11 <> 0 AS success, 0.05::DOUBLE + m::DOUBLE / 10007 AS h0, (m % 3)::DOUBLE / 503 AS h1, 5.017::DOUBLE AS h2, (m % 2)::DOUBLE / 1009 AS h3, -0.0613::DOUBLE AS h4, 40.0071::DOUBLE AS h5,
           CASE WHEN m % 23 = 0 THEN (0.05::DOUBLE + m::DOUBLE / 10007) * 2 ELSE 0.0::DOUBLE END AS h6, CASE WHEN m % 23 = 0 THEN (m % 3)::DOUBLE / 503 * 2 ELSE (m % 7)::DOUBLE / 100000 END AS h7,
           CASE WHEN m % 23 = 0 THEN 10.034::DOUBLE ELSE 1.0::DOUBLE END AS h8, m % 17 <> 0 AS is_plausible,
           CASE m % 13 WHEN 0 THEN 'uncalibrated' WHEN 1 THEN 'relative_5yd' WHEN 2 THEN 'relative_10yd' ELSE 'absolute' END AS x_coord_mode, CASE WHEN m % 29 <> 0 THEN 0.30::DOUBLE + (m % 71)::DOUBLE / 100 END AS confidence,
           CASE WHEN m % 11 = 0 AND m % 2 = 0 THEN 'insufficient_yard_lines' END AS failure_reason, m % 5 = 0 AS is_propagated, (m % 4)::INT AS propagation_age, (m % 6 + 1)::INT AS n_yard_lines,
           CASE WHEN m % 19 <> 0 THEN (m % 9)::DOUBLE / 2 END AS ridge_px, (m % 25)::INT AS n_hash, CASE WHEN m % 31 <> 0 THEN (m % 10)::DOUBLE / 2 END AS hash_rmse_px,
           CASE WHEN m % 37 <> 0 THEN (m % 14)::DOUBLE / 100 END AS even_score, (m % 9)::DOUBLE / 100 AS odd_score, m % 3 = 0 AS start_verified
    FROM (SELECT DISTINCT run_id, frame_id, (run_id * 31 + frame_id * 7) % 97 AS m FROM samples) WHERE m % 41 <> 40
), gated AS (
    SELECT *, coalesce(success AND is_plausible AND x_coord_mode <> 'uncalibrated' AND confidence BETWEEN 0.45 AND 1.0 AND m % 23 <> 0, false) AS ok FROM cals
)"""
BOXES_SQL = """boxes AS (
    SELECT *, x1 + 15 + k % 25 AS x2, y1 + 30 + k % 41 AS y2 FROM (
        SELECT run_id, frame_id, track_id AS box_id, (track_id % 22 * 14 + k % 7 * 3)::DOUBLE AS x1, (track_id % 2 * 60 + k % 10 * 12 + CASE WHEN k % 16 = 0 THEN 330 ELSE 0 END)::DOUBLE AS y1, 0.2::DOUBLE + (k % 80)::DOUBLE / 100 AS confidence,
               k % 5 = 0 AS sideline_occluded, k % 37 = 0 AS lower_body_occluded, k % 31 = 0 AS player_crossing, k FROM samples)
)"""


def scored_boxes(sampled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth and predictions for scoring: players in groups of three whose boxes compete for each other's predictions."""
    k, t, f = F.col("k"), F.col("track_id"), F.col("frame_id")
    place, group = t % 22 % 3, F.floor(t % 22 / 3)
    x1 = (group * 100 + place * 8 + k % 7).cast("double") + t.cast("double") * 0.0131
    y1 = (k % 5 * 2).cast("double")
    size = {"x2": F.col("x1") + 30 + k % 5, "y2": F.col("y1") + 50 + k % 11}
    base = sampled.withColumns({"x1": x1, "y1": y1}).withColumns(size).withColumn("cid", F.when(f < 70, "cal:0").otherwise("cal:1"))
    columns = ["run_id", "frame_id", "box_id", "x1", "y1", "x2", "y2", "x_yd", "y_yd", "x_coord_mode", "coordinate_frame_id", "observed", "is_sideline_player"]
    truth = base.where(f % 10 != 3).withColumns(
        {"box_id": t, "x_yd": F.when(k % 5 != 0, F.col("x_yd")), "x_coord_mode": F.lit("absolute"), "coordinate_frame_id": F.col("cid"), "observed": F.lit(True), "is_sideline_player": k % 16 == 0}
    )
    swap = F.when(f % 40 >= 20, F.when(place == 0, 1).when(place == 1, -1).otherwise(0)).otherwise(0)
    shifted = {"x1": F.col("x1") + k % 4 + 0.37, "x2": F.col("x2") + k % 4 + 0.37, "y1": F.col("y1") + k % 3 + 0.11, "y2": F.col("y2") + k % 3 + 0.11}
    made = base.where((f % 10 != 7) & (k % 9 != 0)).withColumns(shifted).withColumns(
        {"box_id": t + swap, "x_yd": F.col("x_yd") + (k % 10).cast("double") / 20, "x_coord_mode": F.lit("absolute"), "coordinate_frame_id": F.when(k % 14 == 0, "other").otherwise(F.col("cid")), "observed": k % 11 != 0, "is_sideline_player": F.lit(False)}
    )
    extra = made.where("k % 8 = 0").withColumns({"box_id": F.col("box_id") + 500000, "x1": F.col("x1") + 11, "x2": F.col("x2") + 11})
    return truth.select(*columns), made.unionByName(extra).select(*columns)


def benchmark(sampled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Samples that claim players, the truth, corrupted samples and sequences, for the scoring of trajectories."""
    k, t, f = F.col("k"), F.col("track_id"), F.col("frame_id")
    swap = F.when((f % 40 >= 20) & (t % 6 == 0), 1).when((f % 40 >= 20) & (t % 6 == 1), -1).otherwise(0)
    late = F.when((t % 5 == 0) & (f >= 45), 1000000).otherwise(0)
    bad = (k % 12 == 0) & (k != 50)
    accepted = (F.col("position_source") == "measured_smoothed") & F.col("is_measurement_used") & ~F.col("is_outlier_rejected") & (F.col("track_state") == "observed")
    status = F.element_at(F.array(*map(F.lit, ("calibration_refused:x", "footpoint_unreliable:y", "projection_refused:z", "unprojected"))), (k % 4 + 1).cast("int"))
    samples_ = sampled.select(
        "run_id", (t + swap + late).alias("track_id"), "frame_id", F.when(k != 50, t).alias("gt_id"), "k", "track_state", "position_source", "is_measurement_used", "is_outlier_rejected", "geometry_state",
        F.when(F.col("is_outlier_rejected"), F.when(k % 2 == 0, "jump_flagged_image_space_speed_gate").otherwise("jump_rejected_field_mahalanobis_gate")).alias("rejection_reason"),
        F.when(accepted, F.col("x_yd")).alias("x_yd"), F.when(accepted, F.col("y_yd")).alias("y_yd"), (F.col("x_yd") + (k % 7).cast("double") / 10 + F.when(bad, 8.0).otherwise(0.0)).alias("raw_x"), F.col("y_yd").alias("raw_y"),
        F.when(F.col("position_source") == "predicted_dead_reckoning", F.col("x_yd") + 0.5).alias("predicted_x"), F.when(F.col("position_source") == "predicted_dead_reckoning", F.col("y_yd") + 0.5).alias("predicted_y"),
        (F.col("speed_yd_s") * 0.6).alias("vx"), (F.col("speed_yd_s") * F.when(k % 2 == 0, 0.8).otherwise(-0.8)).alias("vy"), F.when(k % 9 != 0, k.cast("double") / 10).alias("gate_statistic"), (k % 15 == 0).alias("image_jump_flagged"),
        (k % 6).cast("int").alias("frames_since_measurement"), status.alias("projection_status"), (k % 21 == 0).alias("reinit_after_gap"), "cov_xx", "cov_xy", "cov_yy", (F.col("geometry_state") == "propagated").alias("is_inflated"),
    )
    truth = sampled.select("run_id", "frame_id", t.alias("gt_id"), (F.lit(30.0) + F.lit(0.3) * f).alias("gx"), ((t - 1) * 7 % 54).cast("double").alias("gy"), (F.col("speed_yd_s") * 0.6).alias("gvx"), (F.col("speed_yd_s") * 0.8).alias("gvy"))
    events_ = sampled.where(bad).select("run_id", t.alias("gt_id"), "frame_id")
    split = F.element_at(F.array(*map(F.lit, ("dev", "validation", "test"))), (F.col("run_id") % 3 + 1).cast("int"))
    sequences = sampled.groupBy("run_id").agg((F.max("frame_id") + 1).alias("n_frames"), F.countDistinct("track_id").alias("n_players")).withColumn("split", split)
    return samples_, truth, events_, sequences


SCORED_SQL = """placed AS (
    SELECT *, track_id % 22 % 3 AS place, track_id % 22 // 3 AS grp, (track_id % 22 // 3 * 100 + track_id % 22 % 3 * 8 + k % 7)::DOUBLE + track_id::DOUBLE * 0.0131::DOUBLE AS x1, (k % 5 * 2)::DOUBLE AS y1,
           CASE WHEN frame_id < 70 THEN 'cal:0' ELSE 'cal:1' END AS cid FROM samples
), truth AS (
    SELECT run_id, frame_id, track_id AS box_id, grp, x1, y1, x1 + 30 + k % 5 AS x2, y1 + 50 + k % 11 AS y2, CASE WHEN k % 5 <> 0 THEN x_yd END AS x_yd, y_yd, cid, k % 16 = 0 AS side FROM placed WHERE frame_id % 10 <> 3
), made AS (
    SELECT run_id, frame_id, track_id + CASE WHEN frame_id % 40 >= 20 THEN CASE place WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END ELSE 0 END AS box_id, x1 + k % 4 + 0.37::DOUBLE AS x1, y1 + k % 3 + 0.11::DOUBLE AS y1,
           x1 + 30 + k % 5 + k % 4 + 0.37::DOUBLE AS x2, y1 + 50 + k % 11 + k % 3 + 0.11::DOUBLE AS y2, x_yd + (k % 10)::DOUBLE / 20 AS x_yd, y_yd, CASE WHEN k % 14 = 0 THEN 'other' ELSE cid END AS cid, k % 11 <> 0 AS observed, k
    FROM placed WHERE frame_id % 10 <> 7 AND k % 9 <> 0
), predicted AS (
    SELECT * FROM made UNION ALL SELECT run_id, frame_id, box_id + 500000, x1 + 11, y1, x2 + 11, y2, x_yd, y_yd, cid, observed, k FROM made WHERE k % 8 = 0
)"""
BENCHMARK_SQL = """bench AS (
    SELECT run_id, track_id + CASE WHEN frame_id % 40 >= 20 AND track_id % 6 = 0 THEN 1 WHEN frame_id % 40 >= 20 AND track_id % 6 = 1 THEN -1 ELSE 0 END + CASE WHEN track_id % 5 = 0 AND frame_id >= 45 THEN 1000000 ELSE 0 END AS track_id,
           frame_id, CASE WHEN k <> 50 THEN track_id END AS gt_id, k, track_state, position_source, is_measurement_used, is_outlier_rejected, geometry_state, is_outlier_rejected AND k % 2 = 0 AS by_image,
           CASE WHEN acc THEN x_yd END AS x_yd, CASE WHEN acc THEN y_yd END AS y_yd, x_yd + (k % 7)::DOUBLE / 10 + CASE WHEN k % 12 = 0 AND k <> 50 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS raw_x, y_yd AS raw_y,
           CASE WHEN position_source = 'predicted_dead_reckoning' THEN x_yd + 0.5::DOUBLE END AS predicted_x, CASE WHEN position_source = 'predicted_dead_reckoning' THEN y_yd + 0.5::DOUBLE END AS predicted_y,
           speed_yd_s * 0.6::DOUBLE AS vx, speed_yd_s * CASE WHEN k % 2 = 0 THEN 0.8::DOUBLE ELSE -0.8::DOUBLE END AS vy, CASE WHEN k % 9 <> 0 THEN k::DOUBLE / 10 END AS gate, k % 15 = 0 AS image_flag, k % 6 AS fsm, k % 4 AS st,
           k % 21 = 0 AS gap, cov_xx, cov_xy, cov_yy, geometry_state = 'propagated' AS inflated
    FROM (SELECT *, position_source = 'measured_smoothed' AND is_measurement_used AND NOT is_outlier_rejected AND track_state = 'observed' AS acc FROM samples)
), gt AS (
    SELECT run_id, frame_id, track_id AS gt_id, 30.0::DOUBLE + 0.3::DOUBLE * frame_id AS gx, ((track_id - 1) * 7 % 54)::DOUBLE AS gy, speed_yd_s * 0.6::DOUBLE AS gvx, speed_yd_s * 0.8::DOUBLE AS gvy FROM samples
), bad AS (SELECT DISTINCT run_id, track_id AS gt_id, frame_id FROM samples WHERE k % 12 = 0 AND k <> 50
), seqs AS (SELECT run_id, max(frame_id) + 1 AS n_frames, count(DISTINCT track_id) AS n_players, ['dev', 'validation', 'test'][run_id % 3 + 1] AS split FROM samples GROUP BY run_id
), runs_of AS (
    SELECT run_id, gt_id, track_id, max(n) AS longest FROM (SELECT run_id, gt_id, track_id, g, count(*) AS n FROM (SELECT run_id, gt_id, track_id, frame_id - row_number() OVER (PARTITION BY run_id, gt_id, track_id ORDER BY frame_id) AS g
        FROM bench WHERE gt_id IS NOT NULL AND track_state = 'observed') GROUP BY ALL) GROUP BY ALL
), groups AS (
    SELECT b.run_id, b.gt_id, b.track_id, count(*) AS n, count(x_yd) AS pos, count(*) FILTER (track_state = 'observed') AS obs, count(*) FILTER (position_source = 'predicted_dead_reckoning') AS dead, min(frame_id) AS first_frame, max(frame_id) AS last_frame,
           coalesce(any_value(longest), 0) AS longest
    FROM bench b LEFT JOIN runs_of r ON r.run_id = b.run_id AND r.gt_id = b.gt_id AND r.track_id = b.track_id WHERE b.gt_id IS NOT NULL GROUP BY ALL
), main AS (SELECT run_id, gt_id, track_id FROM groups QUALIFY row_number() OVER (PARTITION BY run_id, gt_id ORDER BY n DESC, track_id) = 1
), roles AS (
    SELECT b.*, m.track_id IS NOT NULL AS main, x.gt_id IS NOT NULL AS is_bad, gx, gy, gvx, gvy, sqrt(pow(b.x_yd - gx, 2) + pow(b.y_yd - gy, 2)) AS error
    FROM bench b LEFT JOIN main m ON m.run_id = b.run_id AND m.gt_id = b.gt_id AND m.track_id = b.track_id LEFT JOIN bad x ON x.run_id = b.run_id AND x.gt_id = b.gt_id AND x.frame_id = b.frame_id
    LEFT JOIN gt ON gt.run_id = b.run_id AND gt.gt_id = b.gt_id AND gt.frame_id = b.frame_id
)"""
