"""Registered queries of scoring, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake import domain
from playlake.domain import BENCHMARK_SQL, BOXES_SQL, CALIBRATIONS_SQL, LABELS_SQL, SAMPLES_SQL, SCORED_SQL
from playlake.operators import benchmarks, detections, predicates, projection, scoring, segments

Query = Callable[[SparkSession, str], DataFrame]


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return domain.scored_boxes(domain.samples(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted = _scored(spark, sf_dir)
    return scoring.iou_pairs(truth, scoring.detections_only(predicted), 0.5)


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def best_track_per_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.best_prediction(_pairs(spark, sf_dir))


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth, predicted = _scored(spark, sf_dir)
    return truth, predicted, scoring.match_boxes(spark, truth, predicted)


def assignment_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)[2]


def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.greedy_matches(_pairs(spark, sf_dir))


def id_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, _, matches = _matches(spark, sf_dir)
    return scoring.identity_switches(truth, matches)


def dominant_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.dominant_tracks(_matches(spark, sf_dir)[2])


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted, matches = _matches(spark, sf_dir)
    return scoring.detection_rates(truth.select("run_id", "frame_id").distinct(), truth, predicted, matches)


def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rates(spark, sf_dir)


def detection_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.detection_rates_or_zero(_rates(spark, sf_dir))


def frame_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.frame_differences(*_scored(spark, sf_dir))


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, predicted, matches = _matches(spark, sf_dir)
    return scoring.field_scores(truth, scoring.field_errors(truth, predicted, matches))


def _helmets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    truth, predicted = _scored(spark, sf_dir)
    helmets = truth.withColumn("y2", F.col("y1") + 10)
    return helmets, predicted, scoring.helmet_matches(spark, helmets, predicted)


def helmet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _helmets(spark, sf_dir)[2].groupBy("run_id", "frame_id").agg(F.count("*").alias("n_matched"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    helmets, predicted, matches = _helmets(spark, sf_dir)
    frames = domain.samples(spark, sf_dir).select("run_id", "frame_id").distinct()
    labeled = helmets.where("run_id % 2 = 0").select("run_id", "frame_id").distinct()
    return scoring.batch_summary(frames, predicted, labeled, helmets, matches)


def field_error_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir)
    error = F.when(predicates.is_usable(), F.abs(F.col("y_yd") - (F.col("track_id") - 1) * 7 % 54))
    return scoring.error_percentiles(s.select("run_id", error.alias("error")), 1.0)


def _bench(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return domain.benchmark(domain.samples(spark, sf_dir))


def bench_track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.track_stats(_bench(spark, sf_dir)[0].where("gt_id is not null"), benchmarks.GROUP).drop("n_measurements_used", "n_outlier_rejected")


def bench_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.dominant_tracks(_bench(spark, sf_dir)[0])


def rule_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.rule_agreement(_bench(spark, sf_dir)[0])


def track_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.track_labels(_bench(spark, sf_dir)[0])


def bench_id_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.identity_switches(_bench(spark, sf_dir)[0])


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, events, _ = _bench(spark, sf_dir)
    return benchmarks.fragments(s, events)


def fragment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, events, _ = _bench(spark, sf_dir)
    return benchmarks.fragment_counts(s, benchmarks.fragments(s, events))


def rejection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, events, _ = _bench(spark, sf_dir)
    return benchmarks.rejection_accounting(s, events)


def uncertainty_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.uncertainty_coverage(*_bench(spark, sf_dir)[:3])


def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.sample_scores(*_bench(spark, sf_dir)[:3])


def motion_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.motion_lengths(*_bench(spark, sf_dir)[:2])


def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, events, _ = _bench(spark, sf_dir)
    return benchmarks.event_outcomes(s, events)


def split_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, truth, events, sequences = _bench(spark, sf_dir)
    return benchmarks.split_rollup(benchmarks.sample_scores(s, truth, events), sequences)


def _segment_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manual labels against a truth some frames off, without any estimate."""
    s = domain.samples(spark, sf_dir)
    found = segments.segment_plays(s, domain.labels(s).where("play_id = 'p1'"), automatic_snap=False)
    r = F.col("run_id")
    expected = found.select(
        "run_id", "play_id", F.when(r % 3 != 1, 38 + r % 5).alias("gt_snap"), (F.lit(58) + r % 4).alias("gt_end"), F.when(r % 5 == 0, "automatic_estimation_disabled").alias("expected_reason"),
        F.when(r % 2 == 1, 1).alias("snap_bound"), F.lit(1).alias("end_bound"),
    )
    return benchmarks.segmentation_scores(found, expected), s.select("run_id", F.when(r % 2 == 0, "dev").otherwise("test").alias("split")).distinct()


def segmentation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segment_scores(spark, sf_dir)[0]


def segmentation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.segmentation_rollup(*_segment_scores(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = domain.calibrations(domain.samples(spark, sf_dir))
    tags = F.array_compact(F.array(F.when(F.col("n_hash") > 12, "marked"), F.when(F.col("is_propagated"), "moving"), F.lit("any")))
    return c.select("success", "failure_reason", "confidence", F.col("is_plausible").alias("expected"), F.col("ridge_px").alias("error_yd"), tags.alias("conditions"))


def calibration_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    return benchmarks.calibration_summary(r.withColumn("condition", F.explode("conditions")), F.col("condition"))


def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.failure_histogram(_records(spark, sf_dir))


def landmark_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks on fitted frames, whose true row is off by some pixels; the inverse is that of an affine view."""
    c = domain.calibrations(domain.samples(spark, sf_dir)).where(projection.can_project()).withColumn("h7", F.lit(0.0))
    det = F.col("h0") * F.col("h4") - F.col("h1") * F.col("h3")
    back = [F.col("h4") / det, -F.col("h1") / det, (F.col("h1") * F.col("h5") - F.col("h2") * F.col("h4")) / det, -F.col("h3") / det, F.col("h0") / det, (F.col("h2") * F.col("h3") - F.col("h0") * F.col("h5")) / det, F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    c = c.withColumns({f"i{i}": b for i, b in enumerate(back)})
    marks = c.withColumn("n", F.explode(F.array(*(F.lit(i) for i in range(3)))))
    marks = marks.withColumns({"x": F.lit(20.0) + F.col("n") * 5, "y": F.lit(15.0) + F.col("n") * 3})
    return benchmarks.landmark_errors(marks.withColumn("true_v", F.col("i3") * F.col("x") + F.col("i4") * F.col("y") + F.col("i5") + F.col("n") + 0.25))


def smoothed_image_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    feet = detections.footpoints(domain.boxes(domain.samples(spark, sf_dir)), 900, 506)
    smooth = benchmarks.smoothed_image_error(feet.select("run_id", F.col("box_id").alias("track_id"), "frame_id", "u", "v"))
    return smooth.withColumns({"u": F.round("u", 6), "v": F.round("v", 6)})


def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, _, events, _ = _bench(spark, sf_dir)
    return benchmarks.same_rows(benchmarks.event_outcomes(s, events), benchmarks.event_outcomes(s.repartition(7), events))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        iou_pairs, best_track_per_gt, assignment_per_frame, greedy_matches, id_switches, dominant_track, detection_rates, detection_f1, frame_differences, field_scores, helmet_counts, batch_summary,
        field_error_percentiles, bench_track_stats, bench_dominant, rule_agreement, track_labels, bench_id_switches, fragments, fragment_counts, rejection_rates, uncertainty_coverage, sample_scores, motion_lengths,
        event_outcomes, split_rollup, segmentation_scores, segmentation_rollup, calibration_by_condition, failure_histogram, landmark_errors, smoothed_image_track, determinism,
    )
}

_S = f"WITH RECURSIVE {SAMPLES_SQL}"
_ACCEPTED = "position_source = 'measured_smoothed' AND is_measurement_used AND NOT is_outlier_rejected AND track_state = 'observed' AND x_yd IS NOT NULL AND geometry_state <> 'unknown' AND x_coord_mode <> 'uncalibrated' AND coordinate_frame_id IS NOT NULL"
_I = "greatest(0, least(t.x2, p.x2) - greatest(t.x1, p.x1)) * greatest(0, least(t.y2, p.y2) - greatest(t.y1, p.y1))"
_IOU = f"round({_I} / ((t.x2 - t.x1) * (t.y2 - t.y1) + (p.x2 - p.x1) * (p.y2 - p.y1) - {_I}), 6)"
_P = f"""{_S}, {SCORED_SQL}, pairs AS (SELECT t.run_id, t.frame_id, grp, t.box_id AS gt_id, p.box_id AS pred_id, {_IOU} AS iou FROM truth t JOIN predicted p USING (run_id, frame_id) WHERE p.observed AND {_IOU} >= 0.5)"""


def _best_assignment(pairs: str) -> str:
    """All one-to-one choices within each group of three players, then the one of most pairs and the greatest total."""
    return f"""places AS (SELECT DISTINCT run_id, frame_id, grp, gt_id, dense_rank() OVER (PARTITION BY run_id, frame_id, grp ORDER BY gt_id) AS r FROM {pairs}
), options AS (SELECT run_id, frame_id, grp, r, gt_id, pred_id, iou FROM {pairs} JOIN places USING (run_id, frame_id, grp, gt_id) UNION ALL SELECT run_id, frame_id, grp, r, NULL, NULL, 0 FROM places
), choices AS (
    SELECT DISTINCT run_id, frame_id, grp, 0::BIGINT AS r, []::STRUCT(gt_id BIGINT, pred_id BIGINT, iou DOUBLE)[] AS taken, 0::DOUBLE AS total FROM places
    UNION ALL SELECT c.run_id, c.frame_id, c.grp, o.r, CASE WHEN o.pred_id IS NULL THEN c.taken ELSE list_append(c.taken, struct_pack(gt_id := o.gt_id, pred_id := o.pred_id, iou := o.iou::DOUBLE)) END, c.total + o.iou
    FROM choices c JOIN options o ON o.run_id = c.run_id AND o.frame_id = c.frame_id AND o.grp = c.grp AND o.r = c.r + 1 WHERE o.pred_id IS NULL OR len(list_filter(c.taken, lambda x: x.pred_id = o.pred_id)) = 0
), matches AS (
    SELECT run_id, frame_id, unnest(taken, recursive := true) FROM (SELECT * FROM choices QUALIFY row_number() OVER (PARTITION BY run_id, frame_id, grp ORDER BY len(taken) DESC, total DESC) = 1)
)"""


_M = f"{_P}, {_best_assignment('pairs')}"
_H = f"""{_S}, {SCORED_SQL}, held AS (SELECT t.run_id, t.frame_id, grp, t.box_id AS gt_id, p.box_id AS pred_id, 1::DOUBLE AS iou FROM truth t JOIN predicted p USING (run_id, frame_id)
    WHERE NOT side AND (t.x1 + t.x2) / 2 BETWEEN p.x1 AND p.x2 AND t.y1 + 5 BETWEEN p.y1 AND p.y2), {_best_assignment('held')}"""
_RATES = """frames AS (SELECT DISTINCT run_id, frame_id FROM truth), n AS (
    SELECT run_id, (SELECT count(*) FROM truth t WHERE t.run_id = r.run_id) AS g, (SELECT count(*) FROM predicted p SEMI JOIN frames USING (run_id, frame_id) WHERE p.run_id = r.run_id AND observed) AS p,
           (SELECT count(*) FROM matches m WHERE m.run_id = r.run_id) AS tp FROM (SELECT DISTINCT run_id FROM truth) r
)"""
_B = f"{_S}, {BENCHMARK_SQL}"
_LOST = "x_yd IS NULL AND predicted_x IS NULL"
_FRAGMENTS = """starts AS (SELECT run_id, gt_id, first_frame, max(track_id) AS highest FROM groups GROUP BY ALL), episodes AS (
    SELECT g.*, (SELECT arg_max(s.highest, s.first_frame) FROM starts s WHERE s.run_id = g.run_id AND s.gt_id = g.gt_id AND s.first_frame < g.first_frame) AS previous FROM groups g
), frags AS (
    SELECT e.run_id, e.gt_id, e.track_id, e.first_frame, last_frame, n AS n_samples, obs AS n_observed, pos AS n_positioned, dead AS n_dead_reckoned,
           CASE WHEN b.gt_id IS NOT NULL THEN 'outlier_induced_spawn' WHEN previous IS NULL THEN 'legitimate_new_track' WHEN a.track_id IS NOT NULL THEN 'active_association_swap' ELSE 'post_expiration_reinitialization' END AS origin,
           m.track_id IS NULL AS excluded, (SELECT count(*) FROM groups x WHERE x.run_id = e.run_id AND x.track_id = e.track_id) > 1 AS carries_several
    FROM episodes e LEFT JOIN bad b ON b.run_id = e.run_id AND b.gt_id = e.gt_id AND b.frame_id = e.first_frame
    LEFT JOIN (SELECT DISTINCT run_id, frame_id, track_id FROM bench) a ON a.run_id = e.run_id AND a.frame_id = e.first_frame AND a.track_id = e.previous LEFT JOIN main m ON m.run_id = e.run_id AND m.gt_id = e.gt_id AND m.track_id = e.track_id
)"""
_D = "(error IS NOT NULL AND main)"
_RAW = "sqrt(pow(raw_x - gx, 2) + pow(raw_y - gy, 2))"
_SP, _TSP = "sqrt(vx * vx + vy * vy)", "sqrt(gvx * gvx + gvy * gvy)"
_HD, _THD = (f"CASE WHEN abs({a}x) < 1e-9 AND abs({a}y) < 1e-9 THEN 0.0::DOUBLE ELSE atan2({a}y, {a}x) END" for a in ("v", "gv"))
_TURN = f"abs(({_HD}) - ({_THD}) - 2 * pi() * floor((({_HD}) - ({_THD}) + pi()) / (2 * pi()))) * 180 / pi()"
_DEAD = "main AND gx IS NOT NULL AND predicted_x IS NOT NULL AND position_source = 'predicted_dead_reckoning'"
_SCORES = f"""SELECT run_id, count(*) AS n_samples, count(*) FILTER (main AND gx IS NOT NULL) AS dominant, count(*) FILTER (NOT main AND gx IS NOT NULL) AS non_dominant, count(*) FILTER (gx IS NULL) AS unattributed,
    count(*) FILTER {{d}} AS measured, count(*) FILTER (main AND gx IS NOT NULL AND (error IS NOT NULL OR predicted_x IS NOT NULL) AND track_state = 'observed') AS observed_dominant,
    round(median(error) FILTER {{d}}, 4) AS error_median, round(quantile_cont(error, 0.9) FILTER {{d}}, 4) AS error_p90, round(sqrt(avg(error * error) FILTER {{d}}), 4) AS error_rmse,
    round(median({_RAW}) FILTER {{d}}, 4) AS raw_median, round(sqrt(avg(pow({_RAW}, 2)) FILTER {{d}}), 4) AS raw_rmse, round(median(error) FILTER (NOT main AND gx IS NOT NULL), 4) AS other_tracks_median,
    round(median(error) FILTER (main AND NOT gap), 4) AS accepted_median, round(median(error) FILTER (main AND gap), 4) AS post_gap_median, count(*) FILTER ({_DEAD} AND is_outlier_rejected) AS dead_reckoned_after_rejection,
    count(*) FILTER ({_DEAD} AND NOT is_outlier_rejected) AS dead_reckoned_without_measurement, round(median(sqrt(pow(predicted_x - gx, 2) + pow(predicted_y - gy, 2))) FILTER ({_DEAD}), 4) AS dead_reckoning_median,
    round(median(abs({_SP} - {_TSP})) FILTER {{d}}, 4) AS speed_error_median, round(sqrt(avg(pow(vx - gvx, 2) + pow(vy - gvy, 2)) FILTER {{d}}), 4) AS velocity_rmse,
    round(median({_TURN}) FILTER ({{d}} AND {_TSP} > 0.5 AND {_SP} > 0.3), 4) AS heading_error_median, count(*) FILTER (x_yd IS NOT NULL AND geometry_state = 'unknown') AS positions_in_unknown_geometry
    FROM roles GROUP BY run_id""".replace("{d}", _D)
_SEGMENTED = f"""{_S}, {LABELS_SQL}, sc AS (SELECT run_id, play_id, snap_frame, end_frame, CASE WHEN run_id % 3 <> 1 THEN 38 + run_id % 5 END AS gs, 58 + run_id % 4 AS ge, run_id % 5 = 0 AS wanted, run_id % 2 = 1 AS bound FROM labels WHERE play_id = 'p1'
), scores AS (
    SELECT run_id, play_id, abs(snap_frame - gs) AS snap_error, abs(end_frame - ge) AS end_error, CASE WHEN bound THEN coalesce(abs(snap_frame - gs) <= 1, false) END AS snap_within, coalesce(abs(end_frame - ge) <= 1, false) AS end_within,
           snap_frame IS NULL AND gs IS NOT NULL AS false_refusal, snap_frame IS NULL AND gs IS NULL AS true_refusal,
           CASE WHEN wanted THEN (snap_frame IS NOT NULL)::INT ELSE (snap_frame IS NULL)::INT + CASE WHEN bound THEN (NOT coalesce(abs(snap_frame - gs) <= 1, false))::INT ELSE 0 END + (NOT coalesce(abs(end_frame - ge) <= 1, false))::INT END AS violations,
           CASE WHEN snap_frame IS NULL THEN 'unavailable' ELSE 'manual' END AS snap_source, 'manual' AS end_source FROM sc
)"""
_RECORDS = "records AS (SELECT *, is_plausible AS expected, list_filter([CASE WHEN n_hash > 12 THEN 'marked' END, CASE WHEN is_propagated THEN 'moving' END, 'any'], lambda x: x IS NOT NULL) AS tags FROM cals)"
_UNPOSITIONED = ", ".join(
    f"count(*) FILTER ({_LOST} AND {test}) AS unpositioned_{name}"
    for name, test in (("gap_exceeded", "fsm > 3"), ("geometry_refused", "fsm <= 3 AND st = 0"), ("footpoint_refused", "fsm <= 3 AND st = 1"), ("out_of_bounds", "fsm <= 3 AND st = 2"), ("other", "fsm <= 3 AND st = 3"))
)

SQL: dict[str, str] = {
    "iou_pairs": f"{_P} SELECT run_id, frame_id, gt_id, pred_id, iou FROM pairs",
    "best_track_per_gt": f"{_P} SELECT run_id, frame_id, gt_id, pred_id, iou FROM pairs QUALIFY row_number() OVER (PARTITION BY run_id, frame_id, gt_id ORDER BY iou DESC, pred_id) = 1",
    "assignment_per_frame": f"{_M} SELECT run_id, frame_id, gt_id, pred_id, iou FROM matches",
    "greedy_matches": f"""{_P}, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY run_id, frame_id ORDER BY pred_id) AS r FROM pairs), steps AS (
            SELECT DISTINCT run_id, frame_id, 0::BIGINT AS r, []::STRUCT(gt_id BIGINT, pred_id BIGINT, iou DOUBLE)[] AS taken FROM ranked
            UNION ALL SELECT s.run_id, s.frame_id, s.r + 1, coalesce(list_append(s.taken, (SELECT arg_min(struct_pack(gt_id := k.gt_id, pred_id := k.pred_id, iou := k.iou::DOUBLE), struct_pack(a := -k.iou, b := k.gt_id)) FROM ranked k
                WHERE k.run_id = s.run_id AND k.frame_id = s.frame_id AND k.r = s.r + 1 AND len(list_filter(s.taken, lambda x: x.gt_id = k.gt_id)) = 0)), s.taken)
            FROM steps s WHERE s.r < (SELECT max(r) FROM ranked q WHERE q.run_id = s.run_id AND q.frame_id = s.frame_id))
        SELECT run_id, frame_id, m.gt_id AS gt_id, m.pred_id AS pred_id, m.iou AS iou FROM (SELECT run_id, frame_id, unnest(taken) AS m FROM (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY run_id, frame_id ORDER BY r DESC) = 1)) WHERE m IS NOT NULL""",
    "id_switches": f"""{_M}, l AS (SELECT t.run_id, t.box_id AS gt_id, t.frame_id, pred_id, last_value(pred_id IGNORE NULLS) OVER (PARTITION BY t.run_id, t.box_id ORDER BY t.frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
            lag(pred_id) OVER (PARTITION BY t.run_id, t.box_id ORDER BY t.frame_id) AS b FROM truth t LEFT JOIN matches m ON m.run_id = t.run_id AND m.frame_id = t.frame_id AND m.gt_id = t.box_id)
        SELECT run_id, gt_id, count(*) FILTER (pred_id <> e) AS switches, count(*) FILTER (pred_id IS NOT NULL AND e IS NOT NULL AND b IS NULL) AS fragments, count(pred_id) AS n_matched FROM l GROUP BY ALL""",
    "dominant_track": f"{_M}, n AS (SELECT run_id, gt_id, pred_id, count(*) AS n FROM matches GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY run_id, gt_id ORDER BY n DESC, pred_id) = 1",
    "detection_rates": f"""{_M}, {_RATES} SELECT run_id, tp, p - tp AS fp, g - tp AS fn, round(tp::DOUBLE / nullif(p, 0), 6) AS "precision", round(tp::DOUBLE / nullif(g, 0), 6) AS recall FROM n""",
    "detection_f1": f"""{_M}, {_RATES}, f AS (SELECT run_id, tp, p - tp AS fp, g - tp AS fn, tp::DOUBLE / greatest(1, p) AS pr, tp::DOUBLE / greatest(1, g) AS re FROM n)
        SELECT run_id, tp, fp, fn, round(pr, 4) AS "precision", round(re, 4) AS recall, round(2 * pr * re / greatest(1e-9, pr + re), 4) AS f1 FROM f""",
    "frame_differences": f"""{_S}, {SCORED_SQL} SELECT run_id, count(*) FILTER (a) AS annotated_frames, count(*) FILTER (a AND NOT p) AS missing_prediction_frames, count(*) FILTER (p AND NOT a) AS unannotated_prediction_frames FROM (
        SELECT run_id, frame_id, bool_or(x = 1) AS a, bool_or(x = 2) AS p FROM (SELECT run_id, frame_id, 1 AS x FROM truth UNION ALL SELECT run_id, frame_id, 2 FROM predicted) GROUP BY ALL) GROUP BY run_id""",
    "field_scores": f"""{_M}, e AS (SELECT m.run_id, CASE WHEN t.cid = p.cid THEN sqrt(pow(t.x_yd - p.x_yd, 2) + pow(t.y_yd - p.y_yd, 2)) END AS e FROM matches m JOIN truth t ON t.run_id = m.run_id AND t.frame_id = m.frame_id AND t.box_id = m.gt_id
            JOIN predicted p ON p.run_id = m.run_id AND p.frame_id = m.frame_id AND p.box_id = m.pred_id WHERE t.x_yd IS NOT NULL AND p.x_yd IS NOT NULL), s AS (
            SELECT run_id, count(e) AS n_scored, count(*) - count(e) AS n_incompatible, round(median(e), 6) AS median_error, round(quantile_cont(e, 0.95), 6) AS p95_error, count(*) FILTER (e <= 1.0) AS w FROM e GROUP BY 1)
        SELECT run_id, n AS n_truth, coalesce(n_scored, 0) AS n_scored, round(coalesce(n_scored, 0)::DOUBLE / n, 6) AS coverage, coalesce(n_incompatible, 0) AS n_incompatible, median_error, p95_error, round(coalesce(w, 0)::DOUBLE / n, 6) AS within
        FROM (SELECT run_id, count(*) AS n FROM truth WHERE x_yd IS NOT NULL GROUP BY 1) LEFT JOIN s USING (run_id)""",
    "helmet_counts": f"{_H} SELECT run_id, frame_id, count(*) AS n_matched FROM matches GROUP BY ALL",
    "batch_summary": f"""{_H}, labeled AS (SELECT DISTINCT run_id, frame_id FROM truth WHERE run_id % 2 = 0), f AS (SELECT run_id, count(DISTINCT frame_id) AS frames_processed FROM samples GROUP BY 1), c AS (
            SELECT run_id, frames_processed, (SELECT count(DISTINCT box_id) FROM predicted p WHERE p.run_id = f.run_id AND observed) AS observed_tracks, (SELECT count(*) FROM labeled l WHERE l.run_id = f.run_id) AS labeled_frames,
                   (SELECT count(*) FROM truth t SEMI JOIN labeled USING (run_id, frame_id) WHERE t.run_id = f.run_id AND NOT side) AS h, (SELECT count(*) FROM matches m SEMI JOIN labeled USING (run_id, frame_id) WHERE m.run_id = f.run_id) AS m FROM f)
        SELECT run_id, frames_processed, observed_tracks, labeled_frames, frames_processed - labeled_frames AS unlabeled_frames, CASE WHEN labeled_frames > 0 THEN m END AS matched_helmets, CASE WHEN labeled_frames > 0 THEN h END AS labeled_helmets,
               round(m::DOUBLE / nullif(h, 0), 6) AS containment FROM c""",
    "field_error_percentiles": f"""{_S}, r AS (SELECT run_id, CASE WHEN {_ACCEPTED} THEN abs(y_yd - (track_id - 1) * 7 % 54) END AS error FROM samples)
        SELECT run_id, count(*) AS n_truth, count(error) AS n_scored, round(median(error), 6) AS median_error, round(quantile_cont(error, 0.95), 6) AS p95_error,
               round(sqrt(avg(error * error)), 6) AS rmse, round(count(*) FILTER (error <= 1.0)::DOUBLE / count(*), 6) AS within FROM r GROUP BY run_id""",
    "bench_track_stats": f"{_B} SELECT run_id, gt_id, track_id, n AS n_samples, obs AS n_observed, pos AS n_positioned, dead AS n_dead_reckoned, first_frame, last_frame, longest AS longest_observed_run FROM groups",
    "bench_dominant": f"{_B} SELECT * FROM main",
    "rule_agreement": f"""{_B}, p AS (SELECT run_id, gt_id, track_id FROM groups QUALIFY row_number() OVER (PARTITION BY run_id, gt_id ORDER BY pos DESC, track_id) = 1), o AS (SELECT run_id, gt_id, track_id FROM groups QUALIFY row_number() OVER (PARTITION BY run_id, gt_id ORDER BY longest DESC, track_id) = 1)
        SELECT m.run_id, count(*) AS players, count(*) FILTER (p.track_id = m.track_id) AS agreeing_positioned, count(*) FILTER (o.track_id = m.track_id) AS agreeing_observed_run FROM main m JOIN p USING (run_id, gt_id) JOIN o USING (run_id, gt_id) GROUP BY ALL""",
    "track_labels": f"{_B} SELECT run_id, track_id, gt_id, n FROM groups",
    "bench_id_switches": f"""{_B}, o AS (SELECT run_id, gt_id, frame_id, track_id, lag(track_id) OVER w AS old, frame_id - lag(frame_id) OVER w AS g FROM bench WHERE gt_id IS NOT NULL AND track_state = 'observed' WINDOW w AS (PARTITION BY run_id, gt_id ORDER BY frame_id)),
        a AS (SELECT o.*, b.track_id IS NOT NULL AS alive FROM o LEFT JOIN (SELECT DISTINCT run_id, frame_id, track_id FROM bench) b ON b.run_id = o.run_id AND b.frame_id = o.frame_id AND b.track_id = o.old)
        SELECT run_id, count(*) FILTER (old <> track_id) AS id_switches, count(*) FILTER (old <> track_id AND alive) AS active_swaps, count(*) FILTER (old <> track_id AND NOT alive) AS post_expiration, count(*) FILTER (g > 1) AS track_fragmentations FROM a GROUP BY run_id""",
    "fragments": f"{_B}, {_FRAGMENTS} SELECT * FROM frags",
    "fragment_counts": f"""{_B}, {_FRAGMENTS}, tr AS (SELECT run_id, track_id, count(DISTINCT gt_id) AS l FROM bench GROUP BY ALL)
        SELECT run_id, count(*) AS n_tracks, count(*) FILTER (l = 0) AS tracks_without_label, count(*) FILTER (l > 1) AS tracks_with_several, (SELECT count(*) FROM frags f WHERE f.run_id = tr.run_id) AS n_episodes,
               {', '.join(f"(SELECT count(*) FROM frags f WHERE f.run_id = tr.run_id AND origin = '{o}') AS {o}" for o in benchmarks.FRAGMENTS)}, (SELECT count(*) FROM frags f WHERE f.run_id = tr.run_id AND excluded) AS n_excluded,
               (SELECT max(n) FROM (SELECT count(*) AS n FROM frags f WHERE f.run_id = tr.run_id GROUP BY gt_id)) AS most_tracks_per_player FROM tr GROUP BY run_id""",
    "rejection_rates": f"""{_B}, c AS (SELECT run_id, count(*) FILTER (main AND raw_x IS NOT NULL AND NOT is_bad AND gate IS NOT NULL) AS clean_judged,
            count(*) FILTER (main AND raw_x IS NOT NULL AND NOT is_bad AND gate IS NOT NULL AND NOT is_outlier_rejected AND is_measurement_used AND x_yd IS NOT NULL) AS clean_accepted,
            count(*) FILTER (main AND raw_x IS NOT NULL AND NOT is_bad AND gate IS NULL AND NOT is_outlier_rejected AND is_measurement_used AND x_yd IS NOT NULL) AS clean_accepted_in_warmup,
            count(*) FILTER (main AND raw_x IS NOT NULL AND NOT is_bad AND is_outlier_rejected) AS clean_rejected, count(*) FILTER (main AND raw_x IS NOT NULL AND NOT is_bad AND gate IS NULL) AS clean_in_warmup,
            count(*) FILTER (main AND raw_x IS NOT NULL AND is_bad) AS corrupted, count(*) FILTER (main AND raw_x IS NOT NULL AND is_bad AND is_outlier_rejected) AS corrupted_rejected,
            count(*) FILTER (main AND raw_x IS NOT NULL AND is_bad AND NOT is_outlier_rejected AND is_measurement_used AND x_yd IS NOT NULL) AS corrupted_accepted,
            count(*) FILTER (main AND raw_x IS NOT NULL AND NOT is_bad AND is_outlier_rejected AND position_source = 'predicted_dead_reckoning') AS dead_reckoned_after_false_rejection,
            count(*) FILTER (is_outlier_rejected AND NOT by_image) AS rejections_by_field_gate, count(*) FILTER (by_image) AS rejections_by_image_gate, count(*) FILTER (main AND is_outlier_rejected) AS rejections_on_dominant,
            count(*) FILTER (image_flag) AS image_flags, {_UNPOSITIONED}, round(median(gate) FILTER (main AND raw_x IS NOT NULL AND NOT is_bad AND is_outlier_rejected), 4) AS median_gate_of_false,
            round(median(gate) FILTER (main AND raw_x IS NOT NULL AND is_bad AND is_outlier_rejected), 4) AS median_gate_of_corrupted FROM roles GROUP BY run_id)
        SELECT *, round(clean_rejected::DOUBLE / nullif(clean_judged, 0), 6) AS false_rejection_rate, round(clean_rejected::DOUBLE / nullif(clean_judged + clean_in_warmup, 0), 6) AS false_rejection_rate_with_warmup,
               round(corrupted_rejected::DOUBLE / nullif(corrupted, 0), 6) AS true_rejection_rate, round(corrupted_accepted::DOUBLE / nullif(corrupted, 0), 6) AS false_acceptance_rate FROM c""",
    "uncertainty_coverage": f"""{_B}, f AS (SELECT run_id, geometry_state, inflated, x_yd - gx AS dx, y_yd - gy AS dy, cov_xx AS a, cov_xy AS b, cov_yy AS c, (cov_xx + cov_yy) / 2 AS m, sqrt(pow((cov_xx - cov_yy) / 2, 2) + cov_xy * cov_xy) AS r
            FROM roles WHERE main AND error IS NOT NULL AND cov_xx IS NOT NULL AND is_measurement_used AND NOT is_bad
        ), g AS (SELECT *, greatest(m + r, 1e-4) AS hi, greatest(m - r, 1e-4) AS lo FROM f), s AS (SELECT *, (hi + lo) / 2 + (hi - lo) / 2 * ((a - c) / 2 / r) AS sxx, (hi - lo) / 2 * (b / r) AS sxy, (hi + lo) / 2 - (hi - lo) / 2 * ((a - c) / 2 / r) AS syy FROM g
        ), d AS (SELECT run_id, (syy * dx * dx - 2 * sxy * dx * dy + sxx * dy * dy) / (sxx * syy - sxy * sxy) AS d2, unnest(['all', 'state:' || geometry_state, CASE WHEN inflated THEN 'inflated' ELSE 'not_inflated' END]) AS slice FROM s)
        SELECT run_id, slice, count(*) AS n, round(100 * avg((d2 <= 2.278)::INT), 2) AS coverage_68, round(100 * avg((d2 <= 5.991)::INT), 2) AS coverage_95, round(median(d2), 4) AS median_d2, round(median(d2) / 1.386::DOUBLE, 4) AS scale_k2 FROM d GROUP BY ALL""",
    "sample_scores": f"{_B} {_SCORES}",
    "motion_lengths": f"""{_B}, w AS (SELECT r.* FROM roles r WHERE main AND gx IS NOT NULL), l AS (SELECT run_id, sqrt(pow(x_yd - last_value(x_yd IGNORE NULLS) OVER o, 2) + pow(y_yd - last_value(y_yd IGNORE NULLS) OVER o, 2)) AS s,
            sqrt(pow(raw_x - last_value(raw_x IGNORE NULLS) OVER o, 2) + pow(raw_y - last_value(raw_y IGNORE NULLS) OVER o, 2)) AS r, sqrt(pow(gx - last_value(gx IGNORE NULLS) OVER o, 2) + pow(gy - last_value(gy IGNORE NULLS) OVER o, 2)) AS t
            FROM w WINDOW o AS (PARTITION BY run_id, gt_id, track_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), x AS (SELECT run_id, coalesce(sum(s), 0) AS s, coalesce(sum(r), 0) AS r, coalesce(sum(t), 0) AS t FROM l GROUP BY 1)
        SELECT run_id, round(s, 4) AS smooth_length, round(r, 4) AS raw_length, round(t, 4) AS true_length, round(s / nullif(r, 0), 4) AS ratio_to_raw, round(s / nullif(t, 0), 4) AS ratio_to_true FROM x""",
    "event_outcomes": f"""{_B}, old AS (SELECT run_id, gt_id, frame_id + 1 AS frame_id, max(track_id) AS old FROM bench WHERE gt_id IS NOT NULL GROUP BY ALL), j AS (
            SELECT x.run_id, x.gt_id, x.frame_id, b.track_id, old, coalesce(is_measurement_used AND x_yd IS NOT NULL, false) AS m, coalesce(is_outlier_rejected, false) AS rej FROM bad x LEFT JOIN bench b ON b.run_id = x.run_id AND b.gt_id = x.gt_id AND b.frame_id = x.frame_id
            LEFT JOIN old o ON o.run_id = x.run_id AND o.gt_id = x.gt_id AND o.frame_id = x.frame_id)
        SELECT run_id, gt_id, frame_id, count(track_id) AS n_samples, CASE WHEN bool_or(m AND track_id IS NOT NULL AND (old IS NULL OR old <> track_id)) THEN 'spawning_spurious_track' WHEN bool_or(rej) THEN 'rejected_by_field_gate'
            WHEN NOT bool_or(m) THEN 'refused_by_projection_gate' ELSE 'absorbed_into_track' END AS outcome FROM j GROUP BY ALL""",
    "split_rollup": f"""{_B}, sc AS ({_SCORES}) SELECT split, count(*) AS n_sequences, sum(n_frames)::BIGINT AS n_frames, coalesce(sum(dominant), 0)::BIGINT AS dominant, coalesce(sum(measured), 0)::BIGINT AS measured,
        round(coalesce(sum(measured), 0)::DOUBLE / greatest(1, sum(n_frames * n_players)), 4) AS completeness, round(median(error_median), 4) AS error_median, round(median(error_p90), 4) AS error_p90,
        round(sqrt(avg(error_rmse * error_rmse)), 4) AS error_rmse, round(sqrt(avg(velocity_rmse * velocity_rmse)), 4) AS velocity_rmse, round(coalesce(sum(observed_dominant), 0)::DOUBLE / greatest(1, sum(dominant)), 4) AS observed_ratio
        FROM seqs LEFT JOIN sc USING (run_id) GROUP BY split""",
    "segmentation_scores": f"{_SEGMENTED} SELECT * FROM scores",
    "segmentation_rollup": f"""{_SEGMENTED} SELECT CASE WHEN run_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, count(*) AS n_plays, count(*) FILTER (snap_source <> 'unavailable') AS snaps_resolved, count(*) FILTER (snap_source = 'unavailable') AS snaps_refused,
        count(*) FILTER (snap_source = 'manual') AS snaps_from_manual, 0::BIGINT AS ends_from_motion, count(*) FILTER (snap_error = 0) AS snap_exact, round(count(*) FILTER (snap_error = 0)::DOUBLE / nullif(count(*) FILTER (snap_source <> 'unavailable'), 0), 6) AS snap_exact_rate,
        median(snap_error) AS snap_error_median, max(snap_error) AS snap_error_max, median(end_error) AS end_error_median, count(*) FILTER (false_refusal) AS false_refusals, count(*) FILTER (true_refusal) AS true_refusals, sum(violations)::BIGINT AS violations FROM scores GROUP BY ALL""",
    "calibration_by_condition": f"""{_S}, {CALIBRATIONS_SQL}, {_RECORDS} SELECT t AS by, count(*) AS n_frames, count(*) FILTER (expected) AS expected_calibratable, count(*) FILTER (success) AS calibrated, count(*) FILTER (NOT success) AS refused,
        round(count(*) FILTER (NOT success)::DOUBLE / count(*), 3) AS failure_rate, coalesce(round(avg(confidence) FILTER (success), 4), 0.0) AS mean_confidence, round(median(ridge_px) FILTER (success), 3) AS median_error_yd FROM (SELECT *, unnest(tags) AS t FROM records) GROUP BY t""",
    "failure_histogram": f"""{_S}, {CALIBRATIONS_SQL} SELECT coalesce(failure_reason, 'unknown') AS reason, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM cals), 2) AS pct_of_frames,
        round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM cals WHERE NOT success), 2) AS pct_of_refused FROM cals WHERE NOT success GROUP BY 1""",
    "landmark_errors": f"""{_S}, {CALIBRATIONS_SQL}, c AS (SELECT *, h0 * h4 - h1 * h3 AS det FROM gated WHERE ok), i AS (SELECT run_id, frame_id, h0, h1, h2, h3, h4, h5, h4 / det AS i0, -h1 / det AS i1, (h1 * h5 - h2 * h4) / det AS i2, -h3 / det AS i3, h0 / det AS i4, (h2 * h3 - h0 * h5) / det AS i5,
            unnest([0, 1, 2]) AS n FROM c), m AS (SELECT *, 20.0::DOUBLE + n * 5 AS x, 15.0::DOUBLE + n * 3 AS y FROM i), v AS (SELECT *, i3 * x + i4 * y + i5 AS v0, i3 * x + i4 * y + i5 + n + 0.25::DOUBLE AS tv FROM m
        ), u AS (SELECT *, i0 * x + i1 * (160.0::DOUBLE / 3) + i2 + (i0 * x + i2 - (i0 * x + i1 * (160.0::DOUBLE / 3) + i2)) / (i3 * x + i5 - (i3 * x + i4 * (160.0::DOUBLE / 3) + i5)) * (tv - (i3 * x + i4 * (160.0::DOUBLE / 3) + i5)) AS tu FROM v
        ), e AS (SELECT run_id, frame_id, abs(v0 - tv) AS px, sqrt(pow(h0 * tu + h1 * tv + h2 - x, 2) + pow(h3 * tu + h4 * tv + h5 - y, 2)) AS yd FROM u)
        SELECT run_id, frame_id, count(*) AS n_landmarks, round(avg(px), 2) AS mean_px, round(median(px), 2) AS median_px, round(max(px), 2) AS max_px, round(avg(yd), 3) AS mean_yd, round(median(yd), 3) AS median_yd, round(max(yd), 3) AS max_yd FROM e GROUP BY ALL""",
    "smoothed_image_track": f"""{_S}, {BOXES_SQL}, o AS (SELECT run_id, box_id AS track_id, frame_id, round((x1 + x2) / 2, 3) AS u0, round(y2, 3) AS v0, row_number() OVER (PARTITION BY run_id, box_id ORDER BY frame_id) AS r FROM boxes), sm AS (
            SELECT run_id, track_id, frame_id, r, u0 AS u, v0 AS v FROM o WHERE r = 1 UNION ALL SELECT s.run_id, s.track_id, o.frame_id, o.r, 0.5::DOUBLE * o.u0 + 0.5::DOUBLE * s.u, 0.5::DOUBLE * o.v0 + 0.5::DOUBLE * s.v
            FROM sm s JOIN o ON o.run_id = s.run_id AND o.track_id = s.track_id AND o.r = s.r + 1) SELECT run_id, track_id, frame_id, round(u, 6) AS u, round(v, 6) AS v FROM sm""",
    "determinism": f"{_B} SELECT run_id, gt_id, frame_id, 0::BIGINT AS n_samples, '' AS outcome, '' AS side FROM bad WHERE false",
}
