"""Scoring of predicted boxes and positions against ground truth.

Boxes have run_id, frame_id, box_id and corners; a box_id is unique within a frame. Truth may have
positions (x_yd, y_yd with x_coord_mode and coordinate_frame_id), and so may predictions, which also say
whether they were observed: a box that only continues a track is no detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlake.functions.geometry import box_iou
from playlake.operators.assignment import assign_pairs

FRAME = ["run_id", "frame_id"]
CORNERS = ("x1", "y1", "x2", "y2")


def ratio(a: Column, b: Column) -> Column:
    """a / b, rounded; NULL where b is 0 or NULL."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def iou_pairs(truth: DataFrame, predicted: DataFrame, least: float) -> DataFrame:
    """Pairs of boxes of a frame that overlap enough: (frame, gt_id, pred_id, iou)."""
    t = truth.select(*FRAME, F.col("box_id").alias("gt_id"), *(F.col(c).alias(f"t_{c}") for c in CORNERS))
    p = predicted.select(*FRAME, F.col("box_id").alias("pred_id"), *CORNERS)
    iou = box_iou(tuple(F.col(f"t_{c}") for c in CORNERS), tuple(F.col(c) for c in CORNERS))
    return t.join(p, FRAME).withColumn("iou", F.round(iou, 6)).where(F.col("iou") >= least).select(*FRAME, "gt_id", "pred_id", "iou")


def detections_only(predicted: DataFrame) -> DataFrame:
    return predicted.where(F.coalesce("observed", F.lit(True)))


def match_boxes(spark: SparkSession, truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches per frame: as many as possible, then of the greatest total overlap."""
    return assign_pairs(spark, iou_pairs(truth, detections_only(predicted), least))


def best_prediction(pairs: DataFrame) -> DataFrame:
    """Best overlapping prediction of each ground-truth box, independently; ties go to the lower id."""
    best = pairs.groupBy(*FRAME, "gt_id").agg(F.min(F.struct((-F.col("iou")).alias("d"), "pred_id")).alias("b"))
    return best.select(*FRAME, "gt_id", F.col("b.pred_id").alias("pred_id"), (-F.col("b.d")).alias("iou"))


def greedy_matches(pairs: DataFrame, order: str = "pred_id") -> DataFrame:
    """Detections in order take the best truth that is left; ties go to the lower truth id.

    A frame's pairs are folded in order within one array expression; a frame has some tens of players.
    """
    options = pairs.groupBy(*FRAME, F.col(order).alias("place"), "pred_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("d"), "gt_id"))).alias("options"))
    frames = options.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("place", "pred_id", "options"))).alias("all"))
    taken_type = f"array<struct<gt_id:{dict(pairs.dtypes)['gt_id']},pred_id:{dict(pairs.dtypes)['pred_id']},iou:double>>"
    empty = F.array().cast(taken_type)

    def take(taken: Column, d: Column) -> Column:
        left = F.filter(d["options"], lambda o: ~F.exists(taken, lambda t: t["gt_id"] == o["gt_id"]))
        first = F.get(left, F.lit(0))
        added = F.array(F.struct(first["gt_id"].alias("gt_id"), d["pred_id"].alias("pred_id"), (-first["d"]).alias("iou")))
        return F.when(F.size(left) > 0, F.concat(taken, added)).otherwise(taken)

    return frames.select(*FRAME, F.explode(F.aggregate("all", empty, take)).alias("m")).select(*FRAME, "m.gt_id", "m.pred_id", "m.iou")


def identity_switches(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Per ground-truth player: how often the matched id differs from the last matched one, and how often it is
    matched again after frames that label it but where it was missed. Frames without the player don't count."""
    at = Window.partitionBy("run_id", "gt_id").orderBy("frame_id")
    seen = truth.select(*FRAME, F.col("box_id").alias("gt_id")).join(matches.select(*FRAME, "gt_id", "pred_id"), [*FRAME, "gt_id"], "left")
    earlier = F.last("pred_id", ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    seen = seen.withColumns({"earlier": earlier, "missed": F.lag("pred_id").over(at).isNull()})
    matched = F.col("pred_id").isNotNull() & F.col("earlier").isNotNull()
    return seen.groupBy("run_id", "gt_id").agg(
        F.count_if(matched & (F.col("earlier") != F.col("pred_id"))).alias("switches"), F.count_if(matched & F.col("missed")).alias("fragments"), F.count("pred_id").alias("n_matched")
    )


def dominant_tracks(matches: DataFrame) -> DataFrame:
    """The prediction that matched each ground-truth player most often; ties go to the lower id."""
    n = matches.groupBy("run_id", "gt_id", "pred_id").agg(F.count("*").alias("n"))
    best = n.groupBy("run_id", "gt_id").agg(F.min(F.struct((-F.col("n")).alias("d"), "pred_id")).alias("b"))
    return best.select("run_id", "gt_id", F.col("b.pred_id").alias("pred_id"), (-F.col("b.d")).alias("n"))


def detection_rates(frames: DataFrame, truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Per run, over the annotated `frames`: true and false positives, misses, precision and recall (NULL where
    undefined). Duplicate detections are false positives."""
    t = truth.groupBy("run_id").agg(F.count("*").alias("n_truth"))
    p = detections_only(predicted).join(frames.select(*FRAME), FRAME, "left_semi").groupBy("run_id").agg(F.count("*").alias("n_predicted"))
    m = matches.groupBy("run_id").agg(F.count("*").alias("tp"))
    runs = frames.select("run_id").distinct()
    j = runs.join(t, "run_id", "left").join(p, "run_id", "left").join(m, "run_id", "left").fillna(0)
    tp, n, g = F.col("tp"), F.col("n_predicted"), F.col("n_truth")
    return j.select("run_id", "tp", (n - tp).alias("fp"), (g - tp).alias("fn"), ratio(tp, n).alias("precision"), ratio(tp, g).alias("recall"))


def detection_rates_or_zero(rates: DataFrame) -> DataFrame:
    """The same counts with precision, recall and F1 that are 0 rather than NULL where undefined."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    precision, recall = tp / F.greatest(F.lit(1.0), tp + fp), tp / F.greatest(F.lit(1.0), tp + fn)
    f1 = 2 * precision * recall / F.greatest(F.lit(1e-9), precision + recall)
    return rates.select("run_id", "tp", "fp", "fn", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def frame_differences(annotated: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per run: frames annotated, annotated ones without prediction, and predicted ones without annotation."""
    a, p = annotated.select(*FRAME).distinct(), predicted.select(*FRAME).distinct()
    j = a.withColumn("a", F.lit(1)).join(p.withColumn("p", F.lit(1)), FRAME, "full")
    return j.groupBy("run_id").agg(
        F.count("a").alias("annotated_frames"), F.count_if(F.col("p").isNull()).alias("missing_prediction_frames"), F.count_if(F.col("a").isNull()).alias("unannotated_prediction_frames")
    )


def field_errors(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Per match of two positions: their distance if they are in one frame of reference, else NULL."""
    place = ("x_yd", "y_yd", "x_coord_mode", "coordinate_frame_id")
    t = truth.select(*FRAME, F.col("box_id").alias("gt_id"), F.struct(*place).alias("t")).where("t.x_yd is not null")
    p = predicted.select(*FRAME, F.col("box_id").alias("pred_id"), F.struct(*place).alias("p")).where("p.x_yd is not null")
    same = (F.col("t.x_coord_mode") == F.col("p.x_coord_mode")) & (F.col("t.coordinate_frame_id") == F.col("p.coordinate_frame_id"))
    apart = F.hypot(F.col("t.x_yd") - F.col("p.x_yd"), F.col("t.y_yd") - F.col("p.y_yd"))
    return matches.join(t, [*FRAME, "gt_id"]).join(p, [*FRAME, "pred_id"]).select(*FRAME, "gt_id", "pred_id", F.when(same, apart).alias("error"))


def field_scores(truth: DataFrame, errors: DataFrame, within: float = 1.0) -> DataFrame:
    """Per run: positions to find, scored ones, coverage, incompatible ones, median and 95th percentile of the
    errors of scored ones, and the share of all positions to find that were within a bound."""
    t = truth.where("x_yd is not null").groupBy("run_id").agg(F.count("*").alias("n_truth"))
    e = F.col("error")
    s = errors.groupBy("run_id").agg(
        F.count(e).alias("n_scored"), F.count_if(e.isNull()).alias("n_incompatible"), F.round(F.median(e), 6).alias("median_error"), F.round(F.percentile(e, 0.95), 6).alias("p95_error"), F.count_if(e <= within).alias("n_within")
    )
    j = t.join(s, "run_id", "left").fillna(0, ["n_scored", "n_incompatible", "n_within"])
    return j.select("run_id", "n_truth", "n_scored", ratio(F.col("n_scored"), F.col("n_truth")).alias("coverage"), "n_incompatible", "median_error", "p95_error", ratio(F.col("n_within"), F.col("n_truth")).alias("within"))


def helmet_matches(spark: SparkSession, helmets: DataFrame, boxes: DataFrame) -> DataFrame:
    """One-to-one matches of the centres of on-field helmets with boxes that hold them, edges included."""
    h = helmets.where(~F.coalesce("is_sideline_player", F.lit(False))).select(*FRAME, F.col("box_id").alias("gt_id"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    b = boxes.select(*FRAME, F.col("box_id").alias("pred_id"), *CORNERS)
    inside = F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    return assign_pairs(spark, h.join(b, FRAME).where(inside).select(*FRAME, "gt_id", "pred_id", F.lit(1.0).alias("iou")))


def batch_summary(frames: DataFrame, tracks: DataFrame, labeled: DataFrame, helmets: DataFrame, matches: DataFrame) -> DataFrame:
    """Per run: frames, observed tracks, labelled frames, and how many helmets of those are matched.

    `labeled` lists the frames that have labels at all; without any the counts are NULL, not 0.
    """
    n = frames.groupBy("run_id").agg(F.count("*").alias("frames_processed"))
    ids = tracks.where("observed").groupBy("run_id").agg(F.countDistinct("box_id").alias("observed_tracks"))
    known = labeled.join(frames.select(*FRAME), FRAME, "left_semi")
    lab = known.groupBy("run_id").agg(F.count("*").alias("labeled_frames"))
    on_field = helmets.where(~F.coalesce("is_sideline_player", F.lit(False))).join(known.select(*FRAME), FRAME, "left_semi").groupBy("run_id").agg(F.count("*").alias("helmets"))
    met = matches.join(known.select(*FRAME), FRAME, "left_semi").groupBy("run_id").agg(F.count("*").alias("matched"))
    j = n
    for part in (ids, lab, on_field, met):
        j = j.join(part, "run_id", "left")
    j = j.fillna(0)
    some = F.col("labeled_frames") > 0
    return j.select(
        "run_id", "frames_processed", "observed_tracks", "labeled_frames", (F.col("frames_processed") - F.col("labeled_frames")).alias("unlabeled_frames"), F.when(some, F.col("matched")).alias("matched_helmets"),
        F.when(some, F.col("helmets")).alias("labeled_helmets"), ratio(F.col("matched"), F.col("helmets")).alias("containment"),
    )


def error_percentiles(errors: DataFrame, within: float) -> DataFrame:
    """Per run: median, 95th percentile and RMSE of errors, and the share of all rows within a bound."""
    e = F.col("error")
    return errors.groupBy("run_id").agg(
        F.count("*").alias("n_truth"),
        F.count(e).alias("n_scored"),
        F.round(F.median(e), 6).alias("median_error"),
        F.round(F.percentile(e, 0.95), 6).alias("p95_error"),
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.count_if(e <= within) / F.count("*"), 6).alias("within"),
    )
