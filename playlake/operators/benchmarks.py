"""Scoring of trajectories against ground truth: identities, fragments, gates, uncertainty, errors, roll-ups.

Samples have run_id, track_id, frame_id and gt_id, the player that a sample claims (NULL if none), beside
the columns of trajectories: x_yd and y_yd (accepted positions), raw_x and raw_y, predicted_x and predicted_y,
vx, vy, gate_statistic, is_outlier_rejected, rejection_reason, is_measurement_used and so on. Truth has
run_id, frame_id, gt_id, gx, gy, gvx and gvy. Events list the corrupted samples: run_id, gt_id, frame_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlake.functions import geometry

#: The reason of a rejection that isn't the field gate's, and the kinds of fragments and outcomes.
IMAGE_GATE = "jump_flagged_image_space_speed_gate"
FRAGMENTS = ("legitimate_new_track", "active_association_swap", "post_expiration_reinitialization", "outlier_induced_spawn")
OUTCOMES = ("spawning_spurious_track", "rejected_by_field_gate", "refused_by_projection_gate", "absorbed_into_track")
RULES = {"samples": "n_samples", "positioned": "n_positioned", "observed_run": "longest_observed_run"}

TRACK = ["run_id", "track_id"]
GROUP = ["run_id", "gt_id", "track_id"]


def _having(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _share(a: Column, b: Column, places: int) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), places)


def _observed() -> Column:
    return F.col("track_state") == "observed"


def longest_runs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run of consecutive frames that are all observed, 0 if none is."""
    at = Window.partitionBy(*keys).orderBy("frame_id")
    runs = samples.where(_observed()).withColumn("island", F.col("frame_id") - F.row_number().over(at))
    n = runs.groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max("n").alias("longest_observed_run"))


def track_stats(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counters of each track, from its own samples only."""
    keys = keys or TRACK
    counted = samples.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        _having(_observed()).alias("n_observed"),
        F.count("x_yd").alias("n_positioned"),
        _having(F.col("position_source") == "predicted_dead_reckoning").alias("n_dead_reckoned"),
        _having(F.col("is_measurement_used")).alias("n_measurements_used"),
        _having(F.col("is_outlier_rejected")).alias("n_outlier_rejected"),
        F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame"),
    )
    return counted.join(longest_runs(samples, keys), keys, "left").fillna(0, ["longest_observed_run"])


def dominant_tracks(samples: DataFrame, rule: str = "samples") -> DataFrame:
    """(run_id, gt_id, track_id): of the tracks that claim a player the one with most of what the rule counts,
    ties going to the lowest. Errors against the truth play no part."""
    groups = track_stats(samples.where("gt_id is not null"), GROUP)
    best = groups.groupBy("run_id", "gt_id").agg(F.min(F.struct((-F.col(RULES[rule])).alias("d"), "track_id")).alias("b"))
    return best.select("run_id", "gt_id", F.col("b.track_id").alias("track_id"))


def rule_agreement(samples: DataFrame) -> DataFrame:
    """Per run: players, and how many the other two rules give the same track."""
    j = dominant_tracks(samples)
    for other in ("positioned", "observed_run"):
        j = j.join(dominant_tracks(samples, other).withColumnRenamed("track_id", other), ["run_id", "gt_id"])
    return j.groupBy("run_id").agg(F.count("*").alias("players"), *(F.count_if(F.col(o) == F.col("track_id")).alias(f"agreeing_{o}") for o in ("positioned", "observed_run")))


def track_labels(samples: DataFrame) -> DataFrame:
    """How many samples of each track claim each player."""
    return samples.where("gt_id is not null").groupBy(*TRACK, "gt_id").agg(F.count("*").alias("n"))


def identity_switches(samples: DataFrame) -> DataFrame:
    """Per run, over observed samples of each player: changes of track, split by whether the old track still has
    a sample at that frame, and returns after frames in which the player wasn't observed."""
    at = Window.partitionBy("run_id", "gt_id").orderBy("frame_id")
    seen = samples.where(F.col("gt_id").isNotNull() & _observed()).groupBy("run_id", "gt_id", "frame_id").agg(F.max("track_id").alias("track_id"))
    seen = seen.withColumns({"old": F.lag("track_id").over(at), "gap": F.col("frame_id") - F.lag("frame_id").over(at)})
    alive = samples.select("run_id", "frame_id", F.col("track_id").alias("old"), F.lit(True).alias("alive")).distinct()
    j = seen.join(alive, ["run_id", "frame_id", "old"], "left")
    switch = F.coalesce(F.col("old") != F.col("track_id"), F.lit(False))
    return j.groupBy("run_id").agg(
        F.count_if(switch).alias("id_switches"),
        F.count_if(switch & F.col("alive").isNotNull()).alias("active_swaps"),
        F.count_if(switch & F.col("alive").isNull()).alias("post_expiration"),
        _having(F.col("gap") > 1).alias("track_fragmentations"),
    )


def fragments(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Every (player, track) episode with exactly one kind of origin, and whether it is a dominant track.

    The episode before is the one that started last before this one did, ties going to the higher track.
    """
    episodes = track_stats(samples.where("gt_id is not null"), GROUP).select(*GROUP, "first_frame", "last_frame", "n_samples", "n_observed", "n_positioned", "n_dead_reckoned")
    # episodes that start at the same frame don't precede each other
    starts = episodes.groupBy("run_id", "gt_id", "first_frame").agg(F.max("track_id").alias("highest"))
    before = Window.partitionBy("run_id", "gt_id").orderBy("first_frame")
    starts = starts.withColumn("previous", F.lag("highest").over(before)).drop("highest")
    alive = samples.select("run_id", F.col("frame_id").alias("first_frame"), F.col("track_id").alias("previous"), F.lit(True).alias("alive")).distinct()
    spawned = events.select("run_id", "gt_id", F.col("frame_id").alias("first_frame"), F.lit(True).alias("spawned")).distinct()
    j = episodes.join(starts, ["run_id", "gt_id", "first_frame"]).join(alive, ["run_id", "first_frame", "previous"], "left").join(spawned, ["run_id", "gt_id", "first_frame"], "left")
    kind = (
        F.when(F.col("spawned"), "outlier_induced_spawn").when(F.col("previous").isNull(), "legitimate_new_track").when(F.col("alive"), "active_association_swap").otherwise("post_expiration_reinitialization")
    )
    main = dominant_tracks(samples).withColumn("main", F.lit(True))
    several = track_labels(samples).groupBy(*TRACK).agg((F.count("*") > 1).alias("carries_several"))
    j = j.withColumn("origin", kind).join(main, GROUP, "left").join(several, TRACK)
    return j.select(*episodes.columns, "origin", F.col("main").isNull().alias("excluded"), "carries_several")


def fragment_counts(samples: DataFrame, episodes: DataFrame) -> DataFrame:
    """Per run: episodes by origin, how many aren't dominant, and tracks without or with several players."""
    tracks = samples.groupBy(*TRACK).agg(F.countDistinct("gt_id").alias("labels"))
    per_track = tracks.groupBy("run_id").agg(F.count("*").alias("n_tracks"), F.count_if(F.col("labels") == 0).alias("tracks_without_label"), F.count_if(F.col("labels") > 1).alias("tracks_with_several"))
    per_player = episodes.groupBy("run_id", "gt_id").agg(F.count("*").alias("n")).groupBy("run_id").agg(F.max("n").alias("most_tracks_per_player"))
    n = episodes.groupBy("run_id").agg(F.count("*").alias("n_episodes"), *(F.count_if(F.col("origin") == f).alias(f) for f in FRAGMENTS), F.count_if(F.col("excluded")).alias("n_excluded"))
    return per_track.join(n, "run_id", "left").join(per_player, "run_id", "left").fillna(0)


def _with_roles(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Samples with `main`, whether they are of their player's dominant track, and `bad`, whether corrupted."""
    main = dominant_tracks(samples).withColumn("main", F.lit(True))
    bad = events.select("run_id", "gt_id", "frame_id", F.lit(True).alias("bad")).distinct()
    j = samples.join(main, GROUP, "left").join(bad, ["run_id", "gt_id", "frame_id"], "left")
    return j.fillna(False, ["main", "bad"])


def rejection_accounting(samples: DataFrame, events: DataFrame, max_gap: int = 3) -> DataFrame:
    """Per run: clean and corrupted samples of dominant tracks that the gate accepted, rejected or didn't judge
    yet, rates on explicit denominators, rejections by gate, and unpositioned samples by reason.

    Accepted and rejected clean samples add up to the judged ones, which `rejection_mismatch` must confirm with 0.
    """
    s = _with_roles(samples, events)
    raw, rejected, judged = F.col("main") & F.col("raw_x").isNotNull(), F.col("is_outlier_rejected"), F.col("gate_statistic").isNotNull()
    clean, corrupt = raw & ~F.col("bad"), raw & F.col("bad")
    used = ~rejected & F.col("is_measurement_used") & F.col("x_yd").isNotNull()
    by_image = F.coalesce(F.col("rejection_reason") == IMAGE_GATE, F.lit(False))
    lost = F.col("x_yd").isNull() & F.col("predicted_x").isNull()
    gap, status = F.col("frames_since_measurement") > max_gap, F.col("projection_status")
    why = F.when(gap, "gap_exceeded").when(status.startswith("calibration_refused"), "geometry_refused").when(status.startswith("footpoint_unreliable"), "footpoint_refused").when(status.startswith("projection_refused"), "out_of_bounds").otherwise("other")
    n = s.groupBy("run_id").agg(
        _having(clean & judged).alias("clean_judged"),
        _having(clean & used & judged).alias("clean_accepted"),
        _having(clean & used & ~judged).alias("clean_accepted_in_warmup"),
        _having(clean & rejected).alias("clean_rejected"),
        _having(clean & ~judged).alias("clean_in_warmup"),
        _having(corrupt).alias("corrupted"),
        _having(corrupt & rejected).alias("corrupted_rejected"),
        _having(corrupt & used).alias("corrupted_accepted"),
        _having(clean & rejected & (F.col("position_source") == "predicted_dead_reckoning")).alias("dead_reckoned_after_false_rejection"),
        _having(rejected & ~by_image).alias("rejections_by_field_gate"),
        _having(rejected & by_image).alias("rejections_by_image_gate"),
        _having(F.col("main") & rejected).alias("rejections_on_dominant"),
        _having(F.col("image_jump_flagged")).alias("image_flags"),
        *(_having(lost & (why == r)).alias(f"unpositioned_{r}") for r in ("gap_exceeded", "geometry_refused", "footpoint_refused", "out_of_bounds", "other")),
        F.round(F.median(F.when(clean & rejected, F.col("gate_statistic"))), 4).alias("median_gate_of_false"),
        F.round(F.median(F.when(corrupt & rejected, F.col("gate_statistic"))), 4).alias("median_gate_of_corrupted"),
    )
    return n.withColumns(
        {
            "false_rejection_rate": _share(F.col("clean_rejected"), F.col("clean_judged"), 6),
            "false_rejection_rate_with_warmup": _share(F.col("clean_rejected"), F.col("clean_judged") + F.col("clean_in_warmup"), 6),
            "true_rejection_rate": _share(F.col("corrupted_rejected"), F.col("corrupted"), 6),
            "false_acceptance_rate": _share(F.col("corrupted_accepted"), F.col("corrupted"), 6),
        }
    )


def rejection_mismatch(accounting: DataFrame) -> DataFrame:
    """Per run, by how much accepted and rejected clean samples miss the judged ones."""
    return accounting.select("run_id", (F.col("clean_accepted") + F.col("clean_rejected") - F.col("clean_judged")).alias("mismatch"))


def _scored(samples: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """Samples with roles, truth and the error of their accepted position."""
    j = _with_roles(samples, events).join(truth, ["run_id", "frame_id", "gt_id"], "left")
    return j.withColumn("error", F.hypot(F.col("x_yd") - F.col("gx"), F.col("y_yd") - F.col("gy")))


def uncertainty_coverage(samples: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """Per run and slice: share of clean accepted positions within the 68 and 95 per cent ellipses of their covariance,
    the median squared distance, and the scale the covariance would need.

    Slices are all samples, those of each geometry state, and those with and without inflation.
    """
    s = _scored(samples, truth, events).where(F.col("main") & F.col("error").isNotNull() & F.col("cov_xx").isNotNull() & F.col("is_measurement_used") & ~F.col("bad"))
    cov = geometry.with_least_variance((F.col("cov_xx"), F.col("cov_xy"), F.col("cov_yy")))
    s = s.withColumns(dict(zip(("sxx", "sxy", "syy"), cov, strict=True)))
    s = s.withColumn("d2", geometry.mahalanobis2(F.col("x_yd") - F.col("gx"), F.col("y_yd") - F.col("gy"), (F.col("sxx"), F.col("sxy"), F.col("syy"))))
    slices = F.array(F.lit("all"), F.concat(F.lit("state:"), F.col("geometry_state")), F.when(F.col("is_inflated"), "inflated").otherwise("not_inflated"))
    each = s.select("run_id", "d2", F.explode(slices).alias("slice"))
    d2 = F.col("d2")
    return each.groupBy("run_id", "slice").agg(
        F.count("*").alias("n"),
        F.round(100 * F.avg((d2 <= geometry.CHI2_68).cast("double")), 2).alias("coverage_68"),
        F.round(100 * F.avg((d2 <= geometry.CHI2_95).cast("double")), 2).alias("coverage_95"),
        F.round(F.median(d2), 4).alias("median_d2"),
        F.round(F.median(d2) / geometry.CHI2_MEDIAN, 4).alias("scale_k2"),
    )


def sample_scores(samples: DataFrame, truth: DataFrame, events: DataFrame) -> DataFrame:
    """Per run: errors of positions, raw positions, velocities and headings of dominant tracks, by how a position came
    about, and what the other tracks hold, so that every sample is in exactly one count."""
    s = _scored(samples, truth, events)
    labelled = F.col("gx").isNotNull()
    main = F.col("main") & labelled
    raw = F.hypot(F.col("raw_x") - F.col("gx"), F.col("raw_y") - F.col("gy"))
    guess = F.hypot(F.col("predicted_x") - F.col("gx"), F.col("predicted_y") - F.col("gy"))
    positioned = main & F.col("error").isNotNull()
    dead = main & F.col("predicted_x").isNotNull() & (F.col("position_source") == "predicted_dead_reckoning")
    speed, heading = geometry.speed_and_heading(F.col("vx"), F.col("vy"))
    true_speed, true_heading = geometry.speed_and_heading(F.col("gvx"), F.col("gvy"))
    turn = F.abs(geometry.wrap_angle(heading - true_heading)) * (180.0 / 3.141592653589793)
    velocity = F.hypot(F.col("vx") - F.col("gvx"), F.col("vy") - F.col("gvy"))

    def median(value: Column, among: Column) -> Column:
        return F.round(F.median(F.when(among, value)), 4)

    def rmse(value: Column, among: Column) -> Column:
        return F.round(F.sqrt(F.avg(F.when(among, value * value))), 4)

    e = F.col("error")
    return s.groupBy("run_id").agg(
        F.count("*").alias("n_samples"),
        _having(main).alias("dominant"),
        _having(labelled & ~F.col("main")).alias("non_dominant"),
        _having(~labelled).alias("unattributed"),
        _having(positioned).alias("measured"),
        _having(main & (e.isNotNull() | F.col("predicted_x").isNotNull()) & _observed()).alias("observed_dominant"),
        median(e, positioned).alias("error_median"),
        F.round(F.percentile(F.when(positioned, e), 0.9), 4).alias("error_p90"),
        rmse(e, positioned).alias("error_rmse"),
        median(raw, positioned).alias("raw_median"),
        rmse(raw, positioned).alias("raw_rmse"),
        median(e, labelled & ~F.col("main")).alias("other_tracks_median"),
        median(e, positioned & ~F.col("reinit_after_gap")).alias("accepted_median"),
        median(e, positioned & F.col("reinit_after_gap")).alias("post_gap_median"),
        _having(dead & F.col("is_outlier_rejected")).alias("dead_reckoned_after_rejection"),
        _having(dead & ~F.col("is_outlier_rejected")).alias("dead_reckoned_without_measurement"),
        median(guess, dead).alias("dead_reckoning_median"),
        median(F.abs(speed - true_speed), positioned).alias("speed_error_median"),
        rmse(velocity, positioned).alias("velocity_rmse"),
        median(turn, positioned & (true_speed > 0.5) & (speed > 0.3)).alias("heading_error_median"),
        _having(F.col("x_yd").isNotNull() & (F.col("geometry_state") == "unknown")).alias("positions_in_unknown_geometry"),
    )


def motion_lengths(samples: DataFrame, truth: DataFrame) -> DataFrame:
    """Per run: path lengths of dominant tracks by accepted, raw and true positions, each over the samples that have
    one, however far apart; and the ratios of the first to the others."""
    main = samples.join(dominant_tracks(samples), GROUP, "left_semi").join(truth, ["run_id", "frame_id", "gt_id"])
    at = Window.partitionBy(*GROUP).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)

    def step(x: str, y: str) -> Column:
        before = F.last(F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y"))), ignorenulls=True).over(at)
        return F.hypot(F.col(x) - before["x"], F.col(y) - before["y"])

    main = main.withColumns({"smooth": step("x_yd", "y_yd"), "raw": step("raw_x", "raw_y"), "true": step("gx", "gy")})
    total = main.groupBy("run_id").agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("smooth", "raw", "true")))
    ratio = lambda c: F.round(F.when(F.col(c) > 0, F.col("smooth") / F.col(c)), 4)
    return total.select("run_id", *(F.round(c, 4).alias(f"{c}_length") for c in ("smooth", "raw", "true")), ratio("raw").alias("ratio_to_raw"), ratio("true").alias("ratio_to_true"))


def event_outcomes(samples: DataFrame, events: DataFrame) -> DataFrame:
    """What became of each corrupted sample: one outcome each, the first that applies."""
    keys = ["run_id", "gt_id", "frame_id"]
    at = samples.where("gt_id is not null")
    old = at.groupBy("run_id", "gt_id", (F.col("frame_id") + 1).alias("frame_id")).agg(F.max_by("track_id", "track_id").alias("old"))
    j = events.select(*keys).distinct().join(at, keys, "left").join(old, keys, "left")
    measured = F.coalesce(F.col("is_measurement_used") & F.col("x_yd").isNotNull(), F.lit(False))
    new = F.col("track_id").isNotNull() & (F.col("old").isNull() | (F.col("track_id") != F.col("old")))
    per_event = j.groupBy(*keys).agg(F.count("track_id").alias("n_samples"), F.max(new & measured).alias("spawned"), F.max(F.coalesce("is_outlier_rejected", F.lit(False))).alias("rejected"), F.max(measured).alias("measured"))
    outcome = F.when(F.col("spawned"), OUTCOMES[0]).when(F.col("rejected"), OUTCOMES[1]).when(~F.col("measured"), OUTCOMES[2]).otherwise(OUTCOMES[3])
    return per_event.select(*keys, "n_samples", outcome.alias("outcome"))


def split_rollup(scores: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per split: sums of counts, medians of medians, root mean squares of root mean squares, and ratios of sums.

    `sequences` has run_id, split, n_frames and n_players. Errors are not pooled.
    """
    j = sequences.join(scores, "run_id", "left")
    expected = F.sum(F.col("n_frames") * F.col("n_players"))
    return j.groupBy("split").agg(
        F.count("*").alias("n_sequences"),
        F.sum("n_frames").alias("n_frames"),
        F.coalesce(F.sum("dominant"), F.lit(0)).alias("dominant"),
        F.coalesce(F.sum("measured"), F.lit(0)).alias("measured"),
        F.round(F.coalesce(F.sum("measured"), F.lit(0)) / F.greatest(F.lit(1), expected), 4).alias("completeness"),
        F.round(F.median("error_median"), 4).alias("error_median"),
        F.round(F.median("error_p90"), 4).alias("error_p90"),
        F.round(F.sqrt(F.avg(F.col("error_rmse") * F.col("error_rmse"))), 4).alias("error_rmse"),
        F.round(F.sqrt(F.avg(F.col("velocity_rmse") * F.col("velocity_rmse"))), 4).alias("velocity_rmse"),
        F.round(F.coalesce(F.sum("observed_dominant"), F.lit(0)) / F.greatest(F.lit(1), F.sum("dominant")), 4).alias("observed_ratio"),
    )


def within(actual: Column, bound: Column) -> Column:
    """Whether a value keeps a bound: NULL without a bound, false without a value."""
    return F.when(bound.isNotNull(), F.coalesce(actual <= bound, F.lit(False)))


def segmentation_scores(segments: DataFrame, expected: DataFrame) -> DataFrame:
    """Per play: errors of boundaries in frames, whether a refusal was right, and what broke an expectation.

    `expected` has run_id, play_id, gt_snap, gt_end, expected_reason, snap_bound and end_bound, all nullable.
    """
    j = segments.join(expected, ["run_id", "play_id"])
    snap, end = F.abs(F.col("snap_frame") - F.col("gt_snap")), F.abs(F.col("end_frame") - F.col("gt_end"))
    j = j.withColumns({"snap_error": snap, "end_error": end})
    snap_ok, end_ok = within(F.col("snap_error"), F.col("snap_bound")), within(F.col("end_error"), F.col("end_bound"))
    wanted = F.col("expected_reason")
    broken = (
        F.when(wanted.isNotNull() & ~F.coalesce(F.col("snap_reason") == wanted, F.lit(False)), 1)
        .when(wanted.isNotNull(), 0)
        .otherwise(F.col("snap_frame").isNull().cast("int") + F.coalesce((~snap_ok).cast("int"), F.lit(0)) + F.coalesce((~end_ok).cast("int"), F.lit(0)))
    )
    return j.select(
        "run_id", "play_id", "snap_error", "end_error", snap_ok.alias("snap_within"), end_ok.alias("end_within"), (F.col("snap_frame").isNull() & F.col("gt_snap").isNotNull()).alias("false_refusal"),
        (F.col("snap_frame").isNull() & F.col("gt_snap").isNull()).alias("true_refusal"), broken.alias("violations"), "snap_source", "end_source",
    )


def segmentation_rollup(scores: DataFrame, splits: DataFrame) -> DataFrame:
    """Per split of runs: plays, boundaries by source, exact matches, errors pooled over plays, and refusals."""
    j = scores.join(splits, "run_id")
    resolved = F.col("snap_source") != "unavailable"
    return j.groupBy("split").agg(
        F.count("*").alias("n_plays"),
        F.count_if(resolved).alias("snaps_resolved"),
        F.count_if(~resolved).alias("snaps_refused"),
        F.count_if(F.col("snap_source") == "manual").alias("snaps_from_manual"),
        F.count_if(F.col("end_source") == "motion_cessation").alias("ends_from_motion"),
        _having(F.col("snap_error") == 0).alias("snap_exact"),
        _share(_having(F.col("snap_error") == 0), F.count_if(resolved), 6).alias("snap_exact_rate"),
        F.median("snap_error").alias("snap_error_median"),
        F.max("snap_error").alias("snap_error_max"),
        F.median("end_error").alias("end_error_median"),
        F.count_if("false_refusal").alias("false_refusals"),
        F.count_if("true_refusal").alias("true_refusals"),
        F.sum("violations").alias("violations"),
    )


def phase_accuracy(phases: DataFrame, true_phases: DataFrame) -> DataFrame:
    """Per play: frames with a true phase, and how many have it. Frames without a phase are outside of the play."""
    j = true_phases.withColumnRenamed("phase", "true").join(phases, ["run_id", "play_id", "frame_id"], "left").withColumn("phase", F.coalesce("phase", F.lit("outside_play")))
    return j.groupBy("run_id", "play_id").agg(F.count("*").alias("n_frames"), F.count_if(F.col("phase") == F.col("true")).alias("n_matched"))


def calibration_summary(records: DataFrame, by: Column) -> DataFrame:
    """Calibrated, refused and expected frames, confidence and error of the calibrated ones, per value of `by`.

    `by` may be an exploded list of conditions: a frame counts for each of them.
    """
    done = F.col("success")
    return records.withColumn("by", by).groupBy("by").agg(
        F.count("*").alias("n_frames"),
        F.count_if("expected").alias("expected_calibratable"),
        F.count_if(done).alias("calibrated"),
        F.count_if(~done).alias("refused"),
        F.round(F.count_if(~done) / F.count("*"), 3).alias("failure_rate"),
        F.coalesce(F.round(F.avg(F.when(done, F.col("confidence"))), 4), F.lit(0.0)).alias("mean_confidence"),
        F.round(F.median(F.when(done, F.col("error_yd"))), 3).alias("median_error_yd"),
    )


def failure_histogram(records: DataFrame) -> DataFrame:
    """Refused frames by reason, as shares of all frames and of refused ones."""
    refused = records.where("not success")
    n = records.agg(F.count("*").alias("n_all"), F.count_if(~F.col("success")).alias("n_refused"))
    reasons = refused.groupBy(F.coalesce("failure_reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))
    j = reasons.crossJoin(F.broadcast(n))  # one row
    return j.select("reason", "n", F.round(100.0 * F.col("n") / F.col("n_all"), 2).alias("pct_of_frames"), F.round(100.0 * F.col("n") / F.col("n_refused"), 2).alias("pct_of_refused"))


def landmark_errors(landmarks: DataFrame, width_yd: float = 160 / 3) -> DataFrame:
    """Per run and frame: errors in pixels and yards of held-out landmarks (x, y, true_v) along their yard lines.

    Landmarks come with the homographies in columns h0 to h8 (image to field) and i0 to i8 (its inverse).
    """
    h, inverse = [F.col(f"h{i}") for i in range(9)], [F.col(f"i{i}") for i in range(9)]
    x = F.col("x")
    _, v = geometry.project(inverse, x, F.col("y"))
    (tu, tv), (bu, bv) = (geometry.project(inverse, x, F.lit(edge)) for edge in (width_yd, 0.0))
    marked = landmarks.withColumns({"px": F.abs(v - F.col("true_v")), "u": tu + (bu - tu) / (bv - tv) * (F.col("true_v") - tv)})
    fx, fy = geometry.project(h, F.col("u"), F.col("true_v"))
    marked = marked.withColumn("yd", F.hypot(fx - x, fy - F.col("y")))
    return marked.groupBy("run_id", "frame_id").agg(
        F.count("*").alias("n_landmarks"),
        *(f(c).alias(f"{n}_{c}") for c, places in (("px", 2), ("yd", 3)) for n, f in (("mean", lambda c, p=places: F.round(F.avg(c), p)), ("median", lambda c, p=places: F.round(F.median(c), p)), ("max", lambda c, p=places: F.round(F.max(c), p)))),
    )


def smoothed_image_error(tracks: DataFrame, weight: float = 0.5) -> DataFrame:
    """(track, frame, u, v) smoothed exponentially in frame order, the first point being its own.

    Weights of earlier points shrink by a constant factor, so a track's points are folded within one array.
    """
    point = F.struct("frame_id", "u", "v")
    ordered = tracks.groupBy(*TRACK).agg(F.array_sort(F.collect_list(point)).alias("points"))
    kind = ordered.schema["points"].dataType.simpleString()

    def add(done: Column, p: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        mix = lambda c: F.when(F.size(done) == 0, p[c]).otherwise(weight * p[c] + (1 - weight) * last[c])
        return F.concat(done, F.array(F.struct(p["frame_id"].alias("frame_id"), mix("u").alias("u"), mix("v").alias("v"))))

    smooth = F.aggregate("points", F.array().cast(kind), add)
    return ordered.select(*TRACK, F.explode(smooth).alias("p")).select(*TRACK, "p.frame_id", "p.u", "p.v")


def same_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that two runs of the same computation don't have in common; there must be none."""
    return first.exceptAll(second).withColumn("side", F.lit("first")).unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def sweep(evaluate, variants: list[dict]) -> DataFrame:
    """Results of `evaluate` for each variant of its parameters, side by side, with the parameters as columns.

    Samples that tune must not be those that are reported: leave the test split out before.
    """
    done = [evaluate(**v).withColumns({f"p_{k}": F.lit(x) for k, x in v.items()}) for v in variants]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
