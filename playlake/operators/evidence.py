"""Collective motion per frame, and the play boundaries that it supports.

A play's window is dense: a frame without samples exists with zero counts, and its moving fraction is
NULL, as it is with too few usable samples. A boundary that the evidence doesn't support is NULL with
the first reason that applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlake.operators.predicates import evidence_bucket
from playlake.operators.windows import closed_windows, in_windows, tracks_in_windows

MIN_TRACKS = 6
MOVING_YD_S = 1.0
BASELINE_FRAMES, BASELINE_MAX = 10, 0.15
SUSTAINED_FRAMES, ONSET_MIN = 3, 0.45
MIN_PLAY_FRAMES, QUIET_FRAMES, QUIET_MAX = 6, 6, 0.15
REFERENCE_CONTRAST, MAX_CONFIDENCE = 0.5, 0.99

KEYS = ["run_id", "play_id"]


def _the_only(name: str, among: Column) -> Column:
    """The value that all rows of a group share, among those that pass a test; NULL if they differ."""
    value = F.when(among, F.col(name))
    return F.when(F.min(value) == F.max(value), F.min(value)).alias(name)


def motion_evidence(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Usable and moving samples of each frame of each closed window, and the fraction that moves.

    A frame whose usable samples name more than one frame of reference, or segment, has none.
    """
    frames = windows.where("end_frame >= start_frame").select(*KEYS, F.explode(F.sequence("start_frame", "end_frame")).alias("frame_id"))
    usable = evidence_bucket() == "usable"
    counted = samples.groupBy("run_id", "frame_id").agg(
        F.count_if(usable).alias("n_usable"),
        F.count_if(usable & (F.col("speed_yd_s") >= MOVING_YD_S)).alias("n_moving"),
        _the_only("coordinate_frame_id", usable),
        _the_only("coordinate_segment", usable),
    )
    dense = frames.join(counted, ["run_id", "frame_id"], "left").fillna(0, ["n_usable", "n_moving"])
    fraction = F.when(F.col("n_usable") >= MIN_TRACKS, F.col("n_moving") / F.col("n_usable"))
    return dense.select(*KEYS, "frame_id", "n_usable", "n_moving", fraction.alias("moving_fraction"), "coordinate_frame_id", "coordinate_segment")


def evidence_buckets(samples: DataFrame) -> DataFrame:
    """How many samples of a run fall into each evidence bucket."""
    return samples.groupBy("run_id", evidence_bucket().alias("bucket")).agg(F.count("*").alias("n"))


def exclusion_totals(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Per play: tracks and samples in its window, and samples that each reason keeps from being evidence."""
    inside = in_windows(samples, windows.select(*KEYS, "start_frame", "end_frame")).withColumn("bucket", evidence_bucket())
    reasons = ("dead_reckoning", "rejected", "coasted", "unprojected")
    return inside.groupBy(*KEYS).agg(
        F.countDistinct("track_id").alias("n_tracks"),
        F.count("*").alias("n_samples"),
        F.count_if(F.col("bucket") == "usable").alias("n_usable"),
        *(F.count_if(F.col("bucket") == r).alias(f"n_{r}") for r in reasons),
    )


def evidence_totals(evidence: DataFrame) -> DataFrame:
    """Per play: frames, frames with a fraction, and what those say about the frame of reference.

    Frames of reference come in order of appearance, a frame without one counting as its own kind; segments
    ascend, and a missing one is left out.
    """
    defined = F.col("moving_fraction").isNotNull()
    cid = F.coalesce("coordinate_frame_id", F.lit("none"))
    first = evidence.groupBy(*KEYS, F.when(defined, cid).alias("cid")).agg(F.min("frame_id").alias("first"))
    ordered = first.where("cid is not null").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("first", "cid"))).alias("ids"))
    totals = evidence.groupBy(*KEYS).agg(
        F.count("*").alias("n_frames"),
        F.count_if(defined).alias("n_defined"),
        F.count_if(~defined).alias("n_undefined"),
        F.sum("n_usable").alias("n_usable"),
        F.array_join(F.array_sort(F.collect_set(F.when(defined, F.col("coordinate_segment")))).cast("array<string>"), ",").alias("segments"),
    )
    return totals.join(ordered, KEYS, "left").select(*totals.columns, F.coalesce(F.array_join("ids.cid", ","), F.lit("")).alias("coordinate_frames"))


def snap_onset(samples: DataFrame, windows: DataFrame, evidence: DataFrame) -> DataFrame:
    """First sustained collective motion after a quiet start, per closed window, or why there is none.

    Refusals carry the evidence's counts and have confidence 0.

    The quiet start is the window's first `BASELINE_FRAMES` frames: as a longer one must hold them, no
    other start can qualify where they don't.
    """
    at = Window.partitionBy(*KEYS).orderBy("frame_id")
    ahead = at.rowsBetween(0, SUSTAINED_FRAMES - 1)
    frac = F.col("moving_fraction")
    marked = evidence.withColumns(
        {
            "i": F.row_number().over(at) - 1,
            "low": F.when(F.count(frac).over(ahead) == SUSTAINED_FRAMES, F.min(frac).over(ahead)),
            "behind": F.max(frac).over(at.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    n = Window.partitionBy(*KEYS)
    onset = (F.col("i") >= BASELINE_FRAMES) & (F.col("low") >= ONSET_MIN)
    per_play = marked.withColumn("n_frames", F.count("*").over(n)).groupBy(*KEYS).agg(
        F.count("*").alias("n_frames"),
        F.count(frac).alias("n_defined"),
        F.count_if((F.col("i") < BASELINE_FRAMES) & (frac <= BASELINE_MAX)).alias("quiet"),
        F.count_if(frac.isNull() & (F.col("i") < F.col("n_frames") - 1)).alias("gaps"),
        F.min(F.when(onset, F.struct("frame_id", "low", "behind"))).alias("onset"),
        *_frames_of_reference(),
    )
    joined = windows.select(*KEYS, "start_frame", "end_frame").join(per_play, KEYS, "left").join(tracks_in_windows(samples, windows), KEYS, "left")
    reason = (
        _window_reason(BASELINE_FRAMES + SUSTAINED_FRAMES)
        .when((F.col("quiet") < BASELINE_FRAMES) & (F.col("gaps") > 0), "baseline_evidence_gaps")
        .when(F.col("quiet") < BASELINE_FRAMES, "no_quiescent_baseline")
        .when(F.col("onset").isNull(), "no_sustained_onset")
    )
    contrast = (F.col("onset.low") - F.col("onset.behind")) / REFERENCE_CONTRAST * F.col("n_defined") / F.col("n_frames")
    found = joined.withColumn("reason", reason).fillna(0, ["n_tracks", "n_defined", "n_frames"])
    ok = F.col("reason").isNull()
    return found.select(
        *KEYS,
        F.when(ok, F.col("onset.frame_id")).alias("snap_frame"),
        F.when(ok, F.round(F.col("onset.low"), 6)).alias("onset_fraction"),
        F.when(ok, F.round(F.col("onset.behind"), 6)).alias("baseline_fraction"),
        F.when(ok, F.round(F.least(F.lit(MAX_CONFIDENCE), F.greatest(F.lit(0.0), contrast)), 4)).otherwise(0.0).alias("confidence"),
        "reason",
        "n_tracks",
        (F.col("n_frames") - F.col("n_defined")).alias("n_undefined"),
    )


def _frames_of_reference() -> list[Column]:
    """Least and greatest frame of reference of the frames with a fraction; none counts as ''."""
    cid = F.when(F.col("moving_fraction").isNotNull(), F.coalesce("coordinate_frame_id", F.lit("")))
    return [F.min(cid).alias("least_id"), F.max(cid).alias("most_id")]


def _window_reason(least_frames: int) -> Column:
    """The first reason against a window as a whole, to be continued with others."""
    return (
        F.when(F.col("n_tracks").isNull(), "no_trajectories")
        .when(F.coalesce("n_frames", F.lit(0)) < least_frames, "window_too_short")
        .when(F.col("n_tracks") < MIN_TRACKS, "insufficient_tracks")
        .when(F.col("n_defined") == 0, "insufficient_measured_samples")
        .when((F.col("least_id") != F.col("most_id")) | (F.col("least_id") == ""), "coordinate_frame_change")
    )


def play_end(samples: DataFrame, plays: DataFrame) -> DataFrame:
    """First sustained quiet after sustained motion that follows a known snap, or why there is none.

    `plays` has run_id, play_id, start_frame, snap_frame and end_frame, the last frame to search. The quiet
    must leave a play of `MIN_PLAY_FRAMES` frames; its first frame is the end.
    """
    closed = closed_windows(plays, samples)
    searched = motion_evidence(samples, closed.withColumn("start_frame", F.col("snap_frame") + 1))
    at = Window.partitionBy(*KEYS).orderBy("frame_id")
    frac, active, quiet = F.col("moving_fraction"), at.rowsBetween(0, SUSTAINED_FRAMES - 1), at.rowsBetween(0, QUIET_FRAMES - 1)
    marked = searched.withColumns(
        {
            "i": F.row_number().over(at) - 1,
            "moves": (F.count(frac).over(active) == SUSTAINED_FRAMES) & (F.min(frac).over(active) >= ONSET_MIN),
            "rest": F.when(F.count(frac).over(quiet) == QUIET_FRAMES, F.max(frac).over(quiet)),
        }
    )
    marked = marked.withColumn("a", F.min(F.when(F.col("moves"), F.col("i"))).over(Window.partitionBy(*KEYS)))
    ends = (F.col("i") >= F.greatest(F.lit(MIN_PLAY_FRAMES - 1), F.col("a") + 1)) & (F.col("rest") <= QUIET_MAX)
    marked = marked.withColumn("q", F.min(F.when(ends, F.col("i"))).over(Window.partitionBy(*KEYS)))
    per_play = marked.groupBy(*KEYS).agg(
        F.count("*").alias("n_frames"),
        F.count(frac).alias("n_defined"),
        F.min("a").alias("a"),
        *_frames_of_reference(),
        F.max(F.when((F.col("i") >= F.col("a")) & (F.col("i") < F.col("q")), frac)).alias("active"),
        F.max(F.when(F.col("i") == F.col("q"), F.struct("frame_id", "rest"))).alias("end"),
    )
    joined = closed.select(*KEYS, "snap_frame").join(per_play, KEYS, "left").join(tracks_in_windows(samples, plays), KEYS, "left")
    reason = (
        F.when(F.col("snap_frame").isNull(), "snap_unavailable")
        .otherwise(_window_reason(MIN_PLAY_FRAMES + QUIET_FRAMES))
    )
    reason = (
        F.when(reason.isNotNull(), reason)
        .when(F.col("a").isNull(), "no_prior_sustained_motion")
        .when(F.col("end").isNull(), "no_motion_cessation")
    )
    contrast = (F.col("active") - F.col("end.rest")) / REFERENCE_CONTRAST * F.col("n_defined") / F.col("n_frames")
    ok = F.col("reason").isNull()
    return joined.withColumn("reason", reason).select(
        *KEYS,
        F.when(ok, F.col("end.frame_id")).alias("end_frame"),
        F.when(ok, F.round("active", 6)).alias("active_fraction"),
        F.when(ok, F.round("end.rest", 6)).alias("quiet_fraction"),
        F.when(ok, F.round(F.least(F.lit(MAX_CONFIDENCE), F.greatest(F.lit(0.0), contrast)), 4)).otherwise(0.0).alias("confidence"),
        "reason",
    )
