"""Plays with resolved boundaries: a label's own frame wins, else an estimate, else NULL with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlake.operators.evidence import motion_evidence, play_end, snap_onset
from playlake.operators.windows import KEYS, closed_windows, in_windows

#: The phases a frame can be in, and the sources of boundaries.
PHASES = ("outside_play", "pre_snap", "snap", "play", "play_end", "snap_unknown")
MANUAL, ONSET, CESSATION, REFUSED = "manual", "collective_motion_onset", "motion_cessation", "unavailable"


def check_labels(labels: DataFrame) -> DataFrame:
    """Labels that break a rule, with the first rule broken: there must be none before plays are segmented."""
    from playlake.operators.reports import label_overlaps

    start, snap, end = F.col("start_frame"), F.col("snap_frame"), F.col("end_frame")
    broken = (
        F.when(F.coalesce("play_id", F.lit("")) == "", "empty_play_id")
        .when(start.isNull() | (start < 0), "negative_start")
        .when(end < start, "end_before_start")
        .when(snap < start, "snap_before_start")
        .when(snap > end, "snap_after_end")
    )
    own = labels.withColumn("violation", broken).where("violation is not null").select(*KEYS, "violation")
    twice = labels.groupBy(*KEYS).agg(F.count("*").alias("n")).where("n > 1").select(*KEYS, F.lit("duplicate_play_id").alias("violation"))
    return own.unionByName(twice).unionByName(label_overlaps(labels))


def _one_of(name: str, among: Column | None = None) -> Column:
    value = F.col(name) if among is None else F.when(among, F.col(name))
    return F.when(F.min(value) == F.max(value), F.min(value))


def provenance(samples: DataFrame, plays: DataFrame) -> DataFrame:
    """Per play: tracks, the mode and frame of reference if there is but one, and all segments touched.

    Uncalibrated samples don't count as a mode; mixed modes are uncalibrated. Samples without a frame of
    reference are ignored.
    """
    inside = in_windows(samples, plays.select(*KEYS, "start_frame", "end_frame"))
    return inside.groupBy(*KEYS).agg(
        F.countDistinct("track_id").alias("n_tracks"),
        F.coalesce(_one_of("x_coord_mode", F.col("x_coord_mode") != "uncalibrated"), F.lit("uncalibrated")).alias("x_coord_mode"),
        _one_of("coordinate_frame_id").alias("coordinate_frame_id"),
        F.array_join(F.array_sort(F.collect_set("coordinate_segment")).cast("array<string>"), ",").alias("coordinate_segments"),
    )


def segment_plays(samples: DataFrame, labels: DataFrame, automatic_snap: bool = True, automatic_end: bool = False) -> DataFrame:
    """One row per labelled play: boundaries, their sources, confidences and refusals, and provenance.

    `labels` has run_id, play_id, start_frame, snap_frame and end_frame, the last two nullable. Raises if a
    label breaks a rule, or has no end while ends aren't estimated.
    """
    bad = check_labels(labels).limit(5).collect()
    if bad:
        raise ValueError(f"play labels: {[(r['play_id'], r['violation']) for r in bad]}")
    if not automatic_end and labels.where("end_frame is null").limit(1).count():
        raise ValueError("play labels: a play has no end_frame and ends aren't estimated")
    labels = labels.select(*KEYS, "start_frame", "snap_frame", "end_frame")
    made = labels.withColumnsRenamed({"snap_frame": "manual_snap", "end_frame": "manual_end"})
    if automatic_snap:
        windows = closed_windows(labels.where("snap_frame is null"), samples)
        snaps = snap_onset(samples, windows, motion_evidence(samples, windows)).select(*KEYS, F.col("snap_frame").alias("est"), F.col("confidence").alias("est_confidence"), F.col("reason").alias("why"))
    else:
        snaps = labels.where("snap_frame is null").select(*KEYS, F.lit(None).cast("long").alias("est"), F.lit(0.0).alias("est_confidence"), F.lit("automatic_estimation_disabled").alias("why"))
    made = _resolved(made, snaps, "snap", ONSET)
    if automatic_end:
        open_plays = made.where("manual_end is null").select(*KEYS, "start_frame", "snap_frame", F.lit(None).cast("long").alias("end_frame"))
        ends = play_end(samples, open_plays).select(*KEYS, F.col("end_frame").alias("est"), F.col("confidence").alias("est_confidence"), F.col("reason").alias("why"))
    else:
        ends = labels.where("false").select(*KEYS, F.lit(None).cast("long").alias("est"), F.lit(0.0).alias("est_confidence"), F.lit("").alias("why"))
    made = _resolved(made, ends, "end", CESSATION)
    return made.join(provenance(samples, made), KEYS, "left").fillna({"n_tracks": 0, "x_coord_mode": "uncalibrated", "coordinate_segments": ""})


def _resolved(plays: DataFrame, estimates: DataFrame, name: str, source: str) -> DataFrame:
    manual, est = F.col(f"manual_{name}"), F.col("est")
    joined = plays.join(estimates, KEYS, "left").withColumns(
        {
            f"{name}_frame": F.coalesce(manual, est),
            f"{name}_source": F.when(manual.isNotNull(), MANUAL).when(est.isNotNull(), source).otherwise(REFUSED),
            f"{name}_confidence": F.when(manual.isNotNull(), 1.0).when(est.isNotNull(), F.col("est_confidence")).otherwise(0.0),
            f"{name}_reason": F.when(manual.isNull() & est.isNull(), F.col("why")),
        }
    )
    return joined.drop("est", "est_confidence", "why", f"manual_{name}")


def refusals(segments: DataFrame) -> DataFrame:
    """(run_id, play_id, scope, reason) of every boundary that isn't known."""
    parts = [segments.where(F.col(f"{b}_frame").isNull()).select(*KEYS, F.lit(scope).alias("scope"), F.col(f"{b}_reason").alias("reason")) for b, scope in (("snap", "snap"), ("end", "play_end"))]
    return parts[0].unionByName(parts[1])


def segment_counters(segments: DataFrame) -> DataFrame:
    """Per run: plays, boundaries by source, refusals, and boundaries without a source, which must be 0."""
    def having(name: str, source: str) -> Column:
        return F.count_if(F.col(f"{name}_source") == source)

    made_up = {b: F.count_if(F.col(f"{b}_frame").isNotNull() & (F.col(f"{b}_source") == REFUSED)) for b in ("snap", "end")}
    return segments.groupBy("run_id").agg(
        F.count("*").alias("plays_segmented"),
        having("snap", MANUAL).alias("snaps_from_manual"),
        having("snap", ONSET).alias("snaps_from_motion_onset"),
        having("snap", REFUSED).alias("snaps_refused"),
        having("end", MANUAL).alias("play_ends_from_manual"),
        having("end", CESSATION).alias("play_ends_from_motion_cessation"),
        having("end", REFUSED).alias("play_ends_refused"),
        made_up["snap"].alias("fabricated_snap_frames"),
        made_up["end"].alias("fabricated_play_ends"),
    )


def phase_of(frame: Column) -> Column:
    """The phase of a frame in the row's play, never inventing a snap."""
    start, snap, end = F.col("start_frame"), F.col("snap_frame"), F.col("end_frame")
    return (
        F.when((frame < start) | (end.isNotNull() & (frame > end)), "outside_play")
        .when(snap.isNull(), "snap_unknown")
        .when(frame < snap, "pre_snap")
        .when(frame == snap, "snap")
        .when(frame == end, "play_end")
        .otherwise("play")
    )


def frame_phases(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Phase of every frame of every play; an open play reaches to its run's last known frame."""
    closed = closed_windows(segments.withColumn("true_end", F.col("end_frame")), samples)
    frames = closed.withColumn("frame_id", F.explode(F.sequence("start_frame", "end_frame"))).withColumn("end_frame", F.col("true_end"))
    return frames.select(*KEYS, "frame_id", phase_of(F.col("frame_id")).alias("phase"))


def phase_counts(phases: DataFrame) -> DataFrame:
    """Frames of each play in each of the phases, zero-filled."""
    counted = phases.groupBy(*KEYS).agg(*(F.count_if(F.col("phase") == p).alias(p) for p in PHASES))
    return counted.unpivot(KEYS, list(PHASES), "phase", "n_frames")


def segment_of_frames(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """(run_id, frame_id) with the play that holds it and its phase; frames of no play are outside."""
    found = in_windows(frames, segments.select(*KEYS, "start_frame", "snap_frame", "end_frame")).select("run_id", "frame_id", "play_id", phase_of(F.col("frame_id")).alias("phase"))
    return frames.join(found, ["run_id", "frame_id"], "left").withColumn("phase", F.coalesce("phase", F.lit("outside_play")))


def play_records(segments: DataFrame, fps: float) -> DataFrame:
    """The exchange form of segments: an unknown end is -1 with a note, and boundaries are listed as events."""
    def event(b: str, kind: str) -> Column:
        at = F.col(f"{b}_frame")
        return F.struct(F.lit(kind).alias("type"), at.alias("frame_id"), F.round(at / fps, 6).alias("timestamp_s"), F.col(f"{b}_source").alias("source"), F.when(at.isNotNull(), F.col(f"{b}_confidence")).alias("confidence"))

    events = F.when(F.col("end_frame").isNull(), F.array(event("snap", "snap"))).otherwise(F.array(event("snap", "snap"), event("end", "play_end")))
    note = F.array_compact(
        F.array(
            F.when(F.col("snap_frame").isNull(), F.concat(F.lit("snap refused: "), F.col("snap_reason"))),
            F.when(F.col("end_frame").isNull(), F.concat(F.lit("play_end refused: "), F.col("end_reason"))),
            F.when(F.col("end_frame").isNull(), F.lit("end_frame unresolved: exported as sentinel -1")),
        )
    )
    return segments.select(*KEYS, "start_frame", "snap_frame", F.coalesce("end_frame", F.lit(-1)).cast("long").alias("end_frame"), "x_coord_mode", F.to_json(events).alias("events"), F.array_join(note, "; ").alias("notes"))


def segment_durations(segments: DataFrame, fps: float) -> DataFrame:
    """Frames of each closed play, and its boundaries in seconds."""
    seconds = {f"{b}_s": F.round(F.col(f"{b}_frame") / fps, 6) for b in ("start", "snap", "end")}
    return segments.select(*KEYS, (F.col("end_frame") - F.col("start_frame") + 1).alias("n_frames"), *(v.alias(k) for k, v in seconds.items()))


def trajectory_counters(samples: DataFrame) -> DataFrame:
    """Per track: samples by position source, track state and geometry state."""
    def having(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    return samples.groupBy("run_id", "track_id").agg(
        F.count("*").alias("n_samples"),
        having("position_source", "measured_smoothed").alias("n_measured"),
        having("position_source", "predicted_dead_reckoning").alias("n_predicted"),
        having("track_state", "observed").alias("n_observed"),
        having("track_state", "coasted").alias("n_coasted"),
        *(having("geometry_state", g).alias(f"n_{g}") for g in ("calibrated", "propagated", "unknown")),
    )


def review_diagnostics(samples: DataFrame) -> DataFrame:
    """Per run: distinct observed tracks, most observed at a frame, frames of reference, projectable frames."""
    observed = F.col("track_state") == "observed"
    frames = samples.groupBy("run_id", "frame_id").agg(F.count_if(observed).alias("n"), F.max(F.col("geometry_state") != "unknown").alias("projectable"))
    per_run = frames.groupBy("run_id").agg(F.count("*").alias("n_frames"), F.max("n").alias("max_observed"), F.count_if(F.col("projectable")).alias("projectable_frames"))
    ids = samples.groupBy("run_id").agg(F.countDistinct(F.when(observed, F.col("track_id"))).alias("observed_tracks"), F.countDistinct("coordinate_frame_id").alias("coordinate_frames"))
    return per_run.join(ids, "run_id")
