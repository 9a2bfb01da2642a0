"""Registered queries of the tracking operators over the domain tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake import domain
from playlake.functions import geometry
from playlake.operators import evidence, events, formations, play, reports, routes, segments, windows

Query = Callable[[SparkSession, str], DataFrame]


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir)
    return s.select("run_id", "track_id", "frame_id", F.when(F.col("track_state") == "observed", 1).otherwise(0).alias("observed"), (F.col("k") / F.lit(100.0)).alias("confidence"), "x_yd", "y_yd")


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = domain.samples(spark, sf_dir)
    closed = windows.closed_windows(domain.plays(s), s)
    return s, closed, evidence.motion_evidence(s, closed)


def motion_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)[2].withColumn("moving_fraction", F.round("moving_fraction", 6))


def evidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_buckets(domain.samples(spark, sf_dir))


def exclusion_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir)
    return evidence.exclusion_totals(s, domain.plays(s))


def evidence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.evidence_totals(_evidence(spark, sf_dir)[2])


def snap_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.snap_onset(*_evidence(spark, sf_dir))


def play_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir)
    snap = F.when(F.col("run_id") % 3 != 2, 20).cast("long")  # a third of the runs has no snap
    return evidence.play_end(s, domain.plays(s).where("play_id = 'p1'").withColumn("snap_frame", snap))


def play_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir)
    snap = F.when(F.col("run_id") % 3 != 2, F.col("start_frame") + 15)
    return play.play_metrics(s, domain.plays(s).withColumn("snap_frame", snap), 10.0)


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = domain.samples(spark, sf_dir)
    return s, segments.segment_plays(s, domain.labels(s), automatic_end=True)


def play_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)[1]


def segment_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.refusals(_segments(spark, sf_dir)[1])


def segment_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_counters(_segments(spark, sf_dir)[1])


def segment_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_durations(_segments(spark, sf_dir)[1], 10.0)


def segment_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, found = _segments(spark, sf_dir)
    return segments.segment_of_frames(s.select("run_id", "frame_id").distinct(), found)


def frame_phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, found = _segments(spark, sf_dir)
    return segments.phase_counts(segments.frame_phases(found, s))


def play_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = segments.play_records(_segments(spark, sf_dir)[1], 10.0)
    return made.withColumn("n_events", F.json_array_length("events")).drop("events")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.timeline(*_segments(spark, sf_dir))


def unavailable_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.unavailable_kinds(_segments(spark, sf_dir)[1])


def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with a rule broken in most runs."""
    good, case = domain.labels(domain.samples(spark, sf_dir)), F.col("run_id") % 5
    broken = good.withColumns(
        {
            "play_id": F.concat("play_id", F.when(case == 4, "x").otherwise("")),
            "start_frame": F.col("start_frame") - F.when(case == 1, 40).otherwise(0),
            "snap_frame": F.col("snap_frame") + F.when(case == 2, 90).otherwise(0),
            "end_frame": F.col("end_frame") - F.when(case == 3, 50).otherwise(0),
        }
    )
    none = F.lit(None).cast("long")
    twice = good.where((case == 0) & (F.col("play_id") == "p1")).select("run_id", "play_id", F.lit(5).cast("long").alias("start_frame"), none.alias("snap_frame"), F.lit(20).cast("long").alias("end_frame"))
    return segments.check_labels(broken.unionByName(twice))


def trajectory_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.trajectory_counters(domain.samples(spark, sf_dir))


def review_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.review_diagnostics(domain.samples(spark, sf_dir))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.route_islands(domain.samples(spark, sf_dir))


def route_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.route_segments(_islands(spark, sf_dir), 20, 26.0, -1)


def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.route_status(routes.route_segments(_islands(spark, sf_dir), 20))


def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.line_crossings(_islands(spark, sf_dir), 26.0)


def presnap_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.presnap_motion(_islands(spark, sf_dir), 20)


def nearest_defender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.nearest_defender(domain.samples(spark, sf_dir))


def sideline_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sideline_exits(domain.samples(spark, sf_dir)).select("run_id", "track_id", "frame_id", "sideline")


def formation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formations.formation_status(domain.samples(spark, sf_dir))


def formation_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formations.formation_shapes(domain.samples(spark, sf_dir))


def nearest_teammate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formations.nearest_teammates(domain.samples(spark, sf_dir))


def box_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formations.box_counts(domain.samples(spark, sf_dir), "TEAM_B", 35.0, 26.0, 8.0, 12.0)


def report_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.track_report(_observations(spark, sf_dir))


def report_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.coverage_report(_observations(spark, sf_dir))


def report_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or three runs share a video; the report is of the video of run 1, or of run 0 where there is no other."""
    s = domain.samples(spark, sf_dir)
    runs = s.select("run_id", F.floor(F.col("run_id") / 3).cast("string").alias("video_sha256")).distinct()
    return reports.run_report(runs, s.select("run_id", "frame_id").distinct(), s.select("run_id", "track_id").distinct(), 0)


def missing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.missing_frames(_observations(spark, sf_dir))


def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.label_overlaps(domain.plays(domain.samples(spark, sf_dir)))


def window_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir)
    return windows.tracks_in_windows(s, domain.plays(s))


def longest_observed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.longest_observed_runs(_observations(spark, sf_dir))


def recovery_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recovery_latency(_observations(spark, sf_dir))


def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    cell = F.concat(F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", " =", "x"))), (F.col("n_nationkey") % 6 + 1).cast("int")), "n_name")
    return n.select("n_nationkey", cell.alias("cell")).select("n_nationkey", reports.guard_csv("cell").alias("cell"))


def homography_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = domain.samples(spark, sf_dir).where("x_yd is not null")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("double").alias("a"), F.col("n_nationkey").cast("int").alias("cal"))
    j = s.join(F.broadcast(n), F.col("cal") == F.col("run_id") % 25)  # 25 nations, whatever the scale
    a = F.col("a")
    h = [1 + a / 100, a / 50, a, a / 200, 1 - a / 100, -a, a / 10000, a / 20000, F.lit(1.0)]
    x, y = geometry.project(h, F.col("x_yd"), F.col("y_yd"))
    xx, xy, yy = geometry.propagate(geometry.jacobian(h, F.col("x_yd"), F.col("y_yd")), (F.lit(0.01), F.lit(0.001), F.lit(0.02)), geometry.confidence_inflation(F.col("k") / F.lit(100.0)), 0.05)
    return j.select("run_id", "track_id", "frame_id", F.round(x, 6).alias("fx"), F.round(y, 6).alias("fy"), F.round(xx, 10).alias("cov_xx"), F.round(xy, 10).alias("cov_xy"), F.round(yy, 10).alias("cov_yy"), F.round(geometry.mahalanobis2(F.lit(0.1), F.lit(-0.2), (xx, xy, yy)), 4).alias("d2"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        motion_evidence, evidence_buckets, exclusion_totals, evidence_totals, snap_onset, play_end, play_metrics, play_segments, segment_refusals, segment_counters, segment_durations,
        segment_of_frames, frame_phase_counts, play_records, timeline, unavailable_kinds, label_violations, trajectory_counters, review_diagnostics, route_segments,
        route_status, line_crossings, presnap_motion, nearest_defender, sideline_exits, formation_status, formation_shape, nearest_teammate, box_count, report_tracks, report_coverage,
        report_runs, missing_frames, label_overlap, window_semi, longest_observed_run, recovery_latency, csv_guard, homography_project,
    )
}
