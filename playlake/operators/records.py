"""Rules that records must keep, as queries of the rows that break them, and their exchange form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_broken(rules: dict[str, Column]) -> Column:
    out = None
    for name, broken in rules.items():
        test = F.coalesce(broken, F.lit(False))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def check_samples(samples: DataFrame) -> DataFrame:
    """(run_id, track_id, frame_id, violation) of trajectory samples that claim what they can't.

    A position needs known geometry and a source, a source needs a position or prediction, a prediction must be named
    as one, and a yard line needs absolute coordinates, if there is a column for it.
    """
    source, placed, guessed = F.col("position_source"), F.col("x_yd").isNotNull(), F.col("predicted_x").isNotNull()
    rules = {
        "position_in_unknown_geometry": placed & (F.col("geometry_state") == "unknown"),
        "position_without_source": placed & (source == "none"),
        "source_without_position": (source != "none") & ~placed & ~guessed,
        "unnamed_prediction": guessed & (source != "predicted_dead_reckoning"),
    }
    if "absolute_yardline" in samples.columns:
        rules["yardline_without_absolute_mode"] = F.col("absolute_yardline").isNotNull() & (F.col("x_coord_mode") != "absolute")
    return samples.withColumn("violation", _first_broken(rules)).where("violation is not null").select("run_id", "track_id", "frame_id", "violation")


def check_segments(segments: DataFrame) -> DataFrame:
    """(run_id, play_id, violation) of plays whose boundaries, sources, reasons and confidences disagree."""
    start, snap, end = F.col("start_frame"), F.col("snap_frame"), F.col("end_frame")
    rules = {"negative_start": start < 0, "end_before_start": end < start, "snap_before_start": snap < start, "snap_after_end": snap > end}
    for b, known in (("snap", ("manual", "collective_motion_onset", "unavailable")), ("end", ("manual", "motion_cessation", "unavailable"))):
        frame, source = F.col(f"{b}_frame"), F.col(f"{b}_source")
        rules[f"unknown_{b}_source"] = ~source.isin(*known)
        rules[f"{b}_and_source_disagree"] = frame.isNull() != (source == "unavailable")
        rules[f"{b}_refused_without_reason"] = (source == "unavailable") & (F.coalesce(F.length(f"{b}_reason"), F.lit(0)) == 0)
        rules[f"{b}_confidence_out_of_range"] = ~F.coalesce(F.col(f"{b}_confidence").between(0.0, 1.0), F.lit(False))
    return segments.withColumn("violation", _first_broken(rules)).where("violation is not null").select("run_id", "play_id", "violation")


def refuse_duplicates(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """`rows`, after a check that no key occurs twice; raises and names a few if one does."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{what}: {[tuple(r) for r in twice]} occur more than once")
    return rows


def player_records(tracks: DataFrame, samples: DataFrame) -> DataFrame:
    """Tracks with the position of their sample at the same frame, where there is one."""
    own = samples.select("run_id", "track_id", "frame_id", "x_yd", "y_yd", "x_coord_mode", "coordinate_frame_id", "coordinate_segment")
    return tracks.join(own, ["run_id", "track_id", "frame_id"], "left")


def documents(observations: DataFrame) -> DataFrame:
    """(run_id, frames): each run's observations as one JSON list of frames, in order, each with its players by track.

    A run becomes one value, so this is for the exchange of runs that fit into memory one by one.
    """
    box = F.array("x1", "y1", "x2", "y2").alias("bbox")
    xy = F.when(F.col("x_yd").isNotNull(), F.array("x_yd", "y_yd")).alias("field_position")
    player = F.struct("track_id", box, (F.col("observed") == 1).alias("observed"), F.col("confidence").alias("detection_confidence"), xy, "x_coord_mode", "coordinate_frame_id", "coordinate_segment")
    frames = observations.groupBy("run_id", "frame_id").agg(F.array_sort(F.collect_list(player)).alias("players"))
    return frames.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("frame_id", "players")))).alias("frames"))
