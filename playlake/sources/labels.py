"""Readers of play labels and helmet labels, and the writer of long metric tables.

Readers refuse: they return a table of violations beside the rows, and `refuse` raises on any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.operators.reports import guard_csv

PLAYS = "game_id STRING, plays ARRAY<STRUCT<play_id: STRING, start_frame: BIGINT, snap_frame: BIGINT, end_frame: BIGINT>>"
HELMETS = "video STRING, frame STRING, label STRING, left DOUBLE, top DOUBLE, width DOUBLE, height DOUBLE, isSidelinePlayer STRING"


def refuse(violations: DataFrame, what: str) -> None:
    """Raise if there is any violation; names a few."""
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def read_play_labels(spark: SparkSession, path: str) -> DataFrame:
    """Plays of label documents; refuses empty ids, negative or reversed frames and repeated plays."""
    plays = spark.read.schema(PLAYS).json(path, multiLine=True).select("game_id", F.explode("plays").alias("p")).select("game_id", "p.*")
    bad = F.coalesce(F.length("game_id") == 0, F.lit(True)) | F.coalesce(F.length("play_id") == 0, F.lit(True)) | F.coalesce(F.col("start_frame") < 0, F.lit(True))
    bad |= F.coalesce(F.col("end_frame") < F.col("start_frame"), F.lit(True)) | F.coalesce((F.col("snap_frame") < F.col("start_frame")) | (F.col("snap_frame") > F.col("end_frame")), F.lit(False))
    refuse(plays.where(bad), "play labels")
    refuse(plays.groupBy("game_id", "play_id").count().where("count > 1"), "repeated play labels")
    return plays


def read_helmet_labels(spark: SparkSession, path: str, videos: DataFrame) -> DataFrame:
    """Boxes of helmets in the selected videos, frames counted from 0.

    Refuses frames that aren't positive integers, empty boxes, flags other than TRUE or FALSE and
    repeated (video, frame, label).
    """
    rows = spark.read.schema(HELMETS).csv(path, header=True, enforceSchema=False).join(videos.select("video").distinct(), "video", "left_semi")
    bad = F.coalesce(~F.col("frame").rlike("^[1-9][0-9]*$"), F.lit(True)) | ~F.coalesce(F.col("isSidelinePlayer").isin("TRUE", "FALSE"), F.lit(False))
    bad |= F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0) | F.isnan("left") | F.isnan("top"), F.lit(True)) | F.col("left").isNull() | F.col("top").isNull()
    refuse(rows.where(bad), "helmet labels")
    refuse(rows.groupBy("video", "frame", "label").count().where("count > 1"), "repeated helmet labels")
    return rows.select(
        "video", (F.col("frame").cast("long") - 1).alias("frame_id"), "label", F.col("left").alias("x1"), F.col("top").alias("y1"),
        (F.col("left") + F.col("width")).alias("x2"), (F.col("top") + F.col("height")).alias("y2"), (F.col("isSidelinePlayer") == "TRUE").alias("on_sideline"),
    )


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """Write a long metric table; NULL is blank, and text can't be read as a formula."""
    guarded = metrics.select(*(guard_csv(c).alias(c) if t == "string" else F.col(c) for c, t in metrics.dtypes))
    guarded.write.mode("errorifexists").csv(path, header=True, nullValue="")
