"""Streaming forms: tables of observations as they arrive, folded by run with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.folds.calibration import propagate_stream
from playlake.folds.tracker import track_stream
from playlake.folds.trajectory import trajectory_stream

__all__ = ["count_observed", "propagate_stream", "read_table", "track_stream", "trajectory_stream"]


def read_table(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def count_observed(samples: DataFrame, late: str = "10 seconds", window: str = "1 second") -> DataFrame:
    """Observed samples and distinct positions of each run in windows of play time, late rows being dropped after a while.

    `samples` has timestamp_s, which counts from the run's start.
    """
    timed = samples.withColumn("at", F.timestamp_seconds("timestamp_s")).withWatermark("at", late)
    return timed.groupBy("run_id", F.window("at", window)).agg(F.count_if(F.col("track_state") == "observed").alias("n_observed"), F.count("x_yd").alias("n_positioned"))
