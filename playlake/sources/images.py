"""Detectors over tables of images: a callable per image, run by the executors in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.shipping import ship_package

#: An image's bytes and frame_id give boxes as (x1, y1, x2, y2, confidence).
Detector = Callable[[bytes, int], list[tuple[float, float, float, float, float]]]
BOXES = "run_id int, frame_id long, box_id long, x1 double, y1 double, x2 double, y2 double, confidence double, detector string"

_factories: dict[str, Callable[..., Detector]] = {}


def register_detector(name: str, factory: Callable[..., Detector]) -> None:
    """Make a detector known by name; a name is given once."""
    if name in _factories:
        raise ValueError(f"detector {name} is known already")
    _factories[name] = factory


def make_detector(name: str, **parameters) -> Detector:
    """The named detector. An unknown name is an error, never another detector."""
    if name not in _factories:
        raise ValueError(f"unknown detector {name}; known are {sorted(_factories)}")
    return _factories[name](**parameters)


def read_images(spark: SparkSession, path: str, pattern: str = r"frame_?([0-9]+)\.") -> DataFrame:
    """(path, frame_id, content) of image files whose names hold their frame's number."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.regexp_extract("path", pattern, 1).try_cast("long").alias("frame_id"), "content").where("frame_id is not null")


def detect(images: DataFrame, detector: Detector, name: str, least_confidence: float = 0.0) -> DataFrame:
    """Boxes of images (run_id, frame_id, content), numbered from left to right within their frame."""
    ship_package(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for image in batch.itertuples():
                found = sorted(b for b in detector(bytes(image.content), int(image.frame_id)) if b[4] >= least_confidence)
                rows += [(image.run_id, image.frame_id, i, *map(float, b), name) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BOXES.split(", ")])

    return images.select("run_id", "frame_id", "content").mapInPandas(run, BOXES)


def given_boxes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """A detector that looks its boxes up: those of the given frames; frames without any have none."""
    return boxes.join(frames.select("run_id", "frame_id").distinct(), ["run_id", "frame_id"], "left_semi")
