"""Analysis documents as tables of one folder: videos, runs, frames, tracks, observations and plays.

A run's id is the SHA-256 of its document in canonical form, so importing a document again changes nothing. Rows of a
run are partitions that become visible only when its row in the table of runs is written, which comes last: a run that
failed half-way leaves no trace in any read, and its partitions are overwritten by the next attempt.

The store has a version; others, and folders that hold something else, are refused. Version 1, whose observations lack
a segment, is rewritten.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.shipping import ship_package

APPLICATION, VERSION = "playlake-store", 2
MODES = ("absolute", "relative_10yd", "relative_5yd")
TABLES = {
    "frames": "run_id string, frame_id long",
    "tracks": "run_id string, track_id long",
    "observations": "run_id string, track_id long, frame_id long, observed int, x1 double, y1 double, x2 double, y2 double, confidence double, x_yd double, y_yd double, x_coord_mode string, coordinate_frame_id string, coordinate_segment long",
    "plays": "run_id string, play_id string, start_frame long, snap_frame long, end_frame long, play_json string",
}
RUNS = "run_id string, video_sha256 string, fps double, source_kind string, pipeline_sha256 string, package_version string, analysis_json string"


def canonical(document: dict) -> str:
    """The document's one form: sorted keys, no blanks, no infinities."""
    return json.dumps(document, sort_keys=True, separators=(",", ":"), allow_nan=False)


def run_id_of(document: dict) -> str:
    return hashlib.sha256(canonical(document).encode()).hexdigest()


def _whole(value, least: int, what: str) -> int:
    if type(value) is not int or value < least:
        raise ValueError(f"{what} must be a whole number from {least}")
    return value


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{what} must be a finite number")
    return float(value)


def _numbers(value, n: int, what: str) -> list[float]:
    if not isinstance(value, list | tuple) or len(value) != n:
        raise ValueError(f"{what} must be {n} numbers")
    return [_number(v, what) for v in value]


def _player(player: dict) -> dict:
    if type(player.get("observed")) is not bool:
        raise ValueError("observed must be given")
    x1, y1, x2, y2 = _numbers(player["bbox"], 4, "bbox")
    if not (x2 > x1 and y2 > y1):
        raise ValueError("bbox must have an area")
    xy, mode, origin, sure, segment = (player.get(k) for k in ("field_position", "x_coord_mode", "coordinate_frame_id", "detection_confidence", "coordinate_segment"))
    if xy is not None and not (player["observed"] and mode in (*MODES, "relative") and isinstance(origin, str) and origin):
        raise ValueError("a position must be observed, with a mode and a frame of reference")
    x, y = (None, None) if xy is None else _numbers(xy, 2, "field_position")
    return {
        "track_id": _whole(player["track_id"], 1, "track_id"), "observed": int(player["observed"]), "x1": x1, "y1": y1, "x2": x2, "y2": y2, "confidence": None if sure is None else _number(sure, "detection_confidence"),
        "x_yd": x, "y_yd": y, "x_coord_mode": mode, "coordinate_frame_id": origin, "coordinate_segment": None if segment is None else _whole(segment, 0, "coordinate_segment"),
    }


def rows_of(document: dict) -> tuple[dict, dict[str, list[dict]]]:
    """The run's row, and the rows of the other tables; raises if the document breaks a rule."""
    if not isinstance(document, dict) or type(document.get("schema_version")) is not int or document["schema_version"] != 1:
        raise ValueError("schema_version must be 1")
    run, video, fps = run_id_of(document), document.get("video_sha256"), _number(document.get("fps"), "fps")
    if not isinstance(video, str) or not re.fullmatch("[0-9a-f]{64}", video) or fps <= 0 or document.get("source_kind") not in ("real", "synthetic"):
        raise ValueError("a video digest, positive fps and a source_kind are needed")
    frames = document.get("frames")
    if not isinstance(frames, list) or not frames:
        raise ValueError("frames must be given")
    out: dict[str, list[dict]] = {t: [] for t in TABLES}
    known, tracks = set(), set()
    for frame in frames:
        fid = _whole(frame["frame_id"], 0, "frame_id")
        if fid in known:
            raise ValueError("a frame occurs twice")
        known.add(fid)
        out["frames"].append({"run_id": run, "frame_id": fid})
        players = [_player(p) for p in frame["players"]]
        if len({p["track_id"] for p in players}) < len(players):
            raise ValueError("a track occurs twice in a frame")
        tracks |= {p["track_id"] for p in players}
        out["observations"] += [{"run_id": run, "frame_id": fid, **p} for p in players]
    out["tracks"] = [{"run_id": run, "track_id": t} for t in sorted(tracks)]
    names = set()
    for play in document.get("plays", []):
        name, bounds = play["play_id"], [play["segment"].get(k) for k in ("start_frame", "snap_frame", "end_frame")]
        start = _whole(bounds[0], 0, "start_frame")
        for b in bounds[1:]:
            if b is not None and _whole(b, 0, "a play's frame") < start:
                raise ValueError("a play's frames must not precede its start")
        if not isinstance(name, str) or not name or name in names or any(b is not None and b not in known for b in bounds):
            raise ValueError("plays need names of their own and frames of the run")
        if None not in bounds[1:] and bounds[1] > bounds[2]:
            raise ValueError("a play's snap must not follow its end")
        names.add(name)
        out["plays"].append({"run_id": run, "play_id": name, "start_frame": start, "snap_frame": bounds[1], "end_frame": bounds[2], "play_json": json.dumps(play, allow_nan=False)})
    head = {"run_id": run, "video_sha256": video, "fps": fps, "source_kind": document["source_kind"], "pipeline_sha256": document.get("pipeline_sha256"), "package_version": document.get("package_version"), "analysis_json": canonical(document)}
    return head, out


class Store:
    """The tables below one folder. Opening makes or migrates it; `readonly` does neither."""

    def __init__(self, spark: SparkSession, path: str, readonly: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        ship_package(spark)
        found = self._meta()
        if found is None and (readonly or self._exists(self.path)):
            raise ValueError("not a store, or an unrelated folder")
        if found is None:
            self._set_meta(VERSION)
        elif found[0] != APPLICATION or found[1] not in (1, VERSION):
            raise ValueError("a store of another application or version")
        elif found[1] == 1 and not readonly:
            self._migrate()

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs().exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))

    def _meta(self) -> tuple[str, int] | None:
        if not self._exists(f"{self.path}/meta"):
            return None
        r = self.spark.read.json(f"{self.path}/meta", schema="application string, version int").collect()
        return (r[0][0], r[0][1]) if r else None

    def _set_meta(self, version: int) -> None:
        self.spark.createDataFrame([(APPLICATION, version)], "application string, version int").coalesce(1).write.mode("overwrite").json(f"{self.path}/meta")

    def _migrate(self) -> None:
        """Give observations a segment, and keep everything else as it is."""
        if self._exists(f"{self.path}/observations"):
            old = self.spark.read.parquet(f"{self.path}/observations")
            if "coordinate_segment" not in old.columns:
                made = old.withColumn("coordinate_segment", F.lit(None).cast("long"))
                made.select(*[c.split()[0] for c in TABLES["observations"].split(", ")]).write.mode("overwrite").partitionBy("run_id").parquet(f"{self.path}/observations-new")
                jvm, fs = self.spark.sparkContext._jvm, self._fs()
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/observations"), True)
                fs.rename(jvm.org.apache.hadoop.fs.Path(f"{self.path}/observations-new"), jvm.org.apache.hadoop.fs.Path(f"{self.path}/observations"))
        self._set_meta(VERSION)

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS)

    def videos(self) -> DataFrame:
        """The distinct videos of all runs."""
        return self.runs().select("video_sha256").distinct()

    def table(self, name: str) -> DataFrame:
        """Rows of the imported runs."""
        return self._read(name, TABLES[name]).join(self.runs().select("run_id"), "run_id", "left_semi")

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def import_documents(self, texts: DataFrame) -> DataFrame:
        """Import documents from a column `text`, and return (run_id, inserted) of each distinct one.

        All documents are checked before anything is written. Documents are parsed by the executors; only ids
        of runs come to the driver's plan.
        """
        parsed = texts.select("text").mapInPandas(_parse, "run_id string, violation string, head string, body string").persist()
        try:
            bad = parsed.where("violation is not null").select("violation").limit(3).collect()
            if bad:
                raise ValueError(f"import: {[r[0] for r in bad]}")
            distinct = parsed.dropDuplicates(["run_id"])
            result = distinct.join(self.runs().select("run_id", F.lit(False).alias("inserted")), "run_id", "left").select("run_id", F.coalesce("inserted", F.lit(True)).alias("inserted"))
            result = self.spark.createDataFrame(result.collect(), "run_id string, inserted boolean")  # a row per document
            new = distinct.join(result.where("inserted"), "run_id", "left_semi")
            if result.where("inserted").limit(1).count():
                for name, schema in TABLES.items():
                    plain = ", ".join(c for c in schema.split(", ") if not c.startswith("run_id"))
                    rows = new.select("run_id", F.explode(F.from_json(F.get_json_object("body", f"$.{name}"), f"array<struct<{', '.join(c.replace(' ', ': ', 1) for c in plain.split(', '))}>>")).alias("r")).select("run_id", "r.*")
                    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{self.path}/{name}")
                heads = new.select(F.from_json("head", RUNS).alias("h")).select("h.*")
                heads.write.mode("append").parquet(f"{self.path}/runs")  # the run exists from here on
            return result
        finally:
            parsed.unpersist()

    def report(self, run_id: str, name: str) -> DataFrame:
        """One of the fixed reports of a run: tracks, coverage or runs."""
        from playlake.operators.reports import coverage_report, run_report, track_report

        if name not in ("tracks", "coverage", "runs"):
            raise ValueError("unknown report")
        if not self.runs().where(F.col("run_id") == run_id).limit(1).count():
            raise ValueError("unknown run_id")
        if name == "runs":
            return run_report(self.runs(), self.table("frames"), self.table("tracks"), run_id)
        own = self.table("observations").where(F.col("run_id") == run_id)
        return track_report(own).orderBy("track_id") if name == "tracks" else coverage_report(own)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch["text"]:
            try:
                head, body = rows_of(json.loads(text))
                out.append((head["run_id"], None, json.dumps(head), json.dumps(body)))
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                out.append((None, f"{type(e).__name__}: {e}", None, None))
        yield pd.DataFrame(out, columns=["run_id", "violation", "head", "body"])


def open_store(spark: SparkSession, path: str) -> Store:
    """An existing store, for reading; raises where there is none."""
    try:
        return Store(spark, path, readonly=True)
    except AnalysisException as e:
        raise ValueError("not a store") from e
