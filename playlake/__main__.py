"""Command line: import documents into a store, print its reports, track detections, review a run."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _import(spark: SparkSession, a: argparse.Namespace) -> None:
    from playlake.storage.store import Store

    texts = spark.read.text(a.documents, wholetext=True).select(F.col("value").alias("text"))
    for r in Store(spark, a.store).import_documents(texts).collect():
        print(r["run_id"], "inserted" if r["inserted"] else "known")


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    from playlake.storage.store import open_store

    for r in open_store(spark, a.store).report(a.run, a.name).toJSON().toLocalIterator():
        print(r)


def _track(spark: SparkSession, a: argparse.Namespace) -> None:
    from playlake.folds.tracker import track

    track(spark.read.parquet(a.frames), spark.read.parquet(a.detections)).write.mode("errorifexists").parquet(a.output)


def _review(spark: SparkSession, a: argparse.Namespace) -> None:
    from playlake.review import write_review

    samples = spark.read.parquet(a.samples)
    run = samples.select(F.lit(a.run).cast(samples.schema["run_id"].dataType)).first()[0]
    write_review(spark, samples, spark.read.parquet(a.labels), run, a.output, a.fps, a.estimate_ends)


def parser() -> argparse.ArgumentParser:
    """The commands and their arguments."""
    p = argparse.ArgumentParser("playlake", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, run, arguments in (
        ("import", _import, ("store", "documents")),
        ("report", _report, ("store", "run", "name")),
        ("track", _track, ("frames", "detections", "output")),
        ("review", _review, ("samples", "labels", "run", "output")),
    ):
        c = commands.add_parser(name)
        c.set_defaults(run_command=run)
        for argument in arguments:
            c.add_argument(argument, **({"choices": ("tracks", "coverage", "runs")} if argument == "name" else {}))
        if name == "review":
            c.add_argument("--fps", type=float, default=30.0)
            c.add_argument("--estimate-ends", action="store_true")
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run_command(SparkSession.builder.appName("playlake").getOrCreate(), a)


if __name__ == "__main__":
    main()
