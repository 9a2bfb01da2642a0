"""Exact deduplication of an incoming batch against an immutable snapshot.

Texts are equal when identical after lower-casing A-Z. A snapshot holds one row per distinct digest,
cut into buckets of bounded size, and a static binary-fuse filter per bucket. Digests of the incoming
batch are first grouped among themselves, then screened by their bucket's filter; positives join the
exact buckets. Every group of two or more rows is confirmed by comparing its texts byte for byte.

Hot groups: rows are counted by digest with map-side partial aggregation, so a group that holds a
third of all rows sends one row per task. Texts of confirmed candidates are aggregated in the same
way. Nothing is collected to the driver.

Edge cases: a null text is the empty text; empty texts form one group like any other; of rows with
equal text and equal doc_id one arbitrary but fixed row stays; a null doc_id ranks below all others;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.llm.fuse_filter import FuseFilter
from playlake.llm.scratch import ROW, Scratch, drop_rows, small_batches, with_row
from playlake.llm.textkit import tidied

#: Distinct digests that a bucket holds on average; bounds the memory of one filter.
BUCKET_KEYS = 100_000
#: Of so many equal shares of the rows, one arrives as the new batch in `exact_dedup`.
BATCH_SHARES = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            body = (text or b"").lower()
            digests.append(hashlib.sha256(body).digest())
            sizes.append(len(body))
        keys = np.frombuffer(b"".join(d[:8] for d in digests), dtype="<i8")
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())],
            names=[ROW, "doc_id", "digest", "n_bytes", "key"],
        )


def digest_documents(docs: DataFrame) -> DataFrame:
    """(row key, doc_id, digest, n_bytes, key) of each row; key is the digest's first 64 bits."""
    return docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        tidied(_digest_batches), f"{ROW} long, doc_id long, digest binary, n_bytes long, key long"
    )


def _groups(digests: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest: the row that stays, and the count."""
    return (
        digests.groupBy("digest", "n_bytes", "key")
        .agg(F.max(F.struct("doc_id", ROW)).alias("last"), F.count("*").alias("n"))
        .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    )


def _filter_of(bucket: pa.Table) -> pa.Table:
    made = FuseFilter.build(bucket.column("key").to_numpy())
    return pa.table(
        {"bucket": bucket.column("bucket")[:1], "seed": pa.array([made.seed], pa.int64()), "segment": pa.array([made.segment], pa.int64()), "segments": pa.array([made.segments], pa.int64()), "prints": pa.array([made.table.tobytes()], pa.binary())}
    )


def _screen_bucket(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    keys = incoming.column("key").to_numpy()
    may = np.zeros(len(keys), bool)
    for f in filters.to_pylist():
        may |= FuseFilter(f["seed"], f["segment"], f["segments"], np.frombuffer(f["prints"], np.uint8)).may_hold(keys)
    return incoming.select(["digest", "n_bytes", "bucket"]).filter(pa.array(may))


class Snapshot:
    """An immutable set of digests: exact buckets, and a filter for each."""

    def __init__(self, groups: DataFrame, filters: DataFrame, buckets: int):
        self.groups, self.filters, self.buckets = groups, filters, buckets

    @classmethod
    def build(cls, digests: DataFrame, scratch: Scratch, name: str = "snapshot") -> Snapshot:
        """Write the buckets of `digests` and their filters."""
        buckets = max(1, digests.count() // BUCKET_KEYS)
        groups = scratch.save(_groups(digests, buckets), f"{name}-groups")
        filters = groups.select("bucket", "key").groupBy("bucket").applyInArrow(_filter_of, "bucket long, seed long, segment long, segments long, prints binary")
        return cls(groups, scratch.save(filters, f"{name}-filters"), buckets)

    def screen(self, incoming: DataFrame) -> DataFrame:
        """The digests of `incoming` groups that the filters can't rule out."""
        return (
            incoming.select("digest", "n_bytes", "key", "bucket")
            .groupBy("bucket")
            .cogroup(self.filters.groupBy("bucket"))
            .applyInArrow(_screen_bucket, "digest binary, n_bytes long, bucket long")
        )


def match_batch(snapshot: Snapshot, digests: DataFrame) -> DataFrame:
    """Groups of an incoming batch: the row that stays in it, its count, and the snapshot's share.

    Groups that exist only within the batch have nulls for the snapshot's columns.
    """
    own = _groups(digests, snapshot.buckets)
    positives = snapshot.screen(own)
    exact = positives.join(snapshot.groups, ["digest", "n_bytes", "bucket"]).select("digest", "n_bytes", F.col("last").alias("snap_last"), F.col("n").alias("snap_n"))
    return own.select("digest", "n_bytes", "last", "n").join(exact, ["digest", "n_bytes"], "left")


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Which row of each group of equal texts stays: the one with the largest doc_id.

    Three of four rows, chosen by a hash of the doc_id, form the snapshot; the others arrive as a
    batch. Returns row key, doc_id, keep_id, group_size, kept, text_sha256, in_snapshot.
    """
    return dedup_rows(spark, with_row(docs))


def dedup_rows(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """`exact_dedup` of rows that have their keys."""
    scratch = Scratch(spark, "exact-dedup")
    docs = keyed.select(ROW, "doc_id", "text")
    with small_batches(spark):
        digests = scratch.save(digest_documents(docs), "digests")
    is_new = F.pmod(F.xxhash64("doc_id"), F.lit(BATCH_SHARES)) == 0
    snapshot = Snapshot.build(digests.where(~is_new), scratch)
    matched = match_batch(snapshot, digests.where(is_new))
    merged = snapshot.groups.select("digest", "n_bytes", "last", "n").unionByName(matched.select("digest", "n_bytes", "last", "n"))
    candidates = scratch.save(
        merged.groupBy("digest", "n_bytes").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.count("*").alias("sides")).where("n > 1"), "candidates"
    )
    confirmed = scratch.save(_confirm(docs, digests, candidates), "confirmed")
    scratch.drop("snapshot-filters", "candidates")
    return (
        digests.join(confirmed, ["digest", "n_bytes"], "left")
        .select(
            ROW,
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col(f"last.{ROW}") == F.col(ROW), F.lit(True)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            (~is_new).alias("in_snapshot"),
        )
    )


def _confirm(docs: DataFrame, digests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Compare the texts of each candidate group byte for byte; refuse if two texts share a digest."""
    members = digests.join(candidates.select("digest", "n_bytes"), ["digest", "n_bytes"], "left_semi").select(ROW, "digest", "n_bytes")
    texts = docs.join(members, ROW).select("digest", "n_bytes", "doc_id", ROW, F.encode(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), "UTF-8").alias("body"))
    classes = texts.groupBy("digest", "n_bytes", "body").agg(F.max(F.struct(F.col("doc_id").cast("long").alias("doc_id"), ROW)).alias("last"), F.count("*").alias("n"))
    whole = classes.groupBy("digest", "n_bytes").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.count("*").alias("bodies"))
    return whole.select("digest", "n_bytes", "last", F.when(F.col("bodies") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))).alias("n"))


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` without the rows that `exact_dedup` drops; all columns stay."""
    return drop_rows(spark, docs, lambda keyed: dedup_rows(spark, keyed).where("not kept"))
