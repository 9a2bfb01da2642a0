"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder. A table written there cuts lineage: a lost executor
costs a re-read, not a recomputation. Tables that a result still reads live until the session ends;
the others are dropped as soon as their consumer has been written.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.shipping import ship_package

#: Name of the row key that `with_row` adds; a leading underscore keeps it clear of user columns.
ROW = "_row_key"
_PATH, _AT, _FILE = "_row_path", "_row_at", "_row_file"
#: Rows that a file may hold for keys of its own.
FILE_ROWS = 1 << 40
#: Row keys up to which they are broadcast.
BROADCAST_KEYS = 1_000_000
#: Whole texts that go to a Python worker at once.
BATCH_TEXTS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is named, as in tests, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = tempfile.mkdtemp(prefix="playlake-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """A family of intermediate tables below the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.drop_all)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` once and return it as a table read back from the shared folder."""
        path = f"{self.root}/{name}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        self._release_shuffles()
        return self.spark.read.schema(df.schema).parquet(path)

    def _release_shuffles(self) -> None:
        """Let go of the shuffle files of finished writes: they stay on disk until the driver collects garbage."""
        gc.collect()  # of Python's handles on plans
        self.spark.sparkContext._jvm.java.lang.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def drop_all(self) -> None:
        """Delete all tables; results that still read them become unreadable."""
        try:
            self._delete(self.root)
        except Exception:  # the session is already gone; its folder is the cluster's to clear
            return

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Plans that pass each row of a scan on once at most, so that its place in its file still names it.
_KEEPING = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "View", "Repartition", "RepartitionByExpression", "RebalancePartitions", "Sort"}


def _is_scan(docs: DataFrame) -> bool:
    """Whether a table is a scan of files with nothing but deterministic selections above it."""
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        if plan.nodeName().split(" ")[0] not in _KEEPING or not plan.deterministic():
            return False
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return True


def with_row(docs: DataFrame) -> DataFrame:
    """Add a key for each row, the same at every read, however the read is split.

    Documents may repeat a doc_id or lack one, so operators join on this key. In a scan of Parquet files
    it is the file's number, by path, and the row's place in the file. Of any other table, as one that is
    joined, united or sampled, the keyed rows are written once and read back. A column that
    already has the key's name is replaced; `drop_rows` keeps a caller's.
    """
    docs = docs.drop(ROW)
    place = None
    if _is_scan(docs):
        try:
            place = docs.metadataColumn("_metadata")
            placed = docs.select("*", place["file_path"].alias(_PATH), place["row_index"].alias(_AT))
        except AnalysisException:  # files of another format
            place = None
    if place is None:
        return Scratch(docs.sparkSession, "keyed").save(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    paths = sorted(r[_PATH] for r in placed.select(_PATH).distinct().collect())  # as many as the table has files
    if len(paths) < 2:
        return placed.withColumn(ROW, F.col(_AT)).drop(_PATH, _AT)
    files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), f"{_PATH} string, {_FILE} long")
    number = F.coalesce(_FILE, F.raise_error(F.lit("a file was added while its table was read")).cast("long"))
    keyed = placed.join(F.broadcast(files), _PATH, "left").withColumn(ROW, number * FILE_ROWS + F.col(_AT))
    return keyed.select(*[F.col(f"`{c}`") for c in docs.columns], ROW)


def drop_rows(spark: SparkSession, docs: DataFrame, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`docs` without the rows whose keys `choose` returns, with all their columns.

    `choose` gets the rows with their keys. A column of the caller's that is named like the key is put aside
    meanwhile. Keys to drop are written once, and broadcast if they are counted to be few.
    """
    aside = next(n for i in range(len(docs.columns) + 1) if (n := f"{ROW}_{i}") not in docs.columns)
    keyed = with_row(docs.withColumnRenamed(ROW, aside))
    dropped = Scratch(spark, "dropped").save(choose(keyed).select(ROW), "keys")
    if dropped.count() <= BROADCAST_KEYS:
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, ROW, "left_anti").drop(ROW).withColumnRenamed(aside, ROW)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hand texts to Python in small batches while something is written.

    A batch stands in memory several times, in the executor and in its worker, and Spark's usual
    10,000 texts may be the whole of a partition. Smaller batches that the session asks for stay.
    """
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_TEXTS:
        spark.conf.set(_BATCH, str(BATCH_TEXTS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def partitions_for(spark: SparkSession, items: int, per_partition: int) -> int:
    """As many partitions as bring each to about `per_partition` items, and the session's at least."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-items // per_partition))
