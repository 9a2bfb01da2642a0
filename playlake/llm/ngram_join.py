"""N-gram Jaccard self-join of documents: rare-first prefixes, each pair verified once.

A document's set holds its distinct word 5-grams, as 64-bit hashes. Two documents link when the
Jaccard similarity of their sets reaches `PERCENT` / 100.

1. One pass over the texts gives each document's set size and a 128-bit signature of its set, and a
   sketch of document frequencies over all documents (a fixed number of counters), which is merged in
   a tree. Equal sets become one node.
2. Sets are ordered by frequency class, rarest first, then by hash; a node posts the prefix that
   any linked partner must meet, n - ceil(t n) + 1 grams.
3. One exchange by gram drops postings that no other node shares; they keep their place.
4. Every posting list gets a pivot, the node that shares most of its prefix. Nodes are paired with their
   pivots if the length filter and the positional filter allow. Distinct pairs are verified once: a
   suffix filter on the counts of hash ranges, then exact intersection. Links give components, and only
   lists whose nodes are still in different components go on, with the next pivot, as long as the pairs
   left over would be many. So a list of near copies costs one pair per member, not all pairs.
5. Then all the pairs left in different components that pass both filters are verified, and no link between
   components is lost. Only lists of documents that are unlike each other, yet hold little else than what they share,
   stay long until then; their postings are compared within the join, which lets few pairs through.

The result is the classes that links give, with one row per document; links within a class that is known
already aren't looked for.

Hot keys: the sketch bounds how many documents may share a gram; a gram above `LIST_ROWS` is dealt to as
many parts as that needs, and aggregates of its list come from map-side partial ones. A pivot with more than
`PARTNERS` partners is dealt to several parts, with a copy of its set each, and so is a list of more nodes in
the last step. Sets travel to pairs by joins, never to the driver, which sees counts only.

Edge cases: a text without words, or null, has an empty set and stands alone; fewer than five words
are one gram; copies share their component; a null doc_id never names a component unless all its
members lack one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlake.llm.components import components
from playlake.llm.scratch import BROADCAST_KEYS, ROW, Scratch, drop_rows, small_batches, with_row
from playlake.llm.textkit import grams, hashes_of, mix, tidied

WORDS = 5
PERCENT = 80
#: Bits of a counter's number in the frequency sketch: enough for so many counters per document,
#: between a least and a most, which bounds what is broadcast to 16 MB. Counters in a block, and tasks
#: whose blocks one step merges.
COUNTERS_PER_DOCUMENT = 16
LEAST_BITS, MOST_BITS = 18, 24
BLOCK = 1 << 16
MERGED_TASKS = 64
#: Hash ranges whose counts the suffix filter compares.
RANGES = 32
#: Pivot rounds at most, and pairs per posting below which all that are left are verified at once.
ROUNDS = 2
PAIRS_PER_POSTING = 32
#: Postings of a gram that are dealt to one part, as the sketch bounds them (a power of two).
LIST_ROWS = 1 << 12
#: Partners of a pivot, or of a list's nodes, that go to one part.
PARTNERS = 1_000
#: Nodes up to which they are broadcast to the scan of the texts.
BROADCAST_NODES = BROADCAST_KEYS


def gram_set(text: bytes | None) -> np.ndarray:
    """Distinct 5-gram hashes of a text, ascending; fewer words count as one gram."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(WORDS, len(words))
    return np.unique(grams(hashes_of(words), n) ^ np.uint64((WORDS - n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


_SETS = f"{ROW} long, doc_id long, n long, sig_a long, sig_b long, task int, block int, counts binary"


def _describe(bits: int):
    return tidied(lambda batches: _described(batches, bits))


def _described(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    sketch, shift = np.zeros(1 << bits, np.uint32), np.uint64(64 - bits)
    names = [ROW, "doc_id", "n", "sig_a", "sig_b", "task", "block", "counts"]
    for batch in batches:
        sizes, sig = [], []
        for text in batch.column("text").cast(pa.binary()):
            s = gram_set(text.as_py())
            at, times = np.unique(s >> shift, return_counts=True)
            sketch[at.astype(np.int64)] += times.astype(np.uint32)
            sizes.append(len(s))
            sig.append(_signature(s))
        null = pa.nulls(len(sizes), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(ROW), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([a for a, _ in sig], pa.int64()), pa.array([b for _, b in sig], pa.int64()), null, null, pa.nulls(len(sizes), pa.binary())], names=names
        )
    blocks = [b for b in range(len(sketch) // BLOCK) if sketch[b * BLOCK : (b + 1) * BLOCK].any()]
    none, task = pa.nulls(len(blocks), pa.int64()), TaskContext.get().partitionId()
    packed = [_packed(sketch[b * BLOCK : (b + 1) * BLOCK]) for b in blocks]
    yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array([task] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(packed, pa.binary())], names=names)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<u8").tobytes(), 1)


def _merge_block(block: pa.Table) -> pa.Table:
    total = np.zeros(BLOCK, np.uint64)
    for counts in block.column("counts").to_pylist():
        total += np.frombuffer(zlib.decompress(counts), "<u8")
    return pa.table({"task": block.column("task")[:1], "block": block.column("block")[:1], "counts": pa.array([_packed(total)], pa.binary())})


def sketch_bits(documents: int) -> int:
    """Bits of a counter's number for a corpus of so many documents."""
    return min(MOST_BITS, max(LEAST_BITS, (COUNTERS_PER_DOCUMENT * max(1, documents) - 1).bit_length()))


def frequency_classes(described: DataFrame, bits: int) -> np.ndarray:
    """For each counter, the logarithm of how many documents' grams it has counted, rounded up.

    The tasks' blocks are merged in a tree, so that no group has more than `MERGED_TASKS` of them.
    """
    merged = described.where("block is not null").select("task", "block", "counts")
    tasks = merged.agg(F.max("task")).collect()[0][0]
    tasks = 0 if tasks is None else tasks + 1
    while tasks > 1:
        tasks = -(-tasks // MERGED_TASKS)
        merged = merged.withColumn("task", F.col("task") % tasks).groupBy("block", "task").applyInArrow(_merge_block, "task int, block int, counts binary")
    classes = np.zeros(1 << bits, np.uint8)
    for r in merged.collect():  # as many rows as the sketch has blocks
        counts = np.frombuffer(zlib.decompress(bytes(r["counts"])), "<u8")
        classes[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.ceil(np.log2(counts + 1.0))
    return classes


def least_overlap(total: int) -> int:
    """Smallest intersection of linked sets whose sizes add up to `total`."""
    return -(-PERCENT * total // (100 + PERCENT))


def prefix_length(n: int) -> int:
    """Grams of a set of n that must hold one of any linked partner's prefix."""
    return n - -(-PERCENT * n // 100) + 1


_POSTINGS = "gram long, node long, n int, place int, salt int"


def _post(shared):
    """Postings of each text's prefix; salt is 0, or from 1 on a hot gram's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        shift = np.uint64(64 - (len(classes) - 1).bit_length())
        cool = LIST_ROWS.bit_length() - 1
        for batch in batches:
            out: list[tuple[np.ndarray, np.ndarray, int, int]] = []
            for row, text in zip(batch.column(ROW).to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                s = gram_set(text.as_py())
                if not len(s):
                    continue
                rarity = classes[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, rarity))[: prefix_length(len(s))]
                parts = np.int64(1) << np.maximum(rarity[order].astype(np.int64) - cool, 0)
                deal = int(mix(np.array([row], np.int64).view(np.uint64))[0] >> np.uint64(1))
                out.append((s[order].view(np.int64), np.where(parts > 1, 1 + deal % parts, 0), row, len(s)))
            lengths = [len(g) for g, _, _, _ in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([g for g, _, _, _ in out] or [np.zeros(0, np.int64)])),
                    pa.array(np.repeat(np.array([r for _, _, r, _ in out], np.int64), lengths)),
                    pa.array(np.repeat(np.array([n for _, _, _, n in out], np.int32), lengths)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths] or [np.zeros(0, np.int32)])),
                    pa.array(np.concatenate([p.astype(np.int32) for _, p, _, _ in out] or [np.zeros(0, np.int32)])),
                ],
                names=["gram", "node", "n", "place", "salt"],
            )

    return tidied(run)


def shared_postings(postings: DataFrame) -> DataFrame:
    """Postings that another row shares, by one exchange; those of hot grams all stay."""
    rows = F.count("*").over(Window.partitionBy("gram", "salt"))
    return postings.withColumn("rows", rows).where("rows > 1 or salt > 0").drop("rows")


def over_lists(postings: DataFrame, **values: Column) -> DataFrame:
    """Postings with aggregates of their gram's list; a hot gram's parts each get a copy of them."""
    whole = Window.partitionBy("gram")
    cool = postings.where("salt = 0").select("*", *(v.over(whole).alias(k) for k, v in values.items()))
    hot = postings.where("salt > 0")
    lists = hot.groupBy("gram").agg(*(v.alias(k) for k, v in values.items()), F.max("salt").alias("parts"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(1), F.col("parts")))).drop("parts")
    return cool.unionByName(hot.join(lists, ["gram", "salt"]).select(*cool.columns))


_NODE_SETS = "node long, parts int, is_b boolean, grams binary"


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["node", "parts", "is_b", "grams"]
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), pa.array([gram_set(t.as_py()).tobytes() for t in batch.column("text").cast(pa.binary())], pa.binary())], names=names)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        last_key, x, cx = None, None, None
        for i, (a, left, right) in enumerate(zip(batch.column("a").to_pylist(), batch.column("left"), batch.column("right"), strict=True)):
            if a != last_key:
                last_key, x = a, np.frombuffer(left.as_buffer(), "<u8")
                cx = np.bincount((x >> np.uint64(59)).astype(np.int64), minlength=RANGES)
            y = np.frombuffer(right.as_buffer(), "<u8")
            need = least_overlap(len(x) + len(y))
            # suffix filter: grams of a hash range without partner can't be in the intersection
            cy = np.bincount((y >> np.uint64(59)).astype(np.int64), minlength=RANGES)
            if int(np.minimum(cx, cy).sum()) < need:
                continue
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            keep[i] = int((x[at] == y).sum()) >= need
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _may_link(p: str, q: str) -> Column:
    """Length filter and positional filter of two postings of a gram, by their prefixes of names.

    `place` counts all grams of a set before this one, `before` those that any other set has in its
    prefix; no other gram before this one can be in both sets.
    """
    n, m, i, j, u, v = (F.col(f"{x}{c}") for c in ("n", "place", "before") for x in (p, q))
    needed = F.ceil((n + m) * float(PERCENT) / (100 + PERCENT) - 1e-9)
    lengths = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    # of the grams of a linked pair that both prefixes hold, the first comes this early in each set
    early = (i <= n - needed) & (j <= m - needed)
    return lengths & early & (F.least(u, v) + F.least(n - i, m - j) >= needed)


class _Join:
    """State of the self-join: open postings, the pivot of each, and the components found so far."""

    def __init__(self, scratch: Scratch, rows: DataFrame, postings: DataFrame):
        self.scratch, self.rows, self.postings = scratch, rows, postings
        self.round, self.labels = 0, None

    def verify(self, pairs: DataFrame) -> None:
        """Add the links among distinct `pairs` (a, b), and update the components."""
        pairs = self.scratch.save(pairs, f"pairs-{self.round}")
        partners = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
        sets = self.sets_for(pairs, partners)
        hot = partners.where("parts > 1")
        dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0)).alias("part"))
        # a set goes to an exchange only on the sides of pairs where it stands, and once on each
        left = sets.where("parts is not null").select(F.col("node").alias("a"), F.col("grams").alias("left"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        right = sets.where("is_b").select(F.col("node").alias("b"), F.col("grams").alias("right"))
        found = dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "left", "right").mapInArrow(tidied(_links), "a long, b long")
        # earlier links matter by their components only
        found = self.scratch.save(found, f"links-{self.round}")
        self.scratch.drop(f"pairs-{self.round}", f"sets-{self.round}")
        known = found if self.labels is None else found.unionByName(self.labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
        self.labels = components(known, self.scratch, f"round-{self.round}")
        self.scratch.drop(f"links-{self.round}")
        self.round += 1

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """Some nodes, with their columns and texts."""
        if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
            nodes = F.broadcast(nodes)
        return self.rows.join(nodes, self.rows[ROW] == nodes["node"]).select(*nodes.columns, "text")

    def sets_for(self, pairs: DataFrame, partners: DataFrame) -> DataFrame:
        """Sets of the nodes that occur in pairs, made from their texts anew.

        `parts` is how many parts a node's partners are dealt to where it comes first in a pair, else NULL; `is_b` is whether it comes second.
        """
        first = partners.select(F.col("a").alias("node"), "parts", F.lit(False).alias("is_b"))
        second = pairs.select(F.col("b").alias("node"), F.lit(None).cast("int").alias("parts"), F.lit(True).alias("is_b"))
        nodes = first.union(second).groupBy("node").agg(F.max("parts").alias("parts"), F.max("is_b").alias("is_b"))
        return self.scratch.save(self.texts_of(nodes).mapInArrow(tidied(_sets_of), _NODE_SETS), f"sets-{self.round}")

    def open_lists(self, name: str) -> None:
        """Give postings their components, keep lists of two or more, and name each list's pivot."""
        if self.labels is None:
            own = self.postings.withColumn("label", F.col("node"))
        else:
            own = self.postings.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pivot = F.min(F.struct("rank", "node", "n", "place", "before", "label"))
        own = over_lists(own, lo=F.min("label"), hi=F.max("label"), size=F.count("*"), p=pivot).where("lo < hi")
        meets = (F.col("label") != F.col("p.label")) & _may_link("", "p.")
        own = own.select("gram", "salt", "node", "n", "place", "before", "rank", "label", "size", F.when(meets, F.col("p.node")).alias("pivot"), (F.col("node") != F.col("p.node")).alias("stays"))
        self.postings = self.scratch.save(own.where("pivot is not null or size > 2"), name)

    def pivot_round(self) -> None:
        """Pair the postings with their lists' pivots, which then leave the lists."""
        lists, name = self.postings, f"lists-{self.round}"
        self.verify(lists.where("pivot is not null").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
        self.postings = lists.where("stays and size > 2").select("gram", "salt", "node", "n", "place", "before", "rank")
        self.open_lists(f"lists-{self.round}")
        self.scratch.drop(name)

    def pairs_left(self) -> tuple[int, int]:
        """How many pairs of postings in different components there are, and postings."""
        by_label = self.postings.groupBy("gram", "label").agg(F.count("*").alias("n"))
        lists = by_label.groupBy("gram").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"))
        r = lists.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("sq")) / 2).alias("pairs"), F.sum("n").alias("n")).collect()[0]
        return int(r["pairs"] or 0), int(r["n"] or 0)

    def run(self) -> DataFrame | None:
        """All components of two nodes or more as (node, label); None without any posting."""
        self.open_lists("lists-0")
        for _ in range(ROUNDS):
            self.pivot_round()
            pairs, n = self.pairs_left()
            if pairs <= PAIRS_PER_POSTING * n:
                break
        if pairs:
            parts = F.ceil(F.col("size") / PARTNERS).cast("int")
            p = self.postings.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).alias("p")
            q = self.postings.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("q")
            meet = (F.col("p.gram") == F.col("q.gram")) & (F.col("p.part") == F.col("q.part")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.label") != F.col("q.label"))
            rest = p.join(q, meet & _may_link("p.", "q."))
            self.verify(rest.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct())
        self.scratch.drop(f"lists-{self.round}", f"lists-{self.round - 1}")
        return self.labels


def similarity_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Row key, doc_id, n_shingles, class (a row key) and component_id of every document."""
    return classes_of_rows(spark, with_row(docs))


def classes_of_rows(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """`similarity_classes` of rows that have their keys."""
    with small_batches(spark):  # of texts, and of pairs with their sets; the result reads written tables
        return _classes(spark, keyed)


def _classes(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    scratch = Scratch(spark, "ngram-join")
    rows = keyed.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = sketch_bits(rows.count())
    described = scratch.save(rows.select(ROW, "doc_id", "text").mapInArrow(_describe(bits), _SETS), "described")
    own = described.where("block is null").select(ROW, "doc_id", "n", "sig_a", "sig_b")
    post = _post(spark.sparkContext.broadcast(frequency_classes(described, bits)))
    same = own.where("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min(ROW).alias("node"))
    members = scratch.save(own.join(same, ["n", "sig_a", "sig_b"], "left").select(ROW, "doc_id", "n", F.coalesce("node", ROW).alias("node")), "members")
    scratch.drop("described")
    postings = shared_postings(_node_postings(rows, members, post))
    # the least edited of a family of near copies shares most of its prefix, and so links to most
    own = Window.partitionBy("node").orderBy("place")
    shared = F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    postings = postings.withColumn("rank", (-shared / F.col("n")).cast("float")).withColumn("before", F.row_number().over(own) - 1)
    labels = _Join(scratch, rows, postings).run()
    if labels is None:
        classed = members.withColumn("class", F.col("node"))
    else:
        classed = members.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node"))
    classed = scratch.save(classed.select(ROW, "doc_id", F.col("n").alias("n_shingles"), "class"), "classed")
    scratch.drop("members")
    least = classed.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", ROW)).alias("first"))
    return classed.join(least, "class").withColumn("stays", F.col("first")[ROW] == F.col(ROW)).drop("first")


def _node_postings(rows: DataFrame, members: DataFrame, post) -> DataFrame:
    """Postings of one text of each node; copies are left out before the exchange if they are few."""
    copies = members.where(F.col("node") != F.col(ROW)).select(ROW)
    if copies.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        return rows.join(F.broadcast(copies), ROW, "left_anti").select(ROW, "text").mapInArrow(post, _POSTINGS)
    postings = shared_postings(rows.select(ROW, "text").mapInArrow(post, _POSTINGS))
    return postings.join(copies.withColumnRenamed(ROW, "node"), "node", "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with one row of each similarity class, the one with the smallest doc_id."""
    return drop_rows(spark, docs, lambda keyed: classes_of_rows(spark, keyed).where("not stays"))
