"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts become lower-case words, and each word is hashed once; the hash of a run of words is combined from
the hashes of two shorter runs. Of the hashes of all runs of `GRAM` words, the least of every
`SPAN - GRAM + 1` consecutive ones is kept as a fingerprint; two texts that share `SPAN` consecutive
words therefore share a fingerprint. An item of fewer words is one window, and has the hash of its longest
word instead.

One pass over the documents counts their words and joins their fingerprints with the benchmark's. Only
texts with a hit are read again: every place of a hit is extended to the windows of `SPAN` words around
it, and these are compared word by word with the items' windows; short items are compared whole.

The benchmark's fingerprints are broadcast only if counted to be few, else joined by a shuffle; its windows
have no hint. A common fingerprint only adds rows to the stream that are compared in place; documents are
never paired. Rows that are exploded never carry their text or words along.

Edge cases: a null or empty text has no words and is clean; items without words match nothing; hits of
an item without item_id count as hit words, but the item isn't listed; repeated items count once per
item_id; repeated documents are judged each for itself; an empty benchmark leaves all documents clean;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlake.llm.scratch import ROW, Scratch, drop_rows, with_row

SPAN = 13
GRAM = 5
#: A document is contaminated if hit words are at least one in so many.
ONE_IN = 20
#: Keys, of eight bytes each, up to which they are broadcast.
BROADCAST_ROWS = 200_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged; null stays null."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """Words of a text, in lower case; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _chained(short: Column, long: Column, by: int) -> Column:
    """Hashes of runs that begin with a run of `short` and go on with one of `long`, `by` words later."""
    n = F.size(long) - by
    return F.zip_with(F.slice(short, F.lit(1), n), F.slice(long, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))


def _sliding_least(values: Column, by: int) -> Column:
    """Least of each value and the one `by` places on, for all that have one."""
    n = F.size(values) - by
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(by + 1), n), lambda a, b: F.least(a, b))


def _with_steps(rows: DataFrame, least_words: int, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows with arrays that build on each other; they are null below `least_words` words."""
    for name, value in steps:
        rows = rows.withColumn(name, F.when(F.size("words") >= least_words, value))
    return rows


def _word_hashes() -> Column:
    return F.transform("words", lambda w: F.xxhash64(w))


def with_grams(rows: DataFrame) -> DataFrame:
    """Rows with `grams`, the hashes of all runs of `GRAM` (5) words, where there are `SPAN` words."""
    h = F.col
    return _with_steps(rows, SPAN, [("h1", _word_hashes()), ("h2", _chained(h("h1"), h("h1"), 1)), ("h4", _chained(h("h2"), h("h2"), 2)), ("grams", _chained(h("h4"), h("h1"), 4))])


def with_prints(rows: DataFrame) -> DataFrame:
    """Rows with `prints`, the distinct least grams of all windows of 9, where there are `SPAN` words."""
    h = F.col
    two_four_eight = [("m2", _sliding_least(h("grams"), 1)), ("m4", _sliding_least(h("m2"), 2)), ("m8", _sliding_least(h("m4"), 4))]
    return _with_steps(with_grams(rows), SPAN, [*two_four_eight, ("prints", F.array_distinct(_sliding_least_ends(h("m8"), h("grams"))))])


def _sliding_least_ends(eights: Column, grams: Column) -> Column:
    n = F.size(grams) - (SPAN - GRAM)
    return F.zip_with(F.slice(eights, F.lit(1), n), F.slice(grams, F.lit(SPAN - GRAM + 1), n), lambda a, b: F.least(a, b))


def _is_small(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


class Benchmark:
    """Keys and windows of the items, written once. A key is a fingerprint, or a short item's anchor."""

    def __init__(self, scratch: Scratch, items: DataFrame):
        rows = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
        rows = scratch.save(rows.distinct(), "items")
        windows = rows.where(F.size("words") >= SPAN).select(
            "item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - (SPAN - 1)), lambda i: F.slice("words", i, SPAN))).alias("window")
        )
        short = rows.where(F.size("words") < SPAN)
        longest = F.aggregate("words", F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
        short = short.withColumn("anchor", longest).withColumn("at", F.array_position("words", F.col("anchor")).cast("int"))
        self.windows = scratch.save(windows.distinct().withColumn("window_key", F.xxhash64("window")), "item-windows")
        self.short = scratch.save(short.select("item_id", F.col("words").alias("window"), F.xxhash64("anchor").alias("key"), "at"), "item-short")
        self.has_short = bool(self.short.limit(1).count())
        # the outer form: the plain one filters by the array's size, and the optimizer would write out all steps for that
        prints = with_prints(rows).select(F.explode_outer("prints").alias("key")).where("key is not null").distinct()
        self.keys = scratch.save(prints.union(self.short.select("key")).distinct().withColumn("known", F.lit(True)), "item-keys")


def screen(scratch: Scratch, rows: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(row key, doc_id, n_words, key): a row without key for each document, and one per key it shares."""
    worded = with_prints(rows.withColumn("words", words_of(F.col("text"))))
    keys = F.coalesce("prints", F.array().cast("array<bigint>"))
    if benchmark.has_short:
        keys = F.array_distinct(F.concat(keys, _word_hashes()))
    counted = worded.select(ROW, "doc_id", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("bigint")), keys).alias("keys"))
    if _is_small(benchmark.keys):
        # never empty; the outer form keeps the optimizer from making the array twice, once to filter by its size
        each = counted.select(ROW, "doc_id", "n_words", F.explode_outer("keys").alias("key")).join(F.broadcast(benchmark.keys), "key", "left")
        each = each.where("key is null or known")
    else:
        counted = scratch.save(counted, "keyed")
        met = counted.select(ROW, "doc_id", "n_words", F.explode("keys").alias("key")).where("key is not null").join(benchmark.keys, "key")
        none = counted.select(ROW, "doc_id", "n_words", F.lit(None).cast("long").alias("key"))
        each = none.unionByName(met.drop("known"))
    return scratch.save(each.select(ROW, "doc_id", "n_words", "key"), "screened")


def find_hits(scratch: Scratch, rows: DataFrame, screened: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(row key, start, length, item_id): every occurrence of an item's window in a document, from 1."""
    met = screened.where("key is not null").select(ROW, "key")
    few = met.select(ROW).distinct()
    texts = rows.select(ROW, "text").join(F.broadcast(few) if _is_small(few) else few, ROW)
    worded = scratch.save(with_grams(texts.select(ROW, words_of(F.col("text")).alias("words"))).select(ROW, "words", "h1", "grams"), "hit-words")
    starts = [_long_starts(worded, met)]
    if benchmark.has_short:
        starts.append(_short_starts(worded, benchmark))
    each = starts[0] if len(starts) == 1 else starts[0].unionByName(starts[1])
    places = each.groupBy(ROW).agg(F.collect_set(F.struct("start", "length")).alias("places"))
    cut = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"), F.slice("words", p["start"], p["length"]).alias("found")))
    cut = worded.select(ROW, "words").join(places, ROW).select(ROW, F.explode(cut).alias("w")).select(ROW, "w.*")
    windows = benchmark.windows.select("item_id", "window", "window_key").unionByName(benchmark.short.select("item_id", "window", F.xxhash64("window").alias("window_key")))
    hits = cut.withColumn("window_key", F.xxhash64("found")).join(windows, "window_key").where(F.col("found") == F.col("window"))
    return scratch.save(hits.select(ROW, F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "item_id").distinct(), "hits")


def _long_starts(worded: DataFrame, met: DataFrame) -> DataFrame:
    """Starts of all windows that hold a gram which is a fingerprint of the document and of an item."""
    grams = worded.select(ROW, (F.size("words") - (SPAN - 1)).alias("last"), F.posexplode("grams").alias("at", "key"))
    found = grams.join(met, [ROW, "key"])
    around = F.sequence(F.greatest(F.col("at") + 1 - (SPAN - GRAM), F.lit(1)), F.least(F.col("at") + 1, F.col("last")))
    return found.select(ROW, F.explode(around).alias("start"), F.lit(SPAN).alias("length")).distinct()


def _short_starts(worded: DataFrame, benchmark: Benchmark) -> DataFrame:
    """Starts of the places where a short item fits around its anchor."""
    hashes = worded.select(ROW, F.size("words").alias("n"), F.posexplode(_word_hashes()).alias("pos", "key"))
    known = benchmark.short.select("key", "at", F.size("window").alias("length")).distinct()
    each = hashes.join(known, "key").select(ROW, "n", (F.col("pos") + 2 - F.col("at")).alias("start"), "length")
    return each.where((F.col("start") >= 1) & (F.col("start") + F.col("length") - 1 <= F.col("n"))).select(ROW, "start", "length").distinct()


def judge_documents(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Row key, doc_id, n_words, n_hit, items (sorted as strings) and contaminated of each document."""
    return judge_rows(spark, with_row(docs), items)


def judge_rows(spark: SparkSession, keyed: DataFrame, items: DataFrame) -> DataFrame:
    """`judge_documents` of rows that have their keys."""
    scratch = Scratch(spark, "decontamination")
    rows, benchmark = keyed.select(ROW, "doc_id", "text"), Benchmark(scratch, items)
    screened = screen(scratch, rows, benchmark)
    hits = find_hits(scratch, rows, screened, benchmark)
    scratch.drop("keyed", "hit-words", "items", "item-windows", "item-short", "item-keys")
    spans = hits.groupBy(ROW, "start").agg((F.col("start") + F.max("length")).alias("stop"))
    before = Window.partitionBy(ROW).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hit_words = spans.groupBy(ROW).agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).alias("n_hit"))
    listed = hits.groupBy(ROW).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = hit_words.join(listed, ROW)
    judged = screened.where("key is null").select(ROW, "doc_id", "n_words").join(found, ROW, "left")
    judged = judged.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without contaminated ones; all columns stay."""
    return drop_rows(spark, docs, lambda keyed: judge_rows(spark, keyed, items).where("contaminated"))
