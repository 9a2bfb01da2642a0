"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes a word boundary, and the character n-grams of
its words (with boundary marks) are hashed into a fixed number of buckets. The text's vector is the
mean of their embeddings; a linear softmax on top gives the languages' probabilities. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on the driver, on a bounded
sample of labelled rows, of which it gets n-gram counts only, made by the executors; a part of that sample is set aside to calibrate the temperature and the
rejection threshold.

As the model is linear, prediction needs the product of both matrices only: per n-gram one row of
`languages` numbers. It reads whole texts in pieces of bounded size, so memory doesn't grow with the
longest text. The broadcast model has a fixed number of buckets.

Edge cases: a text that is null or has no letter is `und` with score 0 and rejected; rows with a null
label aren't trained on; with no labelled row at all every text is `und`; repeated rows and extra
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playlake.llm.scratch import ROW, Scratch, drop_rows, small_batches
from playlake.llm.textkit import tidied
from playlake.shipping import ship_package

UNKNOWN = "und"
BUCKETS = 1 << 16
DIMENSION = 16
ORDERS = (1, 2, 3)
#: Labelled rows that training expects over all languages, and of each; no language gets less than one.
SAMPLE_ROWS = 6_000
SAMPLE_PER_LANGUAGE = 600
#: Label values up to which their counts are broadcast to the rows, so that no text is shuffled by its label.
BROADCAST_LANGUAGES = 100_000
#: Code points of a text that are held as numbers at once.
PIECE = 1 << 20
#: Passes over the training rows, and gradient steps, at least.
EPOCHS, STEPS = 6, 8_000
RATE = 0.5
#: Share of the sample that calibrates, and the share of it that the threshold may reject.
CALIBRATION_SHARE = 0.25
REJECT_SHARE = 0.002
#: Texts of at least this calibrated probability are never rejected.
SURE = 0.5


def _classes() -> np.ndarray:
    """For each code point, its lower-case letter, or 0 for anything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: np.ndarray | None = None


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters of a text, with one 0 for each run of anything else, framed by 0."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = _classes()
    c = _LETTERS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    gap = c == 0
    c = c[~(gap & np.concatenate(([False], gap[:-1])))] if len(c) else c
    return np.concatenate(([0], c, [0])).astype(np.uint32)


def subwords(c: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of framed letters; n-grams don't reach over a boundary."""
    out = []
    inner = np.concatenate(([0], np.cumsum(c == 0)))  # boundaries before each place
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        if n == 1:
            h = h[c != 0]
        elif n > 2:  # a boundary may come first or last, not in between
            h = h[inner[n - 1 : n - 1 + m] == inner[1 : 1 + m]]
        out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def pieces_of(text: str, size: int = PIECE) -> Iterator[str]:
    """A long text in pieces; a word on a cut counts as two."""
    for at in range(0, len(text), size):
        yield text[at : at + size]


@dataclass
class Model:
    """Languages, per-bucket scores, biases, temperature and rejection threshold."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str | None) -> np.ndarray | None:
        """Mean score per language; None without a letter."""
        total, n = np.zeros(len(self.languages)), 0
        letters = False
        for piece in pieces_of(text or ""):
            c = letters_of(piece)
            if not c.any():
                continue
            letters = True
            grams = subwords(c)
            total += [row.take(grams).sum() for row in self.scores]
            n += len(grams)
        return total / n + self.bias if letters and self.languages else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        z = self.logits(text)
        if z is None:
            return UNKNOWN, 0.0, True
        p = _softmax(z[None] / self.temperature)[0]
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Counted = tuple[np.ndarray, np.ndarray, str, int]


def count_subwords(text: str, lang: str) -> Counted | None:
    """(buckets, counts, language, checksum of the text) of a training row; None without a letter."""
    grams = np.concatenate([subwords(letters_of(p)) for p in pieces_of(text)] or [np.zeros(0, np.uint32)])
    if not len(grams):
        return None
    ids, counts = np.unique(grams, return_counts=True)
    return ids.astype(np.uint32), counts.astype(np.uint32), lang, zlib.crc32(text.encode("utf-8", "surrogatepass"))


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit a model to (text, language) rows; the same rows in any order give the same model."""
    return train_counted([c for text, lang in rows if (c := count_subwords(text, lang))], seed)


def train_counted(rows: list[Counted], seed: int = 7) -> Model:
    """Fit a model to counted rows."""
    languages = sorted({r[2] for r in rows})
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    place = {lang: i for i, lang in enumerate(languages)}
    ordered = sorted(rows, key=lambda r: (r[3], r[2], r[0].tobytes(), r[1].tobytes()))
    data = [(ids, (counts / counts.sum()).astype(np.float32), place[lang], check) for ids, counts, lang, check in ordered]
    check = [d for d in data if d[3] % 1000 < 1000 * CALIBRATION_SHARE]
    fit = [d for d in data if d[3] % 1000 >= 1000 * CALIBRATION_SHARE] or data
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    weight, bias = np.zeros((DIMENSION, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, -(-STEPS // max(1, len(fit))))
    steps, step = max(1, epochs * len(fit)), 0
    boost = np.float32(20)  # means of many n-grams move slowly; embeddings learn faster than the softmax
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            ids, share, y, _ = fit[i]
            rate = np.float32(RATE * (1 - step / steps))
            hidden = share @ embed[ids]
            p = _softmax((hidden @ weight + bias)[None])[0]
            p[y] -= 1
            back = weight @ p
            weight -= rate * np.outer(hidden, p)
            bias -= rate * np.float32(0.1) * p
            embed[ids] -= rate * boost * share[:, None] * back[None]
            step += 1
    model = Model(languages, np.ascontiguousarray((embed @ weight).T), bias.astype(np.float64))
    _calibrate(model, check or fit)
    return model


def _calibrate(model: Model, rows: list[tuple]) -> None:
    """Pick the temperature of least log loss, and reject below a low quantile of right answers."""
    if not rows:
        return
    z = np.stack([model.scores[:, ids] @ share + model.bias for ids, share, _, _ in rows]).astype(np.float64)
    y = np.array([r[2] for r in rows])
    at = np.arange(len(y))
    loss = {t: -np.log(_softmax(z / t)[at, y] + 1e-9).mean() for t in np.geomspace(0.05, 20, 60)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(z / model.temperature)
    right = p.argmax(axis=1) == y
    sure = np.sort(p.max(axis=1)[right])
    if len(sure):
        model.threshold = float(min(SURE, sure[int(len(sure) * REJECT_SHARE)]))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the decimal doc_id leaves 2 modulo 4; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [c for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if (c := count_subwords(text, lang))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())],
            names=["ids", "counts", "lang", "check"],
        )


def sample_rows(labelled: DataFrame) -> list[Counted]:
    """Counted rows of a sample, as many of each language as there are, up to `SAMPLE_PER_LANGUAGE`.

    Every language is in, at one rate each, by a hash of the doc_id; `SAMPLE_ROWS` are shared evenly, and
    of more languages than that the sample expects one row each.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return []
    per = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // languages))
    if languages <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(counts, "lang").where(draw * F.col("n") < per).select("text", "lang")
    taken = rows.mapInArrow(tidied(_count_batches), "ids binary, counts binary, lang string, check long").collect()
    return [(np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["counts"], np.uint32), r["lang"], r["check"]) for r in taken]


def fit_model(docs: DataFrame) -> Model:
    """Train on labelled rows outside the held-out share; only text and label are read."""
    ship_package(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    return train_counted(sample_rows(labelled.select("doc_id", "text", "lang")))


def _predict_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column("text")]
            named = dict(zip(batch.schema.names, batch.columns, strict=True)) | {
                "lang_pred": pa.array([g[0] for g in got], pa.string()),
                "score": pa.array([g[1] for g in got], pa.float64()),
                "rejected": pa.array([g[2] for g in got], pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays(list(named.values()), names=list(named))

    return run


def predict_languages(spark: SparkSession, rows: DataFrame, model: Model) -> DataFrame:
    """`rows`, which must have a column text, with lang_pred, score and rejected in addition."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(tidied(_predict_batches(shared)), schema)


def identify_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    model = fit_model(docs)
    rows = predict_languages(spark, docs.select("doc_id", "text"), model)
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` without the texts that the model rejects; all columns stay, whatever their names."""
    model = fit_model(docs)

    def rejected(keyed: DataFrame) -> DataFrame:
        # texts go to Python in small batches, and only keys come back
        with small_batches(spark):
            return Scratch(spark, "langid").save(predict_languages(spark, keyed.select(ROW, "text"), model).where("rejected").select(ROW), "rejected")

    return drop_rows(spark, docs, rejected)
