"""Removal of repeated passages by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of `BLOCK` words, and every rolling window
of that many words is a probe. A repeated passage of at least 2 * BLOCK - 1 words holds a whole
reference block of the other occurrence, whatever their offsets, so each of its copies has a probe
that equals an indexed block: a hit. Hits are extended to all windows of `WINDOW` words around them;
equal windows are compared by a 96-bit fingerprint, the earliest occurrence stays, and the union of
the others is the set of maximal exact repeats that is removed.

Work is dealt out in chunks of documents (a hash of the row key) and in parts of the hash space.
A chunk sends each part its distinct hashes only, as one sorted, delta-coded array, so a passage that
a third of all documents share costs one entry per chunk; parts answer each chunk with what it asked
about. Texts are shuffled once; no group grows beyond a chunk or a part, and nothing is collected.

Order: a smaller doc_id is earlier (null before all), then the row's place in the table, then the
start. Edge cases: a null or empty text has no words; texts shorter than a window lose nothing;
repeated rows lose all that the first of them keeps; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.llm.scratch import ROW, partitions_for, with_row
from playlake.llm.textkit import SECOND_BASE, grams, hashes_of
from playlake.shipping import ship_package

WINDOW = 20
BLOCK = 10
#: Bytes of text in a chunk, and probes in a part of the hash space, on average.
CHUNK_BYTES = 4 << 20
PART_PROBES = 2_000_000
#: Bytes per word, blank included, assumed when parts are counted.
WORD_BYTES = 6

_MESSAGE = "part long, chunk long, body binary, flags binary"


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as deltas, low and high halves apart, which compresses well."""
    deltas = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return deltas.view("<u2").reshape(-1, 2).T.tobytes()


def unpack_sorted(body: bytes) -> np.ndarray:
    """The inverse of `pack_sorted`."""
    halves = np.frombuffer(body, "<u2").reshape(2, -1)
    return np.cumsum(np.ascontiguousarray(halves.T).view("<u4").ravel(), dtype=np.uint32)


class Chunk:
    """The documents of a chunk in order, and the hashes of their words in one array."""

    def __init__(self, rows: pa.Table, hashed: bool = True):
        ids = [(-(1 << 63) if d is None else d) for d in rows.column("doc_id").to_pylist()]
        keys = rows.column(ROW).to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (ids[i], keys[i]))
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        self.rows = np.array([keys[i] for i in order], np.int64)
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.words = [(texts[i] or b"").split() for i in order]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.hashes = np.concatenate([hashes_of(w) for w in self.words if hashed] or [np.zeros(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(self.words)), self.lengths)

    def whole(self, n: int) -> np.ndarray:
        """Places of windows of `n` words that lie within one document."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        return at[self.doc[: len(at)] == self.doc[n - 1 :]] if len(at) else at

    def probes(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rolling windows, their keys (part and residue), and which are reference blocks."""
        at = self.whole(BLOCK)
        h = grams(self.hashes, BLOCK)[at]
        return at, (_part(h, parts) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)), (at - self.starts[self.doc[at]]) % BLOCK == 0


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _cuts(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, from, to) of the runs of equal values in an ascending array."""
    at = np.flatnonzero(np.diff(parts, prepend=-1)) if len(parts) else np.zeros(0, np.int64)
    return list(zip(parts[at].tolist(), at.tolist(), [*at[1:].tolist(), len(parts)], strict=True))


def _messages(part: list, chunk: list, body: list, flags: list) -> pa.Table:
    return pa.table({"part": pa.array(part, pa.int64()), "chunk": pa.array(chunk, pa.int64()), "body": pa.array(body, pa.binary()), "flags": pa.array(flags, pa.binary())})


def _ask(parts: int):
    """Chunk to parts: its distinct probes; flags tell repeated ones and reference blocks."""

    def run(rows: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        _, keys, block = chunk.probes(parts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        is_block = np.maximum.reduceat(block[order].astype(np.uint8), first) if len(first) else np.zeros(0, np.uint8)
        keys = keys[first]
        cuts = _cuts((keys >> np.uint64(32)).astype(np.int64))
        number = rows.column("chunk")[0].as_py()
        residues, many = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (n > 1).astype(np.uint8)
        return _messages(
            [p for p, _, _ in cuts],
            [number] * len(cuts),
            [pack_sorted(residues[a:b]) for _, a, b in cuts],
            [np.packbits(np.concatenate((many[a:b], is_block[a:b]))).tobytes() for _, a, b in cuts],
        )

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """Part to chunks: which of their probes occur twice or more and equal a reference block."""
    bodies = [unpack_sorted(b) for b in asked.column("body").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8))[: 2 * len(b)].reshape(2, -1) for f, b in zip(asked.column("flags").to_pylist(), bodies, strict=True)]
    residues = np.concatenate(bodies)
    order = np.argsort(residues, kind="stable")
    values = residues[order]
    first = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    n = np.add.reduceat(1 + np.concatenate([f[0] for f in flags])[order].astype(np.int64), first)
    block = np.maximum.reduceat(np.concatenate([f[1] for f in flags])[order], first)
    hits = values[first][(n > 1) & (block > 0)]
    own = [b[np.isin(b, hits, assume_unique=True)] for b in bodies]
    kept = [i for i, b in enumerate(own) if len(b)]
    part, chunks = asked.column("part")[0].as_py(), asked.column("chunk").to_pylist()
    return _messages([part] * len(kept), [chunks[i] for i in kept], [pack_sorted(own[i]) for i in kept], [b""] * len(kept))


def _window_prints(chunk: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grams(chunk.hashes, WINDOW)[at], (grams(chunk.hashes, WINDOW, SECOND_BASE)[at] >> np.uint64(32)).astype(np.uint32)


def _firsts(a: np.ndarray, b: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices sorted by (a, b, *order), and which of them are the first with their (a, b)."""
    at = np.lexsort((*order[::-1], b, a))
    new = np.ones(len(at), bool)
    new[1:] = (a[at][1:] != a[at][:-1]) | (b[at][1:] != b[at][:-1])
    return at, new


_WINDOWS = np.dtype([("a", "<u8"), ("b", "<u4"), ("id", "<i8"), ("row", "<i8"), ("at", "<u4")])


def _extend(parts: int):
    """Chunk to parts: the first occurrence in the chunk of each window around its hits.

    The later ones go to a part of the chunk's own, which hands them on.
    """

    def run(rows: pa.Table, hits: pa.Table) -> pa.Table:
        if not rows.num_rows or not hits.num_rows:
            return _messages([], [], [], [])
        chunk = Chunk(rows)
        wanted = np.concatenate([(np.uint64(p) << np.uint64(32)) | unpack_sorted(b).astype(np.uint64) for p, b in zip(hits.column("part").to_pylist(), hits.column("body").to_pylist(), strict=True)])
        place, keys, _ = chunk.probes(parts)
        hit = np.zeros(len(chunk.hashes) + 1, np.int64)
        hit[place[np.isin(keys, wanted)] + 1] = 1
        hit = np.cumsum(hit)  # hits before each place
        at = chunk.whole(WINDOW)
        at = at[hit[at + WINDOW - BLOCK + 1] > hit[at]]
        a, b = _window_prints(chunk, at)
        order, new = _firsts(a, b, at)
        repeats = np.sort(at[order[~new]])
        order = order[new]  # ascending in a, hence in the part
        out = np.zeros(len(order), _WINDOWS)
        doc = chunk.doc[at[order]]
        out["a"], out["b"], out["at"], out["id"], out["row"] = a[order], b[order], at[order], chunk.ids[doc], chunk.rows[doc]
        number = rows.column("chunk")[0].as_py()
        cuts = _cuts(_part(out["a"], parts).astype(np.int64))
        bodies = []
        for _, lo, hi in cuts:
            own = np.sort(out[lo:hi], order="at")  # by document, whose keys then repeat and compress
            bodies.append(b"".join(own[c].tobytes() for c in _WINDOWS.names))
        own_part = [parts + number] if len(repeats) else []
        targets = [p for p, _, _ in cuts] + own_part
        return _messages(targets, [number] * len(targets), bodies + [pack_sorted(repeats) for _ in own_part], [b""] * len(targets))

    return run


def _unpack_windows(body: bytes) -> np.ndarray:
    n, at = len(body) // _WINDOWS.itemsize, 0
    out = np.zeros(n, _WINDOWS)
    for name in _WINDOWS.names:
        kind = _WINDOWS[name]
        out[name] = np.frombuffer(body, kind, n, at)
        at += n * kind.itemsize
    return out


def _later(parts: int):
    """Part to chunks: places of windows that start earlier in another chunk, or in the same one."""

    def run(windows: pa.Table) -> pa.Table:
        part, chunks = windows.column("part")[0].as_py(), windows.column("chunk").to_pylist()
        if part >= parts:
            return windows.select(["part", "chunk", "body", "flags"])
        bodies = [_unpack_windows(b) for b in windows.column("body").to_pylist()]
        every = np.concatenate(bodies)
        sender = np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
        order, new = _firsts(every["a"], every["b"], every["id"], every["row"], every["at"])
        late = np.zeros(len(every), bool)
        late[order] = ~new
        out = []
        for i in np.unique(sender[late]).tolist():
            own = late[sender == i]
            out.append((i, pack_sorted(np.sort(bodies[i]["at"][own]))))
        return _messages([part] * len(out), [chunks[i] for i, _ in out], [b for _, b in out], [b""] * len(out))

    return run


_RESULT = f"{ROW} long, doc_id long, n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_text string"


def _cut(rows: pa.Table, late: pa.Table) -> pa.Table:
    """Remove every word that a late window covers."""
    chunk = Chunk(rows, hashed=False)
    gone = np.zeros(len(chunk.doc) + 1, np.int64)
    for body in late.column("body").to_pylist():
        gone[unpack_sorted(body)] = 1
    starts = np.flatnonzero(gone)
    edge = np.zeros(len(chunk.doc) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    removed, texts, counts = [], [], []
    for i, words in enumerate(chunk.words):
        own = covered[chunk.starts[i] : chunk.starts[i + 1]]
        n = int(own.sum())
        counts.append(n)
        if not n:
            removed.append([])
            texts.append(b" ".join(words))
            continue
        turns = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0]))))
        removed.append([{"start": s, "stop": e} for s, e in turns.reshape(-1, 2).tolist()])
        texts.append(b" ".join([w for w, g in zip(words, own.tolist(), strict=True) if not g]))
    ids = dict(zip(rows.column(ROW).to_pylist(), rows.column("doc_id").to_pylist(), strict=True))
    return pa.table(
        {
            ROW: pa.array(chunk.rows),
            "doc_id": pa.array([ids[r] for r in chunk.rows.tolist()], pa.int64()),
            "n_words": pa.array(chunk.lengths),
            "n_removed": pa.array(counts, pa.int64()),
            "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
        }
    )


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Row key, doc_id, n_words, n_removed, removed word spans and the kept text of each document."""
    ship_package(spark)
    size = docs.select(F.sum(F.octet_length("text")).alias("b")).collect()[0]["b"] or 0
    chunks = partitions_for(spark, size, CHUNK_BYTES)
    parts = partitions_for(spark, size // WORD_BYTES, PART_PROBES)
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(ROW), F.lit(chunks))).repartition(chunks, "chunk")
    hits = rows.groupBy("chunk").applyInArrow(_ask(parts), _MESSAGE).groupBy("part").applyInArrow(_answer, _MESSAGE)
    windows = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(parts), _MESSAGE)
    late = windows.groupBy("part").applyInArrow(_later(parts), _MESSAGE)
    return rows.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(_cut, _RESULT)
