"""Packing of tokenised documents into sequences of a fixed window.

A document is cut at multiples of the window only, so whole pieces fill windows by themselves and at
most one residual piece per document has to share. Residual lengths are counted in classes of
`QUANTUM` tokens. Shallow combinations of up to three classes that fill a window are enumerated, a
non-negative least-squares problem gives how often each is used, counts are rounded down, and the
rest is packed greedily, longest first, on the histogram. All of this works on at most
window / QUANTUM counts, whatever the corpus size; the driver sees counts only.

Pieces get their place by rank: pieces are ranged by (class, doc_id, ...), ranked within a range,
and offsets of the ranges make the rank global; the plan then maps (class, rank) to (sequence, slot).
Ranges split a class that holds a third of all pieces over many tasks.

Padding: a sequence counts as padded to the window unless its length is a power of two.

Edge cases: a null or empty text is the end token alone; rows that repeat are packed separately; a
null doc_id is kept; an empty table gives no sequences; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlake.llm.scratch import ROW, Scratch, partitions_for, small_batches, with_row
from playlake.llm.textkit import tidied, worker_cache

WINDOW = 2048
END_ID = 1
#: Residual lengths are counted in classes of so many tokens.
QUANTUM = 8
#: Units that a worker's token cache may hold before it starts afresh: a hash table of 2^19 places at two thirds.
#: Longer units, which seldom come again, are not kept, so the cache's memory doesn't depend on the texts.
CACHE_UNITS = 349_000
UNIT_CHARS = 32
#: Pieces that a range of the ranking holds on average.
RANGE_PIECES = 500_000

#: How the byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where units would depend on their neighbours: any white space but lone inner blanks and newlines.
_ODD_SPACE = re.compile(r"\A\s|\s\Z|\s\s|[^\S \n]")

_SCHEMA = f"{ROW} long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class UnitTokens(dict):
    """Token ids, as bytes, of a unit: a blank-led word with its marks, or a newline and a word.

    The tokenizer's splitting pattern starts a token at every blank or newline that stands between two
    non-blanks, so such units are encoded independently of their neighbours.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.marks = {m: encode(m) for m in ".,;:!?"}

    def __missing__(self, unit: str) -> bytes:
        mark = self.marks.get(unit[-1])
        if mark is not None and unit[-2:-1].isalpha():  # letters and a lone mark are separate tokens
            value = self[unit[:-1]] + mark
        else:
            value = self.encode(unit if unit[0] == "\n" else " " + unit)
        if len(unit) <= UNIT_CHARS:
            if len(self) >= CACHE_UNITS:
                self.clear()
            self[unit] = value
        return value


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Tokenizer:
    """A byte-level BPE tokenizer read from a file, with a cache of the units that words form.

    Units are merged by a second public implementation of the same vocabulary, which is several times
    as fast on short strings; texts that hold one of the special tokens go to the first as a whole. The second
    one merges by the tokens' ids, so a vocabulary whose ids don't ascend with its merges is refused.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer as Rust

        self.whole = Rust.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self._check_merges()
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in self.whole.get_vocab(with_added_tokens=False).items() if token not in self.special}
        fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode_plain = lambda text: _as_bytes(fast.encode_ordinary(text))
        self.units = UnitTokens(self.encode_plain)

    def _check_merges(self) -> None:
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        merges = [m.split(" ") if isinstance(m, str) else m for m in json.loads(self.whole.to_str())["model"]["merges"]]
        ids = [vocabulary[a + b] for a, b in merges]
        if any(x >= y for x, y in itertools.pairwise(ids)):
            raise ValueError("tokenizer: the vocabulary's ids don't ascend with its merges")

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return _as_bytes(self.whole.encode(text, add_special_tokens=False).ids)
        if not text or _ODD_SPACE.search(text):
            return self.encode_plain(text)
        units = text.replace("\n", " \n").split(" ")
        return self.encode_plain(units[0]) + b"".join(map(self.units.__getitem__, units[1:]))


_tokenizers: dict[str, Tokenizer] = worker_cache("tokenizers")


def _tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer; not within what is pickled, which has a copy of the cache in each task."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def _pieces_of(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        encode = tokenizer.encode
        for batch in batches:
            out: list[tuple] = []
            for row, doc, cell in zip(batch.column(ROW).to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = cell.as_py()
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                for at in range(0, n, window):
                    cut = ids[4 * at : 4 * (at + window)]
                    out.append((row, doc, at, len(cut) // 4, zlib.crc32(cut), n))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            names = [ROW, "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
        tokenizer.units.clear()

    return tidied(run, "tokenizers")


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Tokenise whole documents and cut them at multiples of the window; one row per piece."""
    rows = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces_of(tokenizer_path, window, end_id), _SCHEMA)


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """Non-negative least squares of a 0/1/2/3 matrix, by an active set (Lawson and Hanson, 1974).

    `columns` lists, for each combination, the classes that it uses, with repeats.
    """
    n = len(columns)
    rows = np.array([c for combo in columns for c in combo])
    cols = np.repeat(np.arange(n), [len(c) for c in columns])
    dense = np.zeros((len(target), n), np.float32)
    np.add.at(dense, (rows, cols), 1)
    x, active = np.zeros(n), []
    residual = target.astype(float).copy()
    for _ in range(rounds):
        gain = dense.T @ residual.astype(np.float32)
        gain[active] = -1
        best = int(np.argmax(gain))
        if gain[best] <= 1e-3 * max(1.0, float(target.max())):
            break
        active.append(best)
        while True:
            part = dense[:, active].astype(float)
            s = np.linalg.lstsq(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ target, rcond=None)[0] if len(active) > len(target) else np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ target)
            if (s > 0).all():
                break
            old = x[active]
            low = s <= 0
            if old[low].max(initial=0) <= 0 and low.sum() == 1 and low[-1]:
                s[-1] = 0
                low[:] = False
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-12), initial=1.0)
            x[active] = old + step * (s - old)
            keep = [c for c, v in zip(active, x[active], strict=True) if v > 1e-9]
            x[[c for c in active if c not in set(keep)]] = 0
            if keep == active:
                break
            active = keep
            if not active:
                s = np.zeros(0)
                break
        if len(s) == len(active):
            x[active] = np.maximum(s, 0)
        residual = target - dense[:, active] @ x[active]
    return x


def plan_packing(histogram: dict[int, int], classes: int) -> list[tuple[tuple[int, ...], int]]:
    """Which combinations of classes fill windows, and how often; class c stands for c quanta.

    The plan uses each class exactly as often as the histogram has it.
    """
    left = np.zeros(classes + 1, np.int64)
    for c, n in histogram.items():
        left[c] += n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[classes]:
        plan.append(((classes,), int(left[classes])))
        left[classes] = 0
    used = set(np.flatnonzero(left).tolist())
    combos = [(a, classes - a) for a in range(1, classes // 2 + 1) if {a, classes - a} <= used]
    combos += [(a, b, classes - a - b) for a in sorted(used) for b in sorted(used) if a <= b <= classes - a - b and classes - a - b in used]
    if combos:
        for j, repeats in enumerate(np.floor(nnls(combos, left[: classes + 1].astype(float)) + 1e-6).astype(np.int64)):
            need = np.bincount(combos[j], minlength=classes + 1)
            fits = int(min(repeats, *(left[c] // need[c] for c in set(combos[j]))))
            if fits > 0:
                plan.append((combos[j], fits))
                left -= fits * need
    while left.any():  # longest first, each gap by the largest class that fits; ends one class at least
        pattern, room = [], classes
        free = left.copy()
        while room and (at := np.flatnonzero(free[: room + 1])).size:
            c = int(at[-1])
            take = int(min(room // c, free[c]))
            pattern += [c] * take
            free[c] -= take
            room -= c * take
        need = np.bincount(pattern, minlength=classes + 1)
        fits = int(min(left[c] // need[c] for c in set(pattern)))
        plan.append((tuple(pattern), fits))
        left -= fits * need
    return plan


def _lookup(plan: list[tuple[tuple[int, ...], int]], first_sequence: int = 0) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first rank, repeats' first sequence, copies in a sequence, first slot."""
    ranks: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = first_sequence
    for combo, repeats in plan:
        slot = 0
        for c, group in itertools.groupby(combo):
            m = len(list(group))
            rows.setdefault(c, []).append((ranks.get(c, 0), sequence, m, slot))
            ranks[c] = ranks.get(c, 0) + m * repeats
            slot += m
        sequence += repeats
    return {c: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for c, r in rows.items()}


def _place(lookup: dict[int, tuple[np.ndarray, ...]], offsets: dict[tuple[int, int], int]):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, part, rank = (batch.column(c).to_numpy() for c in ("class", "part", "rank"))
            sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                own = np.flatnonzero(cls == c)
                base = {p: offsets[(int(p), int(c))] for p in np.unique(part[own])}
                whole = rank[own] + np.array([base[p] for p in part[own]], np.int64)
                first, seq, copies, at = lookup[int(c)]
                k = np.searchsorted(first, whole, "right") - 1
                sequence[own] = seq[k] + (whole - first[k]) // copies[k]
                slot[own] = at[k] + (whole - first[k]) % copies[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:5]), pa.array(sequence), pa.array(slot)], names=names)

    return run


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, quantum: int = QUANTUM) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and offset.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_classes.
    """
    scratch = Scratch(spark, "packing")
    with small_batches(spark):
        pieces = scratch.save(cut_documents(with_row(docs.select("doc_id", "text")), tokenizer_path, window, end_id), "pieces")
    classed = pieces.withColumn("class", F.ceil(F.col("length") / quantum))
    ranges = partitions_for(spark, pieces.count(), RANGE_PIECES)
    order = ["doc_id", "start", ROW]
    ranged = classed.repartitionByRange(ranges, "class", *order).withColumn("part", F.spark_partition_id().cast("long"))
    local = Window.partitionBy("part", "class").orderBy(*order)
    ranked = scratch.save(ranged.withColumn("rank", F.row_number().over(local).cast("long") - 1), "ranked")
    # a row per range and class within it: as many as ranges and classes together, at most
    counts = {(r["part"], r["class"]): r["n"] for r in ranked.groupBy("part", "class").agg(F.count("*").alias("n")).collect()}
    histogram: dict[int, int] = {}
    offsets: dict[tuple[int, int], int] = {}
    for (part, c), n in sorted(counts.items()):
        offsets[(part, c)] = histogram.get(c, 0)
        histogram[c] = histogram.get(c, 0) + n
    lookup = _lookup(plan_packing(histogram, window // quantum))
    placed = ranked.mapInArrow(tidied(_place(lookup, offsets)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    scratch.drop("pieces")
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")
