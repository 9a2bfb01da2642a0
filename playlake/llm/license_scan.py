"""Licence notices in texts: MinHash bands retrieve templates, exact containment verifies them.

Words are runs of ASCII letters and digits or of other bytes, in lower case; shingles are five words,
or the whole notice if it has fewer. A template of s shingles is sought by windows of about s shingles
that overlap by seven eighths or more. A window's signature holds, per band, the least values of `ROWS`
permutations; a window and a template that agree in any band are a candidate pair.

The number of bands follows from s: a copy that holds `PERCENT` % of the template's shingles, seen
through the nearest window, has a least Jaccard similarity, and bands are added until such a pair
collides with a probability of `RECALL` or more. Where that share means all shingles, one band suffices and
nothing is missed. Verified are all windows of s shingles around a candidate: the share of the
template's distinct shingles in the window. Copies may follow each other directly: of sufficient
windows that overlap, those that share no word and together hold most shingles are matches.

Documents are scanned in one pass without a shuffle; the templates are a fixed list, whose signatures
each task computes for itself.

Edge cases: a null or empty text matches nothing; a text shorter than a template matches if it holds
enough of it; repeated rows are scanned each for itself; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.llm.license_templates import TEMPLATES
from playlake.llm.scratch import ROW, with_row
from playlake.llm.textkit import grams, hashes_of
from playlake.shipping import ship_package

WORDS = 5
PERCENT = 80
ROWS = 2
RECALL = 0.999
#: Windows start every (s / STEPS) shingles.
STEPS = 8
#: Words whose signatures are held at once.
CHUNK_WORDS = 60_000

_TABLE = bytes((b + 32) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words of a text."""
    return (text or b"").translate(_TABLE).split()


@dataclass
class Sought:
    """Templates of one shingle length and count, and the bands that find them."""

    words: int
    size: int
    step: int = field(init=False)
    blocks: int = field(init=False)
    bands: int = field(init=False)
    keys: dict[int, dict[int, list[int]]] = field(default_factory=dict)

    def __post_init__(self):
        self.step = max(1, self.size // STEPS)
        self.blocks = -(-self.size // self.step)
        self.bands = bands_for(self.size, self.step, self.step * self.blocks)


def bands_for(size: int, step: int, window: int) -> int:
    """Bands by which a sufficient copy and its nearest window collide with a probability of `RECALL`."""
    common = -(-PERCENT * size // 100)
    seen = common - step // 2
    similarity = max(0.05, seen / (size + window - seen))
    return 1 if similarity >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - similarity**ROWS))


_SALTS = np.random.default_rng(20).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _permuted(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th permutation of shingle hashes, as 32-bit ranks."""
    return ((h * _SALTS[k]) >> np.uint64(32)).astype(np.uint32)


def _window_minima(values: np.ndarray, step: int, blocks: int) -> np.ndarray:
    """Least value of windows of `blocks` steps, one at each step; the last ones are cut short."""
    if not len(values):
        return values
    m = np.minimum.reduceat(values, np.arange(0, len(values), step)) if step > 1 else values
    span = 1
    out = np.concatenate((m, np.full(blocks, np.uint32(0xFFFFFFFF))))
    while 2 * span <= blocks:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = blocks - span
    if rest:
        out = np.minimum(out[:-rest], out[rest:])
    return out[: len(m)]


class Permutations(dict):
    """Permutations of some shingle hashes, each computed once."""

    def __init__(self, h: np.ndarray):
        super().__init__()
        self.hashes = h

    def __missing__(self, k: int) -> np.ndarray:
        value = self[k] = _permuted(self.hashes, k)
        return value


def _band_keys(ranks: Permutations, sought: Sought) -> Iterator[np.ndarray]:
    """Per band, a 64-bit key of each window."""
    for band in range(sought.bands):
        first, second = (_window_minima(ranks[ROWS * band + r], sought.step, sought.blocks).astype(np.uint64) for r in range(ROWS))
        yield (first << np.uint64(32)) | second


def _growth(h: list[int], known: set[int], start: int, size: int) -> list[int]:
    """How many distinct known shingles the first 0, 1, 2, ... shingles from `start` hold."""
    seen: set[int] = set()
    counts = [0]
    for x in h[start : start + size]:
        if x in known:
            seen.add(x)
        counts.append(len(seen))
    return counts


def _apart(h: list[int], known: set[int], n: int, size: int, run: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """(start, stop, share) of the sufficient windows of a run that share no word and hold most shingles.

    A window may end before its `size` where the next one starts. Of equal choices, the one of fewer
    windows is taken, then of earlier starts. A run of one copy gives its best window.
    """
    need = PERCENT * len(known)
    starts = [p for p, _ in run]
    if 100 * (starts[-1] - starts[0]) < need:  # two sufficient windows don't fit
        starts = [max(run, key=lambda x: (x[1], -x[0]))[0]]
    # from the last start to the first: the best (shingles, -windows) with a window here, its stop, and what follows
    best: dict[int, tuple[int, int]] = {}
    chosen: dict[int, tuple[int, int, int | None]] = {}
    onward: list[int | None] = [None] * (len(starts) + 1)  # best start at or after each place of the run
    for i in range(len(starts) - 1, -1, -1):
        p = starts[i]
        counts = _growth(h, known, p, size)
        lasts = [q for q in range(p, p + len(counts) - 1) if h[q] in known]
        options = [(counts[-1], onward[bisect_left(starts, lasts[-1] + n)], lasts[-1] + n)]
        for q in starts[i + 1 : bisect_left(starts, p + size + n - 1)]:
            end = q - n + 1  # shingles from here on reach into the next window
            if end > p and 100 * counts[end - p] >= need:
                options.append((counts[end - p], q, lasts[bisect_left(lasts, end) - 1] + n))
        for count, after, stop in options:
            total, windows = best[after] if after is not None else (0, 0)
            value = (total + count, windows - 1)
            if p not in best or value > best[p]:
                best[p], chosen[p] = value, (count, stop, after)
        rest = onward[i + 1]
        onward[i] = p if rest is None or best[p] >= best[rest] else rest
    out, at = [], onward[0]
    while at is not None:
        count, stop, after = chosen[at]
        out.append((at, stop, count / len(known)))
        at = after
    return out


class Templates:
    """The templates' shingles, and their band keys by shingle length and count."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [name for name, _ in templates]
        self.sets: list[set[int]] = []
        self.shape: list[tuple[int, int]] = []
        self.sought: dict[tuple[int, int], Sought] = {}
        for at, (_, text) in enumerate(templates):
            words = words_of(text.encode())
            n = min(WORDS, len(words))
            h = grams(hashes_of(words), n)
            self.sets.append(set(h.tolist()))
            self.shape.append((n, len(h)))
            sought = self.sought.setdefault((n, len(h)), Sought(n, len(h)))
            for band, keys in enumerate(_band_keys(Permutations(h), sought)):
                sought.keys.setdefault(band, {}).setdefault(int(keys[0]), []).append(at)

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, place) of windows over word hashes that share a band with a template."""
        by_words = {n: Permutations(grams(hashes, n)) for n in {s.words for s in self.sought.values()}}
        for sought in self.sought.values():
            for band, keys in enumerate(_band_keys(by_words[sought.words], sought)):
                for key, templates in sought.keys[band].items():
                    for at in np.flatnonzero(keys == np.uint64(key)).tolist():
                        for template in templates:
                            yield template, at * sought.step

    def matches(self, hashes: np.ndarray, places: dict[int, list[int]]) -> list[tuple[int, int, int, float]]:
        """(template, start, stop, share) in a document's words, near the candidates' places."""
        out = []
        for template, near in sorted(places.items()):
            n, size = self.shape[template]
            h = grams(hashes, n).tolist()
            known, need = self.sets[template], PERCENT * len(self.sets[template])
            starts = sorted({p for at in near for p in range(max(0, at - 2 * size), min(len(h), at + 2 * size + 1))})
            good: list[tuple[int, float]] = []
            for p in starts:
                if h[p] in known:  # a best window starts with a shingle of the template
                    share = len(known.intersection(h[p : p + size]))
                    if 100 * share >= need:
                        good.append((p, share / len(known)))
            run: list[tuple[int, float]] = []
            for p, share in [*good, (1 << 60, 0.0)]:
                if run and p >= run[-1][0] + size + n - 1:
                    out += [(template, start, stop, best) for start, stop, best in _apart(h, known, n, size, run)]
                    run = []
                run.append((p, share))
        return out


_MATCH = pa.struct([("license", pa.string()), ("template", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])
_SCHEMA = f"{ROW} long, doc_id long, n_words long, matches array<struct<license:string,template:long,start:long,stop:long,share:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = Templates()
    for batch in batches:
        hashes = [hashes_of(words_of(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        found: list[dict[int, list[int]]] = [{} for _ in hashes]
        first = 0
        while first < len(hashes):
            last, n = first, 0
            while last < len(hashes) and (n == 0 or n + len(hashes[last]) <= CHUNK_WORDS):
                n += len(hashes[last])
                last += 1
            starts = np.concatenate(([0], np.cumsum([len(h) for h in hashes[first:last]])))
            for template, at in templates.candidates(np.concatenate(hashes[first:last])):
                size = templates.shape[template][1]
                # a window over a border belongs to every document that it touches
                lo = int(np.searchsorted(starts, at, "right")) - 1
                hi = int(np.searchsorted(starts, at + size, "left"))
                for doc in range(max(0, lo), min(hi, last - first)):
                    found[first + doc].setdefault(template, []).append(at - int(starts[doc]))
            first = last
        rows = [[{"license": templates.names[t], "template": t, "start": s, "stop": e, "share": v} for t, s, e, v in templates.matches(h, p)] for h, p in zip(hashes, found, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array([len(h) for h in hashes], pa.int64()), pa.array(rows, pa.list_(_MATCH))], names=[ROW, "doc_id", "n_words", "matches"])


def scan_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Row key, doc_id, n_words and the matches (licence, template, word span, share) of each document."""
    ship_package(spark)
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.mapInArrow(_scan, _SCHEMA)
