"""Secrets in texts: three base patterns, and a randomness test battery on other long tokens.

Candidates are runs of at least `LEAST` characters of the base64/base64url alphabet that no base span
touches, whatever letters and digits they hold. A candidate's encoding (hex, letters, base32, alphanumeric, base64) is the smallest alphabet
that holds it, and it is read as a sequence of positions in that alphabet. The battery asks whether
that sequence looks drawn evenly: a chi-squared test of uniformity, a Wald-Wolfowitz runs test about
the alphabet's middle and a serial-correlation test. A candidate that fails the battery isn't random.

Passing alone says little of a short token, as a test of few characters rejects little. So each
candidate also gets the probability that an ordinary token of its length and encoding looks as even.
By its letter shares: a chi-squared value as low, the tail of a non-central chi-squared whose centre
grows with the length. By its order: as many changes between letters and digits, a binomial tail, as
ordinary tokens glue words and numbers. Encodings of one letter case combine both (Fisher); with both
cases, digits are too few for the second. In hex, whose words and numbers together may use the alphabet
evenly, the second alone tells: 16 to 24 digits get p-values of 0.01 to 0.0001, which pass only where
many candidates do. Over all
candidates of the corpus these p-values enter the Benjamini-Hochberg procedure, which bounds the share
of ordinary tokens among the reported ones by `FDR`; a candidate that fails the battery counts as a test with
a p-value of 1. The cut-off needs a histogram of p-values only, of a fixed number of bins.

Base spans stay whatever the tests say, but carry the same p-value where they are long enough.

Edge cases: a null or empty text has no span; a text of any length is scanned whole; repeated rows are
judged each for itself and count each in the procedure; without candidates the cut-off is 0; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.llm.scratch import ROW, Scratch, with_row

LEAST = 16
#: Share of ordinary tokens that the reported candidates may hold, and the battery's level.
FDR = 0.01
LEVEL = 0.001
#: Bins of the p-value histogram, per factor of ten, and factors of ten.
BINS, DECADES = 100, 60

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# runs of the class are matched whole, so the least length can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")

# Alphabets in their usual order
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upper_digits": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower_digits": "0123456789abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "alphanumeric": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_PLACES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: Sum of squared letter shares of ordinary text, times the alphabet's size, less one, at least: the
#: chi-squared excess per character of an ordinary token. Letters of European languages have a sum of
#: squares of 0.065 or more.
TEXT_SQUARES = 0.065
#: Share of neighbouring characters of an ordinary token that change between letter and digit, at most:
#: its words and numbers have nearly seven characters on average. An even hex token changes at 0.47.
CHANGES = 0.15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base kinds, by start, then as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds a token; None if none does."""
    chars = set(token)
    return next((name for name in sorted(ALPHABETS, key=lambda n: len(ALPHABETS[n])) if chars <= _PLACES[name].keys()), None)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_score(x: float, df: float) -> float:
    """The normal score of a chi-squared value (Wilson and Hilferty's cube root)."""
    return ((max(x, 0.0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def _chi_tail(x: float, df: float) -> float:
    """Upper tail of the chi-squared distribution."""
    return _normal_tail(_chi_score(x, df))


def chi_squared(places: list[int], size: int) -> float:
    """Pearson's statistic of even use of an alphabet."""
    n = len(places)
    return size / n * sum(c * c for c in Counter(places).values()) - n


def runs_p(places: list[int], size: int) -> float:
    """Two-sided p-value of the number of runs above and below the alphabet's middle."""
    high = [p >= size / 2 for p in places]
    a, n = sum(high), len(high)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    return 2 * _normal_tail(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(places: list[int]) -> float:
    """Two-sided p-value of the correlation of neighbouring characters."""
    n = len(places)
    mean = sum(places) / n
    var = sum((p - mean) ** 2 for p in places)
    if not var:
        return 0.0
    r = sum((x - mean) * (y - mean) for x, y in zip(places, places[1:], strict=False)) / var
    return 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))


def battery_p(places: list[int], size: int) -> float:
    """p-value of evenness by all three tests (Fisher's combination)."""
    x = chi_squared(places, size)
    logs = [math.log(max(p, 1e-300)) for p in (_chi_tail(x, size - 1), runs_p(places, size), serial_p(places))]
    return _chi_tail(-2 * sum(logs), 6)


def ordinary_p(places: list[int], size: int) -> float:
    """Probability that an ordinary token of this length is at least as even.

    The statistic of a token with uneven letter shares is non-central; Patnaik's two moments map it to
    a central one. The excess grows with the length, so short tokens can't get a low value.
    """
    n, df = len(places), size - 1
    excess = max(0.0, TEXT_SQUARES * size - 1) * n
    x = chi_squared(places, size)
    scale = (df + 2 * excess) / (df + excess)
    return max(1e-300, _normal_tail(-_chi_score(x / scale, (df + excess) ** 2 / (df + 2 * excess))))


def changes_p(token: str) -> float:
    """Probability that an ordinary token of this length changes as often between letters and digits."""
    digit = [c.isdigit() for c in token]
    n, k = len(token) - 1, sum(x != y for x, y in zip(digit, digit[1:], strict=False))
    if k <= CHANGES * n:
        return 1.0
    # the binomial terms from k on, relative to the first; they fall off from above the mean
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(CHANGES) + (n - k) * math.log1p(-CHANGES)
    term = total = 1.0
    while term > 1e-17 * total and k < n:
        term *= (n - k) / (k + 1) * CHANGES / (1 - CHANGES)
        total += term
        k += 1
    return min(1.0, max(1e-300, math.exp(max(first, -700.0)) * total))


def unusual_p(token: str, name: str) -> float:
    """Probability that an ordinary token of this length and encoding looks as evenly drawn."""
    alphabet = ALPHABETS[name]
    if len(alphabet) == 16:
        return changes_p(token)
    shares = ordinary_p([_PLACES[name][c] for c in token], len(alphabet))
    if len(alphabet) > 36 or alphabet.isalpha():
        return shares
    log = math.log(shares) + math.log(changes_p(token))
    return max(1e-300, math.exp(max(log, -700.0)) * (1 - log))


def token_p(token: str) -> tuple[str | None, float]:
    """Encoding of a token, and its p-value: 1 if the battery says that it isn't evenly drawn."""
    token = token.rstrip("=")
    name = encoding_of(token)
    if name is None:
        return None, 1.0
    if battery_p([_PLACES[name][c] for c in token], len(ALPHABETS[name])) < LEVEL:
        return name, 1.0
    return name, unusual_p(token, name)


def base_p(text: str, span: tuple[int, int, str]) -> tuple[str | None, float | None]:
    """The same for what a base span holds; None if that is too short to be tested."""
    start, stop, kind = span
    value = text[start:stop]
    if kind == "assign":
        value = _ASSIGN.match(text, start)[2]
    return token_p(value) if len(value) >= LEAST else (None, None)


def candidates(text: str, taken: list[tuple[int, int, str]]) -> tuple[int, list[tuple[int, int, str, float]]]:
    """How many tokens no base span touches, and (start, end, encoding, p) of those that pass the battery."""
    out, at, tested = [], 0, 0
    taken = sorted(taken)
    for m in _TOKEN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if any(s < m.end() and m.start() < e for s, e, _ in taken[at : at + len(KINDS)]):
            continue
        tested += 1
        name, p = token_p(m[0])
        if p < 1.0:
            out.append((m.start(), m.end(), name, p))
    return tested, out


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("p", pa.float64()), ("encoding", pa.string())])
_SCHEMA = f"{ROW} long, doc_id long, tested long, spans array<struct<start:long,stop:long,kind:string,p:double,encoding:string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, tested = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            n, more = candidates(text, base)
            tested.append(n)
            judged = [(b, base_p(text, b)) for b in base]
            spans.append([{"start": s, "stop": e, "kind": k, "p": p, "encoding": n} for (s, e, k), (n, p) in judged] + [{"start": s, "stop": e, "kind": "random", "p": p, "encoding": n} for s, e, n, p in more])
        yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(tested, pa.int64()), pa.array(spans, pa.list_(_SPAN))], names=[ROW, "doc_id", "tested", "spans"])


def cut_off(histogram: dict[int, int], tests: int, fdr: float = FDR) -> float:
    """Largest p that Benjamini and Hochberg's procedure lets pass; bin b holds p up to 10^(-b/BINS)."""
    passed, best = 0, 0.0
    for b in sorted(histogram, reverse=True):
        passed += histogram[b]
        bound = 10 ** (-b / BINS)
        if bound <= fdr * passed / tests:
            best = bound
    return best


def scan_secrets(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Row key, doc_id, n_tested and the spans (start, stop, kind, p, encoding) of each document, by start."""
    scratch = Scratch(spark, "secret-scan")
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = scratch.save(rows.mapInArrow(_scan, _SCHEMA), "found")
    each = found.select(F.explode("spans").alias("s")).where("s.kind = 'random'")
    bins = F.least(F.floor(-F.log10("s.p") * BINS), F.lit(BINS * DECADES)).cast("int")
    histogram = {r["bin"]: r["n"] for r in each.groupBy(bins.alias("bin")).agg(F.count("*").alias("n")).collect()}
    tests = found.agg(F.sum("tested")).collect()[0][0] or 0
    limit = cut_off(histogram, max(1, tests))
    return found.select(ROW, "doc_id", F.col("tested").alias("n_tested"), F.array_sort(F.filter("spans", lambda s: (s["kind"] != "random") | (s["p"] <= limit)), _by_start).alias("spans"))


def _by_start(a: Column, b: Column) -> Column:
    place = lambda s: s["start"] * len(KINDS) + F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
