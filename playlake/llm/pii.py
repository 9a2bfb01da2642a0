"""Personal data in texts by weak supervision, with DataFrame functions only.

Candidates come from patterns: four base kinds, whose passing matches are always reported, and looser
kinds. Labelers (format, checksum, gazetteer, context) vote on each candidate or abstain. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is, for personal and
other spans, and gives each pattern a probability. These soft labels train a logistic span classifier
that doesn't see the votes but the span and its place: digit groups, separators, letters, the word before it (hashed) and
the character after it. It decides which of the looser candidates are reported.

The corpus is read by Spark's functions alone. The driver fits the label model to one row per distinct
kind and vote pattern (`kinds * 3^labelers` at most) and the classifier to one row per distinct kind and
features (`kinds * GROUPS * 5 * 4 * (WORDS + 1) * 4` at most), whatever the corpus.

Positions: matches are marked in place, the text is split at the marks, and running sums of the
parts' lengths give code points. Patterns use possessive quantifiers and start only where a run of
their characters does, so long runs cost linear time.

Edge cases: a null or empty text has no span; a text may hold the marks themselves, which are replaced
by another control character of the same length first; repeated rows are judged each for itself; a
corpus without candidates fits no model; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playlake.llm.scratch import ROW, Scratch, with_row

#: Probability from which a looser candidate is reported.
ACCEPT = 0.8
#: Votes that a labeler is taken to have cast rightly and wrongly on each class before it casts any.
PRIOR = (9.0, 1.0)
#: Code points before a match that the context labeler reads.
CONTEXT = 40
#: Values of the classifier's features: digit groups counted, and buckets of the word before.
GROUPS, WORDS = 6, 24
LABELERS = ("v_format", "v_checksum", "v_gazetteer", "v_context")
FEATURES = ("f_groups", "f_separator", "f_letters", "f_before", "f_after")

_MARK, _OTHER = "\x01", "\x02"

# gazetteers
_DOMAINS = "com|org|net|edu|gov|int|info|io|de|fr|es|uk|us|eu|it|nl|ch|at|be|pt|pl|se|no|dk|fi|ie|ca|au|jp|cn|in|br|mx"
_COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
_GIVEN = "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|David|Elizabeth|William|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Daniel|Nancy|Peter|Anna|Hans|Julia|Pierre|Marie|Jean|Sophie|Carlos|Maria|Juan|Carmen|Luis|Lucia"
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra"
_CUES = r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|e-?mail|mail|reach|ssn|social security|iban|account|card|visa|address|name|dear|signed|passport)[^A-Za-z]{0,3}$"
_ANTI_CUES = r"(?i)(?:version|isbn|issn|doi|order|invoice|page|figure|fig|table|section|chapter|no|nr|\$|€|£|#|=)[^A-Za-z0-9]{0,3}$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _octets(c: Column) -> Column:
    """Whether all dotted numbers are at most 255; they may have leading zeros and any length."""
    return F.forall(F.split(c, r"\."), lambda p: p.rlike("^0*(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _mod97(c: Column) -> Column:
    """Whether an account number's check digits are right: letters count from 10, the first four places come last."""
    plain = F.regexp_replace(c, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))
    value = lambda ch: F.when(ch.between("0", "9"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, ch: F.when(ch == "", r).otherwise((r * F.when(ch.between("0", "9"), 10).otherwise(100) + value(ch)) % 97))
    return rest == 1


def _always(c: Column) -> Column:
    return F.lit(True)


def _abstain(c: Column) -> Column:
    return F.lit(None).cast("int")


@dataclass(frozen=True)
class Kind:
    """A pattern, when to try it, what a match must pass, and its labelers' votes."""

    name: str
    pattern: str
    trigger: str
    passes: Callable[[Column], Column]
    format: Callable[[Column], Column]
    checksum: Callable[[Column], Column] = _abstain
    gazetteer: Callable[[Column], Column] = _abstain
    base: bool = False


def _vote(test: Column) -> Column:
    return test.cast("int")


KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", _always,
        lambda c: _vote(c.rlike(r"^[A-Za-z0-9][^@]*@[A-Za-z0-9].*\.[A-Za-z]{2,}$")), gazetteer=lambda c: F.when(c.rlike(rf"(?i)\.(?:{_DOMAINS})$"), 1), base=True,
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]", _octets,
        lambda c: _vote(~c.rlike(r"^(?:0|00|000)\.|(?:^|\.)0[0-9]")), checksum=lambda c: _vote(_octets(c)), base=True,
    ),
    Kind(
        "card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", lambda c: F.length(_digits(c)).between(13, 19) & F.call_function("luhn_check", _digits(c)),
        lambda c: _vote(F.length(_digits(c)).between(15, 16)), checksum=lambda c: _vote(F.call_function("luhn_check", _digits(c))),
        gazetteer=lambda c: _vote(_digits(c).rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)")), base=True,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+", lambda c: F.length(_digits(c)).between(9, 15),
        lambda c: _vote(F.length(_digits(c)) >= 10), gazetteer=lambda c: _vote(~c.rlike(r"^\+0")), base=True,
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", _always,
        lambda c: _vote(~c.rlike(r"^(?:000|666|9..)|-00-|-0000$")),
    ),
    Kind(
        "localphone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "[0-9][\x20.-][0-9]", _always,
        lambda c: _vote(_digits(c).rlike("^[2-9]..[2-9]")), gazetteer=lambda c: F.when(c.rlike(r"^\("), 1),
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", _always,
        lambda c: _vote(F.length(F.regexp_replace(c, " ", "")).between(15, 34)), checksum=lambda c: _vote(_mod97(c)), gazetteer=lambda c: _vote(c.rlike(rf"^(?:{_COUNTRIES})")),
    ),
    Kind(
        "name", rf"(?<![A-Za-z])(?:(?:{_TITLES})\.?|(?:{_GIVEN}))\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?(?![A-Za-z])", rf"(?:{_TITLES}|{_GIVEN})\.? [A-Z]", _always,
        lambda c: _vote(c.rlike(r"[A-Z][a-z]+ [A-Z][a-z]+$")), gazetteer=lambda c: _vote(c.rlike(rf"(?:{_GIVEN})")),
    ),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _by_kind(value: Callable[[Kind], Column]) -> Column:
    """The value that belongs to the row's kind."""
    out = F.lit(None)
    for k in KINDS:
        out = F.when(F.col("kind") == k.name, value(k)).otherwise(out)
    return out


def find_candidates(rows: DataFrame) -> DataFrame:
    """(row key, kind, start, stop, is_base, votes and features) of every match; stop is exclusive."""
    clean = rows.select(ROW, F.when(F.col("text").contains(_MARK), F.replace("text", F.lit(_MARK), F.lit(_OTHER))).otherwise(F.col("text")).alias("text"))

    def parts(k: Kind) -> Column:
        return F.when(F.col("text").rlike(k.trigger), F.split(F.regexp_replace("text", k.pattern, f"{_MARK}$0{_MARK}"), _MARK, -1))

    def item(p: Column, i: Column, whole: Column) -> Column:
        odd = i % 2 == 1
        before, after = F.when(odd, F.right(F.get(whole, i - 1), F.lit(CONTEXT))), F.when(odd, F.left(F.get(whole, i + 1), F.lit(1)))
        return F.struct(F.length(p).alias("size"), F.when(odd, p).alias("found"), before.alias("before"), after.alias("after"))

    split = clean.select(ROW, F.explode_outer(F.array(*(F.struct(F.lit(k.name).alias("kind"), parts(k).alias("parts")) for k in KINDS))).alias("k"))
    split = split.select(ROW, F.col("k.kind").alias("kind"), F.col("k.parts").alias("parts")).where(F.size("parts") > 1)
    items = split.select(ROW, "kind", F.transform("parts", lambda p, i: item(p, i, F.col("parts"))).alias("items"))
    each = items.select(ROW, "kind", F.posexplode_outer("items").alias("at", "item")).select(ROW, "kind", "at", "item.*")
    before = Window.partitionBy(ROW, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long")).where("found is not null")
    found = F.col("found")
    return placed.select(
        ROW,
        "kind",
        "start",
        (F.col("start") + F.col("size")).alias("stop"),
        (F.col("kind").isin(*BASE) & _by_kind(lambda k: k.passes(found))).alias("is_base"),
        _by_kind(lambda k: k.format(found)).alias("v_format"),
        _by_kind(lambda k: k.checksum(found)).alias("v_checksum"),
        _by_kind(lambda k: k.gazetteer(found)).alias("v_gazetteer"),
        F.when(F.col("before").rlike(_CUES), 1).when(F.col("before").rlike(_ANTI_CUES), 0).alias("v_context"),
        *(v.alias(k) for k, v in _span_features(found).items()),
    )


def _span_features(found: Column) -> dict[str, Column]:
    """The classifier's features of a match and what stands around it, each of few values."""
    groups = F.size(F.filter(F.split(found, "[^0-9]+"), lambda g: g != ""))
    word = F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]{0,3}$", 1))
    after = F.col("after")
    return {
        "f_groups": F.least(groups, F.lit(GROUPS - 1)),
        "f_separator": F.when(found.contains("-"), 1).when(found.contains("."), 2).when(found.contains("("), 3).when(found.contains(" "), 4).otherwise(0),
        "f_letters": F.when(found.rlike("[a-z]") & found.rlike("[A-Z]"), 3).when(found.rlike("[A-Z]"), 2).when(found.rlike("[a-z]"), 1).otherwise(0),
        "f_before": F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(WORDS)).cast("int")),
        "f_after": F.when(after.rlike("[0-9]"), 1).when(after.rlike("[A-Za-z]"), 2).when(after.isin(" ", "\n", ".", ",", "") | after.isNull(), 0).otherwise(3),
    }


Pattern = tuple[str, tuple[int | None, ...]]


def estimate(patterns: dict[Pattern, int], rounds: int = 100) -> tuple[dict[Pattern, float], dict[str, list[dict]]]:
    """Probability that spans of a pattern are personal, and each labeler's reliability per kind (by EM).

    Each kind has its own reliabilities; with shared ones the classes would come to mean kinds. Both classes
    are held to be equally frequent before any vote, so that a labeler that always votes alike ends up saying nothing.
    Labelers are independent given the class, and an abstention says nothing. A reliability maps (class, vote)
    to a probability; a labeler votes 1 on personal spans at least as often as on others.
    """
    post: dict[Pattern, float] = {}
    tables: dict[str, list[dict]] = {}
    right, wrong = PRIOR
    for kind in sorted({k for k, _ in patterns}):
        own = {p: n for p, n in patterns.items() if p[0] == kind}
        table = [{(c, v): (right if v == c else wrong) / (right + wrong) for c in (0, 1) for v in (0, 1)} for _ in LABELERS]
        for _ in range(rounds):
            for p in own:
                odds = sum(math.log(t[1, v] / t[0, v]) for t, v in zip(table, p[1], strict=True) if v is not None)
                post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            for at, t in enumerate(table):
                mass = {(c, v): right if v == c else wrong for c in (0, 1) for v in (0, 1)}
                for p, n in own.items():
                    if p[1][at] is not None:
                        mass[1, p[1][at]] += n * post[p]
                        mass[0, p[1][at]] += n * (1 - post[p])
                yes = {c: mass[c, 1] / (mass[c, 0] + mass[c, 1]) for c in (0, 1)}
                if yes[1] < yes[0]:
                    yes = dict.fromkeys((0, 1), (mass[0, 1] + mass[1, 1]) / sum(mass.values()))
                t.update({(c, v): yes[c] if v else 1 - yes[c] for c in (0, 1) for v in (0, 1)})
        tables[kind] = table
    return post, tables


Features = tuple[str, ...]


def _named(kind: str, values: Features) -> list[str]:
    """A row's active features: its kind, and each value by itself and within the kind."""
    single = [f"{n}={v}" for n, v in zip(FEATURES, values, strict=True)]
    return [f"kind={kind}", *single, *(f"{kind}:{f}" for f in single)]


def train_classifier(rows: dict[tuple[str, Features], tuple[float, float]], steps: int = 1000, decay: float = 1.0) -> dict[str, float]:
    """Weights of a logistic model, by gradient descent on (spans, sum of their probabilities) per row.

    The penalty is that of `decay` spans, so features seen a few times only hardly count.
    """
    names = sorted({f for k, v in rows for f in _named(k, v)})
    place = {f: i for i, f in enumerate(names)}
    active = np.array([[place[f] for f in _named(k, v)] for k, v in rows])
    load, mass = (np.array([r[i] for r in rows.values()], np.float64) for i in (0, 1))
    weights, seen = np.zeros(len(names)), np.zeros(len(names))
    np.add.at(seen, active, load[:, None])
    pace = 1 / (active.shape[1] * seen / 4 + decay)  # each weight by the greatest curvature it can have
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(weights[active].sum(axis=1), -30, 30)))
        grad = decay * weights
        np.add.at(grad, active, (load * p - mass)[:, None])
        weights -= pace * grad
    return dict(zip(names, weights.tolist(), strict=True))


def score(weights: dict[str, float]) -> Column:
    """The classifier's probability, as an expression over a candidate's columns."""
    table = F.create_map(*(F.lit(x) for f, w in weights.items() for x in (f, w)))
    single = [F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in FEATURES]
    names = [F.concat(F.lit("kind="), F.col("kind")), *single, *(F.concat(F.col("kind"), F.lit(":"), s) for s in single)]
    z = sum((F.coalesce(F.try_element_at(table, n), F.lit(0.0)) for n in names), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def fit(candidates: DataFrame) -> dict[str, float]:
    """Estimate reliabilities on all candidates' votes, and train the classifier on all their features."""
    counted = candidates.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect()
    patterns = {(r["kind"], tuple(r[v] for v in LABELERS)): r["n"] for r in sorted(counted, key=str)}
    if not patterns:
        return {}
    post, _ = estimate(patterns)
    rows = [(k, *votes, p) for (k, votes), p in post.items()]
    table = candidates.sparkSession.createDataFrame(rows, "kind string, " + ", ".join(f"{v} int" for v in LABELERS) + ", post double")
    same = candidates["kind"] == table["kind"]
    for v in LABELERS:
        same = same & candidates[v].eqNullSafe(table[v])
    # a row per vote pattern, whatever the corpus
    soft = candidates.join(F.broadcast(table), same).groupBy(candidates["kind"], *FEATURES).agg(F.count("*").alias("n"), F.sum("post").alias("mass")).collect()
    return train_classifier({(r["kind"], tuple(str(r[f]) for f in FEATURES)): (r["n"], r["mass"]) for r in sorted(soft, key=str)})


def find_personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Row key, doc_id and the reported spans (kind, start, stop, score, is_base) of each document."""
    scratch = Scratch(spark, "pii")
    rows = with_row(docs.select("doc_id", "text"))
    candidates = scratch.save(find_candidates(rows), "candidates")
    weights = fit(candidates)
    scored = candidates.withColumn("score", score(weights) if weights else F.lit(0.0)).where(F.col("is_base") | ((F.col("score") >= ACCEPT) & ~F.col("kind").isin(*BASE)))
    near = Window.partitionBy(ROW).orderBy("start", F.col("is_base").desc(), "stop")
    behind = F.max(F.when(F.col("is_base"), F.col("stop"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("is_base"), F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(behind, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("stop")) >= F.col("stop"))
    reported = scored.withColumn("free", F.col("is_base") | free).where("free")
    spans = reported.groupBy(ROW).agg(F.collect_list(F.struct("kind", "start", "stop", "score", "is_base")).alias("spans"))
    return rows.select(ROW, "doc_id").join(spans, ROW, "left").select(ROW, "doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def kind_order(kind: Column) -> Column:
    """A kind's place among the listed ones."""
    return F.array_position(F.array(*(F.lit(k.name) for k in KINDS)), kind)
