"""Plain versions that share no code with the operators, and what stages do with odd tables."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from playlake.llm import decontamination, exact_dedup, langid, license_scan, license_templates, ngram_join, packing, queries, scratch
from tests.llm import brute
from tests.llm.test_operators import _documents, _prose


def _words(text: str) -> list[str]:
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7F])+", text.translate(brute.LOWER))


def _plain_licenses(text: str) -> set[int]:
    """Templates of which some window of as many shingles holds four fifths, by comparing every window."""
    found = set()
    w = _words(text)
    for at, (_, template) in enumerate(license_templates.TEMPLATES):
        t = _words(template)
        n = min(5, len(t))
        known = {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}
        size = len(t) - n + 1
        own = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        if any(5 * len(known & set(own[i : i + size])) >= 4 * len(known) for i in range(max(1, len(own) - size + 1))):
            found.add(at)
    return found


def test_licenses_against_every_window(spark, tmp_path):
    rng, cases = random.Random(9), []
    for d in range(120):
        words = license_templates.TEMPLATES[d % len(license_templates.TEMPLATES)][1].split()
        for _ in range(rng.randint(0, max(1, len(words) // 50))):
            words[rng.randrange(len(words))] = rng.choice(["other", "x1", "Some"])
        cases.append((d, f"{_prose(d, rng.randint(0, 60))} {' '.join(words[: rng.randint(len(words) * 17 // 20, len(words))])} {_prose(d + 500, rng.randint(0, 60))}"))
    _documents(spark, cases).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    found = license_scan.scan_licenses(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = {r["doc_id"]: {m["template"] for m in r["matches"]} for r in found.collect()}
    want = {d: _plain_licenses(t) for d, t in cases}
    assert all(got[d] <= want[d] for d in want)  # nothing insufficient
    assert sum(len(got[d]) for d in got) >= 0.99 * sum(map(len, want.values())) and sum(map(len, want.values())) > 60


def _language(seed: int, letters: str, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_language_model_is_calibrated_and_rejects_what_it_has_not_learned():
    alphabets = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "nopqrstu"}
    model = langid.train([(_language(i, a, 30), lang) for lang, a in alphabets.items() for i in range(60)])
    right, scores = 0, []
    for lang, a in alphabets.items():
        for i in range(1000, 1030):
            got, score, rejected = model.predict(_language(i, a, 30))
            right += got == lang
            scores.append(score)
            assert not rejected
    assert right == 90 and abs(np.mean(scores) - 1.0) < 0.1  # as sure as it is right
    unlearned = [model.predict(_language(i, "йцукенгшщзхъ", 30)) for i in range(20)]
    assert np.mean([s for _, s, _ in unlearned]) < np.mean(scores)
    mixed = [model.predict(_language(i, "abcdefghijklmnopqrstu", 30))[1] for i in range(20)]
    assert np.mean(mixed) < np.mean(scores)


def test_a_long_text_is_read_in_pieces_to_its_end():
    model = langid.train([(_language(i, a, 30), lang) for lang, a in (("aa", "abcdefgh"), ("bb", "ijklmnop")) for i in range(40)])
    text = _language(1, "abcdefgh", 10) + " " + _language(2, "ijklmnop", 400_000)  # longer than a piece
    assert len(text) > langid.PIECE and model.predict(text)[0] == "bb"


def test_every_label_is_sampled(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 4)
    rows = [(i, f"text {i}", f"l{i % 12:02d}") for i in range(240)]
    sample = langid.sample_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(sample) < 60  # about one of each
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 6000)
    monkeypatch.setattr(langid, "BROADCAST_LANGUAGES", 0)
    assert {r[2] for r in langid.sample_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))} == {f"l{i:02d}" for i in range(12)}


ITEMS = [(1, _prose(77, 30)), (2, None), (3, "")]
ODD = [(1, None), (2, ""), (3, "  "), (3, "  "), (4, _prose(5, 40)), (4, _prose(5, 40)), (None, _prose(6, 40)), (5, _prose(6, 40) + " more"), (6, _prose(77, 30)), (7, "word " * 6000), (8, "ß½ é " * 9)]


def _odd(spark, tmp_path):
    """Null ids and texts, repeated rows and columns named like those that operators make."""
    extra = {"score": F.lit(0.5), "_score_0": F.lit("mine"), "rejected": F.lit("no"), "kept": F.lit(1), "n_words": F.lit(2), "items": F.lit("i"), "node": F.lit(3), "digest": F.lit("d"), "lang": F.lit(None).cast("string")}
    spark.createDataFrame(ODD, "doc_id long, text string").withColumns(extra).withColumn(scratch.ROW, F.lit("mine")).write.mode("overwrite").parquet(str(tmp_path / "odd"))
    return spark.read.parquet(str(tmp_path / "odd"))


def test_stages_on_odd_tables(spark, tmp_path):
    docs = _odd(spark, tmp_path)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    body = lambda t: (t or "").translate(brute.LOWER)
    copies = exact_dedup.drop_copies(spark, docs)
    assert sorted(body(r["text"]) for r in copies.collect()) == sorted({body(t) for _, t in ODD})
    near = ngram_join.drop_near_copies(spark, docs)
    assert near.count() == len(ODD) - 2  # of the repeated row and of the near copies one stays; texts without words link with nothing
    clean = decontamination.drop_contaminated(spark, docs, items)
    assert clean.count() == len(ODD) - 1 and 6 not in {r["doc_id"] for r in clean.collect()}
    assert langid.drop_rejected(spark, docs).count() == 0  # nothing is labelled, so nothing is known
    for kept in (copies, near, clean):
        assert kept.columns == docs.columns and {r[scratch.ROW] for r in kept.collect()} == {"mine"}


def test_stages_on_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS[:1], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_every_document_has_the_ids_of_the_tokenizer(spark):
    own = packing._tokenizers.setdefault("test", packing.Tokenizer(queries.tokenizer_path()))
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        text = r["text"] or ""
        assert own.encode(text) == np.array(own.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
