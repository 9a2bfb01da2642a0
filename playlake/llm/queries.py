"""The registered queries of the pipeline operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlake.llm import chat, decontamination
from playlake.llm import exact_dedup as dedup
from playlake.llm import langid, license_scan, ngram_join, packing, pii, secret_scan, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """Place of the public byte-level vocabulary that the packing query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _located(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document."""
    out = secret_scan.scan_secrets(spark, _documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [_count_kind(F.col("spans"), k) for k in secret_scan.KINDS]
    least = F.array_min(F.transform("spans", lambda s: s["p"]))
    unlikely = F.size(F.filter("spans", lambda s: s["p"] <= 0.001)).cast("long")
    return out.select(
        "doc_id", *counts, F.sha2(_located(base).cast("binary"), 256).alias("base_sha256"), _located(F.col("spans")).alias("spans"), "n_tested", unlikely.alias("n_even"), least.alias("least_p")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark item's window."""
    out = decontamination.judge_documents(spark, _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of each document; spans count words."""
    out = license_scan.scan_licenses(spark, _documents(spark, sf_dir))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["template"].cast("string"), m["start"].cast("string"), m["stop"].cast("string"), F.format_number(m["share"], 4)))
    return out.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", names).alias("licenses"), F.concat_ws(",", spans).alias("spans"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of each group of equal documents stays."""
    return dedup.exact_dedup(spark, _documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document, with a calibrated score."""
    return langid.identify_languages(spark, _documents(spark, sf_dir))


def _span_list(spans: Column) -> Column:
    """Spans (order, start, stop, kind) as kind:start:stop, in order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document."""
    out = pii.find_personal_data(spark, _documents(spark, sf_dir))
    spans = F.transform("spans", lambda s: F.struct(pii.kind_order(s["kind"]).alias("order"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["is_base"].alias("is_base"), s["score"].alias("score")))
    base = F.filter(F.col("every"), lambda s: s["is_base"])
    counts = [_count_kind(F.col("base"), k) for k in pii.BASE]
    out = out.withColumn("every", spans).withColumn("base", base)
    scores = F.array_join(F.transform(F.array_sort("every"), lambda s: F.round(s["score"], 4).cast("string")), ",")
    return out.select("doc_id", *counts, F.sha2(_span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"), _span_list(F.col("every")).alias("spans"), scores.alias("scores"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity class of each document."""
    return ngram_join.similarity_classes(spark, _documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that earlier passages repeat, and the digest of what is kept."""
    out = substring_dedup.remove_repeats(spark, _documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack_documents(spark, _documents(spark, sf_dir), tokenizer_path())


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what can be read back from each formatted conversation."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    made = chat.format_trees(spark, chat.linear_trees(rows.unionByName(probe)))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_chat_formatting": op10_chat_formatting,
}
