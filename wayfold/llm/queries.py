"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from . import decontaminate, factor_quality, filter_audit, importance, near_copies, oracles, packing, quality_rules, secrets, substrings, suffix_dedup, token_files, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op4_warc_archive": oracles.WARC,
    "op5_decontamination": oracles.DECONTAMINATION,
    "op12_filter_audit": oracles.FILTER_AUDIT,
    "op13_importance_resampling": oracles.IMPORTANCE,
}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op4_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    archive = scratch(spark)
    warc.write_archive(_table(spark, folder, "pages"), archive)
    return warc.read_facts(spark, archive)


@_query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, folder, "documents"))
    found = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in secrets.BASE_KINDS],
        F.sha2(secrets.spans_text(F.col("base")), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


@_query
def op1_token_files(spark: SparkSession, folder: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    files = scratch(spark)
    token_files.write_tokens(_table(spark, folder, "documents"), files, public_tokenizers.path(tokenizer), end_id=1)
    return token_files.read_tokens(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op3_best_fit_packing(spark: SparkSession, folder: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    packed = packing.pack(_table(spark, folder, "documents"), public_tokenizers.path(tokenizer), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@_query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    forest = quality_rules.fit_rules(docs, _table(spark, folder, "labels"))
    judged = quality_rules.judge(docs.select("doc_id", "text"), forest)
    return judged.select("doc_id", *[F.col("rules")[name].alias(name) for name in (*quality_rules.COUNTS, "base_failed", "kept")])


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out")


@_query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    machine = toxicity.fit_toxicity(docs, _table(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, machine)
    return scored.select("doc_id", _held_out(), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    machine = factor_quality.fit_quality(docs, _table(spark, folder, "labels"))
    scored = factor_quality.score_quality(docs, machine)
    return scored.select("doc_id", _held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op7_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    found = near_copies.near_copies(_table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


@_query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.without_repeated_bytes(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interactions(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = importance.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
