"""Queries of the operators over one folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relrank.llm import embeddings, html, idfile, jaccard, mixing, packing, passages, quality, toxicity
from relrank.llm import treemerge, trie, variants, whitening
from relrank.llm import words as W
from relrank.session import scratch_path


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    W.small_batches(spark)
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, path: str) -> DataFrame:
    found = html.main_text(_table(spark, path, "pages"))
    text = F.col("main_text")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op2_ngram_jaccard(spark: SparkSession, path: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, path, "documents"))


def op3_toxicity(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path, "documents")
    model = toxicity.fit(docs, _table(spark, path, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("toxicity") >= toxicity.THRESHOLD).cast("int")
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), predicted.alias("predicted")
    )


def op4_mixing(spark: SparkSession, path: str) -> DataFrame:
    """Every document at least once, no source more than twice as often as another."""
    drawn = mixing.mix(_table(spark, path, "documents"), mixing.Target(max_repeats=2.0))
    return drawn.select("doc_id", "source", "mix_block", "mix_order")


def op5_binary_ids(spark: SparkSession, path: str) -> DataFrame:
    """Writes the token-id table below the shared folder and reads it back."""
    table = scratch_path(spark, "token_ids")
    idfile.write_ids(_table(spark, path, "documents"), table)
    return idfile.document_index(spark, table)


def op6_quality_rules(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path, "documents")
    trees = quality.fit(docs, _table(spark, path, "labels"))
    return quality.judge(docs.select("doc_id", "text"), trees).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_best_fit_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack(_table(spark, path, "documents"))


def op8_token_counts(spark: SparkSession, path: str) -> DataFrame:
    return trie.token_counts(_table(spark, path, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def op9_substring_dedup(spark: SparkSession, path: str) -> DataFrame:
    return passages.duplicate_passages(_table(spark, path, "documents"))


def op10_embedding_dedup(spark: SparkSession, path: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, path, "embeddings"))


def op11_whitening(spark: SparkSession, path: str) -> DataFrame:
    return whitening.whiten(_table(spark, path, "embeddings"))


def op12_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    return treemerge.exact_duplicates(spark.read.parquet(f"{path}/documents.parquet"))


def op13_spelling_variants(spark: SparkSession, path: str) -> DataFrame:
    return variants.variant_groups(spark.read.parquet(f"{path}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_binary_ids": op5_binary_ids,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_whitening": op11_whitening,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
