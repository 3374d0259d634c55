"""Registered queries: each operator over its whole table with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilink.llm import bilinear, importance, jaccard, kneser, mixing, packing, periods, rules, substring, suffix, tokencount, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"), size=5, percent=75)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")), rules.POLICIES[max(rules.POLICIES)])
    base = rules.apply_policy(marked, rules.BASE, "base_kept")
    return base.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT base_kept AS base_failed", "kept")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear.score(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=20, start=5)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), length=400, seed_length=128)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "documents"), k=10, every=20, group=F.col("lang"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periods.with_repeats(_table(spark, sf_dir, "documents"))))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_packing, op2_ngram_jaccard, op3_quality_rules, op4_url_filters, op5_lm_scoring, op6_substring_dedup,
        op7_source_mixing, op8_quality_classifier, op9_suffix_dedup, op10_exact_topk, op11_importance_resampling, op12_periodic_runs, op13_token_counts,
    )
    return {f.__name__: f for f in found}


def all_sql() -> dict[str, str]:
    """The other operators (packing, similarity classes, models, repeats) have no SQL form; tests hold them to plain models."""
    return {"op3_quality_rules": rules.SQL, "op4_url_filters": urls.SQL, "op7_source_mixing": mixing.SQL, "op10_exact_topk": topk.SQL, "op11_importance_resampling": importance.SQL}
