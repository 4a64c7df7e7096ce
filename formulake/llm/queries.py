"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formulake.llm import (
    alignment, ngram_lm, packing, page_text, pieces, quotes, resampling, rule_ensemble, rules, sharding, simhash,
    toxicity, vector_search,
)
from formulake.llm.common import read
from formulake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its SQL."""

    def add(run):
        QUERIES[name] = lambda spark, sf_dir: run(tune(spark), sf_dir)
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query("op8_quality_rules", rules.MEASURES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measures(read(spark, sf_dir, "documents"))


@query("op7_simhash_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_ids(read(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read(spark, sf_dir, "pages"))


@query("op9_exact_top_k", vector_search.TOP_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(read(spark, sf_dir, "embeddings"))


@query("op5_lm_scoring")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(read(spark, sf_dir, "documents"))


@query("op6_chat_formatting")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(read(spark, sf_dir, "conversations"), partial=True)


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"))


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_quality_classifier")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.scored_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op11_cross_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(read(spark, sf_dir, "documents"))
