"""No cuts, no lost rows, no switches by size, no failures at size."""

import time

import pytest
from pyspark.sql import functions as F

from formulake.functions.ratio import content_key, plain_number, ratio_key
from formulake.functions.text import spans
from formulake.operators import gate as G
from formulake.operators.folds import attach_folds, hash_share
from formulake.operators.joins import product
from formulake.operators.stats import table_fingerprint
from formulake.plans import views as P


@pytest.mark.parametrize("studies", [2, 999, 1001])
def test_one_fold_rule_for_any_number_of_studies(spark, studies):
    df = spark.range(studies * 2).select((F.col("id") % studies).cast("string").alias("study"))
    folded = attach_folds(df, "study", 5)
    k = min(5, studies)
    assert folded.where(F.col("fold") != hash_share(F.col("study"), k)).count() == 0
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert studies < 900 or max(sizes) < 1.3 * min(sizes)


def test_one_study_is_an_error(spark):
    with pytest.raises(ValueError):
        attach_folds(spark.range(3).select(F.lit("a").alias("study")), "study")


def test_keys_are_exact(spark):
    row = spark.range(1).select(
        *[content_key(F.lit("s"), F.lit("n"), F.lit(f"50:10:{x}:1"), F.lit(90.0)).alias(n)
          for n, x in (("a", "0.00001"), ("b", "0.00002"), ("c", "0.000010"))],
        plain_number(F.lit(50.1)).alias("d"), plain_number(F.lit(1e300)).alias("e"),
        ratio_key(F.lit(":".join(["999999999999999"] * 4))).alias("f"),
    ).first()
    assert row.a != row.b and row.a == row.c and row.d == "50.1" and row.e == "1.0E300"
    assert row.f == ":".join(["999999999999999"] * 4)


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).select(F.lit(6_000_000_000).alias("a"), F.lit(6_000_000_000).alias("b")).agg(
        F.sum(product("a", "b")).alias("p")).first()
    assert int(row.p) == 36 * 10**18
    assert dict(table_fingerprint(spark.range(3), ["id"]).dtypes)["sum_hash"] == "decimal(38,0)"


def test_claims_without_a_document_are_rejected_not_lost(spark, sf_dir):
    claims, articles = P.claims(spark, sf_dir), P.articles(spark, sf_dir)
    missing = claims.join(articles, "doc_id", "left_anti").count()
    assert missing > 0
    gated = G.gate_claims(claims, articles)
    assert gated.count() == claims.count()
    assert gated.where("why = 'no source document'").count() == missing
    assert G.audit(claims, articles).count() == claims.count()
    with_doi = articles.withColumn("doi", F.lit(""))
    job = G.harvest(claims, with_doi, "claim_id")
    assert job.count() == claims.count()
    assert job.where("why = 'no source document'").count() == missing


def test_spans_take_near_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([("ab 12 " * n,)], "t string")
        start = time.perf_counter()
        last = df.select(F.element_at(spans(F.col("t"), "[0-9]+"), -1)).first()[0]
        assert (last.start, last.end, last.hit) == (6 * n - 3, 6 * n - 1, "12")
        return time.perf_counter() - start

    seconds(4_000)
    assert seconds(64_000) < 16 * max(seconds(4_000), 0.3)
