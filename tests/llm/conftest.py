import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents table from (doc_id, text) pairs, with extra columns."""

    def build(rows):
        table = spark.createDataFrame(
            [(i, t, "en", "src0", len(t or "")) for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint",
        )
        return table.withColumn("score", F.lit("extra")).withColumn("fp", F.lit(1.5))

    return build
