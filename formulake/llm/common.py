"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formulake.session import discard, materialise

#: White space that parts words, as a Java and RE2 character class.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows that Python sees at once: whole texts can be long, so few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def known_text(text: str | Column = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_back(doc_id: str | Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is never held back."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % folds == 0, F.lit(False))


def words(text: Column) -> Column:
    """Runs of anything but blanks."""
    return F.array_remove(F.split(text, BLANK, -1), "")


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """Connected components of ``(a bigint, b bigint)``: a row ``(node, root)`` for each node.

    Alternates two star steps: every node's larger neighbours move to its smallest neighbour,
    then the smaller ones do. Minima are taken with partial aggregation and joined back by an
    ordinary join, so a node with very many neighbours is split by adaptive execution. Each
    round is written to the shared folder; the edges become a star for each component after
    about log(n) rounds.
    """
    edges = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(), f"{label}-edges",
    )
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialise(
            moved.where("u <> v").unionByName(near.select("u", F.col("m").alias("v"))).distinct(),
            f"{label}-edges",
        )
        discard(old)
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
