"""Study-grouped and random folds, permutations inside studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake.operators.groups import hash_positions


def hash_share(text: Column, k: int) -> Column:
    """A number below k from a digest that other engines reproduce."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("bigint"), F.lit(k))


def attach_folds(df: DataFrame, study: str, k: int = 5) -> DataFrame:
    """Add ``fold``: no study in two folds, one rule for all studies whatever their number.

    The fold is the hash of the study. There are at most as many folds as studies, and fewer
    than two studies are an error.
    """
    k = require_folds(df, study, k)
    return df.withColumn("fold", hash_share(F.col(study), k))


def require_folds(df: DataFrame, study: str, k: int = 5, minimum: int = 2) -> int:
    """Number of usable folds, at most k: fails when there are fewer than two studies."""
    seen = df.select(study).distinct().limit(k).count()
    if seen < minimum:
        raise ValueError("study-grouped folds need at least two studies")
    return seen


def random_folds(df: DataFrame, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Row folds by hash: the optimistic contrast to study folds, without a sort."""
    return df.withColumn("fold", hash_share(F.concat(F.lit(f"{seed}:"), F.col(row_id)), k))


def permute_within(df: DataFrame, study: str, row_id: str, value: str, seed: int = 42) -> DataFrame:
    """Shuffle a value inside each study; every value is used exactly once."""
    rows = df.select(row_id, study, value)
    here = hash_positions(
        rows.select(study, row_id, F.md5(F.col(row_id)).alias("_d")), [study], "_d", "_at"
    )
    there = hash_positions(
        rows.select(study, value, F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id))).alias("_d")),
        [study], "_d", "_at",
    )
    moved = there.select(study, "_at", F.col(value).alias(f"{value}_shuffled"))
    return here.select(study, row_id, "_at").join(moved, [study, "_at"]).drop("_at")
