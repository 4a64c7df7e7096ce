"""Out-of-fold predictions in closed form and the metrics computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake.functions.numbers import r6


def fold_sums(df: DataFrame, x: str, y: str) -> DataFrame:
    """Per fold, the sums over all *other* folds (one row per fold)."""
    cx, cy = F.col(x) - 2.5, F.col(y) - 50
    parts = df.groupBy("fold").agg(
        F.count("*").cast("double").alias("n"), F.sum(cx).alias("sx"), F.sum(cy).alias("sy"),
        F.sum(cx * cx).alias("sxx"), F.sum(cx * cy).alias("sxy"),
    )
    names = ["n", "sx", "sy", "sxx", "sxy"]
    whole = parts.agg(F.struct(*[F.sum(c).alias(c) for c in names]).alias("t")).scalar()
    return parts.withColumn("_t", whole).select(
        "fold", *[(F.col("_t")[c] - F.col(c)).alias(c) for c in names]
    )


def mean_oof(df: DataFrame, y: str) -> DataFrame:
    """Out-of-fold mean of the training outcomes, from sums."""
    parts = fold_sums(df.withColumn("_x", F.lit(2.5)), "_x", y)
    mean = parts.select("fold", r6(F.col("sy") / F.col("n") + 50).alias("pred"))
    return df.join(F.broadcast(mean), "fold").select(*df.columns, "pred")


def linear_oof(df: DataFrame, x: str, y: str) -> DataFrame:
    """Out-of-fold straight line through the training rows, from sufficient statistics."""
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (
        F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    )
    lines = fold_sums(df, x, y).withColumn("_b", slope).select(
        "fold", "_b", ((F.col("sy") - F.col("_b") * F.col("sx")) / F.col("n")).alias("_a")
    )
    pred = r6(50 + F.col("_a") + F.col("_b") * (F.col(x) - 2.5))
    # one row per fold
    return df.join(F.broadcast(lines), "fold").select(*df.columns, pred.alias("pred"))


def error_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """R2, MAE and RMSE per key, in one pass."""
    e = F.col("y") - F.col("pred")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (1 - F.sum(e * e) / (F.var_pop("y") * F.count("*"))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def with_gain(metrics: DataFrame, baseline: str, scheme: str) -> DataFrame:
    """Gain in percent over the baseline's MAE under the preferred scheme."""
    base = (
        metrics.where((F.col("model") == baseline) & (F.col("cv") == scheme))
        .agg(F.max("mae").alias("b")).scalar()
    )
    return metrics.withColumn("gain", (1 - F.col("mae") / base) * 100)
