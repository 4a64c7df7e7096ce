"""Grouped building blocks that stay whole and balanced when one key holds most rows.

* ``attach``        joins per-key values back to rows; the heaviest keys (at most HOT_KEYS,
                    so the broadcast has a fixed size) are broadcast and their rows spread.
* ``value_ranks``   exact ranks from value counts, cut into value bins, so no task sees a
                    whole group.
* ``group_quantiles`` exact interpolated quantiles from the same counts.
* ``parted``        rows of the heaviest keys apart from the others: a key of the others fits one task, which
                    can rank its rows in place after a single exchange (``placed_quantiles``, ``attach_parted``).
* ``top_rows``      k first rows per key; Spark limits each key before the shuffle.
* ``first_rows``    the first row per key, likewise.
* ``hash_positions`` row positions inside a group in hash order, binned by the hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_KEYS = 1000
HOT_ROWS, HOT_SHARE = 100_000, 0.05  # rows of a key, and its share of all, beyond which no single task ranks it
SPREAD = 4096


def attach(df: DataFrame, stats: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join of per-key values; ``size`` names the column with the rows per key."""
    values = [c for c in stats.columns if c not in keys]
    hot = (
        stats.orderBy(F.desc(size), *keys).limit(HOT_KEYS)
        .select(*keys, F.struct(*values).alias("_hot"))
    )
    rows = df.join(F.broadcast(hot), keys, "left")
    is_hot = F.col("_hot").isNotNull()
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(SPREAD)) + 1
    masked = [F.when(~is_hot, F.col(k)).alias(f"_k_{k}") for k in keys]
    rows = rows.select("*", *masked, F.when(is_hot, spread).otherwise(F.lit(0)).alias("_salt"))
    cold = stats.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(0).cast("bigint").alias("_salt"),
        F.struct(*values).alias("_cold"),
    )
    rows = rows.withColumn("_salt", F.col("_salt").cast("bigint"))
    joined = rows.join(cold, [f"_k_{k}" for k in keys] + ["_salt"], "left")
    picked = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(*df.columns, *[picked[v].alias(v) for v in values])


def parted(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and those of keys beyond HOT_ROWS or HOT_SHARE, or None if there are none.

    At most HOT_KEYS keys count as heavy; any other then has fewer than a 1000th of all rows. The sizes are
    counted at once with map-side combine; null is a key like any other.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.least(F.lit(float(HOT_ROWS)), HOT_SHARE * F.sum("_n"))).scalar()
    found = sizes.where(F.col("_n") > most).orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).drop("_n")
    heavy = found.collect()  # at most HOT_KEYS rows
    if not heavy:
        return df, None
    heavy = df.sparkSession.createDataFrame(heavy, found.schema)
    heavy = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    return df.join(heavy, same, "left_anti"), df.join(heavy, same, "left_semi")


def placed_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Ordinary rows (``parted``) with ``_n`` and the quantiles of their group, as ``group_quantiles`` has them.

    Windows of one group in one task: the rows are exchanged once and nothing is joined back. Values aren't null.
    """
    group = W.partitionBy(*groups)
    at = F.row_number().over(group.orderBy(value)) - 1
    rows = df.withColumns({"_at": at, "_n": F.count("*").over(group)})
    ends = {}
    for name, p in probs.items():
        place = (F.col("_n") - 1) * p
        for end, row in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends[f"_{end}_{name}"] = F.min(F.when(F.col("_at") >= row, F.col(value))).over(group)
    rows = rows.withColumns(ends)
    return rows.select(*df.columns, "_n", *[blend(name, p) for name, p in probs.items()])


def attach_parted(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of per-key values like ``attach``, for values whose keys' sizes in ``df`` aren't known yet."""
    rows, heavy = parted(df, keys)
    out = rows.join(stats, keys, "left")
    if heavy is not None:
        # values of at most HOT_KEYS keys
        own = stats.join(F.broadcast(heavy.select(*keys).distinct()), keys, "left_semi")
        out = out.unionByName(heavy.join(F.broadcast(own), keys, "left"))
    return out.select(*df.columns, *[c for c in stats.columns if c not in keys])


def value_ranks(df: DataFrame, groups: list[str], value: str, width: float) -> DataFrame:
    """One row per distinct value of a group with its exact average rank.

    Values are counted first, so ties cost nothing, then ranked inside bins of the given
    width; bin totals give every bin its offset. ``width`` should cut the value range into
    some hundreds of bins. Columns: groups, value, n, below, avg_rank, total.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*groups, F.floor(F.col(value) / width).alias("_bin"), F.col(value))
        .agg(F.count("*").alias("n"))
    )
    inside = W.partitionBy(*groups, "_bin").orderBy(value)
    counts = counts.withColumn(
        "_inside", F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    )
    bins = counts.groupBy(*groups, "_bin").agg(F.sum("n").alias("_bn"))
    order = W.partitionBy(*groups).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.select(
        *groups, "_bin", (F.sum("_bn").over(order) - F.col("_bn")).alias("_offset"),
        F.sum("_bn").over(W.partitionBy(*groups)).alias("total"),
    )
    ranked = counts.join(bins, [*groups, "_bin"])
    below = F.col("_inside") + F.col("_offset")
    return ranked.select(
        *groups, value, "n", below.alias("below"),
        (below + (F.col("n") + 1) / 2).alias("avg_rank"), "total",
    )


def group_quantiles(
    df: DataFrame, groups: list[str], value: str, probs: dict[str, float], width: float
) -> DataFrame:
    """Exact linearly interpolated quantiles; one row per group with ``_n`` rows."""
    ranks = value_ranks(df, groups, value, width)
    picks = []
    for name, p in probs.items():
        at = (F.col("total") - 1) * p
        last = F.col("below") + F.col("n") - 1
        lo, hi = F.floor(at), F.ceil(at)
        picks.append(F.min(F.when(last >= lo, F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(last >= hi, F.col(value))).alias(f"_hi_{name}"))
    out = ranks.groupBy(*groups).agg(F.max("total").alias("_n"), *picks)
    return out.select(*groups, "_n", *[blend(n, p) for n, p in probs.items()])


def known(groups: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in groups])


def blend(name: str, p: float) -> Column:
    """The quantile between the values at its two ends."""
    at = (F.col("_n") - 1) * p
    lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return (lo + (hi - lo) * (at - F.floor(at))).alias(name)


def with_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float], width: float) -> DataFrame:
    """Rows with the quantiles of their group's values; null for groups with a null key. Values aren't null."""
    rows, heavy = parted(df, groups)
    found = placed_quantiles(rows, groups, value, probs)
    found = found.select(*df.columns, *[F.when(known(groups), F.col(name)).alias(name) for name in probs])
    if heavy is None:
        return found
    wide = attach(heavy, group_quantiles(heavy, groups, value, probs, width), groups, "_n")
    return found.unionByName(wide.select(*df.columns, *probs))


def study_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float], width: float) -> DataFrame:
    """``group_quantiles`` for very many groups, most of them small: their rows are exchanged once."""
    rows, heavy = parted(df.where(F.col(value).isNotNull() & known(groups)).select(*groups, value), groups)
    found = placed_quantiles(rows, groups, value, probs).groupBy(*groups).agg(*[
        F.max(c).alias(c) for c in ("_n", *probs)])
    return found if heavy is None else found.unionByName(group_quantiles(heavy, groups, value, probs, width))


def top_rows(df: DataFrame, groups: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """First k rows of every group; the filter on row_number is applied before the shuffle."""
    w = W.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_rows(df, keys, order, 1, "_rn").drop("_rn")


def flag_first(df: DataFrame, keys: list[str], row_id: str, flag: str) -> DataFrame:
    """Keep all rows and mark the first per key; the join runs on the unique row id."""
    winners = first_rows(df.select(*keys, row_id), keys, [F.col(row_id)])
    winners = winners.select(row_id, F.lit(True).alias(flag))
    return df.join(winners, row_id, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def hash_positions(df: DataFrame, groups: list[str], digest: str, out: str) -> DataFrame:
    """1-based position inside a group in order of a hex digest; digest prefixes are the bins."""
    rows = df.withColumn("_bin", F.substring(F.col(digest), 1, 3))
    bins = rows.groupBy(*groups, "_bin").agg(F.count("*").alias("_bn"))
    order = W.partitionBy(*groups).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = bins.withColumn("_offset", F.sum("_bn").over(order) - F.col("_bn"))
    inside = W.partitionBy(*groups, "_bin").orderBy(digest)
    rows = rows.withColumn("_pos", F.row_number().over(inside))
    return (
        rows.join(bins.drop("_bn"), [*groups, "_bin"])
        .withColumn(out, F.col("_offset") + F.col("_pos"))
        .drop("_bin", "_offset", "_pos")
    )
