"""Study-level statistics from grouped sums and exact ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions.numbers import r6
from formulake.functions.special import normal_two_sided, t_quantile_975, t_two_sided
from formulake.operators.groups import attach, group_quantiles, value_ranks


def study_counts(df: DataFrame, study: str) -> DataFrame:
    """Rows, studies and rows per study (median, smallest, largest)."""
    sizes = df.groupBy(study).agg(F.count("*").alias("size"))
    median = group_quantiles(sizes, [], "size", {"m": 0.5}, 1000.0).select("m").scalar()
    return sizes.agg(
        F.sum("size").alias("n_rows"), F.count("*").alias("n_studies"),
        F.min("size").alias("min_rows"), F.max("size").alias("max_rows"),
    ).withColumn("median_rows", median)


def icc1(df: DataFrame, study: str, y: str) -> DataFrame:
    """Between-study variance share, with the mean and the unbalanced group size, and the
    plain ratio of variances for contrast."""
    per = df.where(F.col(y).isNotNull()).groupBy(study).agg(
        F.count("*").cast("double").alias("k"), F.avg(y).alias("m"),
        (F.var_pop(y) * F.count("*")).alias("ssw"),
    )
    whole = df.agg(F.struct(F.avg(y).alias("gm"), F.var_samp(y).alias("v")).alias("s")).scalar()
    per = per.withColumn("_w", whole)
    tot = per.agg(
        F.count("*").cast("double").alias("g"), F.sum("k").alias("n"),
        F.sum(F.col("k") * (F.col("m") - F.col("_w.gm")) ** 2).alias("ssb"),
        F.sum("ssw").alias("ssw"), F.avg("k").alias("k0"),
        F.sum(F.col("k") * F.col("k")).alias("k2"), F.var_samp("m").alias("vm"),
        F.max("_w.v").alias("v"),
    )
    ms_b = F.col("ssb") / (F.col("g") - 1)
    ms_w = F.col("ssw") / F.greatest(F.col("n") - F.col("g"), F.lit(1.0))
    n0 = (F.col("n") - F.col("k2") / F.col("n")) / (F.col("g") - 1)

    def share(size):
        return F.when(F.col("g") >= 2, (ms_b - ms_w) / (ms_b + (size - 1) * ms_w))

    return tot.select(
        F.col("g").cast("bigint").alias("n_studies"), share(F.col("k0")).alias("icc"),
        share(n0).alias("icc_n0"), (F.col("vm") / F.col("v")).alias("variance_ratio"),
    )


def band_of(y: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, lo, hi in V.BANDS:
        out = F.when((y >= lo) & (y < hi), F.lit(label)).otherwise(out)
    return out


def error_by_band(df: DataFrame) -> DataFrame:
    """Rows and MAE per outcome band, the overall MAE, best and worst band."""
    err = F.abs(F.col("y") - F.col("pred"))
    sums = df.where(err.isNotNull()).groupBy(band_of(F.col("y")).alias("band")).agg(
        F.count("*").alias("n"), F.sum(err).alias("_s"))
    # at most one row per band from here on
    w = W.partitionBy()
    return sums.where(F.col("band").isNotNull()).withColumn("mae", F.col("_s") / F.col("n")).select(
        "band", "n", "mae",
        (F.sum("_s").over(w) / F.sum("n").over(w)).alias("mae_all"),
        (F.max_by("band", -F.col("mae")).over(w) == F.col("band")).alias("is_best"),
        (F.max_by("band", F.col("mae")).over(w) == F.col("band")).alias("is_worst"),
    )


def quantile_bins(df: DataFrame, x: str, y: str, probs=(0.0, 0.25, 0.5, 0.75, 1.0),
                  width: float = 0.1) -> DataFrame:
    """Right-closed quantile bins of x (equal edges merged): size and mean of y."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    edges = group_quantiles(df, [], x, names, width).select(
        F.array_distinct(F.array(*names)).alias("e")).scalar()
    rows = df.where(F.col(x).isNotNull()).withColumn("_e", edges)
    inner = F.slice(F.col("_e"), F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    rows = rows.withColumn("bin", F.size(F.filter(inner, lambda e: F.col(x) > e)).cast("bigint"))
    return rows.groupBy("bin").agg(
        F.max(F.get("_e", F.col("bin").cast("int"))).alias("lo"),
        F.max(F.get("_e", F.col("bin").cast("int") + 1)).alias("hi"),
        F.count("*").alias("n"), F.avg(y).alias("mean_y"),
    )


def data_support(df: DataFrame, columns: list[str], lo: float = 0.05, hi: float = 0.95,
                 width: float = 0.25) -> DataFrame:
    """Lower, upper and median value per component, exact."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("component"), F.col(c).alias("v")) for c in columns
    ])).alias("s")).select("s.*")
    return group_quantiles(
        long, ["component"], "v", {"lo": lo, "hi": hi, "median": 0.5}, width).drop("_n")


def paired_study_error(df: DataFrame, study: str, a: str, b: str, min_rows: int = 3) -> DataFrame:
    """Per study with enough rows the MAE of two predictions."""
    return df.groupBy(study).agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col(a))).alias("mae_a"),
        F.avg(F.abs(F.col("y") - F.col(b))).alias("mae_b"),
    ).where(F.col("n") >= min_rows)


def paired_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("n_studies"), F.avg("mae_a").alias("mae_a"),
        F.avg("mae_b").alias("mae_b"),
        F.count_if(F.col("mae_a") < F.col("mae_b")).alias("a_better"),
    )


def wilcoxon(df: DataFrame, a: str, b: str, min_pairs: int = 6, width: float = 0.05) -> DataFrame:
    """Signed-rank test over pairs: zeros dropped, average ranks, tie-corrected normal score."""
    d = df.select(r6(F.col(a) - F.col(b)).alias("d")).where(F.col("d") != 0)
    d = d.withColumn("size", F.abs("d"))
    signs = d.groupBy("size").agg(F.count_if(F.col("d") > 0).alias("pos"))
    ranks = value_ranks(d, [], "size", width)
    n, t = F.col("n"), F.col("t")
    sums = ranks.join(signs, "size").agg(
        F.sum("n").cast("double").alias("n"),
        F.coalesce(F.sum(F.col("pos") * F.col("avg_rank")), F.lit(0.0)).alias("w_plus"),
        F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t"),
    )
    mean = n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48)
    z = (F.col("w_plus") - mean) / sd
    enough = n >= min_pairs
    return sums.select(
        F.coalesce(n, F.lit(0.0)).cast("bigint").alias("n_pairs"), "w_plus",
        F.when(enough, z).alias("z"), F.when(enough, normal_two_sided(z)).alias("p"),
        F.lit("normal approximation").alias("method"),
    )


def spearman(df: DataFrame, groups: list[str], a: str, b: str, width: float) -> DataFrame:
    """Rank correlation with average ranks, NULL when one side is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = rows.groupBy(*groups, a, b).agg(F.count("*").alias("_c"))
    left = value_ranks(rows, groups, a, width).select(*groups, a, F.col("avg_rank").alias("_ra"), "total")
    right = value_ranks(rows, groups, b, width).select(*groups, b, F.col("avg_rank").alias("_rb"))
    ranked = pairs.join(left, [*groups, a]).join(right, [*groups, b])
    mid = (F.col("total") + 1) / 2
    da, db, c = F.col("_ra") - mid, F.col("_rb") - mid, F.col("_c")
    sums = ranked.groupBy(*groups).agg(
        F.max("total").alias("n"), F.sum(c * da * db).alias("_sab"),
        F.sum(c * da * da).alias("_saa"), F.sum(c * db * db).alias("_sbb"),
    )
    rho = F.when((F.col("_saa") > 0) & (F.col("_sbb") > 0),
                 F.col("_sab") / F.sqrt(F.col("_saa") * F.col("_sbb")))
    return sums.select(*groups, "n", rho.alias("rho"))


def spearman_within(df: DataFrame, study: str, min_rows: int = 4) -> DataFrame:
    """Studies, median rank correlation and how many are positive."""
    per = spearman(df, [study], "y", "pred", 0.25).where(
        (F.col("n") >= min_rows) & F.col("rho").isNotNull())
    per = per.withColumn("rho", r6(F.col("rho")))
    median = group_quantiles(per, [], "rho", {"m": 0.5}, 0.01).select("m").scalar()
    return per.agg(
        F.count("*").alias("n_studies"), F.count_if(F.col("rho") > 0).alias("n_positive")
    ).withColumn("median_rho", median)


def spearman_decompose(df: DataFrame, study: str, a: str, b: str) -> DataFrame:
    """Rank correlation over all rows, between study means, and after removing study means."""
    means = df.groupBy(study).agg(
        F.count("*").alias("_n"), r6(F.avg(a)).alias("_ma"), r6(F.avg(b)).alias("_mb"))
    inside = attach(df.select(study, a, b), means, [study], "_n").select(
        r6(F.col(a) - F.col("_ma")).alias("va"), r6(F.col(b) - F.col("_mb")).alias("vb"))
    parts = {
        "overall": df.select(F.col(a).alias("va"), F.col(b).alias("vb")),
        "between": means.select(F.col("_ma").alias("va"), F.col("_mb").alias("vb")),
        "within": inside,
    }
    out = None
    for label, rows in parts.items():
        one = spearman(rows, [], "va", "vb", 0.1).withColumn("level", F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out


SUMS = ["n", "sx", "sy", "sxx", "sxy", "syy"]


def segment_sums(df: DataFrame, study: str, x: str, y: str, cut: float) -> DataFrame:
    """Within-study sums of squares per (segment, study) from one pass over the rows."""
    cx, cy = F.col(x) - cut, F.col(y) - 50
    seg = F.when(F.col(x) >= cut, "high").otherwise("low")
    per = df.groupBy(seg.alias("segment"), study).agg(
        F.count("*").cast("double").alias("n"), F.sum(cx).alias("sx"), F.sum(cy).alias("sy"),
        F.sum(cx * cx).alias("sxx"), F.sum(cx * cy).alias("sxy"), F.sum(cy * cy).alias("syy"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
    )
    ranges = [F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max")]
    both = per.unionByName(per.withColumn("segment", F.lit("all"))).groupBy("segment", study).agg(
        *[F.sum(c).alias(c) for c in SUMS], *ranges)

    def inner(sq, a, b):
        return F.col(sq) - F.col(a) * F.col(b) / F.col("n")

    return both.select(
        "segment", study, "n", "x_min", "x_max", inner("sxx", "sx", "sx").alias("wxx"),
        inner("sxy", "sx", "sy").alias("wxy"), inner("syy", "sy", "sy").alias("wyy"),
    )


def fe_slope(df: DataFrame, study: str, x: str, y: str, cut: float = V.PEG_BREAK,
             min_rows: int = 20, min_studies: int = 3) -> DataFrame:
    """Slope of y on x with study effects, per segment of x, with its inference.

    Removing study means equals a regression with study dummies; only sums per study are
    shuffled.
    """
    tot = segment_sums(df, study, x, y, cut).groupBy("segment").agg(
        F.sum("n").alias("n"), F.count("*").cast("double").alias("g"),
        F.sum("wxx").alias("wxx"), F.sum("wxy").alias("wxy"), F.sum("wyy").alias("wyy"),
        F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"),
    )
    ok = (F.col("n") >= min_rows) & (F.col("g") >= min_studies)
    free = F.col("n") - F.col("g") - 1
    slope = F.col("wxy") / F.col("wxx")
    mse = (F.col("wyy") - F.col("wxy") * F.col("wxy") / F.col("wxx")) / free
    se = F.sqrt(mse / F.col("wxx"))
    tot = tot.select(
        "segment", F.col("n").cast("bigint").alias("n"),
        F.col("g").cast("bigint").alias("n_studies"), "x_min", "x_max",
        F.when(ok, slope).alias("slope"), F.when(ok, se).alias("se"),
        F.when(ok, F.sqrt(mse)).alias("resid_sd"), free.alias("_free"),
    )
    half = t_quantile_975(F.col("_free")) * F.col("se")
    return tot.select(
        *[c for c in tot.columns if c != "_free"],
        (F.col("slope") - half).alias("ci_lo"), (F.col("slope") + half).alias("ci_hi"),
        t_two_sided(F.col("slope") / F.col("se"), F.col("_free")).alias("p"),
    )


def fe_slope_jackknife(df: DataFrame, study: str, x: str, y: str,
                       cut: float = V.PEG_BREAK) -> DataFrame:
    """Leave-one-study-out slopes in closed form: range and share with the full sign."""
    per = segment_sums(df, study, x, y, cut)
    tot = per.groupBy("segment").agg(F.sum("wxx").alias("txx"), F.sum("wxy").alias("txy"))
    # three rows
    left = per.join(F.broadcast(tot), "segment").withColumn(
        "b", (F.col("txy") - F.col("wxy")) / (F.col("txx") - F.col("wxx")))
    same = F.signum("b") == F.signum(F.col("txy") / F.col("txx"))
    return left.groupBy("segment").agg(
        F.count("*").alias("n_studies"), F.min("b").alias("slope_min"),
        F.max("b").alias("slope_max"), F.avg(same.cast("double")).alias("same_sign"),
    )


def category_frequency(df: DataFrame, column: str, k: int, min_frequency: int) -> DataFrame:
    """Level counts in the training rows of every fold; rare levels are not kept."""
    cells = df.groupBy("fold", column).agg(F.count("*").alias("c"))
    total = cells.groupBy(column).agg(F.sum("c").alias("t")).withColumn(
        "fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    train = total.join(cells, ["fold", column], "left").select(
        "fold", column, (F.col("t") - F.coalesce("c", F.lit(0))).alias("n"))
    return train.where(F.col("n") > 0).withColumn("kept", F.col("n") >= min_frequency)


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and two order-free content hashes."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.sum(number.cast("decimal(38,0)")).alias("sum_hash"),
                  F.bit_xor(number).alias("xor_hash"))


def coverage_report(df: DataFrame, trusted: Column) -> DataFrame:
    """MAE over all and over trusted rows, and the share that is trusted."""
    err = F.abs(F.col("y") - F.col("pred"))
    return df.agg(
        F.avg(err).alias("mae_all"), F.avg(F.when(trusted, err)).alias("mae_trusted"),
        F.avg(trusted.cast("double")).alias("coverage"),
    )
