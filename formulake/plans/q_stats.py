"""Aggregates, ranks, folds and study-level statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions import ratio as R
from formulake.functions import special as SP
from formulake.functions.numbers import r6
from formulake.operators import evaluate as E
from formulake.operators import stats as S
from formulake.operators.anchor import anchor_median, anchor_quantile
from formulake.operators.folds import attach_folds, hash_share, permute_within, random_folds
from formulake.operators.groups import attach, value_ranks
from formulake.plans import sqlviews as Q
from formulake.plans import views as P
from formulake.plans.q_joins import SUPPORT_SQL
from formulake.plans.registry import query
from formulake.plans.sqlviews import r6 as q6
from formulake.plans.sqlviews import sql


def rounded(df, *names):
    """The named columns to six decimals, all others as they are."""
    return df.select(*[r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def sql_p(z: str) -> str:
    t = f"(1 / (1 + {SP.TAIL_T} * abs({z})))"
    a = SP.TAIL
    poly = f"{t} * ({a[0]} + {t} * ({a[1]} + {t} * ({a[2]} + {t} * ({a[3]} + {t} * {a[4]}))))"
    return f"least(1.0::double, 2 * {SP.DENSITY} * exp(-{z} * {z} / 2) * {poly})"


# ------------------------------------------------------------------ aggregates
@query("study_counts", sql("form", """
SELECT cast(sum(n) as bigint) AS n_rows, count(*) AS n_studies, min(n) AS min_rows, max(n) AS max_rows,
       median(n) AS median_rows FROM (SELECT study_small, count(*) AS n FROM form GROUP BY 1)"""))
def q_study_counts(spark, sf_dir):
    return S.study_counts(P.form(spark, sf_dir), "study_small")


GATE_REASONS = """
SELECT reason AS why, count(*) AS n FROM (SELECT coalesce(""" + ", ".join(
    f"CASE WHEN NOT ({c} BETWEEN {V.RANGES[c][0]} AND {V.RANGES[c][1]}) THEN '{c} out of range' END"
    for c in ("np", "ph", "size", "pdi", "zeta")) + """) AS reason FROM form)
WHERE reason IS NOT NULL GROUP BY 1"""


@query("reject_reasons", sql("form", GATE_REASONS))
def q_reject_reasons(spark, sf_dir):
    from formulake.operators.clean import range_checks
    from formulake.plans.q_clean import RANGED

    rows = P.form(spark, sf_dir).select(range_checks(RANGED).alias("why"))
    return rows.where(F.col("why").isNotNull()).groupBy("why").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"))


OOF_RANDOM_SQL = f"""
rand AS (SELECT row_id, x, y, cast({Q.hash_share("concat('42:', row_id)", 5)} as bigint) AS fold FROM obs),
rand_lines AS (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m
  FROM (SELECT DISTINCT fold FROM rand) f JOIN rand r ON r.fold <> f.fold GROUP BY f.fold),
group_means AS (SELECT f.fold, avg(y) AS m FROM (SELECT DISTINCT fold FROM oof) f JOIN oof r ON r.fold <> f.fold GROUP BY f.fold),
grid AS (
  SELECT 'linear' AS model, 'study-grouped' AS cv, y, pred FROM oof
  UNION ALL SELECT 'mean', 'study-grouped', y, {q6('m')} FROM oof JOIN group_means USING (fold)
  UNION ALL SELECT 'linear', 'random', y, {q6('a + b * x')} FROM rand JOIN rand_lines USING (fold)
  UNION ALL SELECT 'mean', 'random', y, {q6('m')} FROM rand JOIN rand_lines USING (fold)),
metrics AS (
  SELECT model, cv, count(*) AS n, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2,
         avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse FROM grid GROUP BY 1, 2)"""


def prediction_grid(spark, sf_dir):
    """Long table of predictions: two closed-form models under both fold schemes."""
    grouped = P.oof(spark, sf_dir).select("row_id", "x", "y", "fold", "pred")
    rand = random_folds(P.obs(spark, sf_dir).select("row_id", "x", "y"), "row_id")
    parts = [
        ("linear", "study-grouped", grouped),
        ("mean", "study-grouped", E.mean_oof(grouped.drop("pred"), "y")),
        ("linear", "random", E.linear_oof(rand, "x", "y")),
        ("mean", "random", E.mean_oof(rand, "y")),
    ]
    out = None
    for model, cv, rows in parts:
        one = rows.select(F.lit(model).alias("model"), F.lit(cv).alias("cv"), "row_id", "y", "pred")
        out = one if out is None else out.unionByName(one)
    return out


def grid_metrics(spark, sf_dir):
    return E.error_metrics(prediction_grid(spark, sf_dir), ["model", "cv"])


@query("error_metrics", sql("oof", f"""
SELECT model, cv, n, {q6('r2')} AS r2, {q6('mae')} AS mae, {q6('rmse')} AS rmse,
       {q6("(1 - mae / (SELECT mae FROM metrics WHERE model = 'mean' AND cv = 'study-grouped')) * 100")} AS gain
FROM metrics""", OOF_RANDOM_SQL))
def q_error_metrics(spark, sf_dir):
    out = E.with_gain(grid_metrics(spark, sf_dir), "mean", "study-grouped")
    return rounded(out, "r2", "mae", "rmse", "gain")


@query("metrics_pivot", sql("oof", "SELECT model, " + ", ".join(
    f"{q6(f'max(CASE WHEN cv = {Q.lit(cv)} THEN {m} END)')} AS {m}_{name}"
    for cv, name in (("study-grouped", "grouped"), ("random", "random")) for m in ("r2", "mae")
) + " FROM metrics GROUP BY model", OOF_RANDOM_SQL))
def q_metrics_pivot(spark, sf_dir):
    wide = grid_metrics(spark, sf_dir).groupBy("model").pivot("cv", ["study-grouped", "random"]).agg(
        F.max("r2").alias("r2"), F.max("mae").alias("mae"))
    return wide.select("model", *[
        r6(F.col(f"{cv}_{m}")).alias(f"{m}_{name}")
        for cv, name in (("study-grouped", "grouped"), ("random", "random")) for m in ("r2", "mae")])


@query("metrics_rollup", sql("oof", f"""
SELECT model, cv, count(*) AS n, {q6('avg(abs(y - pred))')} AS mae FROM grid GROUP BY ROLLUP(model, cv)""",
    OOF_RANDOM_SQL))
def q_metrics_rollup(spark, sf_dir):
    return prediction_grid(spark, sf_dir).rollup("model", "cv").agg(
        F.count("*").alias("n"), r6(F.avg(F.abs(F.col("y") - F.col("pred")))).alias("mae"))


@query("leaderboard", sql("oof", f"""
SELECT model, {q6('mae')} AS mae,
       {q6("(1 - mae / (SELECT mae FROM metrics WHERE model = 'mean' AND cv = 'study-grouped')) * 100")} AS gain
FROM metrics WHERE cv = 'study-grouped'""", OOF_RANDOM_SQL))
def q_leaderboard(spark, sf_dir):
    out = E.with_gain(grid_metrics(spark, sf_dir), "mean", "study-grouped")
    return rounded(out.where(F.col("cv") == "study-grouped").select("model", "mae", "gain"),
                   "mae", "gain").orderBy("mae", "model")


@query("oof_mean_baseline", sql("oof", f"""
SELECT row_id, fold, {q6('m')} AS pred FROM oof JOIN group_means USING (fold)""", OOF_RANDOM_SQL))
def q_oof_mean_baseline(spark, sf_dir):
    rows = P.oof(spark, sf_dir).select("row_id", "fold", "x", "y")
    return E.mean_oof(rows, "y").select("row_id", "fold", "pred")


@query("oof_linear_closed_form", sql("oof", "SELECT row_id, fold, pred FROM oof"))
def q_oof_linear(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", F.col("study_big").alias("study"), "x", "y")
    return E.linear_oof(attach_folds(rows, "study", 5), "x", "y").select("row_id", "fold", "pred")


@query("icc1", sql("obs", f"""
SELECT g AS n_studies, {q6('(msb - msw) / (msb + (k0 - 1) * msw)')} AS icc,
       {q6('(msb - msw) / (msb + ((n - k2 / n) / (g - 1) - 1) * msw)')} AS icc_n0,
       {q6('vm / v')} AS variance_ratio
FROM (SELECT count(*) AS g, sum(k) AS n, sum(k * (m - gm) * (m - gm)) / (count(*) - 1) AS msb,
             sum(ssw) / greatest(sum(k) - count(*), 1) AS msw, avg(k) AS k0, sum(k * k) AS k2,
             var_samp(m) AS vm, max(v) AS v
      FROM (SELECT study_small, cast(count(*) as double) AS k, avg(y) AS m, var_pop(y) * count(*) AS ssw
            FROM obs GROUP BY 1), (SELECT avg(y) AS gm, var_samp(y) AS v FROM obs))"""))
def q_icc1(spark, sf_dir):
    return rounded(S.icc1(P.obs(spark, sf_dir), "study_small", "y"), "icc", "icc_n0", "variance_ratio")


BAND_SQL = "CASE " + " ".join(f"WHEN y >= {lo} AND y < {hi} THEN '{b}'" for b, lo, hi in V.BANDS) + " END"


@query("error_by_band", sql("oof", f"""
SELECT band, n, {q6('mae')} AS mae, {q6('sum(mae * n) OVER () / sum(n) OVER ()')} AS mae_all,
       mae = min(mae) OVER () AS is_best, mae = max(mae) OVER () AS is_worst
FROM (SELECT {BAND_SQL} AS band, count(*) AS n, avg(abs(y - pred)) AS mae FROM oof GROUP BY 1)"""))
def q_error_by_band(spark, sf_dir):
    return rounded(S.error_by_band(P.oof(spark, sf_dir)), "mae", "mae_all")


@query("quantile_bins", sql("obs", f"""
SELECT cast(bin as bigint) AS bin, {q6('e[bin + 1]')} AS lo, {q6('e[bin + 2]')} AS hi, count(*) AS n, {q6('avg(y)')} AS mean_y
FROM (SELECT y, e, len(list_filter(list_slice(e, 2, len(e) - 1), lambda v: x > v)) AS bin
      FROM obs, (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM obs))
GROUP BY bin, e"""))
def q_quantile_bins(spark, sf_dir):
    return rounded(S.quantile_bins(P.obs(spark, sf_dir), "x", "y"), "lo", "hi", "mean_y")


@query("data_support", sql("featured", f"""
SELECT component, {q6('lo')} AS lo, {q6('hi')} AS hi, {q6('median')} AS median FROM support""", SUPPORT_SQL))
def q_data_support(spark, sf_dir):
    return rounded(S.data_support(P.shares(spark, sf_dir), R.COMPONENTS), "lo", "hi", "median")


PAIRED_SQL = """
group_means AS (SELECT f.fold, avg(y) AS m FROM (SELECT DISTINCT fold FROM oof) f JOIN oof r ON r.fold <> f.fold GROUP BY f.fold),
paired AS (
  SELECT study, count(*) AS n, avg(abs(y - pred)) AS mae_a, avg(abs(y - """ + q6("m") + """)) AS mae_b
  FROM oof JOIN group_means USING (fold) GROUP BY study HAVING count(*) >= 3)"""


def paired(spark, sf_dir):
    rows = P.oof(spark, sf_dir, "study_small").withColumnRenamed("pred", "pred_a")
    both = E.mean_oof(rows, "y").withColumnRenamed("pred", "pred_b")
    return S.paired_study_error(both, "study", "pred_a", "pred_b")


@query("paired_study_error", sql("oof_small", f"""
SELECT count(*) AS n_studies, {q6('avg(mae_a)')} AS mae_a, {q6('avg(mae_b)')} AS mae_b,
       cast(count_if(mae_a < mae_b) as bigint) AS a_better FROM paired""", PAIRED_SQL))
def q_paired_study_error(spark, sf_dir):
    return rounded(S.paired_summary(paired(spark, sf_dir)), "mae_a", "mae_b")


def wilcoxon_sql(src: str, a: str, b: str) -> str:
    """CTE wil: n, w_plus, z of a signed-rank test."""
    return f"""
wil_d AS (SELECT {q6(f'{a} - {b}')} AS d FROM {src}),
wil_r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r,
                 count(*) OVER (PARTITION BY abs(d)) AS t FROM wil_d WHERE d <> 0),
wil AS (SELECT n, w_plus, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - t / 48) AS z
  FROM (SELECT cast(count(*) as double) AS n, cast(coalesce(sum(CASE WHEN d > 0 THEN r END), 0) as double) AS w_plus,
               cast(sum(cast(t as double) * t - 1) as double) AS t FROM wil_r))"""


@query("wilcoxon_signed_rank", sql("oof_small", f"""
SELECT cast(n as bigint) AS n_pairs, w_plus, {q6('CASE WHEN n >= 6 THEN z END')} AS z,
       {q6(f"CASE WHEN n >= 6 THEN {sql_p('z')} END")} AS p, 'normal approximation' AS method FROM wil""",
    PAIRED_SQL, wilcoxon_sql("paired", "mae_a", "mae_b")))
def q_wilcoxon(spark, sf_dir):
    return rounded(S.wilcoxon(paired(spark, sf_dir), "mae_a", "mae_b"), "z", "p")


def sql_avg_rank(part: str, v: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    q = f"PARTITION BY {part}, {v}" if part else f"PARTITION BY {v}"
    return f"(rank() OVER ({p}ORDER BY {v}) + (count(*) OVER ({q}) - 1) / 2.0)"


@query("avg_rank", sql("oof", f"""
SELECT row_id, {sql_avg_rank('study', 'y')} ::double AS avg_rank FROM oof"""))
def q_avg_rank(spark, sf_dir):
    rows = P.oof(spark, sf_dir).select("row_id", "study", "y")
    ranks = value_ranks(rows, ["study"], "y", 0.25).select("study", "y", "n", "avg_rank")
    return attach(rows, ranks, ["study", "y"], "n").select("row_id", "avg_rank")


@query("spearman_within", sql("oof", f"""
SELECT count(*) AS n_studies, cast(count_if(rho > 0) as bigint) AS n_positive, {q6('median(rho)')} AS median_rho
FROM (SELECT study, {q6('corr(ry, rp)')} AS rho FROM (
        SELECT study, {sql_avg_rank('study', 'y')} AS ry, {sql_avg_rank('study', 'pred')} AS rp FROM oof)
      GROUP BY study HAVING count(*) >= 4 AND var_pop(ry) > 0 AND var_pop(rp) > 0)"""))
def q_spearman_within(spark, sf_dir):
    return rounded(S.spearman_within(P.oof(spark, sf_dir), "study"), "median_rho")


@query("spearman_by_study", sql("oof_small", f"""
SELECT study, count(*) AS n, {q6('CASE WHEN var_pop(ry) > 0 AND var_pop(rp) > 0 THEN corr(ry, rp) END')} AS rho FROM (
  SELECT study, {sql_avg_rank('study', 'y')} AS ry, {sql_avg_rank('study', 'pred')} AS rp FROM oof)
GROUP BY study"""))
def q_spearman_by_study(spark, sf_dir):
    return rounded(S.spearman(P.oof(spark, sf_dir, "study_small"), ["study"], "y", "pred", 0.25), "rho")


def _rho_sql(level, src, a, b):
    return f"""
SELECT '{level}' AS level, count(*) AS n, {q6('corr(ra, rb)')} AS rho FROM (
  SELECT {sql_avg_rank('', a)} AS ra, {sql_avg_rank('', b)} AS rb FROM {src})"""


@query("spearman_decompose", sql("obs", " UNION ALL ".join([
    _rho_sql("overall", "obs", "x", "y"), _rho_sql("between", "means", "mx", "my"),
    _rho_sql("within", "inside", "dx", "dy")]), f"""
means AS (SELECT study_big, {q6('avg(x)')} AS mx, {q6('avg(y)')} AS my FROM obs GROUP BY 1)""", f"""
inside AS (SELECT {q6('x - mx')} AS dx, {q6('y - my')} AS dy FROM obs JOIN means USING (study_big))"""))
def q_spearman_decompose(spark, sf_dir):
    out = S.spearman_decompose(P.obs(spark, sf_dir), "study_big", "x", "y")
    return rounded(out, "rho")


# ------------------------------------------------------------------ fixed-effect slope
def slope_sql(study: str) -> str:
    z = SP.Z_975
    quant = (f"({z} + {(z**3 + z) / 4} / free + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / (free * free) + "
             f"{(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / (free * free * free))")
    score = "((8 * free + 1) / (8 * free + 3) * sqrt(free * ln(1 + slope / se * (slope / se) / free)))"
    return f"""
seg_rows AS (SELECT 'all' AS segment, {study} AS study, x, y FROM obs
  UNION ALL SELECT CASE WHEN x >= 2.5 THEN 'high' ELSE 'low' END, {study}, x, y FROM obs),
seg_study AS (SELECT segment, study, regr_sxx(y, x) AS wxx, regr_sxy(y, x) AS wxy, regr_syy(y, x) AS wyy,
                     count(*) AS n, min(x) AS x_min, max(x) AS x_max FROM seg_rows GROUP BY 1, 2),
seg_tot AS (
  SELECT segment, n, g, x_min, x_max, CASE WHEN n >= 20 AND g >= 3 THEN wxy / wxx END AS slope,
         CASE WHEN n >= 20 AND g >= 3 THEN sqrt((wyy - wxy * wxy / wxx) / (n - g - 1) / wxx) END AS se,
         CASE WHEN n >= 20 AND g >= 3 THEN sqrt((wyy - wxy * wxy / wxx) / (n - g - 1)) END AS resid_sd,
         cast(n - g - 1 as double) AS free
  FROM (SELECT segment, sum(n) AS n, count(*) AS g, sum(wxx) AS wxx, sum(wxy) AS wxy, sum(wyy) AS wyy,
               min(x_min) AS x_min, max(x_max) AS x_max FROM seg_study GROUP BY 1)),
slopes AS (SELECT segment, cast(n as bigint) AS n, g AS n_studies, x_min, x_max, slope, se, resid_sd,
       slope - {quant} * se AS ci_lo, slope + {quant} * se AS ci_hi, {sql_p(score)} AS p FROM seg_tot)"""


SLOPE_COLS = ["x_min", "x_max", "slope", "se", "resid_sd", "ci_lo", "ci_hi", "p"]


@query("fe_slope", sql("obs", "SELECT segment, n, n_studies, " + ", ".join(
    f"{q6(c)} AS {c}" for c in SLOPE_COLS) + " FROM slopes", slope_sql("study_big")))
def q_fe_slope(spark, sf_dir):
    return rounded(S.fe_slope(P.obs(spark, sf_dir), "study_big", "x", "y"), *SLOPE_COLS)


@query("fe_slope_jackknife", sql("obs", f"""
SELECT segment, count(*) AS n_studies, {q6('min(b)')} AS slope_min, {q6('max(b)')} AS slope_max,
       {q6('avg(cast(sign(b) = sign(full_b) as double))')} AS same_sign
FROM (SELECT segment, (sum(wxy) OVER w - wxy) / (sum(wxx) OVER w - wxx) AS b,
             sum(wxy) OVER w / sum(wxx) OVER w AS full_b FROM seg_study WINDOW w AS (PARTITION BY segment))
GROUP BY segment""", slope_sql("study_big")))
def q_fe_slope_jackknife(spark, sf_dir):
    return rounded(S.fe_slope_jackknife(P.obs(spark, sf_dir), "study_big", "x", "y"),
                   "slope_min", "slope_max", "same_sign")


FOLDED_SQL = "rows0 AS (SELECT row_id, study_big AS study, name_raw FROM obs)," + Q.folds("rows0")


@query("category_frequency", sql("obs", """
SELECT fold, name_raw, n, n >= 5 AS kept FROM (
  SELECT f.fold, name_raw, count(*) AS n FROM (SELECT unnest(range(5)) AS fold) f
  JOIN folded r ON r.fold <> f.fold GROUP BY 1, 2)""", FOLDED_SQL))
def q_category_frequency(spark, sf_dir):
    rows = P.obs_named(spark, sf_dir).select("row_id", F.col("study_big").alias("study"), "name_raw")
    return S.category_frequency(attach_folds(rows, "study", 5), "name_raw", 5, 5)


@query("table_fingerprint", sql("form", """
SELECT count(*) AS n, cast(sum(h) as bigint) AS sum_hash, bit_xor(h) AS xor_hash
FROM (SELECT cast(concat('0x', substr(md5(concat_ws('|', study_big, ratio_raw, outcome_raw)), 1, 8)) as bigint) AS h FROM form)"""))
def q_table_fingerprint(spark, sf_dir):
    out = S.table_fingerprint(P.form(spark, sf_dir), ["study_big", "ratio_raw", "outcome_raw"])
    return out.withColumn("sum_hash", F.col("sum_hash").cast("bigint"))


# ------------------------------------------------------------------ dispersion bands
SD_SQL = f"""
banded AS (SELECT row_id, study, y, pred, fold, {Q.hash_share("concat('sd', row_id)", 160)} / 10.0::double AS sd FROM oof)"""


def dispersed(spark, sf_dir):
    """Predictions with a dispersion per row."""
    sd = hash_share(F.concat(F.lit("sd"), F.col("row_id")), 160) / 10.0
    return P.oof(spark, sf_dir).select("row_id", "study", "y", "pred", "fold", sd.alias("sd"))


def grade_of(sd, edges):
    lo, mid, hi = edges
    g = V.DISPERSION_GRADES
    return F.when(sd <= lo, g[0]).when(sd <= mid, g[1]).when(sd <= hi, g[2]).otherwise(g[3])


def confidence_band(df, edges):
    """Grade, expected error, clipped interval and trust from a dispersion."""
    grade = grade_of(F.col("sd"), edges)
    mae = F.lit(None).cast("double")
    for label, value in V.DISPERSION_MAE.items():
        mae = F.when(F.col("grade") == label, F.lit(value)).otherwise(mae)
    return df.withColumn("grade", grade).withColumns({
        "expected_mae": mae, "lo": F.greatest(F.lit(0.0), F.col("pred") - F.col("sd")),
        "hi": F.least(F.lit(100.0), F.col("pred") + F.col("sd")),
        "trust": F.col("grade") != V.DISPERSION_GRADES[3]})


def sql_grade(sd, edges):
    g = V.DISPERSION_GRADES
    return (f"CASE WHEN {sd} <= {edges[0]} THEN '{g[0]}' WHEN {sd} <= {edges[1]} THEN '{g[1]}' "
            f"WHEN {sd} <= {edges[2]} THEN '{g[2]}' ELSE '{g[3]}' END")


_BAND_MAE_SQL = "CASE grade " + " ".join(
    f"WHEN '{g}' THEN {m}" for g, m in V.DISPERSION_MAE.items()) + " END"


@query("confidence_band", sql("oof", f"""
SELECT row_id, grade, grade_logit, cast({_BAND_MAE_SQL} as double) AS expected_mae, {q6('greatest(0, pred - sd)')} AS lo,
       {q6('least(100, pred + sd)')} AS hi, grade <> 'very low' AS trust
FROM (SELECT *, {sql_grade('sd', V.DISPERSION_EDGES)} AS grade,
             {sql_grade('sd', V.DISPERSION_EDGES_LOGIT)} AS grade_logit FROM banded)""", SD_SQL))
def q_confidence_band(spark, sf_dir):
    rows = confidence_band(dispersed(spark, sf_dir), V.DISPERSION_EDGES)
    logit = grade_of(F.col("sd"), V.DISPERSION_EDGES_LOGIT).alias("grade_logit")
    return rounded(rows.select("row_id", "grade", logit, "expected_mae", "lo", "hi", "trust"), "lo", "hi")


def calibrate(df):
    """Dispersion quartiles, MAE per resulting grade, its rank correlation with the error,
    coverage and the MAE of the trusted part; one row per grade."""
    from formulake.operators.groups import group_quantiles

    rows = df.withColumn("err", r6(F.abs(F.col("y") - F.col("pred"))))
    edges = group_quantiles(rows, [], "sd", {"a": 0.25, "b": 0.5, "c": 0.75}, 0.05)
    rows = rows.withColumn("_e", edges.select(F.struct("a", "b", "c").alias("e")).scalar())
    grade = grade_of(F.col("sd"), (F.col("_e.a"), F.col("_e.b"), F.col("_e.c")))
    rows = rows.withColumn("grade", grade)
    trusted = F.col("grade") != V.DISPERSION_GRADES[3]
    whole = rows.agg(F.struct(
        F.avg("err").alias("mae_all"), F.avg(F.when(trusted, F.col("err"))).alias("mae_trusted"),
        F.avg(trusted.cast("double")).alias("coverage")).alias("w")).scalar()
    rho = S.spearman(rows, [], "sd", "err", 0.05).select("rho").scalar()
    per = rows.groupBy("grade").agg(
        F.count("*").alias("n"), F.avg("err").alias("mae"), F.max("_e").alias("_e"))
    return per.withColumn("_w", whole).select(
        "grade", "n", "mae", F.col("_e.a").alias("q25"), F.col("_e.b").alias("q50"),
        F.col("_e.c").alias("q75"), F.col("_w.mae_all").alias("mae_all"),
        F.col("_w.mae_trusted").alias("mae_trusted"), F.col("_w.coverage").alias("coverage"),
        rho.alias("rho"))


@query("calibrate_bands", sql("oof", f"""
SELECT grade, count(*) AS n, {q6('avg(err)')} AS mae, {q6('max(e[1])')} AS q25, {q6('max(e[2])')} AS q50,
       {q6('max(e[3])')} AS q75, {q6('(SELECT avg(err) FROM cal)')} AS mae_all,
       {q6("(SELECT avg(err) FROM cal WHERE grade <> 'very low')")} AS mae_trusted,
       {q6("(SELECT avg(cast(grade <> 'very low' as double)) FROM cal)")} AS coverage,
       {q6(f"(SELECT corr(a, b) FROM (SELECT {sql_avg_rank('', 'sd')} AS a, {sql_avg_rank('', 'err')} AS b FROM cal))")} AS rho
FROM cal GROUP BY grade""", SD_SQL, f"""
cal AS (SELECT *, {sql_grade('sd', ('e[1]', 'e[2]', 'e[3]'))} AS grade FROM (
  SELECT *, {q6('abs(y - pred)')} AS err FROM banded),
  (SELECT quantile_cont(sd, [0.25, 0.5, 0.75]) AS e FROM banded))"""))
def q_calibrate_bands(spark, sf_dir):
    out = calibrate(dispersed(spark, sf_dir))
    return rounded(out, "mae", "q25", "q50", "q75", "mae_all", "mae_trusted", "coverage", "rho")


@query("coverage_report", sql("oof", f"""
SELECT {q6('avg(abs(y - pred))')} AS mae_all, {q6('avg(CASE WHEN sd <= 10.3 THEN abs(y - pred) END)')} AS mae_trusted,
       {q6('avg(cast(sd <= 10.3 as double))')} AS coverage FROM banded""", SD_SQL))
def q_coverage_report(spark, sf_dir):
    out = S.coverage_report(dispersed(spark, sf_dir), F.col("sd") <= V.DISPERSION_EDGES[2])
    return rounded(out, "mae_all", "mae_trusted", "coverage")


@query("abstain_filter", sql("oof", """
SELECT study, cast(count_if(sd <= 10.3) as bigint) AS n_kept, cast(count_if(sd > 10.3) as bigint) AS n_removed
FROM banded GROUP BY 1""", SD_SQL))
def q_abstain_filter(spark, sf_dir):
    rows = confidence_band(dispersed(spark, sf_dir), V.DISPERSION_EDGES)
    return rows.groupBy("study").agg(F.count_if(F.col("trust")).alias("n_kept"),
                                     F.count_if(~F.col("trust")).alias("n_removed"))


# ------------------------------------------------------------------ folds and anchors
@query("group_folds", sql("obs", """
SELECT study, fold, count(*) AS n FROM folded GROUP BY 1, 2""", FOLDED_SQL.replace("study_big", "study_small")))
def q_group_folds(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", F.col("study_small").alias("study"))
    return attach_folds(rows, "study", 5).groupBy("study", "fold").agg(F.count("*").alias("n"))


@query("random_folds", sql("obs", f"""
SELECT row_id, cast({Q.hash_share("concat('42:', row_id)", 5)} as bigint) AS fold FROM obs"""))
def q_random_folds(spark, sf_dir):
    return random_folds(P.obs(spark, sf_dir).select("row_id"), "row_id")


@query("within_study_permutation", sql("obs", """
SELECT a.study_big AS study, a.row_id, b.y AS y_shuffled FROM
 (SELECT study_big, row_id, row_number() OVER (PARTITION BY study_big ORDER BY md5(row_id)) AS i FROM obs) a
 JOIN (SELECT study_big, y, row_number() OVER (PARTITION BY study_big ORDER BY md5(concat('42:', row_id))) AS i FROM obs) b
 ON a.study_big = b.study_big AND a.i = b.i"""))
def q_within_study_permutation(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", F.col("study_big").alias("study"), "y")
    return permute_within(rows, "study", "row_id", "y")


@query("anchor_median", sql("oof_small", f"""
SELECT study, row_id, rn AS anchor_no FROM (
  SELECT study, row_id, row_number() OVER (PARTITION BY study ORDER BY {q6('abs(pred - m)')}, row_id) AS rn
  FROM (SELECT *, median(pred) OVER (PARTITION BY study) AS m FROM oof)) WHERE rn <= 2"""))
def q_anchor_median(spark, sf_dir):
    return anchor_median(P.oof(spark, sf_dir, "study_small"), "study", "row_id", "pred", 2)


def anchor_quantile_sql(src: str) -> str:
    """CTEs aq1..aq3: three picks per study, each skipping the earlier ones."""
    out = [f"aq_t AS (SELECT study, quantile_cont(pred, [0.25, 0.5, 0.75]) AS t FROM {src} GROUP BY study)"]
    taken = ""
    for i in (1, 2, 3):
        out.append(f"""aq{i} AS (SELECT study, row_id, {i} AS anchor_no FROM (
  SELECT study, row_id, row_number() OVER (PARTITION BY study ORDER BY {q6(f'abs(pred - t[{i}])')}, row_id) AS rn
  FROM {src} JOIN aq_t USING (study) WHERE true {taken}) WHERE rn = 1)""")
        taken += f" AND row_id NOT IN (SELECT row_id FROM aq{i})"
    return ",\n".join(out) + ",\naq AS (SELECT * FROM aq1 UNION ALL SELECT * FROM aq2 UNION ALL SELECT * FROM aq3)"


@query("anchor_quantile", sql("oof_small", "SELECT study, row_id, cast(anchor_no as bigint) AS anchor_no FROM aq",
                              anchor_quantile_sql("oof")))
def q_anchor_quantile(spark, sf_dir):
    return anchor_quantile(P.oof(spark, sf_dir, "study_small"), "study", "row_id", "pred", 3)
