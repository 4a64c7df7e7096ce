"""Anchor calibration and scenario scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions import ratio as R
from formulake.functions.numbers import r6
from formulake.operators import anchor as AN
from formulake.operators import scenario as SC
from formulake.operators import stats as S
from formulake.operators.groups import study_quantiles
from formulake.plans import sqlviews as Q
from formulake.plans import views as P
from formulake.plans.q_joins import GRID_SQL, SUPPORT_SQL, composition_grid
from formulake.plans.q_stats import (
    anchor_quantile_sql, rounded, slope_sql, sql_p, wilcoxon_sql,
)
from formulake.plans.registry import query
from formulake.plans.sqlviews import r6 as q6
from formulake.plans.sqlviews import sql

# ------------------------------------------------------------------ offsets
WEIGHT_SQL = "(CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN k / (k + 0.5::double) WHEN k = 2 THEN k / (k + 0.75::double) ELSE k / (k + 1.0::double) END)"


def anchors_sql(name: str, k: int) -> str:
    return f"""
{name} AS (SELECT study, row_id, y - pred AS resid FROM (
  SELECT *, row_number() OVER (PARTITION BY study ORDER BY {q6('abs(pred - m)')}, row_id) AS rn
  FROM (SELECT *, median(pred) OVER (PARTITION BY study) AS m FROM oof)) WHERE rn <= {k}),
{name}_off AS (SELECT study, count(*) AS k, median(resid) AS raw, stddev_samp(resid) AS spread
  FROM {name} GROUP BY study)"""


@P.stored("anchors")
def anchor_residuals(spark, sf_dir, k):
    rows = P.oof(spark, sf_dir, "study_small")
    picked = AN.anchor_median(rows, "study", "row_id", "pred", k).select("row_id")
    return rows.join(picked, "row_id").select(
        "row_id", "study", "y", (F.col("y") - F.col("pred")).alias("resid"))


@query("shrunk_offset", sql("oof_small", f"""
SELECT study, k, {q6('raw')} AS raw, {q6(WEIGHT_SQL)} AS weight, {q6(f'raw * {WEIGHT_SQL}')} AS shrunk
FROM a3_off""", anchors_sql("a3", 3)))
def q_shrunk_offset(spark, sf_dir):
    out = AN.study_offsets(anchor_residuals(spark, sf_dir, 3), "study", "resid")
    return rounded(out.select("study", "k", "raw", "weight", "shrunk"), "raw", "weight", "shrunk")


@query("offset_reliability", sql("oof_small", f"""
SELECT study, k, {q6('spread')} AS spread, CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'medium'
  WHEN spread > 12 THEN 'low' WHEN k >= 3 THEN 'high' ELSE 'medium' END AS grade FROM a3_off""",
    anchors_sql("a3", 3)))
def q_offset_reliability(spark, sf_dir):
    out = AN.study_offsets(anchor_residuals(spark, sf_dir, 3), "study", "resid")
    return rounded(out.select("study", "k", "spread", "grade"), "spread")


@P.stored("offsets")
def published(spark, sf_dir):
    """Two publications: two anchors for all studies, then shrunk three-anchor values for some."""
    rows = P.oof(spark, sf_dir, "study_small")
    ref = study_quantiles(rows, ["study"], "pred", {"ref_pred": 0.5}, 0.1).select(
        "study", F.col("_n").alias("n_rows"), "ref_pred")
    cols = ["study", "k", "raw"]
    first = AN.publish(AN.study_offsets(
        anchor_residuals(spark, sf_dir, 2), "study", "resid").select(*cols), "study", 1)
    second = AN.study_offsets(anchor_residuals(spark, sf_dir, 3), "study", "resid")
    second = second.where(F.length("study") % 2 == 0).withColumn("raw", F.col("shrunk"))
    second = AN.publish(second.select(*cols), "study", 2, already_shrunk=True)
    return AN.active_offsets(first.unionByName(second), "study").join(ref, "study")


PUBLISHED_SQL = anchors_sql("a2", 2) + ",\n" + anchors_sql("a3", 3).strip() + f""",
refs AS (SELECT study, count(*) AS n_rows, median(pred) AS ref_pred FROM oof GROUP BY study),
offsets AS (
  SELECT study, coalesce(s.k, f.k) AS k, coalesce(s.raw, f.raw) AS raw,
         coalesce(s.raw, f.raw * f.w) AS shrunk, s.study IS NOT NULL AS already_shrunk, n_rows, ref_pred
  FROM (SELECT study, k, raw, {WEIGHT_SQL} AS w FROM a2_off) f
  LEFT JOIN (SELECT study, k, raw * {WEIGHT_SQL} AS raw FROM a3_off WHERE length(study) % 2 = 0) s USING (study)
  JOIN refs USING (study))"""


@query("publish_offset", sql("oof_small", f"""
SELECT study, k, {q6('raw')} AS raw, {q6('shrunk')} AS shrunk, already_shrunk, n_rows, {q6('ref_pred')} AS ref_pred
FROM offsets""", PUBLISHED_SQL))
def q_publish_offset(spark, sf_dir):
    out = published(spark, sf_dir).select(
        "study", "k", "raw", "shrunk", "already_shrunk", "n_rows", "ref_pred")
    return rounded(out, "raw", "shrunk", "ref_pred")


@query("offset_errors", sql("oof_small", f"""
SELECT study, {q6('shrunk')} AS shrunk, count(*) AS n_rows, {q6('avg(abs(y - pred))')} AS mae_before,
  {q6('avg(abs(y - CASE WHEN shrunk = 0 THEN pred ELSE least(100, greatest(0, pred + shrunk)) END))')} AS mae_after
FROM oof JOIN offsets USING (study) WHERE study NOT LIKE '%3' GROUP BY study, shrunk""", PUBLISHED_SQL))
def q_offset_errors(spark, sf_dir):
    """Active offsets after those of some studies were taken back, with the errors before and after."""
    held = published(spark, sf_dir).drop("n_rows", "ref_pred").withColumn("active", F.lit(True))
    gone = held.where(F.col("study").endswith("3")).select("study")
    left = AN.active_offsets(AN.cleared(held, "study", gone, 3), "study")
    rows = P.oof(spark, sf_dir, "study_small").select("row_id", "study", "pred", "y")
    out = AN.with_errors(left, rows, "study", "y", "pred")
    return rounded(out.select("study", "shrunk", "n_rows", "mae_before", "mae_after"), "shrunk", "mae_before", "mae_after")


MOVED_SQL = """
moved AS (SELECT row_id, study, pred, y, CASE WHEN order_key THEN shrunk * 3 ELSE 0 END AS o, ref_pred AS ref
  FROM (SELECT oof.*, study LIKE '%1' OR study LIKE '%2' AS order_key FROM oof) JOIN offsets USING (study))"""


def moved(spark, sf_dir):
    """Rows with the (tripled) offset of their study; studies not ending in 1 or 2 have none."""
    offsets = published(spark, sf_dir).where(F.col("study").rlike("[12]$")).withColumn(
        "shrunk", F.col("shrunk") * 3)
    rows = P.oof(spark, sf_dir, "study_small").select("row_id", "study", "pred", "y")
    return AN.with_offset(rows, offsets, "study")


CLIP_SQL = "CASE WHEN o = 0 THEN pred ELSE least(100, greatest(0, pred + o)) END"


@query("apply_offset_clip", sql("oof_small", f"""
SELECT row_id, {q6(CLIP_SQL)} AS adj, o <> 0 AND (pred + o < 0 OR pred + o > 100) AS clipped FROM moved""",
    PUBLISHED_SQL, MOVED_SQL))
def q_apply_offset_clip(spark, sf_dir):
    p, o = F.col("pred"), F.col("offset")
    return moved(spark, sf_dir).select(
        "row_id", r6(AN.clipped(p, o)).alias("adj"), AN.is_clipped(p, o).alias("clipped"))


@query("offset_clip_counts", sql("oof_small", """
SELECT study, cast(count_if(o <> 0 AND (pred + o < 0 OR pred + o > 100)) as bigint) AS n_clipped, count(*) AS n
FROM moved GROUP BY 1""", PUBLISHED_SQL, MOVED_SQL))
def q_offset_clip_counts(spark, sf_dir):
    rows = moved(spark, sf_dir)
    return rows.groupBy("study").agg(
        F.count_if(AN.is_clipped(F.col("pred"), F.col("offset"))).alias("n_clipped"),
        F.count("*").alias("n"))


HEAD_SQL = """
CASE WHEN o > 0 THEN least(100, pred + o * greatest(100 - pred, 0) / greatest(100 - ref, 1e-9))
     WHEN o < 0 THEN greatest(0, pred + o * greatest(pred, 0) / greatest(ref, 1e-9)) ELSE pred END"""


@query("apply_offset_headroom", sql("oof_small", f"SELECT row_id, {q6(HEAD_SQL)} AS adj FROM moved2",
                                    PUBLISHED_SQL, MOVED_SQL, """
moved2 AS (SELECT * REPLACE (CASE WHEN o = 0 THEN 80 ELSE ref END AS ref) FROM moved)"""))
def q_apply_offset_headroom(spark, sf_dir):
    return moved(spark, sf_dir).select(
        "row_id", r6(AN.headroom(F.col("pred"), F.col("offset"), F.col("ref_pred"))).alias("adj"))


@query("offset_effective_shift", sql("oof_small", f"""
SELECT study, count(*) AS n, {q6(f"median({q6(f'({HEAD_SQL}) - pred')})")} AS shift FROM moved GROUP BY 1""",
    PUBLISHED_SQL, MOVED_SQL))
def q_offset_effective_shift(spark, sf_dir):
    rows = moved(spark, sf_dir).withColumn(
        "adj", AN.headroom(F.col("pred"), F.col("offset"), F.col("ref_pred")))
    return rounded(AN.effective_shift(rows, "study", "pred", "adj"), "shift")


ANCHORED_SQL = f"""
pick AS (SELECT min(study) AS s FROM oof),
anch AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {q6('abs(pred - m)')}, row_id) AS rn
  FROM (SELECT *, median(pred) OVER () AS m FROM oof, pick WHERE study = s)) WHERE rn <= 3),
off AS (SELECT median(y + 1 - pred) AS o FROM oof JOIN anch USING (row_id)),
tab AS (SELECT oof.row_id, study, anch.row_id IS NOT NULL AS is_anchor, study = s AS same_study, y, pred,
               pred + CASE WHEN study = s THEN o ELSE 0 END AS adj
  FROM oof LEFT JOIN anch USING (row_id), pick, off)"""


def anchored(spark, sf_dir):
    rows = P.oof(spark, sf_dir).select("row_id", "study", "y", "pred")
    first = rows.agg(F.min("study").alias("s")).scalar()
    mine = rows.withColumn("_s", first).where(F.col("study") == F.col("_s")).drop("_s")
    picked = AN.anchor_median(mine, "study", "row_id", "pred", 3).select("row_id")
    anchors = mine.join(picked, "row_id").select("row_id", (F.col("y") + 1).alias("anchor_y"))
    return AN.anchored_table(rows, anchors, "study", "row_id")


@query("anchored_table", sql("oof", f"""
SELECT row_id, study, is_anchor, same_study, y, {q6('pred')} AS pred, {q6('adj')} AS adj, {q6('adj - y')} AS error,
  CASE WHEN adj < 50 THEN 'low' WHEN adj < 70 THEN 'medium' WHEN adj < 95 THEN 'high' ELSE 'medium' END AS grade,
  NULL::varchar AS warning FROM tab""", ANCHORED_SQL))
def q_anchored_table(spark, sf_dir):
    return rounded(anchored(spark, sf_dir), "pred", "adj", "error")


@query("anchored_summary", sql("oof", f"""
SELECT count(*) AS n_rows, {q6('avg(abs(adj - y))')} AS mae_all,
  {q6('avg(CASE WHEN NOT same_study THEN abs(adj - y) END)')} AS mae_other,
  {q6('avg(CASE WHEN same_study AND NOT is_anchor THEN abs(adj - y) END)')} AS mae_anchor_study,
  {q6('avg(CASE WHEN same_study AND NOT is_anchor THEN abs(pred - y) END)')} AS mae_anchor_study_plain
FROM tab""", ANCHORED_SQL))
def q_anchored_summary(spark, sf_dir):
    out = AN.anchored_summary(anchored(spark, sf_dir))
    return rounded(out, "mae_all", "mae_other", "mae_anchor_study", "mae_anchor_study_plain")


def loso_sql(study: str) -> str:
    """CTE loso: rows with the prediction of a line fitted without their study."""
    return f"""
loso_c AS (SELECT row_id, {study} AS study, x, y, x - 2.5 AS cx, y - 50 AS cy FROM obs),
loso_s AS (SELECT study, count(*) AS size, sum(cx) AS sx, sum(cy) AS sy, sum(cx * cx) AS sxx, sum(cx * cy) AS sxy
  FROM loso_c GROUP BY study),
loso_r AS (SELECT study, size, sum(size) OVER () - size AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy,
  sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM loso_s),
loso AS (SELECT row_id, study, x, y, size, {q6('50 + (sy - b * sx) / n + b * cx')} AS pred
  FROM loso_c JOIN (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM loso_r) USING (study))"""


@query("loso_predictions", sql("obs", "SELECT row_id, study, pred FROM loso", loso_sql("study_small")))
def q_loso_predictions(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", F.col("study_small").alias("study"), "x", "y")
    return AN.loso_linear(rows, "study", "x", "y").select("row_id", "study", "pred")


LOSO_SQL = loso_sql("study_small") + f""",
loso5 AS (SELECT * FROM loso WHERE size >= 5),
{anchor_quantile_sql('loso5')},
loso_off AS (SELECT study, median(y - pred) AS o FROM loso5 JOIN aq USING (study, row_id) GROUP BY study),
loso_t AS (SELECT study, count(*) AS n, avg(abs(y - least(100, greatest(0, pred)))) AS mae_plain,
    avg(abs(y - least(100, greatest(0, pred + o)))) AS mae_anchored
  FROM loso5 JOIN loso_off USING (study) WHERE row_id NOT IN (SELECT row_id FROM aq) GROUP BY study)"""


def loso(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", F.col("study_small").alias("study"), "x", "y")
    return AN.loso_table(rows, "study", "row_id", "x", "y", 3, 5)


@query("anchor_loso_table", sql("obs", f"""
SELECT study, n, {q6('mae_plain')} AS mae_plain, {q6('mae_anchored')} AS mae_anchored FROM loso_t""", LOSO_SQL))
def q_anchor_loso_table(spark, sf_dir):
    return rounded(loso(spark, sf_dir), "mae_plain", "mae_anchored")


@query("anchor_loso_report", sql("obs", f"""
SELECT count(*) AS n_studies, {q6('avg(mae_plain)')} AS mae_plain, {q6('avg(mae_anchored)')} AS mae_anchored,
  {q6('(1 - avg(mae_anchored) / avg(mae_plain)) * 100')} AS gain,
  cast(count_if(mae_anchored < mae_plain) as bigint) AS improved,
  {q6('(SELECT z FROM wil)')} AS z, {q6(f"(SELECT {sql_p('z')} FROM wil)")} AS p
FROM loso_t""", LOSO_SQL, wilcoxon_sql("loso_t", "mae_plain", "mae_anchored")))
def q_anchor_loso_report(spark, sf_dir):
    return rounded(AN.loso_summary(loso(spark, sf_dir)), "mae_plain", "mae_anchored", "gain", "z", "p")


HOLD = "10.1000/s1"


@query("anchored_holdout", sql("obs oof", f"""
SELECT {q6(f"(SELECT avg(abs(y - {q6('a + b * x')})) FROM obs, (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM obs))")} AS in_sample,
  {q6('(SELECT avg(abs(y - pred)) FROM oof)')} AS holdout,
  {q6('avg(abs(y - least(100, greatest(0, pred + o))))')} AS anchored_holdout,
  {q6('avg(abs(y - least(100, greatest(0, pred))))')} AS holdout_same_study, count(*) AS n_eval
FROM mine, (SELECT median(y - pred) AS o FROM mine WHERE rn <= 3) WHERE rn > 3""", loso_sql("study_big"), f"""
mine AS (SELECT *, row_number() OVER (ORDER BY {q6('abs(pred - m)')}, row_id) AS rn
  FROM (SELECT *, median(pred) OVER () AS m FROM loso WHERE study = '{HOLD}'))"""))
def q_anchored_holdout(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", F.col("study_big").alias("study"), "x", "y")
    out = AN.anchored_holdout(rows, P.oof(spark, sf_dir), "study", "row_id", "x", "y", HOLD)
    return rounded(out, "in_sample", "holdout", "anchored_holdout", "holdout_same_study")


# ------------------------------------------------------------------ scenarios
def closed_score(shares):
    """A closed-form score of the four shares with its dispersion, for the checks."""
    i, h, c, p = shares
    return 90 - 0.02 * (i - 45) * (i - 45) - 0.1 * h + 0.05 * c - 2 * p, 0.5 + 0.02 * i


SCORE_SQL = "(90 - 0.02 * ({i} - 45) * ({i} - 45) - 0.1 * {h} + 0.05 * {c} - 2 * {p})"


def score_sql(prefix: str = "") -> str:
    return SCORE_SQL.format(**{k: prefix + n for k, n in zip("ihcp", R.COMPONENTS)})


SHARES = ", ".join(f"{q6(c)} AS {c}" for c in R.COMPONENTS)


@query("substitute_ratio", sql("featured", f"""
SELECT row_id, {SHARES}, {q6('ionizable / nullif(helper, 0)')} AS ion_to_helper,
  {q6('ionizable + chol')} AS ion_plus_chol, {q6('ln(1 + peg)')} AS log_peg, np, name_raw
FROM (SELECT row_id, np, name_raw, 50 / t * 100 AS ionizable, qty / t * 100 AS helper, 38.5 / t * 100 AS chol,
             1.5 / t * 100 AS peg FROM (SELECT *, 50 + qty + 38.5 + 1.5::double AS t FROM featured))"""))
def q_substitute_ratio(spark, sf_dir):
    rows = P.featured(spark, sf_dir).select("row_id", "np", "name_raw", "qty", *R.FEATURES)
    parts = [F.lit(50.0), F.col("qty").cast("double"), F.lit(38.5), F.lit(1.5)]
    return rounded(SC.substituted(rows, parts).drop("qty"), *R.FEATURES)


def templates(spark, sf_dir):
    """One template per study: its first row."""
    from formulake.operators.groups import first_rows

    rows = P.shares(spark, sf_dir).select("row_id", "study_big", *R.COMPONENTS)
    return first_rows(rows, ["study_big"], [F.col("row_id")])


TEMPLATE_SQL = """
templates AS (SELECT * FROM (SELECT row_id, study_big, ionizable, helper, chol, peg,
  row_number() OVER (PARTITION BY study_big ORDER BY row_id) AS rn FROM featured) WHERE rn = 1)"""


@query("optimize_grid", sql("featured", f"""
SELECT row_id, rank, point, {SHARES}, {q6('pred')} AS pred, {q6('sd')} AS sd, in_support,
       {q6('pred - base')} AS delta, pred >= edge AS tied_with_best, n_tied, n_grid, {q6('span')} AS grid_span
FROM (SELECT t.row_id, {score_sql('t.')} AS base, s.* FROM templates t, scored s) WHERE rank <= 10""",
    SUPPORT_SQL, GRID_SQL, TEMPLATE_SQL, f"""
scored AS (SELECT *, count_if(pred >= edge) OVER () ::bigint AS n_tied FROM (
  SELECT *, max(pred) OVER () - min(pred) OVER () AS span, count(*) OVER () AS n_grid,
         row_number() OVER (ORDER BY round(pred, 9) DESC, point) AS rank,
         first_value(pred - sd) OVER (ORDER BY round(pred, 9) DESC, point) AS edge
  FROM (SELECT *, {score_sql()} AS pred, 0.5 + 0.02 * ionizable AS sd,
          """ + " AND ".join(
        f"{c} BETWEEN (SELECT lo - 1e-9 FROM support WHERE component = '{c}') AND "
        f"(SELECT hi + 1e-9 FROM support WHERE component = '{c}')" for c in R.COMPONENTS) + """
          AS in_support FROM grid)))"""))
def q_optimize_grid(spark, sf_dir):
    support = S.data_support(P.shares(spark, sf_dir), R.COMPONENTS)
    out = SC.optimize_grid(templates(spark, sf_dir), "row_id", composition_grid(support, 7), support,
                           closed_score, 10)
    return rounded(out, *R.COMPONENTS, "pred", "sd", "delta", "grid_span")


@query("topn_with_ties", sql("featured", f"""
SELECT study_big, row_id, rank, {q6('pred')} AS pred, tied_with_best, n_group, n_tied FROM (
  SELECT *, row_number() OVER (PARTITION BY study_big ORDER BY pred DESC, row_id) AS rank,
         pred >= edge AS tied_with_best, count_if(pred >= edge) OVER (PARTITION BY study_big) ::bigint AS n_tied
  FROM (SELECT study_big, row_id, pred, count(*) OVER (PARTITION BY study_big) AS n_group,
          max(pred) OVER (PARTITION BY study_big) - 2 AS edge
        FROM (SELECT study_big, row_id, {q6(score_sql())} AS pred FROM featured))) WHERE rank <= 5"""))
def q_topn_with_ties(spark, sf_dir):
    pred, _ = closed_score([F.col(c) for c in R.COMPONENTS])
    rows = P.shares(spark, sf_dir).select(
        "study_big", "row_id", r6(pred).alias("pred"), F.lit(2.0).alias("sd"))
    out = SC.top_with_ties(rows, "study_big", "pred", "sd", "row_id", 5)
    return out.select("study_big", "row_id", F.col("rank").cast("bigint").alias("rank"), "pred",
                      "tied_with_best", "n_group", "n_tied")


REQUEST_SQL = """
requests AS (SELECT row_id, CASE qty % 5 WHEN 0 THEN '50:10:38.5:1.5' WHEN 1 THEN '60:38.5:1.5'
  WHEN 2 THEN concat('50/10/', qty, '/1.5') WHEN 3 THEN 'n.r.' ELSE '45:10:38:1:2' END AS new_ratio FROM featured)"""


def requests(spark, sf_dir):
    q = F.col("qty") % 5
    return P.featured(spark, sf_dir).select(
        "row_id", F.when(q == 0, "50:10:38.5:1.5").when(q == 1, "60:38.5:1.5")
        .when(q == 2, F.concat(F.lit("50/10/"), F.col("qty").cast("string"), F.lit("/1.5")))
        .when(q == 3, "n.r.").otherwise("45:10:38:1:2").alias("new_ratio"))


_N = Q.numbers("new_ratio")


@query("whatif_batch", sql("featured", f"""
SELECT row_id, new_ratio, reason, {q6('p0')} AS pred_before, {q6('p1')} AS pred_after, {q6('p1 - p0')} AS delta,
  {q6('noise')} AS noise, abs(p1 - p0) > noise AS significant,
  CASE WHEN abs(p1 - p0) <= noise THEN 'within noise' WHEN p1 > p0 THEN 'up' WHEN p1 < p0 THEN 'down' END AS verdict
FROM (SELECT *, CASE WHEN reason IS NULL THEN {score_sql('n_')} END AS p1,
        CASE WHEN reason IS NULL THEN sqrt((0.5 + 0.02 * ionizable) ** 2 + (0.5 + 0.02 * n_ionizable) ** 2) END AS noise
  FROM (SELECT row_id, new_ratio, ionizable, {score_sql()} AS p0,
          CASE WHEN n IS NULL THEN 'ratio needs 3 or 4 numbers' END AS reason, """ + ", ".join(
        f"n[{i + 1}] / list_sum(n) * 100 AS n_{c}" for i, c in enumerate(R.COMPONENTS)) + f"""
        FROM (SELECT featured.*, new_ratio, CASE WHEN len(list_filter({_N}, lambda v: v IS NULL)) > 0 THEN NULL
                WHEN len({_N}) = 4 THEN {_N} WHEN len({_N}) = 3 THEN [{_N}[1], 0.0, {_N}[2], {_N}[3]] END AS n
              FROM featured JOIN requests USING (row_id))))""", REQUEST_SQL))
def q_whatif_batch(spark, sf_dir):
    rows = P.featured(spark, sf_dir).select("row_id", *R.COMPONENTS)
    out = SC.whatif_batch(rows, requests(spark, sf_dir), "row_id", "new_ratio", closed_score)
    return rounded(out.drop(*R.COMPONENTS), "pred_before", "pred_after", "delta", "noise")


_REST = "(ionizable + helper + chol + peg - CASE component " + " ".join(
    f"WHEN '{c}' THEN {c}" for c in R.COMPONENTS) + " END)"
CURVE_SQL = f"""
curve AS (SELECT row_id, component, step, value, {score_sql('n_')} AS pred, 0.5 + 0.02 * n_ionizable AS sd
  FROM (SELECT row_id, component, step, value, """ + ", ".join(
    f"u_{c} / (u_ionizable + u_helper + u_chol + u_peg) * 100 AS n_{c}" for c in R.COMPONENTS) + """
    FROM (SELECT *, """ + ", ".join(
    f"CASE WHEN component = '{c}' THEN value WHEN {_REST} > 0 THEN {c} / {_REST} * (100 - value) ELSE {c} END AS u_{c}"
    for c in R.COMPONENTS) + """
      FROM (SELECT t.*, component, i AS step, lo + (hi - lo) * i / 20 AS value
            FROM templates t, support, range(21) r(i)))))"""


@query("response_curve", sql("featured", f"""
SELECT row_id, component, step, {q6('value')} AS value, {q6('pred')} AS pred, {q6('sd')} AS sd FROM curve""",
    SUPPORT_SQL, TEMPLATE_SQL, CURVE_SQL))
def q_response_curve(spark, sf_dir):
    support = S.data_support(P.shares(spark, sf_dir), R.COMPONENTS)
    out = SC.response_curve(templates(spark, sf_dir), "row_id", support, closed_score)
    return rounded(out, "value", "pred", "sd")


@query("response_range", sql("featured", f"""
SELECT component, {q6('max(pred) - min(pred)')} AS response, {q6('avg(sd)')} AS mean_sd,
       max(pred) - min(pred) > avg(sd) AS exceeds_noise FROM curve GROUP BY 1""",
    SUPPORT_SQL, TEMPLATE_SQL, CURVE_SQL))
def q_response_range(spark, sf_dir):
    support = S.data_support(P.shares(spark, sf_dir), R.COMPONENTS)
    curve = SC.response_curve(templates(spark, sf_dir), "row_id", support, closed_score)
    return rounded(SC.response_range(curve, ["component"]), "response", "mean_sd")


def slopes(spark, sf_dir):
    return S.fe_slope(P.obs(spark, sf_dir), "study_big", "x", "y")


SCEN_SQL = """
scen0 AS (SELECT * FROM (SELECT row_id, x, y, {t} AS target, CASE WHEN greatest(x, {t}) >= 2.5 THEN 'high' ELSE 'low' END AS segment
  FROM obs {j}) JOIN (SELECT segment, slope, ci_lo, ci_hi, resid_sd FROM slopes) USING (segment)),
scen AS (SELECT row_id, x, y, target, segment, slope * (target - x) AS delta,
    least(ci_lo * (target - x), ci_hi * (target - x)) AS delta_lo,
    greatest(ci_lo * (target - x), ci_hi * (target - x)) AS delta_hi, resid_sd,
    least(100, greatest(0, y + slope * (target - x))) AS pred,
    y + slope * (target - x) > 100 OR y + slope * (target - x) < 0 AS clipped,
    segment = 'high' AND target >= 2.5 AS usable FROM scen0)"""


@query("segment_slope_scenario", sql("obs", f"""
SELECT row_id, segment, {q6('delta')} AS delta, {q6('delta_lo')} AS delta_lo, {q6('delta_hi')} AS delta_hi,
  {q6('pred')} AS pred, {q6('resid_sd')} AS pred_sd, clipped, usable,
  CASE WHEN abs(delta) <= 1e-9 THEN 'none' WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction FROM scen""",
    slope_sql("study_big"), SCEN_SQL.format(t="(qty % 9 + 0.25::double)", j="")))
def q_segment_slope_scenario(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", "x", "y", (F.col("qty") % 9 + 0.25).alias("target"))
    out = SC.segment_slope_scenario(rows, slopes(spark, sf_dir), "x", "target", "y")
    return rounded(out.drop("x", "y", "target"), "delta", "delta_lo", "delta_hi", "pred", "pred_sd")


@query("segment_slope_curve", sql("obs", f"""
SELECT row_id, step, {q6('target')} AS target, {q6('pred')} AS pred, {q6('pred - resid_sd')} AS lo,
  {q6('pred + resid_sd')} AS hi, usable, segment FROM (
  SELECT *, cast(round((target - 0.5) * 4) as bigint) AS step FROM scen)""",
    slope_sql("study_big"), SCEN_SQL.format(
        t="(0.5 + 7.5 * i / 30::double)", j=", range(31) r(i)")))
def q_segment_slope_curve(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", "x", "y")
    out = SC.segment_slope_curve(rows, slopes(spark, sf_dir), "x", "y")
    return rounded(out.select("row_id", F.col("step").cast("bigint").alias("step"), "target", "pred",
                              "lo", "hi", "usable", "segment"), "target", "pred", "lo", "hi")


@query("segment_slope_recommend", sql("obs", f"""
SELECT row_id, x >= 2.5 AS actionable, CASE WHEN x >= 2.5 THEN 2.5::double END AS target,
  {q6('CASE WHEN x >= 2.5 THEN slope * (2.5 - x) END')} AS gain,
  {q6('CASE WHEN x >= 2.5 THEN least(ci_lo * (2.5 - x), ci_hi * (2.5 - x)) END')} AS gain_lo,
  {q6('CASE WHEN x >= 2.5 THEN greatest(ci_lo * (2.5 - x), ci_hi * (2.5 - x)) END')} AS gain_hi
FROM obs, (SELECT slope, ci_lo, ci_hi FROM slopes WHERE segment = 'high')""", slope_sql("study_big")))
def q_segment_slope_recommend(spark, sf_dir):
    rows = P.obs(spark, sf_dir).select("row_id", "x")
    out = SC.segment_slope_recommend(rows, slopes(spark, sf_dir), "x")
    return rounded(out.drop("x"), "gain", "gain_lo", "gain_hi")
