"""Model fits: the features are the derived formulation table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.functions import ratio as R
from formulake.functions.numbers import r6
from formulake.operators import evaluate as E
from formulake.operators import models as M
from formulake.operators import scenario as SC
from formulake.operators import stats as S
from formulake.operators import trees as T
from formulake.operators.groups import first_rows
from formulake.operators.folds import attach_folds, permute_within, random_folds
from formulake.plans import sqlviews as Q
from formulake.plans import views as P
from formulake.plans.q_anchor import requests
from formulake.plans.q_clean import CATEGORIES, MEASURED, NUMERIC, SMILES_PATTERNS, smiles_features, to_logit
from formulake.plans.q_stats import rounded
from formulake.plans.registry import query
from formulake.plans.sqlviews import r6 as q6
from formulake.plans.sqlviews import sql
from formulake.session import materialise, spread

# The registered runs use the published folds and penalties and ensembles of full size: 400 trees of depth
# 20, 400 boosting rounds, two-stage forests of 600 and 300 trees. Every model is fitted on all training rows
# and every row is predicted.
FOLDS = 5
FOREST = T.Ensemble("bagged", 400, 20, 3, 0.5)
BOOSTING = T.Ensemble("boosted", 400, 4, 15, 1.0, 0.05)


@P.stored("matrix")
def matrix(spark, sf_dir):
    """Feature matrix with study folds; blank category values get a level of their own."""
    rows = P.featured(spark, sf_dir).select(
        "row_id", F.col("study_big").alias("study"), "y", *NUMERIC, *MEASURED,
        *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("blank")).alias(c) for c in CATEGORIES])
    return attach_folds(rows, "study", FOLDS)


MATRIX_SQL = f"rows0 AS (SELECT *, study_big AS study FROM featured), {Q.folds('rows0', FOLDS)}"


@query("fold_safe_prep", sql("featured", " UNION ALL ".join(f"""
SELECT cast(f as bigint) AS test_fold, '{c}' AS "column", {q6(f'median({c})')} AS median, {q6(f'avg({c})')} AS mean,
  {q6(f'stddev_samp({c})')} AS sd FROM folded, range({FOLDS}) t(f) WHERE fold <> f GROUP BY f""" for c in NUMERIC),
    MATRIX_SQL))
def q_fold_safe_prep(spark, sf_dir):
    return rounded(M.fold_statistics(matrix(spark, sf_dir), NUMERIC, FOLDS), "median", "mean", "sd")


def _oof(spark, sf_dir, members):
    fit = M.Trainer(NUMERIC, CATEGORIES, members)
    return M.oof_predictions(matrix(spark, sf_dir), fit, FOLDS).select("row_id", "study", "fold", "y", "pred")


@query("oof_ridge")
def q_oof_ridge(spark, sf_dir):
    return _oof(spark, sf_dir, M.ridge_members())


def bounded(spark, sf_dir, ensemble):
    rows = matrix(spark, sf_dir)
    return M.bounded_oof(rows, NUMERIC, CATEGORIES, {"model": ensemble}, FOLDS).select(
        "row_id", "study", "fold", "y", "pred")


@query("oof_forest")
def q_oof_forest(spark, sf_dir):
    return bounded(spark, sf_dir, FOREST)


@query("oof_gbt")
def q_oof_gbt(spark, sf_dir):
    return bounded(spark, sf_dir, BOOSTING)


@query("model_grid")
def q_model_grid(spark, sf_dir):
    """Models x fold schemes: metrics, gain, paired test against the mean, verdict, provenance."""
    grouped = M.numbered(matrix(spark, sf_dir))
    schemes = {"study-grouped": grouped,
               "random": random_folds(grouped.drop("fold"), "row_id", FOLDS)}
    members = ["ridge", "forest", "boosting"]
    keep = ["model", "cv", "row_id", "study", "y", "pred"]
    parts = []
    for cv, rows in schemes.items():
        mean = E.mean_oof(rows, "y").withColumn("model", F.lit("mean"))
        trees = M.bounded_oof(rows, NUMERIC, CATEGORIES, {"forest": FOREST, "boosting": BOOSTING}, FOLDS)
        ridge = M.oof_predictions(rows, M.Trainer(NUMERIC, CATEGORIES, M.ridge_members()), FOLDS)
        parts += [p.withColumn("cv", F.lit(cv)).select(*keep)
                  for p in (mean, trees, ridge.withColumn("model", F.lit("ridge")))]
    long = materialise(reduce(DataFrame.unionByName, parts), "grid")
    metrics = E.with_gain(E.error_metrics(long, ["model", "cv"]), "mean", "study-grouped")
    base = long.where((F.col("model") == "mean") & (F.col("cv") == "study-grouped")).select(
        "row_id", F.col("pred").alias("base"))
    tests = None
    for name in members:
        mine = long.where((F.col("model") == name) & (F.col("cv") == "study-grouped")).join(base, "row_id")
        one = S.wilcoxon(S.paired_study_error(mine, "study", "pred", "base"), "mae_a", "mae_b").select(
            F.lit(name).alias("model"), F.lit("study-grouped").alias("cv"), "p")
        tests = one if tests is None else tests.unionByName(one)
    out = metrics.join(tests, ["model", "cv"], "left")
    shape = grouped.agg(F.struct(F.count("*").alias("n_rows"),
                                 F.count_distinct("study").alias("n_studies")).alias("s")).scalar()
    out = out.withColumn("_s", shape).withColumn("verdict", F.when(
        F.col("p").isNotNull(), M.verdict(F.col("gain"), F.col("p"))))
    out = rounded(out, "r2", "mae", "rmse", "gain", "p")
    return out.select(
        "model", "cv", "r2", "mae", "rmse", "gain", "p", "verdict", F.col("_s.n_rows").alias("n_rows"),
        F.col("_s.n_studies").alias("n_studies"), (F.col("cv") == "study-grouped").alias("grouped_cv"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("run_utc"))


@P.stored("two_stage")
def two_stage(spark, sf_dir):
    return M.two_stage(matrix(spark, sf_dir), NUMERIC, CATEGORIES, FOLDS).select(
        "row_id", "study", "fold", "y", "pred", "eps")


@query("two_stage_logit")
def q_two_stage_logit(spark, sf_dir):
    return rounded(two_stage(spark, sf_dir).drop("fold"), "pred")


@query("nested_cv_report")
def q_nested_cv_report(spark, sf_dir):
    return rounded(M.nested_report(two_stage(spark, sf_dir), FOLDS), "mae_model", "mae_baseline", "gain")


@query("tree_dispersion")
def q_tree_dispersion(spark, sf_dir):
    """Mean and deviation over the trees of every row's own fold, in percent and on the log-odds scale."""
    rows = M.numbered(matrix(spark, sf_dir))
    plain = M.bounded_oof(rows, NUMERIC, CATEGORIES, {"plain": FOREST}, FOLDS)
    scaled = rows.withColumn("percent", F.col("y")).withColumn("y", to_logit(F.col("y"), V.LOGIT_BASE))
    logit = M.bounded_oof(scaled, NUMERIC, CATEGORIES, {"logit": FOREST}, FOLDS)
    a = plain.select("row_id", "y", "pred", (F.col("sd") * V.DISPERSION_SCALE).alias("sd"))
    b = logit.select("row_id", M.percent(F.col("pred")).alias("pred_logit"),
                     M.logit_dispersion(F.col("pred"), F.col("sd")).alias("sd_logit"))
    return rounded(a.join(b, "row_id"), "pred", "sd", "pred_logit", "sd_logit")


@query("feature_ablation")
def q_feature_ablation(spark, sf_dir):
    """Mean error of the forest without a block of columns, with the measured ones, and with the structure counts."""
    structure = list(SMILES_PATTERNS)
    dim = smiles_features(P.lipid_lookup(spark, sf_dir)).withColumnRenamed("name", "part_name")
    parts = P.featured(spark, sf_dir).select("row_id", "part_name").join(dim, "part_name", "left")
    rows = M.numbered(matrix(spark, sf_dir).join(parts.drop("part_name"), "row_id"))
    blocks = {
        "all": (NUMERIC + structure, CATEGORIES),
        "no ratios": ([c for c in NUMERIC if c not in R.FEATURES] + structure, CATEGORIES),
        "no categories": (NUMERIC + structure, []),
        "no SMILES": (NUMERIC, CATEGORIES),
        "measured added": (NUMERIC + MEASURED + structure, CATEGORIES),
    }

    def one(block):
        name, (numeric, categories) = block
        found = M.bounded_oof(rows, numeric, categories, {name: FOREST}, FOLDS)
        return found.groupBy(F.col("model").alias("block")).agg(
            r6(F.avg(F.abs(F.col("y") - F.col("pred")))).alias("mae"), F.count("*").alias("n"))

    return reduce(DataFrame.unionByName, M.side_by_side(spark, one, list(blocks.items())))


@query("permutation_control")
def q_permutation_control(spark, sf_dir):
    """Response range of every component, over all rows, on real and on within-study shuffled outcomes."""
    rows = matrix(spark, sf_dir).drop("fold")
    shuffled = permute_within(rows, "study", "row_id", "y").select("row_id", "y_shuffled")
    fake = materialise(rows.join(shuffled, "row_id").withColumn("y_real", F.col("y")), "shuffled")
    support = S.data_support(P.featured(spark, sf_dir), R.COMPONENTS)
    others = matrix(spark, sf_dir).select("row_id", "np", "ph", *CATEGORIES)
    # spread before they unfold: few bytes but 84 points and as many walks a row
    base = spread(P.featured(spark, sf_dir).select("row_id", *R.COMPONENTS).join(others, "row_id"), "row_id")
    swept, shares = SC.swept_shares(base, support, 21)
    points = swept.select("row_id", "component", "step", "np", "ph", *CATEGORIES,
                          *[s.alias(c) for s, c in zip(shares, R.COMPONENTS)])
    grid = points.withColumns({
        "ion_to_helper": F.try_divide(F.col("ionizable"), F.nullif(F.col("helper"), F.lit(0.0))),
        "ion_plus_chol": F.col("ionizable") + F.col("chol"), "log_peg": F.log1p("peg")})
    prep, models = M.fitted_once(fake, NUMERIC, CATEGORIES, {"signal": "y_real", "noise": "y_shuffled"}, FOREST)
    asked = grid.select("row_id", "component", prep.features(F.lit(0)).alias("_x"))
    for label in ("signal", "noise"):
        asked = T.scored(asked, models[label], "_x", label)
    curve = asked.groupBy("row_id", "component").agg(*[
        (F.max(f"{c}.mean") - F.min(f"{c}.mean")).alias(c) for c in ("signal", "noise")])
    both = curve.groupBy("component").agg(*[r6(F.avg(c)).alias(c) for c in ("signal", "noise")])
    ratio = F.try_divide(F.col("signal"), F.col("noise"))
    return both.select("*", r6(ratio).alias("ratio"), (ratio > 2).alias("trusted"))


def forest_score(spark, sf_dir):
    """A forest of all rows as a score."""
    rows = matrix(spark, sf_dir).drop("fold")
    prep, models = M.fitted_once(rows, NUMERIC, CATEGORIES, {"one": "y"}, FOREST)
    return M.tree_score(prep, models["one"])


def study_templates(spark, sf_dir):
    """One template for each study, its first row, with all features."""
    rows = matrix(spark, sf_dir).select("row_id", "study", *NUMERIC, *CATEGORIES)
    return first_rows(rows, ["study"], [F.col("row_id")])


@query("optimize_grid_model")
def q_optimize_grid_model(spark, sf_dir):
    """Best grid points of every study's template by the fitted forest."""
    support = S.data_support(P.featured(spark, sf_dir), R.COMPONENTS)
    out = SC.optimize_by_model(study_templates(spark, sf_dir), "row_id", support, forest_score(spark, sf_dir))
    return rounded(out, *R.COMPONENTS, "pred", "sd", "delta", "grid_span")


@query("whatif_model")
def q_whatif_model(spark, sf_dir):
    """Every row's requested ratio by the fitted forest, both sides moved by an offset's headroom."""
    rows = matrix(spark, sf_dir).select("row_id", *NUMERIC, *CATEGORIES)
    asked = requests(spark, sf_dir).withColumn("request", F.col("row_id"))
    out = SC.whatif_by_model(rows, asked, "row_id", "request", "new_ratio", forest_score(spark, sf_dir),
                             F.lit(5.0), F.lit(70.0))
    return rounded(out.drop("request"), *[c for c, t in out.dtypes if t == "double"])


@query("response_curve_model")
def q_response_curve_model(spark, sf_dir):
    """Response of every study's template to each component by the fitted forest."""
    support = S.data_support(P.featured(spark, sf_dir), R.COMPONENTS)
    out = SC.response_by_model(study_templates(spark, sf_dir), "row_id", support, forest_score(spark, sf_dir))
    return rounded(out, "value", "pred", "sd", "lo", "hi")
