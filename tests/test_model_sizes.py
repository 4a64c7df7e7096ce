"""Bounded fits: ensembles of full size, every row predicted, nothing learned from a row's own fold."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from formulake import vocab as V
from formulake.operators import evaluate as E
from formulake.operators import models as M
from formulake.operators import trees as T
from formulake.plans import q_models as Q
from formulake.plans.q_clean import CATEGORIES, NUMERIC

SMALL = {"forest": T.Ensemble("bagged", 20, 12, 3, 0.5), "random": T.Ensemble("random", 20, 12, 4, 0.6),
         "boosting": T.Ensemble("boosted", 40, 4, 15, 1.0, 0.1)}


def test_registered_sizes():
    assert (Q.FOREST.trees, Q.FOREST.depth, Q.FOREST.min_leaf) == (400, 20, 3)
    assert (Q.BOOSTING.trees, Q.BOOSTING.step, Q.BOOSTING.depth, Q.BOOSTING.min_leaf) == (400, 0.05, 4, 15)
    sizes = inspect.signature(M.two_stage).parameters
    assert [sizes[n].default for n in ("trees", "lite_trees", "depth")] == [600, 300, 20]
    assert M.FIT_ROWS >= 1308


@pytest.fixture(scope="module")
def predicted(spark, sf_dir):
    rows = Q.matrix(spark, sf_dir)
    found = M.bounded_oof(rows, NUMERIC, CATEGORIES, SMALL, Q.FOLDS, fit_rows=800)
    return rows.toPandas(), found.toPandas()


def test_every_row_is_predicted_once_by_every_model(predicted):
    rows, found = predicted
    for name in SMALL:
        own = found[found.model == name]
        assert sorted(own.row_id) == sorted(rows.row_id)
        assert own.pred.notna().all() and own.pred.between(rows.y.min() - 1, rows.y.max() + 1).all()
    forest = found[found.model == "forest"]
    assert (forest.sd > 0).any() and (forest.sd >= 0).all()


def test_models_beat_the_mean_of_other_folds(spark, sf_dir, predicted):
    _, found = predicted
    mean = E.mean_oof(Q.matrix(spark, sf_dir), "y").toPandas()
    base = (mean.y - mean.pred).abs().mean()
    for name, own in found.groupby("model"):
        assert (own.y - own.pred).abs().mean() < base, name


def test_a_fold_learns_nothing_from_its_own_outcomes(spark, sf_dir, predicted):
    """Other outcomes in one fold leave that fold's predictions as they were."""
    rows = Q.matrix(spark, sf_dir)
    turned = rows.withColumn("y", F.when(F.col("fold") == 2, 100 - F.col("y")).otherwise(F.col("y")))
    again = M.bounded_oof(turned, NUMERIC, CATEGORIES, {"forest": SMALL["forest"]}, Q.FOLDS, fit_rows=800).toPandas()
    both = predicted[1].query("model == 'forest'").merge(again, on="row_id")
    same = both.pred_x == both.pred_y
    assert same[both.fold_x == 2].all() and not same[both.fold_x != 2].all()


def test_the_tested_statistics_fill_the_rows(spark):
    rows = spark.createDataFrame(
        [(i, i % 2, float(i) if i % 5 else None, "abc"[i % 3] if i % 7 else None) for i in range(100)]
        + [(200, 0, None, "rare")], "row_id bigint, fold bigint, v double, c string")
    prep = M.Preparation.learn(rows, ["v"], ["c"], 2)
    stats = {r["test_fold"]: r["median"] for r in M.fold_statistics(rows, ["v"], 2).collect()}
    assert {f: prep.medians[f, "v"] for f in (0, 1)} == stats
    for r in rows.select("*", prep.features(F.col("fold")).alias("x")).collect():
        levels = prep.levels[r.fold, "c"]
        assert r.x[0] == (stats[r.fold] if r.v is None else r.v)
        expected = 0 if r.c is None else levels.index(r.c) if r.c in levels else prep.sizes()[0] - 1
        assert r.x[1] == expected
    assert all("rare" not in own for own in prep.levels.values())


def walk(model, tree, row):
    node = tree
    while model.left[node] >= 0:
        value, bound = row[model.column[node]], model.bound[node]
        right = value > bound if model.column[node] < model.numbers else value == bound
        node = model.left[node] + int(right)
    return model.value[node]


@pytest.mark.parametrize("kind, share", [("bagged", 0.5), ("random", 0.6), ("boosted", 1.0)])
def test_walks_equal_single_walks_and_leaves_hold_their_means(kind, share):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.random((400, 3)), rng.integers(0, 6, 400)]).astype(np.float32)
    y = 20 * (x[:, 0] > 0.5) + 10 * (x[:, 3] == 2) + rng.normal(0, 0.5, 400)
    fit = T.Fit(x, y, (7,), T.Ensemble(kind, 25, 6, 5, share, 0.3))
    parts = [T.boosted(fit)] if kind == "boosted" else [T.batch_of(fit, k) for k in range(3)]
    nodes, trees = T.joined([p for p, _ in parts], [t for _, t in parts])
    assert trees == (26 if kind == "boosted" else 25)
    model = T.Model(tuple(a.astype(k) for a, k in zip(nodes, T.KINDS)), trees, 3, kind == "boosted")
    leaves = model.leaves(x[:50])
    for i in range(50):
        assert leaves[:, i].tolist() == [walk(model, t, x[i]) for t in range(trees)]
    assert np.abs(model.predict(x)[0] - y).mean() < 0.35 * np.abs(y - y.mean()).mean()
    if kind == "random":  # all rows train every tree: a leaf's value is the mean of its rows
        for tree in range(3):
            own = model.leaves(x)[tree]
            for value in np.unique(own):
                assert value == pytest.approx(y[own == value].mean()) and (own == value).sum() >= 5


def test_leaf_look_up_equals_single_trees(spark, sf_dir):
    rows = Q.matrix(spark, sf_dir)
    model = M.Trainer(NUMERIC, CATEGORIES, M.forest_members(trees=20, depth=4))(rows)
    forest, prepared = model.members[0], model.prep.transform(rows)
    fast = M.tree_dispersion(prepared, [forest], ["row_id"])
    single = prepared
    for t, tree in enumerate(forest.trees):
        single = tree.setPredictionCol(f"t{t}").transform(single)
    names = [f"t{t}" for t in range(20)]
    slow = single.select("row_id", *names).toPandas().set_index("row_id")[names]
    got = fast.toPandas().set_index("row_id").loc[slow.index]
    assert np.allclose(got.pred, slow.mean(axis=1)) and np.allclose(got.sd, slow.std(axis=1, ddof=0))
    few = M.Trainer(NUMERIC, CATEGORIES, M.forest_members(trees=2, depth=4))(rows)

    def plan_lines(df):
        return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert plan_lines(fast) == plan_lines(M.tree_dispersion(few.prep.transform(rows), few.members, ["row_id"]))


def test_two_stage_and_its_report(spark, sf_dir):
    rows = Q.matrix(spark, sf_dir)
    found = M.two_stage(rows, NUMERIC, CATEGORIES, Q.FOLDS, trees=12, lite_trees=6, depth=8, fit_rows=800)
    table = found.toPandas()
    assert sorted(table.row_id) == sorted(r.row_id for r in rows.select("row_id").collect())
    assert table.pred.between(0, 100).all() and set(table.eps) <= {V.LOGIT_BASE, V.LOGIT_SHARP}
    report = M.nested_report(found, Q.FOLDS).collect()[0]
    assert report.n_rows == len(table) and len(report.picks.split(",")) == table.fold.nunique()
    assert report.gain == pytest.approx((1 - report.mae_model / report.mae_baseline) * 100)
    assert report.mae_model == pytest.approx((table.y - table.pred).abs().mean())
    sharp = M.two_stage(rows, NUMERIC, CATEGORIES, Q.FOLDS, trees=2, lite_trees=2, depth=3, margin=-1e9, fit_rows=300)
    assert {r.eps for r in sharp.select("eps").distinct().collect()} == {V.LOGIT_SHARP}


def test_odd_tables(spark):
    schema = "row_id bigint, study string, y double, v double, c string"
    table = spark.createDataFrame([(i, f"s{i % 4}", float(i % 10), None, None) for i in range(40)], schema)
    folded = M.attach_folds(table, "study", 2)
    if folded.select("fold").distinct().count() == 2:
        found = M.bounded_oof(folded, ["v"], ["c"], {"f": T.Ensemble("bagged", 5, 3, 2, 0.5)}, 2)
        assert found.count() == 40
    with pytest.raises(ValueError):
        M.bounded_oof(folded.limit(0), ["v"], ["c"], {"f": T.Ensemble()}, 2)
