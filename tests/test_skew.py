"""One key holds most rows: results stay whole and equal to brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formulake.operators import groups as G
from formulake.operators.anchor import anchor_median
from formulake.operators.folds import attach_folds, permute_within
from formulake.operators.joins import nearest_mention, pair_agreement
from formulake.operators.stats import fe_slope, fe_slope_jackknife, spearman


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    n = 600
    study = np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 40, n).astype(str))
    x = np.round(rng.uniform(0.5, 8, n), 3)
    y = np.round(np.clip(60 + 3 * x + rng.normal(0, 10, n), 1, 100), 1)
    pred = np.round(y + rng.normal(0, 8, n), 2)
    return pd.DataFrame({"row_id": [f"r{i:04d}" for i in range(n)], "study": study, "x": x, "y": y,
                         "pred": pred})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def test_ranks(df, pdf):
    want = pdf.groupby("study").y.rank()
    got = G.value_ranks(df, ["study"], "y", 0.25).toPandas().set_index(["study", "y"]).avg_rank
    for i, row in pdf.iterrows():
        assert got[(row.study, row.y)] == want[i]


def test_quantiles(df, pdf):
    got = G.group_quantiles(df, ["study"], "pred", {"a": 0.25, "m": 0.5}, 0.1).toPandas().set_index("study")
    for s, g in pdf.groupby("study"):
        assert got.loc[s, "a"] == pytest.approx(np.quantile(g.pred, 0.25))
        assert got.loc[s, "m"] == pytest.approx(g.pred.median())


def test_attach_reaches_hot_and_cold_rows(df, pdf, monkeypatch):
    monkeypatch.setattr(G, "HOT_KEYS", 2)
    sizes = df.groupBy("study").agg(F.count("*").alias("n"))
    got = G.attach(df, sizes, ["study"], "n").toPandas().set_index("row_id").n
    want = pdf.groupby("study").row_id.transform("count")
    assert len(got) == len(pdf) and (got[pdf.row_id].to_numpy() == want.to_numpy()).all()


def test_pair_agreement(df, pdf):
    got = pair_agreement(df, "study", "y", "pred", 5.0).toPandas().set_index("study")
    for s, g in pdf.groupby("study"):
        dy = g.y.to_numpy()[None, :] - g.y.to_numpy()[:, None]
        dp = g.pred.to_numpy()[None, :] - g.pred.to_numpy()[:, None]
        far = dy >= 5 - 1e-9
        assert int(got.loc[s, "n_pairs"]) == far.sum()  # counts are decimals, as they pass 64 bits
        assert int(got.loc[s, "n_agree"]) == (far & (dp > 0)).sum()


def test_spearman(df, pdf):
    got = spearman(df, ["study"], "y", "pred", 0.25).toPandas().set_index("study").rho
    for s, g in pdf.groupby("study"):
        if len(g) > 3 and g.y.nunique() > 1 and g.pred.nunique() > 1:
            assert got[s] == pytest.approx(g.y.rank().corr(g.pred.rank()))


def test_slope_equals_dummy_regression(df, pdf):
    high = pdf[pdf.x >= 2.5]
    design = np.column_stack([high.x, pd.get_dummies(high.study).to_numpy(float)])
    beta, *_ = np.linalg.lstsq(design, high.y.to_numpy(), rcond=None)
    row = fe_slope(df, "study", "x", "y").where("segment = 'high'").first()
    assert row["slope"] == pytest.approx(beta[0])
    rest = high.y.to_numpy() - design @ beta
    assert row["resid_sd"] == pytest.approx(np.sqrt(rest @ rest / (len(high) - design.shape[1])))


def test_jackknife_equals_refits(df, pdf):
    high = pdf[pdf.x >= 2.5]
    slopes = []
    for s in high.study.unique():
        g = high[high.study != s]
        dx, dy = (g[c] - g.groupby("study")[c].transform("mean") for c in ("x", "y"))
        slopes.append((dx * dy).sum() / (dx * dx).sum())
    row = fe_slope_jackknife(df, "study", "x", "y").where("segment = 'high'").first()
    assert row["slope_min"] == pytest.approx(min(slopes))
    assert row["slope_max"] == pytest.approx(max(slopes))


def test_folds_never_split_a_study(df):
    rows = attach_folds(df, "study", 5).toPandas()
    assert len(rows) == df.count() and (rows.groupby("study").fold.nunique() == 1).all()
    assert set(rows.fold) == set(range(5))


def test_permutation_keeps_values(df, pdf):
    got = permute_within(df, "study", "row_id", "y").toPandas()
    for s, g in pdf.groupby("study"):
        assert sorted(got[got.study == s].y_shuffled) == sorted(g.y)


def test_anchors_are_limited_before_the_shuffle(df):
    plan = anchor_median(df, "study", "row_id", "pred", 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    sizes = anchor_median(df, "study", "row_id", "pred", 2).groupBy("study").count().toPandas()
    assert sizes["count"].max() <= 2


def test_nearest_mention(spark):
    rng = np.random.default_rng(3)
    r = pd.DataFrame({"doc_id": rng.integers(0, 5, 200), "start": rng.integers(0, 50000, 200)}).drop_duplicates()
    e = pd.DataFrame({"doc_id": rng.integers(0, 4, 80), "start": rng.integers(0, 50000, 80)})
    r["ratio"], e["ee"] = "x", np.arange(len(e), dtype=float)
    got = nearest_mention(spark.createDataFrame(r), spark.createDataFrame(e)).toPandas()
    assert len(got) == len(r)
    for row in got.itertuples():
        gaps = (e[e.doc_id == row.doc_id].start - row.start).abs()
        if len(gaps) and gaps.min() <= 4000:
            assert row.gap == gaps.min()
        else:
            assert pd.isna(row.gap)
