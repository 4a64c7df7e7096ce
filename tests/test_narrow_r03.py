"""Evaluation rows carry what is asked of them, keys and grids are computed once."""

import datetime

import pytest
from pyspark.sql import functions as F

from formulake.functions.ratio import plain_number
from formulake.operators import keys as K
from formulake.operators import scenario as SC
from formulake.plans import views as P


@pytest.fixture
def listed(spark, tmp_path):
    day = datetime.datetime(1995, 1, 2)
    items = [(o, p, 7, n, 10.0 + n, 0.05, 0.02, day) for o in (1, 2, 3) for n, p in ((1, 5), (2, 6), (3, None))]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_discount double, l_tax double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")

    def parts(*keys):
        spark.createDataFrame([(k, f"part {k}") for k in keys], "p_partkey long, p_name string").write.parquet(
            f"{tmp_path}/part.parquet")
        return str(tmp_path)

    return parts


@pytest.mark.parametrize("keys, joined", [((5, 6, None, None), False), ((5, 5, 5, 6, 6, None), True)])
def test_rows_without_names_are_those_with_names(spark, listed, keys, joined):
    sf_dir = listed(*keys)
    narrow = P.form_rows(spark, sf_dir, named=False)
    wide = P.form_rows(spark, sf_dir).drop("name_raw", "part_name")
    assert narrow.columns == wide.columns
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))
    assert ("p_partkey" in narrow._jdf.queryExecution().optimizedPlan().toString()) == joined


@pytest.mark.parametrize("view", [P.obs, P.shares])
def test_views_without_names_join_no_part(spark, sf_dir, monkeypatch, view):
    monkeypatch.setattr(P, "STORED", {})
    monkeypatch.setattr(P, "materialise", lambda df, label: df)
    plan = view(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_name" not in plan and "Join" not in plan


def test_copies_of_first_lines(spark):
    rows = spark.createDataFrame([("a", "1:2:3:4", 1), ("b", "1:2", 1), ("c", "1:2:3", 2), ("d", None, 1)],
                                 "row_id string, ratio string, line_no long")
    assert sorted(tuple(r)[:2] for r in P.with_copies(rows).collect()) == [
        ("a", "1:2:3:4"), ("a-r", "2:1:3:4"), ("b", "1:2"), ("c", "1:2:3"), ("d", None)]


def test_duplicate_keys_are_computed_once(spark, monkeypatch):
    written = []
    real = K.materialise
    monkeypatch.setattr(K, "materialise", lambda df, label: written.append(df.columns) or real(df, label))
    rows = spark.createDataFrame([(f"r{i:02d}", "s", "n", "1:2:3" if i % 2 else "3:2:1.0", "80", "wide") for i in range(20)]
                                 + [("z", "t", "n", "1:2", "80", "wide")],
                                 "row_id string, study string, name string, ratio string, outcome string, more string")
    out = K.duplicate_report(K.with_key(rows, "study", "name", "ratio", "outcome"), "row_id")
    assert written == [["content_key", "row_id"]]
    assert "RLIKE(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("s|n|1:2:3|800", 20, ",".join(f"r{i:02d}" for i in range(8)))]


def test_plain_numbers(spark):
    texts = {0.0: "0", -0.0: "0", 1.0: "1", 10.0: "10", 38.5: "38.5", -2.25: "-2.25", 0.001: "0.001", 0.00025: "0.00025",
             1e7: "10000000", 12345678.5: "12345678.5", 9999999.0: "9999999", 1e-7: "0.0000001", 0.1 + 0.2: "0.30000000000000004",
             1e25: "1.0E25", 0.002: "0.002", 20.0: "20"}
    rows = spark.createDataFrame([(v,) for v in texts], "v double")
    assert [r[0] for r in rows.select(plain_number(F.col("v"))).collect()] == list(texts.values())
    assert rows.select(plain_number(F.lit(float("nan")))).first()[0] == "NaN"


def test_grid_is_scored_once_for_all_templates(spark):
    templates = spark.createDataFrame([(f"t{i}", 50.0 + i, 10.0, 38.5, 1.5) for i in range(3)],
                                      "row_id string, ionizable double, helper double, chol double, peg double")
    support = spark.createDataFrame([(c, 1.0, 60.0) for c in SC.COMPONENTS], "component string, lo double, hi double")
    grid = spark.createDataFrame([(p, 10.0 + p, 20.0, 30.0, 40.0 - p) for p in range(5)],
                                 "point long, ionizable double, helper double, chol double, peg double")
    out = SC.optimize_grid(templates, "row_id", grid, support, lambda s: (s[0] * 2, F.lit(3.0)), 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if ":" not in line[:12] and "array_sort" in line]
    assert sorted(tuple(r)[:3] + (r.pred, r.delta, r.n_tied, r.n_grid, r.grid_span) for r in out.collect()) == [
        (f"t{i}", k + 1, 4 - k, 28.0 - 2 * k, 28.0 - 2 * k - 2 * (50 + i), 2, 5, 8.0) for i in range(3) for k in range(2)]
