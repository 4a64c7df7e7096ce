"""Evaluation views read line items once, compute outcome and ratio once a row, and write one table."""

import pytest
from pyspark.sql import functions as F

from formulake.functions.numbers import where_known
from formulake.functions.outcome import clean_outcome
from formulake.functions.ratio import ratio_numbers
from formulake.plans import views as P


@pytest.mark.parametrize("view, once", [(P.obs, "RLIKE("), (P.featured, "RLIKE(")])
def test_views_compute_once_and_write_one_table(spark, sf_dir, monkeypatch, view, once):
    written = []
    monkeypatch.setattr(P, "STORED", {})
    monkeypatch.setattr(P, "materialise", lambda df, label: written.append(label) or df)
    plan = view(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert written == [view.__name__]
    assert plan.count(once) == 1


def test_where_known_keeps_rows_with_all_values(spark):
    rows = spark.createDataFrame([(1, "5", "a"), (2, None, "b"), (3, "x", "c"), (3, "7", None)], "id int, y string, z string")
    found = where_known(rows, {"y": F.col("y").try_cast("double"), "s": F.struct("z")}, ["y", "s.z"])
    assert found.columns == ["id", "y", "z", "s"] and [tuple(r)[:3] for r in found.collect()] == [(1, 5.0, "a")]


def test_outcomes_with_and_without_signs(spark):
    texts = {"85.5": 85.5, " 85.5 ": 85.5, ".5": 50.0, "1.2.3": None, ".": None, "0": None, "101": None, "": None,
             "85 ± 2": 85.0, "85 (n=3) ± 2": 85.0, "85± (SD)": 85.0, "(n = 3)": None, "(mean) 85": 85.0,
             "70-80 (SEM 2)": 75.0, "80-70": 80.0, ">90": 90.0, "0.85": 85.0, "7 to 9": 8.0}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", clean_outcome(F.col("t"))).collect()} == texts
    parts = spark.createDataFrame([(" 50/10-38,5;1|2:3 ",), ("n.r.",), (None,)], "t string")
    assert [r[0] for r in parts.select(ratio_numbers(F.col("t"))).collect()] == [[50, 10, 38, 5, 1, 2, 3], [None], None]
