"""Work is spread over all cores and done once, whatever the layout of the input."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from formulake.functions.outcome import clean_outcome
from formulake.operators import models as M
from formulake.operators import scenario as SC
from formulake.operators import trees as T
from formulake.plans import views as P


def test_outcome_casts_no_empty_text(spark):
    rows = spark.createDataFrame([("85.5 (n=3)",), ("70-80",), ("n.d.",), ("none at all",), (None,)], "t string")
    plan = rows.select(clean_outcome(F.col("t")).alias("y"))._jdf.queryExecution().analyzed().toString().lower()
    assert "try_cast(regexp_extract" not in plan
    assert [r[0] for r in rows.select(clean_outcome(F.col("t"))).collect()] == [85.5, 75.0, None, None, None]


def test_one_row_group_is_spread(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("lineitem", "part"):
        spark.read.parquet(f"{source}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = P.form(spark, str(tmp_path))
    assert rows.select(F.input_file_name()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_grid_blocks_are_spread(spark):
    templates = spark.createDataFrame([(f"t{i}", 50.0, 10.0, 38.5, 1.5) for i in range(40)],
                                      "row_id string, ionizable double, helper double, chol double, peg double")
    support = spark.createDataFrame([(c, 1.0, 60.0) for c in SC.COMPONENTS], "component string, lo double, hi double")
    grid = SC.grid_rows(templates, "row_id", support, 3)
    assert grid.select(F.spark_partition_id()).distinct().count() > 4


def test_walk_of_values_that_are_no_numbers():
    nodes = (np.array([0, 0, 0]), np.array([0.5, 0, 0]), np.array([1, -1, -1]), np.array([0.0, 1.0, 2.0]))
    model = T.Model(tuple(a.astype(k) for a, k in zip(nodes, T.KINDS)), 1, 1, False)
    x = np.array([[0.5], [0.6], [np.nan], [-np.inf], [np.inf]], np.float32)
    assert model.leaves(x).tolist() == [[1.0, 2.0, 1.0, 1.0, 2.0]]


@pytest.mark.parametrize("constant", [False, True])
def test_ridge_errors_are_those_of_the_cross_validator(spark, constant):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 4)) * [1, 10, 0.1, 0 if constant else 3] + [0, 5, 1, 2]
    x = np.column_stack([x, x[:, 0] > 0, x[:, 0] <= 0])  # two that sum to one
    y = x[:, 0] * 3 + x[:, 1] + rng.normal(size=240)
    rows = spark.createDataFrame(
        [(float(b), a.tolist(), i % 3) for i, (a, b) in enumerate(zip(x, y))], "y double, x array<double>, inner int")
    rows = rows.select("y", array_to_vector("x").alias("features"), "inner").persist()
    penalties = [1e-5, 0.01, 1.0]
    model = LinearRegression(labelCol="y", elasticNetParam=0.0, solver="normal")
    found = CrossValidator(
        estimator=model, estimatorParamMaps=ParamGridBuilder().addGrid(model.regParam, penalties).build(),
        foldCol="inner", numFolds=3, evaluator=RegressionEvaluator(labelCol="y", metricName="mae")).fit(rows).avgMetrics
    assert np.allclose(M.ridge_errors(rows, penalties, 3), found, rtol=1e-7)
