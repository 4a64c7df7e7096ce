"""Less is written and exchanged: pairs are counted where a study's rows are, ridge keeps its rows once."""

import threading

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake.operators import models as M
from formulake.operators.joins import pair_agreement

RNG = np.random.default_rng(4)


def table(spark, studies):
    rows = [(studies[i % len(studies)], float(RNG.integers(0, 200)) / 2, float(RNG.integers(0, 30)), f"r{i}") for i in range(900)]
    return spark.createDataFrame(rows + [(studies[1], None, 1.0, None), (studies[2], 1.0, None, None)],
                                 "study string, y double, pred double, row_id string")


@pytest.mark.parametrize("studies", [[f"s{i}" for i in range(40)] + [None], ["a"] * 9 + [f"s{i}" for i in range(31)]])
def test_pairs_equal_plain_counts(spark, studies):
    rows = table(spark, studies)
    got = {r["study"]: (int(r.n_pairs), int(r.n_agree)) for r in pair_agreement(rows, "study", "y", "pred", 5.0).collect()}
    for study, own in rows.dropna(subset=["y", "pred"]).toPandas().groupby("study"):
        gap = own.y.to_numpy()[None, :] - own.y.to_numpy()[:, None] >= 5
        higher = own.pred.to_numpy()[None, :] > own.pred.to_numpy()[:, None]
        assert got[study] == (gap.sum(), (gap & higher).sum())


def test_levels_of_ordinary_studies_are_not_exchanged(spark):
    out = pair_agreement(table(spark, [f"s{i}" for i in range(40)]), "study", "y", "pred", 5.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_level" in line]


def test_a_ridge_fit_keeps_its_rows_once(spark, monkeypatch):
    kept, most, lock = set(), [0], threading.Lock()

    def persist(self, level=StorageLevel.DISK_ONLY, run=DataFrame.persist):
        with lock:
            kept.add(id(self))
            most[0] = max(most[0], len(kept))
        return run(self, level)

    def unpersist(self, blocking=False, run=DataFrame.unpersist):
        with lock:
            kept.discard(id(self))
        return run(self, blocking)

    own = type(spark.range(1))
    monkeypatch.setattr(own, "persist", lambda self, level=StorageLevel.DISK_ONLY, run=own.persist: persist(self, level, run))
    monkeypatch.setattr(own, "unpersist", lambda self, blocking=False, run=own.unpersist: unpersist(self, blocking, run))
    rows = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 40).alias("study"), (F.col("id") % 17).cast("double").alias("v"),
                                   (F.col("id") % 23).cast("double").alias("y"))
    folded = M.attach_folds(rows, "study", 5)
    found = M.oof_predictions(folded, M.Trainer(["v"], [], M.ridge_members([0.1, 1.0])), 5)
    assert found.count() == 400 and most[0] <= 2
