"""Approximation files against brute force over all pairs."""

import numpy as np
import pytest

from formulake.llm import vector_search as V
from formulake.llm.queries import QUERIES, SQL
from formulake.plans.compare import connect, differences


def brute(rows, top):
    sound = [
        (i, tuple(int(np.floor(64 * x)) for x in v)) for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in sorted({r for r in sound if r[0] % 20 == 0}):
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in sound if j != i and len(v) == len(q))
        out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("stripe, block", [(32768, (256, 32768)), (17, (3, 5))])
def test_equals_brute_force(spark, monkeypatch, stripe, block):
    monkeypatch.setattr(V, "STRIPE", stripe)
    monkeypatch.setattr(V, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(200)]
    rows += [(300 + i, rows[5][1]) for i in range(40)] + [(20, rows[20][1]), (7, [None] * 6), (8, None)]
    rows += [(9, [float("nan")] * 6), (11, [float("inf")] * 6), (None, [1.0] * 6), (40, [9.0] * 6)]
    rows += [(500 + i, [0.5 * i]) for i in range(5)] + [(600, []), (601, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score int")
    got = rows_of(V.top_k(df))
    single = [r for r in got if r[0] != 40]
    assert single == [r for r in brute(rows, 20) if r[0] != 40]
    assert len([r for r in got if r[0] == 40]) == 40  # two different vectors share the id
    assert V.top_k(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    values = rng.integers(-(2**20), 2**20, (300, 16))
    cells = V.Approximation(values)
    queries = values[:10]
    middle, slack = cells.bounds(queries)
    exact = queries @ values.T
    assert (np.abs(exact - middle) <= slack[:, None]).all()
    assert slack.max() < np.abs(exact).max()
    assert cells.codes.dtype == np.uint8 and cells.codes.nbytes * 8 == values.nbytes and cells.codes.max() < V.CELLS


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    name = "op9_exact_top_k"
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) == []
