"""The pipeline's stages against brute force on the small tables."""

from collections import Counter

import pytest

import corpus_pipeline as C
from formulake.llm import simhash as S
from formulake.llm import toxicity as T
from formulake.llm.common import read
from test_near_copies import first_of_groups
from test_rules import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True, scope="module")
def model(spark):
    """One real fit on the small tables, which all stages of this module then share."""
    fitted = T.fit(read(spark, SF, "documents"), read(spark, SF, "labels"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(T, "fit", lambda documents, labels: fitted)
        yield fitted


def test_stages_keep_what_brute_force_keeps(spark, model):
    docs = read(spark, SF, "documents")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "toxicity", "near_dedup", "best_fit_packing"]
    stages = dict(C.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    good = stages["quality_rules"](spark, docs, SF).collect()
    assert {r.doc_id for r in good} == {i for i, r in rows.items() if brute(r.text)[-1]}

    frame = spark.createDataFrame(good, docs.schema)
    clean = stages["toxicity"](spark, frame, SF)
    assert clean.columns == docs.columns
    scores = model.scores([r.text for r in good])
    clean = clean.collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r, s in zip(good, scores) if s < 0.5}

    frame = spark.createDataFrame(clean, docs.schema)
    single = stages["near_dedup"](spark, frame, SF)
    assert single.columns == docs.columns
    single = single.collect()
    assert sorted(r.doc_id for r in single) == first_of_groups({r.doc_id: r.text for r in clean})
    assert all(rows[r.doc_id] == r for r in single)

    packed = stages["best_fit_packing"](spark, spark.createDataFrame(single, docs.schema), SF).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == {r.doc_id: len(r.text.split()) + 1 for r in single}


def test_run_and_odd_rows(spark, docs_of):
    assert C.run(spark, SF).count() > 0
    table = docs_of([(1, None), (None, "x"), (2, "word " * 10_000), (2, "word " * 10_000)])
    for _, stage in C.STAGES:
        for given in (table, table.limit(0)):
            got = stage(spark, given, SF)
            assert got.count() <= given.count() * 10
    assert S.keep_one(table).count() == 3


def test_registered(spark):
    from __spark_entry__ import queries

    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in queries()
