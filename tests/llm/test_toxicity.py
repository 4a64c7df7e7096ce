"""The string kernel against brute force, the folded machine against its kernel form, held-out accuracy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from formulake.llm import toxicity as T
from formulake.llm.common import read


def brute_features(symbols):
    out = {}
    padded = list(symbols) + [0] * (T.WINDOW - 1)
    for i in range(len(symbols)):
        for gaps in itertools.combinations(range(1, T.WINDOW), T.ORDER - 1):
            key = 0
            for symbol in [padded[i], *[padded[i + gap] for gap in gaps]]:
                key = key * 32 + symbol
            out[key] = out.get(key, 0.0) + T.DECAY ** (gaps[-1] + 1)
    return out


def test_kernel_counts_gapped_subsequences():
    texts, words = ["you are an idiot", "i d i o t", "", "aaaaa aaaa", "Émile"], ["idiot", "an", "émile"]
    got, own = T.Landmarks(words).kernel(texts), T.Landmarks(words).own()
    norms = T.scales(texts)
    for i, text in enumerate(texts):
        full = brute_features(T.symbols(T.points(text)).tolist())
        for j, word in enumerate(words):
            mark = T.landmark_features(word)
            want = norms[i] * sum(v * mark.get(k, 0.0) for k, v in full.items())
            assert abs(got[i, j] - want) < 1e-5
    assert np.allclose(own, own.T) and np.linalg.eigvalsh(own.astype(float)).min() > -1e-6
    assert got[0, 0] > got[1, 0] > got[3, 0]


def test_folded_weights_equal_the_kernel_expansion():
    texts = ["what an idiot is that", "the thing is here", "such a moron indeed", "and there it is",
             "you idiot moron", "one of the things", "idiot", "there are words"] * 3
    toxic = np.array(["idiot" in t or "moron" in t for t in texts])
    owner = np.arange(len(texts))
    model = T.fit_sentences(texts, owner, toxic)
    words, _ = T.choose_landmarks(texts, owner, toxic)
    values = [model.sentence_values(T.points(t)).max() for t in texts]
    assert min(np.array(values)[toxic]) > max(np.array(values)[~toxic])
    k = T.Landmarks(words).kernel(texts)
    marks = [T.landmark_features(word) for word in words]
    table = np.array([[f.get(n, 0.0) for f in marks] for n in model.numbers.tolist()])
    beta = np.linalg.lstsq(table, model.values.astype(float), rcond=None)[0]
    assert np.allclose(k @ beta + model.offset, values, atol=2e-2)


def test_sentences_cover_the_text_once():
    text = "One. Two! Three?\nFour " + "x" * 500 + ". e.g.this stays"
    starts = T.sentence_starts(T.points(text)).tolist()
    assert starts[0] == 0 and starts == sorted(set(starts)) and starts[-1] < len(text)
    assert [text[a:b] for a, b in zip(starts, starts[1:])][:3] == ["One. ", "Two! ", "Three?\n"]
    assert max(np.diff(starts + [len(text)])) <= T.LONGEST


def test_held_out_accuracy_and_inserted_characters(spark):
    sf_dir = "/root/testdata/sf0.1"
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = T.fit(documents, labels)
    scored = T.with_score(documents.select("doc_id", "text", T.held_back("doc_id", 5).alias("h")), model)
    rows = scored.join(labels, "doc_id").where("h").select("score", "toxic").collect()
    hit = sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) / len(rows)
    caught = [r.score >= 0.5 for r in rows if r.toxic == 1]
    assert hit > 0.96 and sum(caught) / len(caught) > 0.8
    plain, parted, clean = model.scores(["you are an idiot", "you i-d-i-o-t", "the thing is here and there"])
    assert plain > 0.5 and parted > 0.5 and clean < 0.1


def test_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    table = docs_of([(1, "you idiot"), (2, "fine words"), (3, None), (None, ""), (3, "long " * 60_000), (2, "fine words")])
    got = T.scored_documents(table, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert T.scored_documents(table, labels.limit(0)).agg(F.max("score")).first()[0] == 0
    assert T.scored_documents(table.limit(0), labels).count() == 0
    model = T.fit(table, labels.limit(0))
    kept = T.drop_toxic(table, model)
    assert kept.columns == table.columns and kept.count() == 6
