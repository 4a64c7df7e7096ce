"""Ids against the model's own library, and exact round trips."""

import random

import numpy as np
import sentencepiece

from formulake.llm import pieces as P
from formulake.llm.common import read

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.model_path())


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["the", " ", "  ", "\n", "\t", "ing", "tion", "É", "ñ", "日本", "語", "😀", "\x00", "aaaa", "lll", ".", "123", "▁",
             "Straße", "https://x.y/z?a=b", "   ", "un", "believable", "'s", "​", "é"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + ["", " ", "      ", " " * 40 + "x", "x" + " " * 33, "a", "\n\n", "é" * 50, "ab" * 300, "l" * 77]


def test_ids_equal_the_librarys():
    own = P.Model(P.model_path())
    given = texts(1, 600)
    for text, ids in zip(given, own.encode(given)):
        assert ids.tolist() == LIBRARY.encode(text), repr(text)
        assert own.decode(ids.tolist()) == LIBRARY.decode(ids.tolist())
        assert own.decode(ids.tolist()) == text.replace("▁", " ")
    assert own.encode([None, "", "a"])[0] is None


def test_pairs_are_judged_as_merging_does():
    own = P.model(P.model_path())
    rng = random.Random(2)
    names = [t for t in own.whole if "▁▁" not in t and t != "▁"]
    common = [t for t in names if own.whole[t] < 6000]
    for _ in range(8000):
        a, b = rng.choice(common), rng.choice(common)
        if b.startswith("▁"):
            continue
        assert own.can_follow(own.whole[a], own.whole[b]) == (own.merged(a + b) == [a, b]), (a, b)


def test_words_beyond_the_memory_are_learned_again(monkeypatch):
    monkeypatch.setattr(P, "KNOWN_WORDS", 50)
    monkeypatch.setattr(P, "INDEXED", 100)
    monkeypatch.setattr(P, "LONG_WORD", 60)
    own = P.Model(P.model_path())
    for part in (texts(3, 40), texts(4, 40), ["x" * 500 + "tion " * 50]):
        for text, ids in zip(part, own.encode(part)):
            assert ids.tolist() == LIBRARY.encode(text)


def test_given_documents(spark):
    documents = read(spark, "/root/testdata/sf0.01", "documents")
    rows = P.round_trip(documents).collect()
    by_id = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(by_id)
    for r in rows:
        assert r.ids == LIBRARY.encode(by_id[r.doc_id]) and r.n_ids == len(r.ids) and r.same_text


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (1, ""), (2, "a b"), (2, "a b"), (None, "word " * 50_000), (3, "x" * 100_000)]
    table = docs_of(rows).withColumnRenamed("score", "ids_of")
    got = P.round_trip(table)
    assert got.columns == ["doc_id", "ids", "n_ids", "n_bytes", "same_text"]
    assert all(r.same_text for r in got.collect()) and got.count() == len(rows)
    assert P.encoded(table).columns == [*table.columns, "ids"]
    assert P.round_trip(table.limit(0)).count() == 0
    assert np.array_equal(P.Model(P.model_path()).encode(["x" * 100_000])[0], LIBRARY.encode("x" * 100_000))
