import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from formulake.llm import resampling as R
from formulake.llm.common import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def naive_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    spans = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(s.encode()) % R.BUCKETS for s in spans]


def naive(rows, target):
    own = {i: naive_features(t) for i, (_, t) in enumerate(rows)}
    s, t = np.zeros(R.BUCKETS, int), np.zeros(R.BUCKETS, int)
    for _, found in own.values():
        np.add.at(s, found, 1)
    for text in target:
        np.add.at(t, naive_features(text)[1], 1)
    gain = [math.floor(1000 * math.log(float((b + 1) * (s.sum() + R.BUCKETS)) / float((a + 1) * (t.sum() + R.BUCKETS))))
            for a, b in zip(s.tolist(), t.tolist())]
    out, able = [], []
    for i, (doc, _) in enumerate(rows):
        words, found = own[i]
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None])
        if words >= 20:
            able.append((-score, doc is None, doc or 0, i))
    for place, (*_, i) in enumerate(sorted(able)[: 5 * len(able) // 100], 1):
        out[i][4] = place
    return sorted(map(tuple, out), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=400), min_size=1, max_size=30))
def test_crcs_of_spans(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert R.span_crcs(data, starts, ends).tolist() == [zlib.crc32(p) for p in parts]


def test_crc_of_long_and_overlapping_spans(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 100_000).astype(np.uint8)
    starts = np.array([0, 5, 63, 64, 65, 99_999, 1, 10, 0])
    ends = np.array([100_000, 69, 64, 128, 130, 100_000, 90_000, 11, 64])
    whole = data.tobytes()
    expected = [zlib.crc32(whole[a:b]) for a, b in zip(starts, ends)]
    assert R.span_crcs(data, starts, ends).tolist() == expected
    monkeypatch.setattr(R, "SLICE", 70)
    assert R.span_crcs(data, starts, ends).tolist() == expected


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBZz09 .-_\n\x00\x7fé中ÄÖ𝔸", max_size=40)), max_size=8))
def test_features_of_any_texts(texts):
    words = R.Words(texts)
    found = [[] for _ in texts]
    for crcs, owner in words.features(3):
        for c, o in zip(crcs.tolist(), owner.tolist()):
            found[o].append(c % R.BUCKETS)
    expected = [naive_features(t) for t in texts]
    assert words.counts.tolist() == [n for n, _ in expected]
    assert [sorted(f) for f in found] == [sorted(f) for _, f in expected]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_rows(spark, docs_of):
    long = "Wort " * 30_000 + "x" * 70_000
    some = " ".join(f"w{i % 37}" for i in range(300))
    rows = [(1, None), (2, ""), (3, "!!"), (4, long), (5, some), (5, some), (None, some), (None, some), (7, "Ärger ÄRGER a")]
    rows += [(100 + i, f"{some} tail{i % 5}") for i in range(60)] + [(200 + i, "just a few words") for i in range(30)]
    target = [("a", "w1 w2 w3 Wort"), ("b", None), ("c", "tail3 tail3")]
    wanted = spark.createDataFrame(target, "item_id string, text string")
    expected = naive(rows, [t for _, t in target])
    assert got(R.resampled(docs_of(rows), wanted)) == expected
    assert got(R.resampled(docs_of(rows).repartition(7), wanted)) == expected
    assert got(R.resampled(docs_of(rows), wanted.limit(0))) == naive(rows, [])
    assert got(R.resampled(docs_of([]), wanted)) == []


def test_given_table_against_brute_force(spark, sf_dir):
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    expected = naive([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got(R.resampled(docs, target)) == expected
    assert any(r[4] for r in expected)


def test_drawn_rows_keep_their_columns(spark, sf_dir):
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    picked = R.draw(docs.withColumn("rank", docs["doc_id"]), target, percent=20)
    assert picked.columns == [*docs.columns, "rank"]
    ranks = R.resampled(docs, target, percent=20).where("rank is not null")
    assert sorted(r.doc_id for r in picked.collect()) == sorted(r.doc_id for r in ranks.collect())
