"""Base and model scores against plain counting."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from formulake.llm import ngram_lm as L


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def brute(rows):
    train = [tokens(t) for i, t in rows if not held(i)]
    c, pairs = Counter(w for t in train for w in t), Counter()
    for t in train:
        pairs.update(zip(["\t", *t], t))
    n, v = sum(c.values()), len(c)
    c["\t"] = len(train)

    def base(w):
        return (c[w] + 0.1) / (n + 0.1 * (v + 1))

    def level(x):
        q = 0
        while x and L.LOG_BASE**q <= x:
            q += 1
        return math.ceil(L.LOG_BASE ** (q - 1) - 1e-9) if q else 0

    out = []
    for i, t in rows:
        t = tokens(t)
        score = sum(
            math.log10((min(level(pairs[h, w]), c[h]) + L.WEIGHT * base(w)) / (c[h] + L.WEIGHT))
            for h, w in zip(["\t", *t], t)
        )
        out.append((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), score))
    return sorted(out)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["É", "É", "Ab", "ab"]
    return [(i, rng.choice(" \t\n\x0b").join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(n)]


def test_scores_equal_plain_counts(spark, docs_of):
    few_false = {"bits_per_entry": 40, "probes": 12}  # false answers become too rare to matter
    rows = corpus(300, 1) + [(None, "no id"), (5, None), (5, ""), (7, "w1 w2 w1 w2"), (7, "w1 w2 w1 w2"), (9, "w1 " * 30_000)]
    want = brute(rows)
    for options in ({}, {"chars": 2000, "segment_pairs": 500, "most_bytes": 600}):
        got = L.score_documents(docs_of(rows), **few_false, **options)
        assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        found = sorted((str(r[0]), *r[1:]) for r in got.collect())
        assert [f[:5] for f in found] == [w[:5] for w in want]
        assert np.allclose([f[5] for f in found], [w[5] for w in want], rtol=1e-9)
        near = [abs(f[6] - w[6]) < 1e-6 * abs(w[6]) for f, w in zip(found, want)]
        assert sum(near) >= 0.98 * len(near)
    assert L.score_documents(docs_of(rows).limit(0)).count() == 0


def test_registered_settings_stay_near_plain_counts(spark, docs_of):
    """A false answer raises a pair by one level mostly: few pairs, and never the score of a text by much."""
    rows = corpus(300, 2)
    want = brute(rows)
    found = sorted((str(r[0]), *r[1:]) for r in L.score_documents(docs_of(rows)).collect())
    assert [f[:5] for f in found] == [w[:5] for w in want]
    tokens_in_all = sum(w[2] for w in want)
    gap = np.array([f[6] - w[6] for f, w in zip(found, want)])
    assert (gap >= -1e-9 * 1000).all()  # never below the plain score
    assert gap.sum() < 0.02 * tokens_in_all and gap.max() < 3
    slices = sorted((str(r[0]), *r[1:]) for r in L.score_documents(
        docs_of(rows), chars=2000, segment_pairs=2000, most_bytes=1).collect())
    assert [s[:5] for s in slices] == [w[:5] for w in want]
    assert np.allclose([s[6] for s in slices], [w[6] for w in want], rtol=0.05)


def test_filter_gives_the_count_of_the_level():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    low = np.unique(hashes & L.PAIR_BITS)
    counts = rng.zipf(1.5, len(low)).clip(1, 10**7)
    found = L.Filter({0: L.segment_filter(low, counts)}, 1)
    got = found.counts(low)
    least = L.count_of(L.level_of(counts))
    assert (least <= counts).all() and (L.count_of(L.level_of(counts) + 1) > counts).all()
    assert (got >= least).all() and (got == least).mean() > 0.98
    other = rng.integers(0, 2**40, 20_000).astype(np.uint64)
    assert (found.counts(other) > 0).mean() < 0.03


def test_chances_sum_to_at_most_one():
    counts = np.arange(1, 3000)
    assert (L.count_of(L.level_of(counts)) <= counts).all()
    assert L.level_of(np.array([1, 2, 3])).tolist() == [1, 2, 3]


def test_copies_of_training_text_score_higher(spark):
    from formulake.llm.common import read

    rows = L.score_documents(read(spark, "/root/testdata/sf0.1", "documents")).where("held_out").collect()
    gain = [(r.score - r.base_score) / r.n_tokens for r in rows]
    assert np.mean(gain) > 0
