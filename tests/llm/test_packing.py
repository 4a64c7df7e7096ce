"""Best-fit packing against a plain search of all bins."""

import random
from collections import defaultdict

from formulake.llm import packing as P


def brute_pack(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        fits = [
            (b["room"], k) for k, b in enumerate(bins)
            if b["room"] >= size and (source is None or source not in b["s"]) and cluster not in b["c"]
        ]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[k]["room"] -= size
        bins[k]["s"].add(source)
        bins[k]["c"].add(cluster)
        out.append(k)
    return out


def test_the_tightest_compatible_bin_is_taken():
    for seed in range(60):
        rng = random.Random(seed)
        n = rng.randint(0, 120)
        rows = sorted(
            ((rng.randint(1, 63), rng.choice([None, "a", "a", "b", "c"]), rng.randint(0, n // 2 + 1)) for _ in range(n)),
            key=lambda r: (-r[0], str(r[1]), r[2]),
        )
        sizes, sources, clusters = map(list, zip(*rows)) if rows else ([], [], [])
        bins, offsets = P.pack(sizes, sources, clusters, 64)
        assert bins == brute_pack(sizes, sources, clusters, 64)
        used = defaultdict(int)
        for size, b, start in zip(sizes, bins, offsets):
            assert start == used[b]
            used[b] += size


def test_documents_are_packed_whole_and_without_conflicts(spark, docs_of):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(1000 + i, "the same words in many copies") for i in range(60)] + [(1, None), (None, "x y"), (5, "v " * 500)] * 2
    table = docs_of(rows).selectExpr("* except (source)", "case when doc_id % 3 = 0 then 'hot' else cast(doc_id % 7 as string) end as source")
    got = P.packed(table, capacity=64, group=100).collect()
    want = sorted(len((t or "").split()) + 1 for _, t in rows)
    assert sum(r.n_tokens for r in got) == sum(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.start)
        assert sum(r.n_tokens for r in own) == own[0].bin_tokens <= 64
        assert [r.start for r in own] == [sum(x.n_tokens for x in own[:k]) for k in range(len(own))]
        known = [r.source for r in own if r.source is not None]
        assert len(set(known)) == len(known)
        assert len({r.cluster for r in own}) == len(own)
    assert P.packed(table.limit(0)).count() == 0
