"""SimHash links and components against brute force."""

import random

import numpy as np
import xxhash

from formulake.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance=3):
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= distance:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in values}


def grouped(rows):
    out = {}
    for key, value in rows:
        out.setdefault(value, set()).add(key)
    return sorted(map(sorted, out.values()))


def test_fingerprint_is_the_majority_of_shingle_hashes():
    texts = [None, "", " \t\n", "One", "one two", "A b\x0bc d", "Ä b c d e f a b c", "x " * 40]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(50)]
    for text in texts:
        assert S.fingerprint(text) == brute_fingerprint(text), text
    assert S.fingerprint("word " * 200_000) == brute_fingerprint("word " * 5)


def near_values(n, seed):
    """Values in tight and loose groups, chains among them, and values apart."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(12)]
    out = set()
    for _ in range(n):
        value = rng.choice(bases)
        for _ in range(rng.randint(0, 6)):
            value ^= 1 << rng.randrange(64)
        out.add(value)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


def test_links_join_what_brute_force_joins(spark):
    values = near_values(500, 3)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = brute_components(values)
    for block in (4096, 7):  # the second cuts every crowded key into blocks
        pairs = S.linked_pairs(nodes, block=block).collect()
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
        found = S.components(S.linked_pairs(nodes, block=block), "test").collect()
        named = {v: v for v in signed} | {r.node: r.root for r in found}
        unsigned = [(k % 2**64, v) for k, v in named.items()]
        assert grouped(unsigned) == grouped(want.items())


def test_every_allocation_is_exact():
    values = np.array(near_values(200, 5), np.uint64)
    near = {(a, b) for i, a in enumerate(values.tolist()) for b in values[i + 1:].tolist()
            if bin(a ^ b).count("1") <= 3}
    for parts in range(2, 7):
        groups = S.grouped_bits(values, parts)
        assert sorted(sum(groups, [])) == list(range(64))
        costs = [{t: float(t == 1) + p * 0.1 for t in range(-1, 3)} for p in range(parts)]
        _, picked = S.allocate(costs, 3 - parts + 1)
        assert sum(picked) == 3 - parts + 1
        for a, b in near:
            x = [bin(int(S.part_values(np.array([a ^ b], np.uint64), g)[0])).count("1") for g in groups]
            assert any(d <= t for d, t in zip(x, picked))


def test_components_of_documents(spark, docs_of):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(80)) for _ in range(6)]
    rows = [(100 + i, base[i % 6]) for i in range(30)]
    rows += [(i, base[i % 6] + " tail") for i in range(6)]
    rows += [(50, None), (51, ""), (52, "  "), (None, base[0]), (60, "lone words here"), (60, "lone words here")]
    got = S.component_ids(docs_of(rows)).collect()
    assert len(got) == len(rows)
    prints = {(r, t): brute_fingerprint(t) for r, t in rows}
    roots = brute_components(prints.values())
    least = {}
    for (doc, _), value in prints.items():
        if doc is not None:
            least[roots[value]] = min(doc, least.get(roots[value], doc))
    want = sorted((d or -1, f"{v:016x}", least[roots[v]]) for (d, t), v in prints.items())
    assert sorted({(r.doc_id or -1, r.fingerprint, r.component_id) for r in got}) == sorted(set(want))


def test_keep_one_leaves_one_row_of_each_group(spark, docs_of):
    text = "one two three four five six seven eight nine ten"
    table = docs_of([(3, text), (2, text), (2, text), (None, text), (9, "other words stand here alone"), (8, None)])
    kept = S.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 8, 9]
    assert S.keep_one(table.limit(0)).count() == 0
    assert S.component_ids(table.limit(0)).count() == 0
