"""Histogram sort against brute force: equal bytes, whole groups, gapless slots."""

import random
import zlib
from collections import defaultdict

from formulake.llm import sharding as S


def check(rows, got, shards, tolerance):
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    slots, size, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return [size[s] for s in range(shards)], homes


def test_bytes_are_near_equal_and_groups_whole(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randint(0, 40) + str(rng.randint(0, 1500))) for i in range(3000)]
    rows += [(None, None), (7, ""), (7, ""), (8, "long " * 2000)]
    got = S.shard_documents(docs_of(rows), 8).collect()
    size, homes = check(rows, got, 8, 0.002)
    assert max(size) - min(size) <= 8 * max(len(t or "") + 8 for _, t in rows[:3000]) + 10_008
    assert sum(len(h) > 1 for h in homes.values()) <= 7


def test_a_text_that_holds_most_rows_is_cut_evenly(spark, docs_of):
    rows = [(i, "the same text") for i in range(2000)] + [(5000 + i, f"text {i}") for i in range(500)]
    rows += [(9000, "one row again and again")] * 300
    size, _ = check(rows, S.shard_documents(docs_of(rows), 6).collect(), 6, 0.002)
    assert max(size) - min(size) < 0.2 * sum(size) / 6 + 300 * 31


def test_few_or_no_rows(spark, docs_of):
    got = S.shard_documents(docs_of([(1, "a"), (2, "b")]), 24).collect()
    check([(1, "a"), (2, "b")], got, 24, 0.002)
    assert S.shard_documents(docs_of([(1, "a")]).limit(0), 24).count() == 0


def test_splitters_find_the_exact_cuts(spark):
    keys = sorted(f"{random.Random(i).getrandbits(128):032x}" for i in range(400))
    rows = spark.createDataFrame([(k, 10, 1) for k in keys], "key string, size bigint, copies bigint")
    cuts = S.splitters(rows, 4, 0.0)
    below = [sum(k < cut for k in keys) for cut, _ in cuts]
    assert below == [100, 200, 300] and all(copies == 0 for _, copies in cuts)


def test_equal_rows_that_hold_most_bytes_are_cut_by_their_copies(spark, docs_of):
    """Rows equal in id and text, also without an id, under the law of equal bytes."""
    for doc in (77, None):
        rows = [(doc, "equal row of some bytes")] * 3000 + [(i, f"text number {i}") for i in range(1500)]
        size, _ = check(rows, S.shard_documents(docs_of(rows), 6).collect(), 6, 0.002)
        assert max(size) - min(size) <= 0.004 * sum(size) / 6 + 2 * 31 and min(size) > 0
    rows = [(1, "one row")] * 50
    size, _ = check(rows, S.shard_documents(docs_of(rows), 24).collect(), 24, 0.002)
    assert max(size) <= 3 * 15 and sum(size) == 50 * 15
