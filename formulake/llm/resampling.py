"""Documents drawn by importance for a target distribution, with hashed n-gram features.

Features of a text are all runs of one to three neighbouring words, each in a bucket by the CRC-32
of its bytes. The bucket counts of all raw texts and of all target texts give every bucket a gain,
a document weighs the sum of its features' gains, and the documents with the highest sums of weight
and Gumbel noise are drawn: a sample without replacement in proportion to importance.

The CRC of many spans is found at once. CRC-32 is linear over XOR but for a constant that depends
on the length alone, so a byte adds a fixed word that depends on its value and its distance from
the end of the span (``POSITION``). The words of all spans stand side by side and
``bitwise_xor.reduceat`` folds each span. A span longer than ``BLOCK`` is cut into blocks from its
end; each block is folded by itself, and the blocks are folded one behind the other, the words so
far being carried over ``BLOCK`` bytes by ``ADVANCE``.

Texts are read twice: once for the bucket counts (each task sums its own and sends as many numbers
as there are buckets), once for the weights. Only the gains, a number for each bucket, go to the
workers. Ranks come from one exchange by range: ranges are numbered by themselves and shifted by
the rows of the ranges before.

Rows: a null text has no words and so no features, its weight is 0. Only A-Z are lower-cased; words
are runs of ASCII letters, digits and anything above ASCII. A null id is written as an empty text in
the noise and stands last among equal scores. Equal rows get equal scores and different ranks. With
an empty target the gains come from the raw counts alone; an empty raw table gives an empty result.
Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formulake.llm.common import known_text, small_batches
from formulake.session import materialise

BUCKETS = 10_000
ORDERS = 3  # words of the longest feature
LEAST_WORDS = 20  # of a document that can be drawn
PERCENT = 5  # of those documents that are drawn
SEED = 42
BLOCK = 64  # bytes with words of their own in POSITION
SLICE = 1 << 17  # bytes of spans that are folded at once, about
POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
SPACE = 32

#: Bytes of words as they are compared, all others as a space.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)
)


def step_table() -> np.ndarray:
    """What a register of one byte becomes after eight steps of the polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


STEP = step_table()


def over_zero(register: np.ndarray) -> np.ndarray:
    """The register after one more zero byte."""
    return (register >> np.uint32(8)) ^ STEP[register & np.uint32(255)]


def tables(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words by distance and byte, start registers by length, and the carry over a whole block."""
    position = np.empty((block, 256), np.uint32)
    start = np.empty(block + 1, np.uint32)
    position[0], start[0] = STEP, ONES
    carry = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for k in range(block):
        if k:
            position[k] = over_zero(position[k - 1])
        start[k + 1 : k + 2] = over_zero(start[k : k + 1])
        carry = over_zero(carry)
    return position, start, carry


POSITION, START, ADVANCE = tables(BLOCK)
FLAT = POSITION.reshape(-1)


def advance(register: np.ndarray) -> np.ndarray:
    """The register after ``BLOCK`` zero bytes."""
    out = ADVANCE[0][register & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ ADVANCE[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def fold(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR of the position words of each span; none of them is empty or longer than a block."""
    behind = np.cumsum(lengths)
    at = np.arange(int(behind[-1]), dtype=np.int64)
    distance = np.repeat(behind - 1, lengths) - at
    index = np.repeat(ends - 1, lengths) - distance
    words = FLAT[distance * 256 + data[index]]
    return np.bitwise_xor.reduceat(words, behind - lengths)


def block_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of some spans, none of them empty."""
    lengths = ends - starts
    if lengths.max() <= BLOCK:
        return START[lengths] ^ fold(data, ends, lengths) ^ ONES
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    order = np.arange(int(blocks.sum())) - np.repeat(first, blocks)  # of a block in its span, from 0
    stops = np.repeat(ends, blocks) - (np.repeat(blocks, blocks) - 1 - order) * BLOCK
    own = np.where(order == 0, np.repeat(lengths - (blocks - 1) * BLOCK, blocks), BLOCK)
    folded = fold(data, stops, own)
    register = START[own[first]] ^ folded[first]
    for k in range(1, int(blocks.max())):
        more = np.flatnonzero(blocks > k)
        register[more] = advance(register[more]) ^ folded[first[more] + k]
    return register ^ ONES


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span ``data[start:end]``, slice by slice; none of them is empty."""
    out = np.empty(len(starts), np.uint32)
    size = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE, "right")))
        out[at:stop] = block_crcs(data, starts[at:stop], ends[at:stop])
        at = stop
    return out


class Words:
    """The words of some texts, each followed by one space, and the words of each text."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass").translate(FOLDED) + b" " for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        inside = data != SPACE
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        behind = np.cumsum([len(r) for r in raw])
        ranks = np.searchsorted(np.flatnonzero(last), behind)
        self.counts = np.diff(ranks, prepend=0)
        kept = inside
        kept[1:] |= last[:-1]
        self.data = data[kept]
        self.ends = np.flatnonzero(self.data == SPACE)
        self.starts = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else self.ends
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def features(self, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each number of words: the CRCs of all features and the text of each."""
        for k in range(1, orders + 1):
            n = len(self.starts) - k + 1
            if n <= 0:
                return
            first = np.flatnonzero(self.owner[:n] == self.owner[k - 1 :])
            if len(first):
                yield span_crcs(self.data, self.starts[first], self.ends[first + k - 1]), self.owner[first]


def bucket_sums(batches: Iterator[pa.RecordBatch], buckets: int, orders: int) -> Iterator[pa.RecordBatch]:
    """How many features of a task's texts fall into each bucket."""
    counts = np.zeros(buckets, np.int64)
    for batch in batches:
        for crcs, _ in Words(batch.column(0).to_pylist()).features(orders):
            counts += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, buckets: int, orders: int) -> np.ndarray:
    """Features of all texts by bucket: as many numbers as buckets, whatever the input."""
    small_batches(texts.sparkSession)
    sums = texts.mapInArrow(lambda b: bucket_sums(b, buckets, orders), "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the target's smoothed share of a bucket over the raw one's."""
    s, t, n = raw.astype(float), target.astype(float), float(len(raw))
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray, orders: int) -> Iterator[pa.RecordBatch]:
    """``(doc_id, n_words, n_features, weight)`` of every document."""
    buckets = np.uint32(len(gain))
    for batch in batches:
        words = Words(batch.column(1).to_pylist())
        n = np.zeros(batch.num_rows, np.int64)
        weight = np.zeros(batch.num_rows, np.int64)
        for crcs, owner in words.features(orders):
            sums = np.concatenate(([0], np.cumsum(gain[crcs % buckets])))
            counts = np.bincount(owner, minlength=batch.num_rows)
            stop = np.cumsum(counts)
            n += counts
            weight += sums[stop] - sums[stop - counts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(words.counts), pa.array(n), pa.array(weight)],
            ["doc_id", "n_words", "n_features", "weight"])


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """All rows numbered from 1 in this order: ranges side by side, none of them a whole table."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    sizes = sorted(dealt.groupBy("_range").count().collect())  # a number for each partition
    before, shift = 0, []
    for part, n in sizes:
        shift.append((part, before))
        before += n
    shifts = dealt.sparkSession.createDataFrame(shift, "_range int, _before bigint")
    inside = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    numbered = dealt.withColumn(rank, inside.cast("bigint"))
    return numbered.join(F.broadcast(shifts), "_range").withColumn(rank, F.col(rank) + F.col("_before")).drop(
        "_range", "_before")


def resampled(
    raw: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, orders: int = ORDERS, seed: int = SEED,
) -> DataFrame:
    """Every document of ``raw`` (doc_id, text) with its weight, score and, if drawn, its rank.

    ``target`` has the texts whose distribution is aimed at.
    """
    spark = raw.sparkSession
    small_batches(spark)
    gain = gains(
        bucket_counts(raw.select(known_text()), buckets, orders),
        bucket_counts(target.select(known_text()), buckets, orders))
    id_type = raw.schema["doc_id"].dataType.simpleString()
    weighed = raw.select("doc_id", known_text().alias("text")).mapInArrow(
        lambda b: weigh(b, gain, orders),
        f"doc_id {id_type}, n_words bigint, n_features bigint, weight bigint")
    able = F.col("n_words") >= least_words
    scored = materialise(weighed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"),
        able.alias("able"), F.monotonically_increasing_id().alias("row")), "weighed")
    drawn = scored.where("able").count() * percent // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))  # those that can't be drawn stand behind all others
    return ranked(scored, order, "rank").select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def draw(raw: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``raw`` with all their columns; ids have to be unique."""
    picked = resampled(raw.select("doc_id", "text"), target, **options).where("rank is not null")
    return raw.join(picked.select("doc_id"), "doc_id", "left_semi").select(*raw.columns)
