"""Language-model scores from a log-frequency Bloom filter of word pairs.

Documents are read in chunks, and a chunk is what one task holds: its documents as word numbers,
packed, and the hashes of its distinct words, the usual ones first. Chunks are written once to
the shared folder; whatever follows reads them and never the texts again. Each chunk gives its
distinct words and the distinct pairs of neighbours in its training rows, both counted and packed
by segments of their hash. Segments are summed over all chunks:

* Words: a segment answers every chunk with the training counts of the chunk's own words, so the
  base score needs no table of all words anywhere. Words are told apart by a 64-bit hash.
* Pairs: a segment becomes its part of the filter. A count ``c`` is quantised to
  ``q = 1 + floor(log_B c)`` and the pair is entered once under each of the levels 1 to q. A pair
  is asked for at level 1, 2, ... until a level is missing; the last one found gives the smallest
  count of its level. False answers only raise a level: a pair that was never seen passes level 1
  with the filter's error rate, which ``BITS_PER_ENTRY`` keeps near one in a hundred. Pairs of a
  segment are told apart by 40 bits, which adds less than that.

The parts are broadcast to the workers. The filter grows with the number of pairs, so one
broadcast is limited to ``MOST_BYTES``; a larger filter is sent and asked in slices of that size,
each slice giving the sums of the pairs that it holds, which changes no score.

The model: words are drawn given the word before (the first one given a start, counted once for
each training row) with ``p(w | h) = (k(h, w) + M p(w)) / (c(h) + M)``, where ``k`` comes from the
filter (at most ``c(h)``), ``c`` is exact, and ``p(w)`` is the base probability. Since k never
exceeds the true count, except for false answers, these sum to at most one over all words.
Contract: only A-Z are lower-cased, words are runs of anything but blanks, an end is counted as a
token after the last word.

A null text counts as empty: its only token is the end. A null id is a training row. Repeated
rows count as often as they are there. An empty table gives an empty result. Without training
rows N is 0 and every word has the base probability ``0.1 / 0.1``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formulake.llm.common import held_back, known_text, small_batches
from formulake.session import materialise

FOLDS = 10
ADD = 0.1
LOG_BASE = 1.5
WEIGHT = 200.0  # M: how many seen words the base probability is worth
BITS_PER_ENTRY = 10
PROBES = 5
CHUNK_CHARS = 8 << 20  # text of a chunk, about
SEGMENT_PAIRS = 4 << 20  # pairs that a segment sums up, about
MOST_BYTES = 128 << 20  # of a filter that is broadcast at once; the driver and each worker hold so much
END, START = b"\n", b"\t"  # no word has these
PAIR_BITS = np.uint64((1 << 40) - 1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * MIX[0] + second)


def plane_packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24 or 2^32 by bytes of equal weight, compressed."""
    width = 3 if numbers.max(initial=0) < 1 << 24 else 4
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def plane_unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, n)
    out = np.zeros(n, np.int64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * k)
    return out


def chunk_row(number: int, rows: list[tuple]) -> dict:
    """A chunk: ids, flags and word numbers of its documents, usual words first, and word hashes.

    Number 0 is the end and 1 the start.
    """
    place: dict[bytes, int] = {END: 0, START: 1}
    words = [[place.setdefault(w, len(place)) for w in text.encode().lower().split()] for _, text, _ in rows]
    lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(rows))
    ids = np.fromiter((i for w in words for i in (*w, 0)), np.int64, int(lengths.sum()))
    held = np.array([h for *_, h in rows], bool)
    counts = np.bincount(ids, minlength=len(place))
    counts[:2] = counts.max() + 1  # these two stay in front
    order = np.argsort(-counts, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    names = list(place)
    return {
        "chunk": number, "doc_ids": [i for i, *_ in rows], "held": held.tolist(),
        "lengths": lengths.tolist(), "words": plane_packed(rank[ids]),
        "hashes": np.array([xxhash.xxh3_64_intdigest(names[k]) for k in order], np.uint64).tobytes(),
    }


CHUNK = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.string())), ("held", pa.list_(pa.bool_())),
    ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("hashes", pa.binary()),
])
CHUNK_SQL = (
    "chunk bigint, doc_ids array<string>, held array<boolean>, lengths array<bigint>, words binary, hashes binary"
)


def chunks_of(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Packs documents into chunks of about this many characters, inside a partition."""
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            rows.append(row)
            size += len(row[1]) + 16
            if size >= chars:
                yield pa.RecordBatch.from_pylist([chunk_row(number, rows)], CHUNK)
                number, rows, size = number + 1, [], 0
    if rows:
        yield pa.RecordBatch.from_pylist([chunk_row(number, rows)], CHUNK)


class Chunk:
    """A chunk unpacked: the word of every token, and the word before it."""

    def __init__(self, row: dict):
        self.number, self.doc_ids = row["chunk"], row["doc_ids"]
        self.held = np.array(row["held"], bool)
        self.lengths = np.array(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ids = plane_unpacked(row["words"], int(self.lengths.sum()))
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.before = np.empty_like(self.ids)
        self.before[1:] = self.ids[:-1]
        self.before[self.starts] = 1

    def pairs(self, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as one number each, where each token's pair is, and how often each comes."""
        coded = self.before * len(self.hashes) + self.ids
        if rows is not None:
            coded = coded[np.repeat(rows, self.lengths)]
        return np.unique(coded, return_inverse=True, return_counts=True)

    def pair_hashes(self, coded: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        return pair_hash(self.hashes[coded // n], self.hashes[coded % n])

    def train_counts(self) -> np.ndarray:
        """How often each word comes in training rows; the start comes once in each."""
        train = ~self.held
        out = np.bincount(self.ids[np.repeat(train, self.lengths)], minlength=len(self.hashes))
        out[1] = train.sum()
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts)


def segments_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Segment by the upper bits of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def segment_ends(sorted_hashes: np.ndarray, segments: int) -> np.ndarray:
    return np.searchsorted(segments_of(sorted_hashes, segments), np.arange(segments + 1))


def packed_counts(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest takes, compressed."""
    most = int(counts.max(initial=0))
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64
    return np.dtype(kind).char.encode() + zstandard.ZstdCompressor(level=1).compress(counts.astype(kind).tobytes())


def unpacked_counts(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.frombuffer(raw, np.dtype(data[:1].decode())).astype(np.int64)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


PART = pa.schema([("segment", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
PART_SQL = "segment int, chunk bigint, hashes binary, counts binary"


def word_parts(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """The distinct words of each chunk with their training counts, by segment."""
    for row in rows_of(batches):
        chunk = Chunk(row)
        order = np.argsort(chunk.hashes)
        hashes, counts = chunk.hashes[order], chunk.train_counts()[order]
        ends = segment_ends(hashes, segments)
        yield pa.RecordBatch.from_pylist([
            {"segment": k, "chunk": chunk.number, "hashes": hashes[a:b].tobytes(), "counts": packed_counts(counts[a:b])}
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
        ], PART)


def pair_parts(batches: Iterator[pa.RecordBatch], segments: int) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each chunk's training rows, by segment, their hashes in 40 bits."""
    for row in rows_of(batches):
        chunk = Chunk(row)
        coded, _, counts = chunk.pairs(~chunk.held)
        hashes = chunk.pair_hashes(coded)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        ends = segment_ends(hashes, segments)
        low = np.ascontiguousarray((hashes & PAIR_BITS).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
        yield pa.RecordBatch.from_pylist([
            {"segment": k, "chunk": chunk.number, "hashes": low[a:b].tobytes(), "counts": packed_counts(counts[a:b])}
            for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b
        ], PART)


def low_hashes(data: list[bytes]) -> np.ndarray:
    low = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 5)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :5] = low
    return out.view("<u8").reshape(-1)


def answer_words(frame: pd.DataFrame) -> pd.DataFrame:
    """Training counts over all chunks, sent back to each chunk of the segment, and their totals."""
    hashes = np.frombuffer(b"".join(frame["hashes"]), np.uint64)
    counts = np.concatenate([unpacked_counts(c) for c in frame["counts"]])
    known, place = np.unique(hashes, return_inverse=True)
    totals = np.bincount(place, counts, len(known)).astype(np.int64)
    real = known != np.uint64(xxhash.xxh3_64_intdigest(START))
    segment, at, out = int(frame["segment"].iloc[0]), 0, []
    for chunk, own in zip(frame["chunk"], frame["hashes"]):
        n = len(own) // 8
        out.append((int(chunk), segment, packed_counts(totals[place[at : at + n]]), 0, 0))
        at += n
    out.append((-1, segment, b"", int(totals[real].sum()), int((totals[real] > 0).sum())))
    return pd.DataFrame(out, columns=["chunk", "segment", "counts", "tokens", "distinct"])


# -- the filter ------------------------------------------------------------------------------


def level_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count: how many powers of the base it reaches."""
    level = np.floor(np.log(np.maximum(counts, 1)) / np.log(LOG_BASE)).astype(np.int64)
    level += LOG_BASE ** (level + 1.0) <= counts  # a rounded logarithm can be one off
    level -= LOG_BASE ** level.astype(float) > counts
    return level + 1


def count_of(level: np.ndarray) -> np.ndarray:
    """The smallest whole count of a level; none for level 0."""
    return np.where(level > 0, np.ceil(LOG_BASE ** (level - 1.0) - 1e-9), 0).astype(np.int64)


def places(hashes: np.ndarray, level: int, bits: np.ndarray | int, probes: int = PROBES) -> Iterator[np.ndarray]:
    """Bits of an entry inside its segment, one array for each probe."""
    one = mixed(hashes + np.uint64(level * int(MIX[0]) % 2**64))
    two = mixed(one + MIX[2]) | np.uint64(1)
    for k in range(probes):
        value = (one + np.uint64(k) * two) >> np.uint64(32)
        yield (value * np.asarray(bits).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def segment_filter(
    hashes: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY, probes: int = PROBES
) -> bytes:
    """Bits of a segment for pairs with these counts."""
    level = level_of(counts)
    bits = max(64, -(-int(level.sum()) * bits_per_entry // 8) * 8)
    out = np.zeros(bits, bool)
    for at in range(1, int(level.max(initial=0)) + 1):
        for place in places(hashes[level >= at], at, bits, probes):
            out[place] = True
    return np.packbits(out, bitorder="little").tobytes()


def build_filter(frame: pd.DataFrame, bits_per_entry: int, probes: int) -> pd.DataFrame:
    counts = np.concatenate([unpacked_counts(c) for c in frame["counts"]])
    known, place = np.unique(low_hashes(list(frame["hashes"])), return_inverse=True)
    sums = np.bincount(place, counts, len(known)).astype(np.int64)
    bits = segment_filter(known, sums, bits_per_entry, probes)
    return pd.DataFrame([(int(frame["segment"].iloc[0]), bits)], columns=["segment", "bits"])


class Filter:
    """Some segments of the filter, side by side.

    With ``sizes`` (bytes of each segment) the parts may come one after the other, and none is held twice.
    """

    def __init__(self, parts: dict[int, bytes] | Iterable[tuple[int, bytes]], segments: int, probes: int = PROBES,
                 sizes: dict[int, int] | None = None):
        self.segments, self.probes = segments, probes
        self.first = np.full(segments, -1, np.int64)
        self.bits = np.ones(segments, np.int64)
        sizes = {k: len(own) for k, own in parts.items()} if sizes is None else sizes
        at = 0
        for k in sorted(sizes):
            self.first[k], self.bits[k] = at * 8, sizes[k] * 8
            at += sizes[k]
        self.bytes = np.empty(at, np.uint8)
        for k, own in parts.items() if isinstance(parts, dict) else parts:
            start = self.first[k] // 8
            self.bytes[start : start + sizes[k]] = np.frombuffer(own, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return self.first[segments_of(hashes, self.segments)] >= 0

    def has(self, hashes: np.ndarray, level: int) -> np.ndarray:
        segment = segments_of(hashes, self.segments)
        first, bits = self.first[segment], self.bits[segment]
        out = np.ones(len(hashes), bool)
        at = np.arange(len(hashes))
        for place in places(hashes & PAIR_BITS, level, bits, self.probes):
            bit = first[at] + place[at]
            found = (self.bytes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            out[at[found == 0]] = False
            at = at[found == 1]
            if not len(at):
                break
        return out

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Quantised counts, by asking level after level while the answer is yes."""
        level = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.holds(hashes))  # all of these have the same level throughout
        while len(at):
            asked = int(level[at[0]]) + 1
            at = at[self.has(hashes[at], asked)]
            level[at] = asked
        return count_of(level)


def score_chunk(
    row: dict, answers: pd.DataFrame, found: Filter, tokens_total: int, distinct: int, first: bool
) -> pd.DataFrame:
    """Base and model scores of a chunk's documents, for the pairs that this filter holds.

    ``first``: whether this is the slice that also gives what doesn't depend on pairs.
    """
    chunk = Chunk(row)
    counts = np.zeros(len(chunk.hashes), np.int64)
    answered = answers.sort_values("segment")["counts"]
    counts[np.argsort(chunk.hashes)] = np.concatenate([unpacked_counts(c) for c in answered])
    base = (counts + ADD) / (tokens_total + ADD * (distinct + 1))
    coded, place, _ = chunk.pairs()
    history, word = coded // len(counts), coded % len(counts)
    hashes = chunk.pair_hashes(coded)
    held = found.holds(hashes)
    seen = np.minimum(found.counts(hashes), counts[history])
    chance = (seen + WEIGHT * base[word]) / (counts[history] + WEIGHT)
    n = len(chunk.lengths)
    return pd.DataFrame({
        "chunk": np.full(n, chunk.number), "place": np.arange(n), "row": chunk.doc_ids, "held_out": chunk.held,
        "n_tokens": chunk.lengths, "n_known": chunk.sums((counts[chunk.ids] > 0).astype(np.int64)),
        "base_score": chunk.sums(np.log10(base)[chunk.ids]) * first,
        "score": chunk.sums(np.where(held, np.log10(chance), 0.0)[place]),
    })


# -- Spark -----------------------------------------------------------------------------------

SCORE_SQL = (
    "chunk bigint, place bigint, row string, held_out boolean, n_tokens bigint, n_known bigint, "
    "base_score double, score double"
)


def score_documents(
    df: DataFrame, most_bytes: int = MOST_BYTES, chars: int = CHUNK_CHARS, segment_pairs: int = SEGMENT_PAIRS,
    bits_per_entry: int = BITS_PER_ENTRY, probes: int = PROBES,
) -> DataFrame:
    """The contract's row for every document.

    Of several slices of the filter only one is held at a time: its sums are written before the next is read.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(
        F.col("doc_id").cast("string").alias("doc_id"), known_text().alias("text"),
        held_back("doc_id", FOLDS).alias("held_out"),
    )
    chunks = materialise(docs.mapInArrow(lambda b: chunks_of(b, chars), CHUNK_SQL), "lm-chunks")
    total = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    segments = max(1, -(-total // segment_pairs))
    words = materialise(
        chunks.mapInArrow(lambda b: word_parts(b, segments), PART_SQL).groupBy("segment").applyInPandas(
            answer_words, "chunk bigint, segment int, counts binary, tokens bigint, distinct bigint"
        ), "lm-words",
    )
    sums = words.where("chunk < 0").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens_total, distinct = int(sums[0] or 0), int(sums[1] or 0)
    parts = materialise(
        chunks.mapInArrow(lambda b: pair_parts(b, segments), PART_SQL).groupBy("segment").applyInPandas(
            lambda frame: build_filter(frame, bits_per_entry, probes), "segment int, bits binary"
        ), "lm-filter",
    )
    answers = words.where("chunk >= 0").select("chunk", "segment", "counts")
    slices = slices_of(parts, most_bytes)
    scored = None
    for number, own in enumerate(slices):
        rows = parts.where(F.col("segment").isin(list(own))).toLocalIterator()
        sent = spark.sparkContext.broadcast(Filter(((r.segment, r.bits) for r in rows), segments, probes, own))
        part = with_filter(chunks, answers, sent, tokens_total, distinct, number == 0)
        if len(slices) > 1:
            part = materialise(part, "lm-sums")
            sent.destroy()
        scored = part if scored is None else scored.unionByName(part)
    if len(slices) > 1:
        scored = scored.groupBy("chunk", "place", "row", "held_out", "n_tokens", "n_known").agg(
            F.sum("base_score").alias("base_score"), F.sum("score").alias("score")
        )
    return scored.select(
        F.col("row").cast(df.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known",
        F.lit(tokens_total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def slices_of(parts: DataFrame, most_bytes: int) -> list[dict[int, int]]:
    """Segments and their sizes in slices of at most this size, one segment at least; one slice if there is none."""
    out: list[dict[int, int]] = [{}]
    room = most_bytes
    for segment, n in sorted(parts.select("segment", F.octet_length("bits")).collect()):
        if n > room and out[-1]:
            out.append({})
            room = most_bytes
        out[-1][segment] = n
        room -= n
    return out


def with_filter(
    chunks: DataFrame, answers: DataFrame, sent: Broadcast, tokens_total: int, distinct: int, first: bool
) -> DataFrame:
    def score(mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return score_chunk(mine.iloc[0].to_dict(), known, sent.value, tokens_total, distinct, first)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, SCORE_SQL)
