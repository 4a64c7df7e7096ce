"""SimHash near-duplicates by the generalised pigeonhole principle.

``fingerprints`` hashes the three-word shingles of whole texts. ``linked_pairs`` finds which
different fingerprints are at most three bits apart:

* Correlated bits are grouped into the same part, so that the parts say different things.
* If two fingerprints differ in at most ``t`` bits then, for any thresholds with
  ``sum(t_i) = t - parts + 1``, some part differs in at most ``t_i`` bits (``t_i = -1`` leaves a
  part out). The number of parts and the thresholds come from dynamic programming over
  estimated candidate counts. The estimate reads a bounded sample; it decides the speed, never
  the links.
* A part with threshold ``t_i`` is probed under every mask of ``t_i`` of its bits: fingerprints
  that agree outside the mask meet under one key, and only they are compared, bit for bit.
* Keys with many fingerprints are cut into blocks that meet in pairs, so no task holds a whole
  key. Each run gives a spanning forest of its links, not its pairs.

Exact copies share a fingerprint and are one node. ``component_ids`` joins the components back
to the documents. A null text counts as empty (fingerprint zero, linked like any other). A null
doc_id takes part but never names a component unless all of its component are null, which then
is null. Repeated rows give repeated rows. Empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake.llm.common import components, known_text, small_batches
from formulake.session import materialise

BITS = 64
DISTANCE = 3
SEED = 42
WIDTH = 3  # words of a shingle
SAMPLE = 20_000  # fingerprints that the estimate reads
BLOCK = 4096  # fingerprints of one key compared at once
ROW_COST, PAIR_COST = 1.0, 0.02  # a probe that is shuffled, a pair that is compared


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle of a text; of the whole text if it is no longer than one."""
    words = (text or "").encode().lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64)


def fingerprint(text: str | None) -> int:
    """Majority bits of XXH64 over the shingles of a text, unsigned; zero without words."""
    hashes = shingle_hashes(text, WIDTH)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """The table with a signed 64-bit fingerprint for each row."""
    small_batches(df.sparkSession)

    @F.pandas_udf("bigint")
    def of(texts):
        import pandas as pd

        values = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return df.withColumn(out, of(known_text(text)))


# -- parts and thresholds --------------------------------------------------------------------


def bit_matrix(sample: np.ndarray) -> np.ndarray:
    return ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of near equal size, correlated ones together."""
    bits = bit_matrix(sample) if len(sample) > 1 else np.zeros((2, BITS))
    bits = bits - bits.mean(axis=0)
    spread = np.sqrt((bits * bits).sum(axis=0))
    spread[spread == 0] = 1
    alike = np.abs((bits / spread).T @ (bits / spread))
    np.fill_diagonal(alike, 0)
    left, out = list(range(BITS)), []
    for size in [len(x) for x in np.array_split(np.arange(BITS), parts)]:
        part = [max(left, key=lambda b: (alike[b, left].max(), -b))]
        left.remove(part[0])
        while len(part) < size:
            nearest = max(left, key=lambda b: (alike[b, part].mean(), -b))
            part.append(nearest)
            left.remove(nearest)
        out.append(sorted(part))
    return out


def part_values(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, threshold: int) -> list[int]:
    """Every set of ``threshold`` bits to leave out; none for a part that is left out."""
    if threshold < 0:
        return []
    return [sum(1 << b for b in picked) for picked in itertools.combinations(range(width), threshold)]


def estimated_cost(sample: np.ndarray, bits: list[int], threshold: int, total: int) -> float:
    """Probes and compared pairs of a part at a threshold, carried from the sample to all."""
    if threshold < 0:
        return 0.0
    values, pairs = part_values(sample, bits), 0.0
    under = masks(len(bits), threshold)
    for mask in under:
        counts = np.unique(values & ~np.uint64(mask), return_counts=True)[1].astype(float)
        pairs += (counts * (counts - 1) / 2).sum()
    grown = (total / max(len(sample), 1)) ** 2
    by_chance = len(under) * total * total / 2 / 2.0 ** (len(bits) - threshold)
    return ROW_COST * total * len(under) + PAIR_COST * max(pairs * grown, by_chance)


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds with this sum and the least total cost, by dynamic programming over parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, picked) in best.items():
            for threshold, own in part.items():
                at = spent + threshold
                if at not in grown or cost + own < grown[at][0]:
                    grown[at] = (cost + own, [*picked, threshold])
        best = grown
    return best.get(budget, (math.inf, []))


def plan_parts(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts and their thresholds: the cheapest over two to six parts."""
    best: tuple[float, list] = (math.inf, [])
    for parts in range(2, 7):
        groups = grouped_bits(sample, parts)
        top = 1 if parts < 4 else 0  # a higher threshold only adds probes to what two parts do
        costs = [
            {t: estimated_cost(sample, bits, t, total) for t in range(-1, top + 1)} for bits in groups
        ]
        cost, picked = allocate(costs, distance - parts + 1)
        if cost < best[0]:
            best = (cost, list(zip(groups, picked)))
    return best[1]


# -- probing ---------------------------------------------------------------------------------


def moved_bits(fp: Column, bits: list[int]) -> Column:
    """The value of a part: its bits side by side, runs of neighbours moved together."""
    out = F.lit(0).cast("bigint")
    for _, run in itertools.groupby(enumerate(bits), key=lambda p: p[1] - p[0]):
        run = list(run)
        place, first, n = run[0][0], run[0][1], len(run)
        piece = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(piece, place))
    return out


def probes(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """A row ``(probe, key, fp)`` for every part and mask."""
    rows, number = [], 0

    def masked(bits: list[int], under: list[int], first: int) -> Column:
        value = moved_bits(F.col("fp"), bits)
        listed = F.array(*[F.lit(m).cast("bigint") for m in under])
        return F.transform(listed, lambda m, i: F.struct(
            (i + first).alias("probe"), value.bitwiseAND(F.bitwise_not(m)).alias("key")))

    for bits, threshold in plan:
        under = masks(len(bits), threshold)
        if under:
            rows.append(masked(bits, under, number))
            number += len(under)
    return nodes.select("fp", F.explode(F.concat(*rows)).alias("p")).select("p.probe", "p.key", "fp")


class Forest:
    """Union-find over fingerprints; ``join`` says whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def run_links(fps: np.ndarray, run: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links between fingerprints of equal run numbers (ascending): a forest, not all pairs.

    Rows are compared with the row ``shift`` places on, for as long as any run is that long.
    """
    forest = Forest()
    at = np.arange(len(fps))
    for shift in range(1, len(fps)):
        at = at[: np.searchsorted(at, len(fps) - shift)]
        at = at[run[at] == run[at + shift]]
        if not len(at):
            return
        near = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
        for a, b in zip(fps[near].view(np.int64).tolist(), fps[near + shift].view(np.int64).tolist()):
            if forest.join(a, b):
                yield a, b


def links_of_sorted(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key come in batches; a run that a batch cuts is carried to the next."""
    rest: list[pa.RecordBatch] = []

    def found(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(c).to_numpy() for c in ("probe", "key", "part")]
        fps = np.ascontiguousarray(table.column("fp").to_numpy()).view(np.uint64)
        new = np.ones(len(fps), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        pairs = np.array(list(run_links(fps, np.cumsum(new), distance)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        key = [batch.column(c)[batch.num_rows - 1].as_py() for c in (0, 1, 2)]
        first = rest[0]
        if [first.column(c)[0].as_py() for c in (0, 1, 2)] == key:
            continue  # one run so far
        table = pa.Table.from_batches(rest)
        same = np.logical_and.reduce([table.column(c).to_numpy() == key[c] for c in (0, 1, 2)])
        cut = int(np.argmax(same))
        yield found(table.slice(0, cut))
        rest = table.slice(cut).to_batches()
    if rest:
        yield found(pa.Table.from_batches(rest))


def linked_pairs(
    nodes: DataFrame, distance: int = DISTANCE, sample_rows: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """Links ``(a, b)`` that join exactly the different fingerprints ``fp`` within the distance.

    ``nodes`` holds each fingerprint once. A key with more than ``block`` fingerprints is cut
    into blocks by hash, and every two blocks of it meet.
    """
    total = nodes.count()
    drawn = nodes.orderBy(F.xxhash64("fp")).limit(sample_rows).toPandas()["fp"]
    sample = drawn.to_numpy(np.int64).view(np.uint64)
    plan = plan_parts(sample, total, distance)
    rows = probes(nodes, plan)
    crowded = (
        rows.groupBy("probe", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select("probe", "key", F.ceil(F.col("n") / block).alias("blocks"))
    )
    rows = rows.join(crowded, ["probe", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    meets = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other),
    )
    part = F.explode(F.coalesce(meets, F.array(F.lit(0).cast("bigint"))))
    spread = rows.select("probe", "key", part.alias("part"), "fp")
    sorted_rows = spread.repartition("probe", "key", "part").sortWithinPartitions("probe", "key", "part", "fp")
    return sorted_rows.mapInArrow(lambda b: links_of_sorted(b, distance), "a bigint, b bigint")


def components_of(hashed: DataFrame) -> DataFrame:
    """``(fp, root)``: the component of every different fingerprint of a table with ``fp``."""
    nodes = materialise(hashed.select("fp").distinct(), "simhash-nodes")
    found = components(linked_pairs(nodes), "simhash")
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def component_ids(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of a documents table."""
    hashed = materialise(fingerprints(df.select("doc_id", "text")).select("doc_id", "fp"), "simhash")
    roots = materialise(components_of(hashed), "simhash-roots")
    first = hashed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    names = roots.join(named, "root").select("fp", "component_id")
    return hashed.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def plain_columns(df: DataFrame) -> list[str]:
    """Columns that Spark can hash."""
    return [f.name for f in df.schema.fields if not any(
        kind in f.dataType.simpleString() for kind in ("map<", "variant", "void"))]


def one_of_each(
    df: DataFrame, named: Callable[[DataFrame], DataFrame], grouped: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """One row of each group, with its columns as they were.

    ``named`` adds ``fp`` to a table, ``grouped`` gives ``(fp, root)`` for a table with ``fp``.

    The row with the smallest doc_id stays (a null id counts as largest); among rows of that id
    the one with the smallest hash of its columns. Identical rows are one.
    """
    columns = plain_columns(df)
    marks = [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *reversed(columns))]
    marked = df.select(F.struct(*marks).alias("mark"), F.struct(*df.columns).alias("row"))
    hashed = materialise(
        named(
            df.select("doc_id", "text", F.struct(*marks).alias("mark"))
        ).select("fp", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark").alias("rank")),
        "simhash",
    )
    roots = grouped(hashed)
    best = hashed.groupBy("fp").agg(F.min("rank").alias("rank"))
    stay = roots.join(best, "fp").groupBy("root").agg(F.min("rank").alias("rank"))
    kept = marked.join(stay.select(F.col("rank.mark").alias("mark")).distinct(), "mark")
    return kept.groupBy("mark").agg(F.first("row").alias("row")).select("row.*")


def keep_one(df: DataFrame) -> DataFrame:
    """One row of each group of linked fingerprints."""
    return one_of_each(df, fingerprints, components_of)
