"""Shards of near equal bytes by histogram sort, in built-in expressions only.

Rows are ordered by a key of 32 hex digits: the hash of the text, then the hash of the row's id.
``splitters`` looks for the keys that cut the bytes into equal shards. Each round counts the
exact bytes below candidate keys, all of them prefixes: first of all rows, then only inside the
prefixes in which a cut still falls, some digits longer each time, until a cut is within the
tolerance. The first sixteen digits are the text's, so equal texts stay together; only a text
that alone holds more than ``CUT`` of a shard may be cut, by the digits of the id. If rows that are
equal in text and id hold that much, the cut falls among them: they are numbered, and a splitter is a
key and the number of its copies that stay before the cut. Then the rows are exchanged once.

Slots: rows of a shard are counted in runs, the prefixes of its keys that hold few rows each
(a text with very many copies is run by its id's digits), so no task sees a whole shard.

A null text has no bytes, size 8 and the checksum of an empty text. A null id is hashed like any
other value. Rows that are equal in id and text are counted once and unfolded at the end, so a
third of all rows may be the same row. Extra columns are left out. Empty tables give empty
results; more shards than rows leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formulake.llm.common import known_text
from formulake.session import materialise

SHARDS = 24
OVERHEAD = 8  # bytes that a row takes besides its text
TOLERANCE = 0.002  # of a shard's bytes
LENGTHS = (3, 6, 9, 12, 16, 19, 22, 25, 28, 32)  # digits of the candidate prefixes by round
TEXT, KEY = 16, 32  # digits of a text's hash, of a whole key
CUT = 0.05  # of a shard's bytes: equal texts that hold more may be cut
RUN = 20_000  # rows of a run, about
UNFOLD = 1 << 16


def hex_of(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key and the number of equal rows; the text is read here alone."""
    text = known_text()
    rows = df.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(hex_of(F.xxhash64(text)), hex_of(F.xxhash64(F.col("doc_id").cast("string")))).alias("key"),
    )
    return rows.groupBy("key", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[str, int]]:
    """For every shard but the first: its first key, and how many copies of that key's rows stay before it."""
    size = F.sum((F.col("size") * F.col("copies")).cast("decimal(38,0)"))
    total = int(rows.agg(size).first()[0] or 0)
    goals = [total * i // shards for i in range(1, shards)]
    slack = total * tolerance / shards
    found: dict[int, tuple[str, int]] = {}
    below = {"": 0}  # exact bytes below each prefix that is looked into
    known = 0
    for length in LENGTHS:
        if not below:
            break
        inside = rows
        if known:
            inside = rows.where(F.substring("key", 1, known).isin(sorted(below)))
        counted = inside.groupBy(F.substring("key", 1, length).alias("prefix")).agg(
            size.alias("bytes"), F.sum("copies").alias("copies"))
        parts = sorted((r["prefix"], int(r["bytes"]), int(r["copies"])) for r in counted.collect())  # 4096 a prefix
        nearer: dict[str, int] = {}
        at, parent = 0, None
        for prefix, own, copies in parts:
            if prefix[:known] != parent:
                parent = prefix[:known]
                at = below[parent]
            for i, goal in enumerate(goals):
                if i in found or not at <= goal < at + own:
                    continue
                before, behind = goal - at, at + own - goal
                whole = length == KEY or length == TEXT and own <= CUT * total / shards
                if length == KEY and copies > 1 and min(before, behind) > slack:
                    found[i] = prefix, min(copies, round(before * copies / own))  # copies of one size
                elif min(before, behind) <= slack or whole:
                    found[i] = (prefix if before <= behind else prefix + "~"), 0  # "~" is behind all digits
                else:
                    nearer[prefix] = at
            at += own
        below, known = nearer, length
    return [found.get(i, ("~", 0)) for i in range(len(goals))]


def with_shards(rows: DataFrame, cuts: list[tuple[str, int]]) -> DataFrame:
    """The rows with their shard; a row whose copies lie in several shards becomes a row for each."""
    first = F.lit(0)
    for cut, copies in cuts:
        first = first + (F.col("key") > cut if copies else F.col("key") >= cut).cast("int")
    inner = [(cut, copies) for cut, copies in cuts if copies]
    if not inner:
        return rows.withColumn("shard", first)
    bounds = F.filter(
        F.array(*[F.when((F.col("key") == cut) & (F.col("copies") > n), F.lit(n).cast("bigint")) for cut, n in inner]),
        lambda n: n.isNotNull())
    rows = rows.withColumn("_b", F.concat(F.array(F.lit(0).cast("bigint")), bounds, F.array("copies")))
    parts = F.transform(F.sequence(F.lit(0), F.size("_b") - 2), lambda k: F.struct(
        (first + k).cast("int").alias("shard"), (F.get("_b", k + 1) - F.get("_b", k)).alias("copies")))
    return rows.withColumn("_p", F.explode(parts)).withColumns({
        "shard": F.col("_p.shard"), "copies": F.col("_p.copies")}).where("copies > 0").drop("_b", "_p")


def with_slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers from 0 inside each shard, ``copies`` of them for each row."""
    total = rows.count()
    digits, runs = 1, 16
    while runs * RUN < total:
        digits, runs = digits + 1, runs * 16
    text = F.substring("key", 1, 16)
    crowded = rows.groupBy(text.alias("text_key")).agg(F.count("*").alias("n")).where(F.col("n") > RUN)
    marked = rows.join(crowded, text == F.col("text_key"), "left")
    run = F.when(F.col("text_key").isNull(), F.substring("key", 1, digits)).otherwise(
        F.concat(text, F.substring("key", 17, digits))
    )
    marked = marked.withColumn("run", run).drop("text_key", "n")
    each = marked.groupBy("shard", "run").agg(F.sum("copies").alias("n"))
    before = W.partitionBy("shard").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    offsets = each.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "run").orderBy("key", "doc_id", "size", "text_crc32")
    first = F.coalesce(F.sum("copies").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = marked.withColumn("first", first).join(offsets, ["shard", "run"])
    return placed.withColumn("first", F.col("first") + F.col("offset")).drop("offset", "run")


def unfolded(rows: DataFrame) -> DataFrame:
    """A row for each copy, its slot counted from ``first``."""
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / UNFOLD)))
    out = rows.withColumn("block", blocks)
    last = F.least(F.col("copies") - F.col("block") * UNFOLD, F.lit(UNFOLD)) - 1
    return out.withColumn("at", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).withColumn(
        "slot", F.col("first") + F.col("block") * UNFOLD + F.col("at")
    )


def shard_documents(df: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row with its shard and slot, under the law ``bytes``."""
    rows = materialise(keyed(df), "shard-keys")
    cuts = splitters(rows, shards, tolerance)
    placed = unfolded(with_slots(with_shards(rows, cuts)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
