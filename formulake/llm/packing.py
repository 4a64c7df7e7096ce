"""Best-fit packing of documents into training rows, with conflicts.

A bin is one training row of ``CAPACITY`` tokens. Two documents of the same source or of the
same duplicate cluster never share a bin. Documents longer than a bin are cut into full pieces,
which are bins by themselves, and a rest, so no token is dropped.

Pieces are dealt to groups by hash, about ``GROUP`` pieces each, so the copies of one text and
the rows of one source spread over all groups and no group grows with the data. Inside a group
the bins are kept in order of the room left, each with a bitmap of its sources and one of its
clusters. A piece (largest first) looks up the first bin with enough room and goes on to its
successors until a bin has none of the piece's bits; that is the tightest compatible bin. Pieces
of equal size, source and cluster go on from where the last one was put, as the bins before it
cannot have become compatible.

Tokens are words plus one end. A cluster is the lower-cased text with white space evened out.
A null text counts as empty and takes one token; a null source conflicts with no other; a null
id is packed like any other. Repeated rows are copies of each other, so they get bins of their
own. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formulake.llm.common import BLANK, known_text
from formulake.session import materialise

CAPACITY = 2048
GROUP = 8192
BIN_BITS = 24  # bins of a group


def token_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("bigint")


def cluster_of(text: Column) -> Column:
    return F.xxhash64(F.regexp_replace(F.lower(text), BLANK, " "))


def pieces(df: DataFrame, capacity: int) -> DataFrame:
    """doc_id, source, cluster and the tokens of every piece, the rest last."""
    text = known_text()
    rows = df.select(
        "doc_id", "source", token_count(text).alias("tokens"), cluster_of(text).alias("cluster"),
        F.monotonically_increasing_id().alias("row"),
    )
    cut = rows.withColumn("piece", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / capacity))))
    size = F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity))
    return cut.select("row", "doc_id", "source", "cluster", "piece", size.cast("bigint").alias("n_tokens"))


def pack(
    sizes: list[int], sources: list, clusters: list, capacity: int
) -> tuple[list[int], list[int]]:
    """Bin and offset of every piece, pieces in descending order of size.

    Pieces of equal size, source and cluster must be neighbours.
    """
    bit_of_source: dict = {}
    bit_of_cluster: dict = {}
    source_bits = [
        0 if s is None else 1 << bit_of_source.setdefault(s, len(bit_of_source)) for s in sources
    ]
    seen: set = set()
    again = {c for c in clusters if c in seen or seen.add(c)}  # only these can conflict
    cluster_bits = [
        1 << bit_of_cluster.setdefault(c, len(bit_of_cluster)) if c in again else 0 for c in clusters
    ]
    bins: list[int] = []
    offsets: list[int] = []
    room: list[int] = []
    held_sources: list[int] = []
    held_clusters: list[int] = []
    order: list[int] = []  # room and bin in one number, ascending
    mask = (1 << BIN_BITS) - 1
    last: tuple | None = None
    at = 0
    for size, source, cluster in zip(sizes, source_bits, cluster_bits):
        if (size, source, cluster) != last or not (source or cluster):
            at = bisect_left(order, size << BIN_BITS)
            last = (size, source, cluster)
        while at < len(order):
            found = order[at] & mask
            if not (held_sources[found] & source or held_clusters[found] & cluster):
                break
            at += 1
        else:
            found = len(room)
            room.append(capacity)
            held_sources.append(0)
            held_clusters.append(0)
            order.append(capacity << BIN_BITS | found)
            at = len(order) - 1
        del order[at]
        bins.append(found)
        offsets.append(capacity - room[found])
        room[found] -= size
        held_sources[found] |= source
        held_clusters[found] |= cluster
        if room[found]:
            insort(order, room[found] << BIN_BITS | found)
            at += 1  # it went in before what is searched next
    return bins, offsets


def packed(df: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every piece with its bin, its place in the bin and the bin's number of tokens."""
    rows = materialise(pieces(df, capacity), "pieces")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))

    def place(key, frame: pd.DataFrame) -> pd.DataFrame:
        # the row number only settles ties between rows that are equal in all the rest
        frame = frame.sort_values(
            ["n_tokens", "source", "cluster", "doc_id", "piece", "row"],
            ascending=[False] + [True] * 5, ignore_index=True,
        )
        full = frame["n_tokens"] == capacity
        rest = frame[~full]
        sources = [None if pd.isna(s) else s for s in rest["source"]]
        bins, offsets = pack(rest["n_tokens"].tolist(), sources, rest["cluster"].tolist(), capacity)
        first = int(full.sum())
        frame["bin"] = list(range(first)) + [b + first for b in bins]
        frame["start"] = [0] * first + offsets
        frame["bin"] += int(key[0]) << BIN_BITS
        frame["bin_tokens"] = frame.groupby("bin")["n_tokens"].transform("sum")
        return frame[["doc_id", "source", "cluster", "piece", "n_tokens", "bin", "start", "bin_tokens"]]

    schema = (
        "doc_id string, source string, cluster bigint, piece bigint, n_tokens bigint, "
        "bin bigint, start bigint, bin_tokens bigint"
    )
    # ids travel as text: pandas would make doubles of a column with a null
    named = dealt.withColumns({c: F.col(c).cast("string") for c in ("doc_id", "source")})
    out = named.groupBy("group").applyInPandas(place, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))
