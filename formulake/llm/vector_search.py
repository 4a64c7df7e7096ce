"""Exact top-k by inner product over vector-approximation files.

Candidates are dealt to stripes and queries to blocks, both by hash and of bounded size; every
block meets every stripe, so a task sees one block and one stripe. In a stripe each component is
quantised to a cell of a grid over the stripe's own range; the approximation file holds one byte, the
cell's number, for each component. A scan of the file bounds every inner product from above and below: a
query has a table of its products with the centres of all cells, and a candidate's bound is the sum of the
entries that its bytes name. The exact vectors are then read in the order of the upper
bounds, until the k-th exact score is above every bound that is left (ties are read, so that they
can be settled by id). The k best of every stripe are merged by rank.

Components become ``floor(64 * x)`` first and scores are 64-bit integers. Vectors that are null
or hold a null or a value that isn't finite take no part, nor do rows without an id. A query
isn't compared with rows of its own id; queries that are equal in id and vector are one. Only
vectors of equal length are compared; vectors of length zero score 0. Equal vectors under
different ids are all candidates, ties go to the smaller id. With fewer than k candidates all
are returned. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from formulake.session import materialise

SCALE = 64
TOP = 20
EVERY = 20  # a row whose id this divides is a query
CELLS = 32  # of a component
STRIPE = 32768  # candidates that meet a block at once, at most
BLOCK = (256, 32768)  # queries, at least and at most
TASKS = 16  # meetings to aim at before blocks grow
AT_ONCE = 64  # queries whose bounds are held at once


def whole_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and the integer vector ``v`` of every row that takes part."""
    sound = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
        & (F.abs(x.cast("double")) < float("inf"))
    )
    whole = F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("bigint"))
    rows = df.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), whole.alias("v"))


class Approximation:
    """The approximation file of a stripe: the cell of every component, a byte each, component by component."""

    def __init__(self, values: np.ndarray):
        low, high = values.min(axis=0), values.max(axis=0)
        width = np.maximum((high - low + CELLS) // CELLS, 1)
        self.codes = np.ascontiguousarray(((values - low) // width).astype(np.uint8).T)
        first = low[:, None] + np.arange(CELLS) * width[:, None]
        last = np.minimum(first + (width - 1)[:, None], np.maximum(high[:, None], first))
        self.centres = (first.astype(np.float64) + last) / 2
        self.half = ((last - first) / 2).max(axis=1, initial=0.0)
        self.exact = values

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centre score of every query and candidate, and how far the exact one can be off."""
        q = queries.astype(np.float64)
        middle = np.zeros((len(q), self.codes.shape[1]))
        for line, query in zip(middle, q):
            for table, codes in zip(query[:, None] * self.centres, self.codes):
                line += table.take(codes)
        slack = np.abs(q) @ self.half
        largest = np.abs(q).sum(axis=1) * np.abs(self.centres).max(initial=0.0)
        return middle, slack + 1e-9 * (largest + slack) + 1e-9  # what rounding can add


def best_of(
    ids: np.ndarray, cells: Approximation, query_ids: np.ndarray, queries: np.ndarray, top: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries, candidate ids and exact scores of each query's best candidates."""
    at, found, scores = [], [], []
    for start in range(0, len(queries), AT_ONCE):
        middle, slack = cells.bounds(queries[start : start + AT_ONCE])
        for row in range(len(middle)):
            own = ids == query_ids[start + row]
            line = middle[row]
            if own.any():
                line = np.where(own, -np.inf, line)
            left = len(ids) - int(own.sum())
            # the k-th centre gives the first certain lower bound of the k-th score
            floor = -np.inf
            if left > top:
                floor = np.partition(line, len(line) - top)[len(line) - top] - slack[row]
            near = np.flatnonzero(line + slack[row] >= floor)
            near = near[line[near] > -np.inf]
            near = near[np.argsort(-line[near], kind="stable")]
            best = np.zeros(0, np.int64)
            read = 0
            values = np.zeros(len(near), np.int64)
            while read < len(near):
                if len(best) == top and line[near[read]] + slack[row] < best[0]:
                    break
                step = near[read : read + max(4 * top, 64, read)]
                values[read : read + len(step)] = cells.exact[step] @ queries[start + row]
                read += len(step)
                best = np.sort(values[:read])[-top:] if read > top else np.sort(values[:read])
            near, values = near[:read], values[:read]
            order = np.lexsort((ids[near], -values))[:top]
            at.append(np.full(len(order), start + row))
            found.append(ids[near[order]])
            scores.append(values[order])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (at, found, scores))


def cut(candidates: int, queries: int) -> tuple[int, int]:
    """How many stripes and blocks. Larger ones move fewer copies, so both grow to their limit."""
    stripes = max(1, -(-candidates // STRIPE))
    wanted = -(-queries * stripes // TASKS)
    return stripes, max(1, -(-queries // min(max(wanted, BLOCK[0]), BLOCK[1])))


def top_k(df: DataFrame, vector: str = "embedding", top: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score of every query's best candidates."""
    rows = materialise(whole_vectors(df, vector), "vectors")
    asked = F.col("vec_id") % every == 0
    stripes, blocks = cut(rows.count(), rows.where(asked).count())
    width, mark = F.size("v").alias("width"), F.xxhash64("vec_id", "v")
    every_stripe = F.sequence(F.lit(0), F.lit(stripes - 1))
    every_block = F.sequence(F.lit(0), F.lit(blocks - 1))
    candidates = rows.select(
        width, F.pmod(F.xxhash64(mark, F.monotonically_increasing_id()), F.lit(stripes))
        .cast("int").alias("stripe"), F.explode(every_block).alias("block"),
        F.lit(False).alias("asks"), "vec_id", "v", mark.alias("mark"),
    )
    queries = rows.where(asked).distinct().select(
        width, F.explode(every_stripe).alias("stripe"), F.pmod(mark, F.lit(blocks)).cast("int").alias("block"),
        F.lit(True).alias("asks"), "vec_id", "v", mark.alias("mark"),
    )
    meeting = candidates.unionByName(queries).groupBy("width", "stripe", "block")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["asks"].to_numpy()
        ids = frame["vec_id"].to_numpy(np.int64)
        values = np.array(frame["v"].tolist(), np.int64).reshape(len(frame), -1)
        if asks.all() or not asks.any():
            at = found = scores = np.zeros(0, np.int64)
        else:
            cells = Approximation(values[~asks])
            at, found, scores = best_of(ids[~asks], cells, ids[asks], values[asks], top)
        marks = frame["mark"].to_numpy(np.int64)[asks]
        return pd.DataFrame({
            "query_id": ids[asks][at], "mark": marks[at], "vec_id": found, "score": scores,
        })

    best = meeting.applyInPandas(search, "query_id bigint, mark bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
with whole as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
    coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::bigint as score
  from (select distinct * from whole where vec_id % 20 = 0) q
  join whole c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
) where rank <= 20
"""
