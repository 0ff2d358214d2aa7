"""Approximate nearest neighbours by a forest of hash-prefix trees held as sorted arrays.

Rows are dealt into blocks by a hash of their id; a block has about ``BLOCK`` rows. In a task, each
tree of a block gives every row a long hash string, one bit for the side of each of ``LENGTH``
random hyperplanes through the middle of the block, and keeps the strings sorted. A query looks in
each tree for its longest prefix by binary search. Then all trees go up together, one bit at a time,
until they have met ``VISITS`` rows for each row of the block, and the rows are ranked by the sum of
their shared prefix lengths over the trees; the first of them are compared exactly, in double
precision, and the nearest of all blocks are merged.

The stated query set meets every block in pieces of ``QUERIES_AT_ONCE``, so a task holds one block
and one piece. Of equal vectors only the first ids can be in a result, so no more of them enter the
index: ``k`` others and the query itself.

``SHARE`` of a block, and ``LEAST`` rows at least, are compared for each query: vectors without any
structure need that many for a recall of 0.9, and the tests measure it against brute force.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite numbers take no part; rows without an id take no part; of rows that repeat an id the
first vector counts; a query without any other row has no result; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import stored, table
from parlance.llm.registry import register

TREES, LENGTH, VISITS, SHARE, LEAST, SEED = 160, 16, 16, 0.25, 100, 20_240_229
BLOCK, QUERIES_AT_ONCE = 8_192, 1_024


def usable(vector: str | Column) -> Column:
    """Whether a vector is not null, not zero and all of it finite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    # a difference with itself is no number for what is infinite or no number
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of one block, one array a tree."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, length: int = LENGTH, seed: int = SEED):
        self.vectors, self.length = vectors, length
        self.middle = vectors.mean(axis=0)
        self.planes = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * length))
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, trees) hash strings as integers, the first bit on top."""
        out = np.empty((len(vectors), self.planes.shape[1] // self.length), np.int64)
        for at in range(0, len(vectors), 512):
            sides = ((vectors[at : at + 512] - self.middle) @ self.planes > 0).reshape(-1, out.shape[1], self.length)
            out[at : at + 512] = sides @ (np.int64(1) << np.arange(self.length - 1, -1, -1, dtype=np.int64))
        return out

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(levels, queries, trees): first and end of the rows that share a prefix; level 0 is the whole string."""
        strings = self.strings(queries)
        shape = (self.length + 1, *strings.shape)
        first, end = np.empty(shape, np.int64), np.empty(shape, np.int64)
        for up in range(self.length + 1):
            low = strings >> up << up
            for t in range(strings.shape[1]):
                first[up, :, t] = np.searchsorted(self.sorted[:, t], low[:, t], "left")
                end[up, :, t] = np.searchsorted(self.sorted[:, t], low[:, t] + (1 << up), "left")
        return first, end

    def candidates(self, queries: np.ndarray, least: int, visits: int = VISITS):
        """For each query the ``least`` rows whose prefixes are longest over all trees, or all rows.

        The trees go up together until they have met ``visits`` rows for each row of the block. A row
        counts one for each tree and level at which it shares the prefix.
        """
        first, end = self.ranges(queries)
        n, trees = len(self.vectors), first.shape[2]
        stop = np.argmax((end - first).sum(axis=2) >= min(visits, trees) * n, axis=0)
        for q, top in enumerate(stop):
            if least >= n:
                yield np.arange(n)
                continue
            low, high = first[top, q], end[top, q]
            base = np.concatenate(([0], np.cumsum(high - low)))
            steps = np.zeros(base[-1] + 1, np.int32)
            for level in range(min(top, self.length - 1) + 1):  # the empty prefix tells nothing
                np.add.at(steps, base[:-1] + first[level, q] - low, 1)
                np.add.at(steps, base[:-1] + end[level, q] - low, -1)
            met = np.concatenate([self.order[low[t] : high[t], t] for t in range(trees)])
            shared = np.bincount(met, np.cumsum(steps[:-1]), n)
            yield np.argpartition(-shared, least - 1)[:least]


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", share: float = SHARE,
    trees: int = TREES, length: int = LENGTH, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest rows found for each query, by distance, then id."""
    rows, queries = (
        df.filter(F.col(key).isNotNull() & usable(vector)).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(vector).alias("v"))
        for df in (rows, queries)
    )
    first_ids = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = stored(rows.withColumn("place", first_ids).filter(F.col("place") <= k + 1).drop("place"), "points")
    asked = stored(queries, "queries")
    blocks = max(1, math.ceil(points.count() / block))
    pieces = max(1, math.ceil(asked.count() / QUERIES_AT_ONCE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = points.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(pieces).alias("piece"), "id", "v")
    right = asked.select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(pieces)).cast("int").alias("piece"), "id", "v")
    names = ["query_id", "id", "score"]

    def stacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = t["v"].combine_chunks()
        return t["id"].to_numpy(), (v.flatten().to_numpy().reshape(len(t), -1) if len(t) else np.zeros((0, 0))).astype(np.float64)

    def search(found: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        sizes = found["v"].combine_chunks().value_lengths().to_numpy() if len(found) else np.zeros(0, int)
        asks = wanted["v"].combine_chunks().value_lengths().to_numpy() if len(wanted) else np.zeros(0, int)
        for size in np.intersect1d(sizes, asks):
            ids, vectors = stacked(found.filter(pa.array(sizes == size)))
            query_ids, asked_for = stacked(wanted.filter(pa.array(asks == size)))
            by_id = np.argsort(ids, kind="stable")  # the same forest whatever the order of arrival
            ids, vectors = ids[by_id], vectors[by_id]
            forest = Forest(vectors, trees, length)
            least = max(LEAST, math.ceil(share * len(ids)))
            for query, q, rows_ in zip(query_ids, asked_for, forest.candidates(asked_for, least), strict=True):
                rows_ = rows_[ids[rows_] != query]
                score = np.sqrt(((vectors[rows_] - q) ** 2).sum(axis=1))
                if len(rows_) > k:
                    close = score <= np.partition(score, k - 1)[k - 1]
                    rows_, score = rows_[close], score[close]
                best = np.lexsort((ids[rows_], score))[:k]
                out[0] += [query] * len(best)
                out[1] += ids[rows_[best]].tolist()
                out[2] += score[best].tolist()
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, out, strict=True)})

    best = left.groupBy("block", "piece").cogroup(right.groupBy("block", "piece")).applyInArrow(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


@register("op9_hash_prefix_forest")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % 100 == 0))
