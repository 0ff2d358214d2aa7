"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the principal axes of all of them, so the leading
coordinates hold most of what sets them apart. Two vectors with cosine c are at most sqrt(2 - 2c)
apart in every coordinate, so those of one label are dealt into slices along the first axis, and a
slice needs comparing with itself and the two above only. Slices are dealt into tiles of about
``TILE`` rows; a task holds one pair of tiles. There the products of the leading coordinates are
summed first; what the rest can add is bounded by the product of the suffix norms, and pairs that
cannot reach the threshold go no further. Those that may are compared exactly, in double precision,
on the vectors as given.

Equal vectors of a label are one row with a count. A pair of tiles gives each vector's number of
links and spanning links, never all pairs. Axes come from sums over all rows, one row a partition.

Defined results: a null label, and a vector that is null, zero, or holds null or non-finite numbers,
link with nothing; vectors of unequal length link with nothing; a null id is counted as a link of
others and gets the smallest id of its component, which is null if there is none; repeated rows link
with each other and give repeated results; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import stored, table
from parlance.llm.components import components, spanning
from parlance.llm.neighbours import usable
from parlance.llm.registry import register

THRESHOLD, TILE, STEPS = 0.98, 2_048, (8, 24)


def principal_axes(units: DataFrame, size: int) -> np.ndarray:
    """Orthonormal axes of unit vectors (column v), by falling variance; shorter vectors are padded."""

    def sums(batches):
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                v = _padded(batch.column(0), size)
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

    def again(batches):
        total = np.zeros(size * size)
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total += np.array(row)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    few = units.select("v").mapInArrow(sums, "s array<double>").repartition(4).mapInArrow(again, "s array<double>")
    total = np.sum([np.array(r.s) for r in few.collect()], axis=0).reshape(size, size)
    return np.linalg.eigh(total)[1][:, ::-1]


def _padded(column: pa.Array, size: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), size))
    out[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Tile:
    """Vectors as given, their unit vectors along the axes, and the norms of what follows each step."""

    def __init__(self, node: np.ndarray, count: np.ndarray, length: np.ndarray, given: np.ndarray, axes: np.ndarray):
        self.node, self.count, self.length, self.given = node, count, length, given
        self.norms = np.sqrt((given**2).sum(axis=1))
        self.turned = (given / self.norms[:, None]) @ axes
        self.rest = {s: np.sqrt((self.turned[:, s:] ** 2).sum(axis=1)) for s in STEPS}


def close_pairs(a: Tile, b: Tile, threshold: float, rows: int = 512):
    """Rows (i of a, j of b) with cosine at ``threshold`` or above, a block of rows of a at a time."""
    slack = 1e-9
    first, second = STEPS
    for start in range(0, len(a.node), rows):
        part = slice(start, start + rows)
        leading = a.turned[part, :first] @ b.turned[:, :first].T
        i, j = np.nonzero(leading + np.outer(a.rest[first][part], b.rest[first]) >= threshold - slack)
        sums, i = leading[i, j], i + start
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            more = sums[at : at + (1 << 16)] + np.einsum("nd,nd->n", a.turned[p, first:second], b.turned[q, first:second])
            may = (more + a.rest[second][p] * b.rest[second][q] >= threshold - slack) & (a.length[p] == b.length[q])
            p, q = p[may], q[may]
            near = np.einsum("nd,nd->n", a.given[p], b.given[q]) / (a.norms[p] * b.norms[q]) >= threshold
            yield p[near], q[near]


def tile_links(vectors: DataFrame, threshold: float, tile: int, size: int, axes: np.ndarray) -> DataFrame:
    """Links of the pairs of tiles: (node, links, root) with root another node or null."""
    width = math.sqrt(2 - 2 * threshold) / 2 + 1e-6

    def slices(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _padded(batch.column(batch.schema.get_field_index("v")), size)
                unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
                at = np.floor((unit @ axes[:, 0]) / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=[*batch.schema.names, "slice"])

    cut = stored(vectors.mapInArrow(slices, "node long, count long, label string, v array<double>, slice int"), "slices")
    sizes = cut.groupBy("label", "slice").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    up = lambda by: sizes.select("label", (F.col("slice") - by).alias("slice"), F.col("tiles").alias(f"up{by}"))
    down = lambda by: sizes.select("label", (F.col("slice") + by).alias("slice"), F.col("tiles").alias(f"down{by}"))
    around = sizes
    for frame in (up(1), up(2), down(1), down(2)):
        around = around.join(frame, ["label", "slice"], "left")
    placed = cut.join(stored(around, "tile-counts"), ["label", "slice"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # every pair of tiles once: those of a slice among themselves, and those of a slice with the two above
    none = "cast(array() as array<int>)"
    tiles_of = lambda column: f"if({column} is null, {none}, sequence(0, {column} - 1))"
    deal = F.expr(
        f"""concat(
          transform(sequence(0, tiles - 1), t -> struct(slice as s1, least(t, tile) as t1, slice as s2, greatest(t, tile) as t2, tile <= t as a, tile >= t as b)),
          transform({tiles_of("up1")}, t -> struct(slice as s1, tile as t1, slice + 1 as s2, t as t2, true as a, false as b)),
          transform({tiles_of("up2")}, t -> struct(slice as s1, tile as t1, slice + 2 as s2, t as t2, true as a, false as b)),
          transform({tiles_of("down1")}, t -> struct(slice - 1 as s1, t as t1, slice as s2, tile as t2, false as a, true as b)),
          transform({tiles_of("down2")}, t -> struct(slice - 2 as s1, t as t1, slice as s2, tile as t2, false as a, true as b)))"""
    )
    dealt = placed.select("label", F.explode(deal).alias("d"), "node", "count", "v")
    pairs = dealt.select("label", "d.s1", "d.t1", "d.s2", "d.t2", "d.a", "d.b", "node", "count", "v")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        def of(side: str) -> Tile | None:
            t = group.filter(group[side])
            v = t["v"].combine_chunks()
            if not len(t):
                return None
            return Tile(t["node"].to_numpy(), t["count"].to_numpy(), v.value_lengths().to_numpy(), _padded(v, size), axes)

        a, b = of("a"), of("b")
        if a is None or b is None:
            return schema.empty_table()
        same = group["s1"][0] == group["s2"][0] and group["t1"][0] == group["t2"][0]
        offset = 0 if same else len(a.node)
        nodes = a.node if same else np.concatenate([a.node, b.node])
        counts = a.count if same else np.concatenate([a.count, b.count])
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        left, right, waiting = [], [], 0
        for i, j in close_pairs(a, b, threshold):
            j = j + offset
            if same:
                i, j = i[i < j], j[i < j]
            links += np.bincount(i, counts[j], len(nodes)).astype(np.int64) + np.bincount(j, counts[i], len(nodes)).astype(np.int64)
            left.append(i)
            right.append(j)
            waiting += len(i)
            if waiting > 1 << 20:
                root = spanning(len(nodes), np.concatenate([*left, np.arange(len(nodes))]), np.concatenate([*right, root]))
                left, right, waiting = [], [], 0
        root = spanning(len(nodes), np.concatenate([*left, np.arange(len(nodes))]), np.concatenate([*right, root]))
        linked = np.flatnonzero(links)
        return pa.table([pa.array(nodes[linked]), pa.array(links[linked]), pa.array(nodes[root[linked]])], schema=schema)

    return pairs.groupBy("label", "s1", "t1", "s2", "t2").applyInArrow(compare, "node long, links long, root long")


def by_power_of_two(v: Column) -> Column:
    """A vector times the power of two that brings its largest number near one.

    This is exact and leaves the cosine as it is, while the squares of very small and very large numbers
    stay in range.
    """
    largest = F.array_max(F.transform(v, F.abs))
    power = F.pow(F.lit(2.0), F.greatest(F.least(-F.floor(F.log2(largest)), F.lit(1000)), F.lit(-1000)))
    return F.transform(v, lambda x: x * power)


def near_vectors(
    rows: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    double = F.transform(vector, lambda x: x.cast("double"))
    every = rows.select(
        F.col(key).cast("long").alias("id"), F.when(usable(vector), by_power_of_two(double)).alias("v"), F.col(label).cast("string").alias("label"),
        (usable(vector) & F.col(label).isNotNull()).alias("takes_part"),
    )
    members = every.filter("takes_part").select("id", "v", "label")
    # a group's smallest id names it; without any id, a hash of what it is
    groups = members.groupBy("label", "v").agg(F.count("*").alias("count"), F.min("id").alias("least"))
    groups = stored(groups.withColumn("node", F.coalesce("least", F.xxhash64("label", "v"))), "groups")
    size = groups.agg(F.max(F.size("v"))).first()[0] or 1
    unit = groups.select(F.expr("transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y)))").alias("v"))
    axes = principal_axes(unit, size)
    found = stored(tile_links(groups.select("node", "count", "label", "v"), threshold, tile, size, axes), "tile-links")
    roots = stored(components(found.filter("node <> root").select("node", "root")), "roots").withColumnRenamed("root", "comp")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_comp = roots.join(groups.select("node", "least"), "node").groupBy("comp").agg(F.min("least").alias("component_id"))
    named = roots.join(of_comp, "comp").select("node", "component_id", F.lit(True).alias("linked"))
    result = groups.join(links, "node", "left").join(named, "node", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"),
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"),
    )
    inside = members.join(stored(result, "classes"), ["label", "v"]).select(F.col("id").alias(key), "n_links", "component_id")
    outside = every.filter("not takes_part").select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return inside.unionByName(outside).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


SQL_OP3 = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.y, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN least l ON l.x = e.vec_id"""


@register("op3_cosine_pca_tiles", SQL_OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
