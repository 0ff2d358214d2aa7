"""Ordered work over keys of any size.

A window over ``partitionBy(session).orderBy(position)`` puts a whole session into one task. The
operators here give the same answers with bounded groups: rows are split into *blocks* of the
order (``block`` is an integer SQL expression that never falls along the order, for example
``f div 4096``), every block is worked on by itself, and only one or two rows per block travel on
to the next level, which groups ``fan`` blocks. The last level sees one row per ``fan`` blocks.

Keys and order columns must not be null, and the order must be unique per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BLOCK, _SUPER = "__block", "__super"


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: str
    fan: int = 1024

    def order_struct(self) -> Column:
        return F.struct(*self.order)


def prefix(df: DataFrame, layout: Layout, **specs: tuple[str, str]) -> DataFrame:
    """Add columns computed from all *earlier* rows of the same key.

    ``name=("sum", expr)``  total of expr over earlier rows, 0 at the start
    ``name=("max", expr)``  largest non-null expr over earlier rows
    ``name=("lag", expr)``  expr of the row just before, null at the start
    """
    keys, order = list(layout.keys), list(layout.order)
    rows = df.withColumn(_BLOCK, F.expr(layout.block).cast("long"))
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)

    block_aggs, local_cols = [], {}
    for name, (kind, expr) in specs.items():
        value = F.expr(expr)
        if kind == "sum":
            block_aggs.append(F.sum(value).alias(name))
            local_cols[f"__l_{name}"] = F.sum(value).over(earlier)
        elif kind == "max":
            block_aggs.append(F.max(value).alias(name))
            local_cols[f"__l_{name}"] = F.max(value).over(earlier)
        elif kind == "lag":
            block_aggs.append(F.max(F.struct(*order, value.alias("__v"))).alias(name))
            local_cols[f"__l_{name}"] = F.lag(F.struct(value.alias("__v"))).over(inside)
        else:
            raise ValueError(f"unknown prefix kind {kind!r}")

    def agg(kind: str, name: str) -> Column:
        return F.sum(name) if kind == "sum" else F.max(name)

    blocks = rows.groupBy(*keys, _BLOCK).agg(*block_aggs).withColumn(
        _SUPER, F.floor(F.col(_BLOCK) / F.lit(layout.fan))
    )
    supers = blocks.groupBy(*keys, _SUPER).agg(
        *[agg(kind, name).alias(name) for name, (kind, _) in specs.items()]
    )
    over_supers = Window.partitionBy(*keys).orderBy(_SUPER).rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select(
        *keys, _SUPER, *[agg(kind, name).over(over_supers).alias(f"__s_{name}") for name, (kind, _) in specs.items()]
    )
    over_blocks = (
        Window.partitionBy(*keys, _SUPER).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = blocks.select(
        *keys,
        _SUPER,
        _BLOCK,
        *[agg(kind, name).over(over_blocks).alias(f"__b_{name}") for name, (kind, _) in specs.items()],
    ).join(supers, [*keys, _SUPER])
    carry = carry.select(
        *keys, _BLOCK, *[_join_levels(kind, f"__b_{n}", f"__s_{n}").alias(f"__c_{n}") for n, (kind, _) in specs.items()]
    )
    out = rows.select("*", *[c.alias(n) for n, c in local_cols.items()]).join(carry, [*keys, _BLOCK])
    final = []
    for name, (kind, _) in specs.items():
        local, carried = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "lag":
            value = F.when(local.isNotNull(), local["__v"]).otherwise(carried["__v"])
        else:
            value = _join_levels(kind, f"__l_{name}", f"__c_{name}")
        final.append(value.alias(name))
    return out.select(*df.columns, *final)


def dealt(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` in parts of some ``each`` of its ``rows`` rows, so no task grows with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)


def _join_levels(kind: str, near: str, far: str) -> Column:
    if kind == "sum":
        return F.coalesce(F.col(near), F.lit(0)) + F.coalesce(F.col(far), F.lit(0))
    if kind == "lag":
        return F.coalesce(F.col(near), F.col(far))
    return F.greatest(F.col(near), F.col(far))


def islands(
    df: DataFrame,
    layout: Layout,
    edge_cols: Sequence[str],
    breaks: str,
    **aggs: tuple[str, str],
) -> DataFrame:
    """Group runs of consecutive rows; a new run begins where ``breaks`` holds.

    ``breaks`` is a boolean SQL expression over structs ``prev`` and ``cur`` that hold
    ``edge_cols`` of neighbouring rows. Aggregates are ``name=("sum"|"min"|"max", expr)``.
    Output: keys, ``head`` and ``tail`` (structs of ``edge_cols`` of the first and last row of
    the run) and the aggregates. Runs are closed inside their block; only the first and last run
    of a block, which may go on in the neighbour, move to the next level.
    """
    keys = list(layout.keys)
    edge = F.struct(*edge_cols)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*layout.order)
    marked = (
        df.withColumn(_BLOCK, F.expr(layout.block).cast("long"))
        .withColumn("cur", edge)
        .withColumn("prev", F.lag("cur").over(inside))
        .withColumn("__run", F.sum(F.expr(f"int(prev is null or coalesce({breaks}, true))")).over(inside))
    )
    runs = marked.groupBy(*keys, _BLOCK, "__run").agg(
        F.min_by("cur", layout.order_struct()).alias("head"),
        F.max_by("cur", layout.order_struct()).alias("tail"),
        *[getattr(F, fn)(F.expr(expr)).alias(name) for name, (fn, expr) in aggs.items()],
    )
    columns = [*keys, "head", "tail", *aggs]
    parts = []
    groups = [[*keys, _SUPER], keys]
    for depth, group in enumerate(groups):
        whole = Window.partitionBy(*keys, _BLOCK)
        flagged = runs.withColumn("__last", F.max("__run").over(whole))
        is_edge = (F.col("__run") == 1) | (F.col("__run") == F.col("__last"))
        parts.append(flagged.filter(~is_edge).select(*columns))
        edges = flagged.filter(is_edge)
        if depth == 0:
            edges = edges.withColumn(_SUPER, F.floor(F.col(_BLOCK) / F.lit(layout.fan)))
        runs = _stitch(edges, group, keys, breaks, aggs)
        if depth == 0:
            runs = runs.withColumnRenamed(_SUPER, _BLOCK)
    parts.append(runs.select(*columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _stitch(edges: DataFrame, group: list[str], keys: list[str], breaks: str, aggs: dict) -> DataFrame:
    """Join the last run of a block with the first run of the next one."""
    along = Window.partitionBy(*group).orderBy(_BLOCK, "__run")
    linked = (
        edges.withColumn("__before", F.lag(F.struct(F.col("tail"), F.col(_BLOCK))).over(along))
        .withColumn("prev", F.col("__before.tail"))
        .withColumn("cur", F.col("head"))
        .withColumn(
            "__new",
            F.expr(f"int(__before is null or __before.{_BLOCK} = {_BLOCK} or coalesce({breaks}, true))"),
        )
        .withColumn("__pos", F.struct(_BLOCK, "__run"))
        .withColumn("__joined", F.sum("__new").over(along))
    )
    merged = linked.groupBy(*group, "__joined").agg(
        F.min_by("head", "__pos").alias("head"),
        F.max_by("tail", "__pos").alias("tail"),
        *[getattr(F, fn)(name).alias(name) for name, (fn, _) in aggs.items()],
    )
    return merged.withColumnRenamed("__joined", "__run")


def lookup(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join one row per key back to many rows without putting a large key into one task.

    No hint is given: Spark broadcasts the small side when its measured size allows. Otherwise the
    small side is repeated ``salts`` times and rows spread over the copies, so a key with a third of
    all rows is cut into ``salts`` pieces before the shuffle, and adaptive execution splits further
    any piece that is still far above the median.
    """
    copies = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return spread.join(copies, [*keys, "__salt"], how).drop("__salt")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    condition: str,
    width: int,
) -> DataFrame:
    """Join intervals on equal keys and ``condition``, blocked by time.

    Each interval is listed under every ``width``-wide slot it touches; a pair is kept only in the
    first slot both touch, so it comes out once. The spans are inclusive integer expressions.
    """
    l_lo, l_hi = (f"({e}) div {width}" for e in left_span)
    r_lo, r_hi = (f"({e}) div {width}" for e in right_span)
    lhs = left.withColumn("__l_first", F.expr(l_lo)).withColumn("__slot", F.expr(f"explode_outer(sequence({l_lo}, {l_hi}))"))
    rhs = right.withColumn("__r_first", F.expr(r_lo)).withColumn("__slot", F.expr(f"explode_outer(sequence({r_lo}, {r_hi}))"))
    joined = lhs.join(rhs, [*keys, "__slot"])
    return joined.filter(F.expr(f"__slot = greatest(__l_first, __r_first) and ({condition})")).drop(
        "__slot", "__l_first", "__r_first"
    )
