"""A Merkle manifest of a dataset, with a proof for every row, by pointer jumping.

Every row is a leaf. The leaves of one group (a language), in the order of their key, are hashed two
by two until one node is left, the group's subroot; the subroots, in the order of the groups, give
the root in the same way. A run of one node is hashed alone, so all leaves of a tree are equally deep.

* Places come from one range sort over all groups together, so no group is one task's work.
* Levels are built in blocks of 256 neighbours: each block folds its eight levels by itself, and
  only one node of each block goes on to the next tier.
* Proofs come from pointer jumping. A node holds the siblings on its way up to an ancestor, at first
  its own sibling and its parent. Each round joins the table with itself and puts the ancestor's
  segment behind the node's own, so the distance doubles until every leaf holds its way to the root.
  A round keeps the levels that later rounds start from or land on, a quarter of the nodes above the
  leaves each time. From 16 levels on many nodes share one ancestor; such ancestors are copied once
  for each 4,096 nodes below them, and the nodes are joined by that block, so no key is hot.

Defined results: a null value is hashed as ``-``, which no other value is; rows without a key come
first in their group and equal keys by leaf; repeated rows are leaves of their own; null is a group
of its own and the first; a lone leaf is its own subroot, a lone subroot the root, and their proofs
are empty; an empty table has no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import discard, partitions_of, stored, table
from parlance.llm.registry import register

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one block of neighbours folds, and levels below an ancestor that share a copy of it.
TIER, SHARED = 8, 12


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_of(*values: Column) -> Column:
    """The digest of a row: each value with its length in bytes before it."""
    texts = [v.cast("string") for v in values]
    return _digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (grp, ...) with pos, the place in the group from 0, and size, the rows of the group.

    ``order`` must tell all rows apart. Rows are dealt out by ranges of (grp, order); a range knows
    how many rows of a group lie before it from the counts, of which there is one a range and group.
    """
    spark = rows.sparkSession
    dealt = stored(rows.repartitionByRange(partitions_of(spark), "grp", *order).withColumn("part", F.spark_partition_id()), "ordered")
    every = Window.partitionBy("grp")
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("grp", "part").agg(F.count("*").alias("rows")).select(
        "grp", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(every).alias("size")
    )
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(runs, ["grp", "part"]).withColumn("pos", F.col("first") + F.col("inside")).drop("part", "inside", "first")


def _above(level: Column) -> Column:
    """The next level of an array of digests."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    right = lambda i: F.coalesce(_hex(F.get(level, i * 2 + 1)), F.lit(""))
    return F.transform(pairs, lambda i: F.unhex(_digest(F.concat(_hex(F.get(level, i * 2)), right(i)))))


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (grp, level, idx, seg) below the roots, roots (grp, root), and the greatest height.

    ``leaves`` has (grp, pos, size, digest binary); seg holds the sibling, null where there is none.
    """
    tier = leaves.select("grp", F.col("pos").alias("idx"), F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0).alias("height"), "digest")
    deepest = tier.agg(F.max("height")).first()[0] or 0
    nodes, roots = [], [tier.filter("height = 0").select("grp", F.col("digest").alias("root"))]
    tier = tier.filter("height > 0")
    for base in range(0, deepest, TIER):
        block = tier.groupBy("grp", "height", F.shiftright("idx", TIER).alias("block")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda n: n["digest"]).alias("low")
        )
        steps = F.sequence(F.lit(1), F.least(F.lit(TIER), F.col("height") - base))
        levels = F.aggregate(steps, F.array("low"), lambda made, _: F.concat(made, F.array(_above(F.element_at(made, -1)))))
        built = stored(block.select("grp", "height", "block", levels.alias("levels")), "levels")
        below = built.select("grp", "block", F.posexplode(F.slice("levels", 1, F.size("levels") - 1)).alias("up", "level"))
        single = below.select("grp", "block", "up", "level", F.posexplode("level").alias("i", "digest"))
        nodes.append(
            single.select(
                "grp", (F.col("up") + base).alias("level"), F.expr(f"shiftleft(block, {TIER} - up)").alias("first"), "i",
                F.array(F.get("level", F.col("i").bitwiseXOR(F.lit(1)))).alias("seg"),
            ).select("grp", "level", (F.col("first") + F.col("i")).alias("idx"), "seg")
        )
        top = built.select("grp", F.col("block").alias("idx"), "height", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"))
        roots.append(top.filter(F.col("height") <= base + TIER).select("grp", F.col("digest").alias("root")))
        tier = top.filter(F.col("height") > base + TIER)
    return _union(nodes, leaves.sparkSession, "grp string, level int, idx long, seg array<binary>"), _union(roots, leaves.sparkSession, "grp string, root binary"), deepest


def _union(frames: Sequence[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema) if not frames else frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def jumped(nodes: DataFrame, deepest: int) -> DataFrame:
    """(grp, pos, proof): all siblings of every leaf from its own level to the root's."""
    nodes = stored(nodes, "nodes")
    distance = 1
    while distance < deepest:
        shift = min(distance, SHARED)
        low = nodes.filter(F.col("level") % (2 * distance) == 0).withColumns({"to": F.col("level") + distance, "spot": F.shiftright("idx", shift)})
        high = nodes.filter(F.col("level") % (2 * distance) == distance).select("grp", F.col("level").alias("to"), "idx", F.col("seg").alias("rest"))
        if distance > shift:  # one copy for each block of nodes below
            copies = 1 << (distance - shift)
            widest = low.agg(F.max("spot")).first()[0] or 0
            first = F.col("idx") * copies
            high = high.withColumn("spot", F.explode(F.sequence(first, F.least(first + (copies - 1), F.lit(widest)))))
        else:
            high = high.withColumn("spot", F.col("idx"))
        met = low.join(high.drop("idx"), ["grp", "to", "spot"], "left")
        joined = met.select("grp", "level", "idx", F.when(F.col("rest").isNull(), F.col("seg")).otherwise(F.concat("seg", "rest")).alias("seg"))
        last, nodes = nodes, stored(joined, "jumped")
        discard(last)
        distance *= 2
    return nodes.filter("level = 0").select("grp", F.col("idx").alias("pos"), F.col("seg").alias("proof"))


def folded(leaf: Column, pos: Column, proof: Column) -> Column:
    """The digest that ``leaf`` at ``pos`` gives with the siblings of ``proof``."""

    def step(state: Column, sibling: Column) -> Column:
        other = _hex(sibling)
        text = (
            F.when(sibling.isNull(), state["digest"])
            .when(state["at"] % 2 == 0, F.concat(state["digest"], other))
            .otherwise(F.concat(other, state["digest"]))
        )
        return F.struct(_digest(text).alias("digest"), F.shiftright(state["at"], 1).alias("at"))

    start = F.struct(leaf.alias("digest"), pos.cast("long").alias("at"))
    return F.aggregate(proof, start, step, lambda s: s["digest"])


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", **extra: Column) -> DataFrame:
    """(key, group, leaf, pos, proof, group_pos, group_proof, subroot, root) of every row, and ``extra`` columns of ``docs``.

    Digests are lowercase hex, proofs arrays of binary digests from the leaf upwards.
    """
    empty = F.expr("cast(array() as array<binary>)")
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"),
        F.unhex(leaf_of(*(F.col(f) for f in fields))).alias("digest"), F.struct(F.lit(0).alias("none"), *(c.alias(n) for n, c in extra.items())).alias("extra"),
    )
    leaves = stored(positions(stored(rows.withColumn("row", F.monotonically_increasing_id()), "leaves"), "key", "digest", "row"), "placed")
    nodes, roots, deepest = tree(leaves)
    proofs = jumped(nodes, deepest)
    subroots = stored(roots, "subroots")
    upper = stored(positions(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), "name"), "groups")
    top_nodes, top_root, top_height = tree(upper)
    top_proofs = stored(jumped(top_nodes, top_height), "group-proofs")
    whole = top_root.first()  # one row
    tops = (
        upper.join(top_proofs.drop("grp"), "pos", "left")
        .select(F.col("name").alias("grp"), F.col("pos").alias("group_pos"), F.coalesce("proof", empty).alias("group_proof"), F.col("digest").alias("subroot"))
        .join(leaves.filter("pos = 0").select("grp", "size"), "grp")
        # one copy for each block of leaves, so that no group is one key
        .select("grp", "group_pos", "group_proof", "subroot", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("size") - 1, SHARED))).alias("spot"))
    )
    return (
        leaves.join(proofs, ["grp", "pos"], "left").withColumn("spot", F.shiftright("pos", SHARED)).join(tops, ["grp", "spot"])
        .select(
            F.col("key").alias(key), F.when(F.col("grp") != "-", F.substring("grp", 2, 1 << 30)).alias(group), _hex(F.col("digest")).alias("leaf"), "pos",
            F.coalesce("proof", empty).alias("proof"), "group_pos", "group_proof", _hex(F.col("subroot")).alias("subroot"),
            F.lit(bytes(whole.root).hex() if whole else None).cast("string").alias("root"), *(F.col(f"extra.{n}").alias(n) for n in extra),
        )
    )


def verified(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``rows`` of a manifest with folded_root, from the digests in ``leaf``, and verified."""
    way = folded(folded(F.col(leaf), F.col("pos"), F.col("proof")), F.col("group_pos"), F.col("group_proof"))
    return rows.withColumn("folded_root", way).withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = " || ".join("coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')".format(f) for f in FIELDS)
SQL_OP12 = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, CAST(xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, len(t) + 1), lambda i: [ascii(t[i]) + 1000, 1, 1, 1, 1, 1, 1, 1, 1]))),
      lambda a, b: CASE WHEN b >= 1000 THEN xor(a, b - 1000) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) AS BIGINT) AS c
  FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS t FROM documents WHERE doc_id IS NOT NULL)),
docs AS (
  SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
         sha256({_LEAF.replace('CAST(n_chars AS', 'CAST(CASE WHEN c % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS')}) AS shown
  FROM documents LEFT JOIN crc USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
tree AS (
  SELECT lang, 0 AS level, pos AS idx, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM tree) WHERE n > 1 GROUP BY lang, level, idx // 2),
heights AS (SELECT lang, max(level) AS height FROM tree GROUP BY lang),
subroots AS (
  SELECT t.lang, h AS subroot, row_number() OVER (ORDER BY t.lang NULLS FIRST) - 1 AS gpos
  FROM tree t JOIN heights g ON t.lang IS NOT DISTINCT FROM g.lang AND t.level = g.height),
tops AS (
  SELECT 0 AS level, gpos AS idx, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, idx // 2),
whole AS (SELECT h AS root, level AS height FROM tops ORDER BY level DESC LIMIT 1),
ways AS (
  SELECT p.lang, p.pos, list(CASE WHEN t.h IS NULL THEN '' WHEN (p.pos >> r.level) % 2 = 1 THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY r.level) AS way
  FROM placed p JOIN heights g ON p.lang IS NOT DISTINCT FROM g.lang JOIN (SELECT DISTINCT level FROM tree) r ON r.level < g.height
  LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM p.lang AND t.level = r.level AND t.idx = xor(p.pos >> r.level, 1)
  GROUP BY p.lang, p.pos),
top_ways AS (
  SELECT s.lang, list(CASE WHEN t.h IS NULL THEN '' WHEN (s.gpos >> r.level) % 2 = 1 THEN 'L' || t.h ELSE 'R' || t.h END ORDER BY r.level) AS way
  FROM subroots s JOIN (SELECT DISTINCT level FROM tops) r ON r.level < (SELECT height FROM whole)
  LEFT JOIN tops t ON t.level = r.level AND t.idx = xor(s.gpos >> r.level, 1)
  GROUP BY s.lang),
full_ways AS (
  SELECT p.doc_id, p.leaf, p.shown, s.subroot, root, list_concat(coalesce(w.way, []), coalesce(x.way, [])) AS way
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN whole
  LEFT JOIN ways w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos LEFT JOIN top_ways x ON x.lang IS NOT DISTINCT FROM p.lang),
ended AS (
  SELECT *, list_reduce(list_prepend(shown, way), lambda a, e: CASE WHEN e = '' THEN sha256(a) WHEN e[1] = 'L' THEN sha256(e[2:] || a) ELSE sha256(a || e[2:]) END) AS folded_root
  FROM full_ways)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda e: e[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ended"""


@register("op12_merkle_jumps", SQL_OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered copy of every seventh folds to."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = leaf_of(*(F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS))
    rows = verified(manifest(docs, shown=F.unhex(F.when(tampered & F.col("n_chars").isNotNull(), other))).withColumn("shown", F.coalesce(_hex(F.col("shown")), "leaf")), "shown")
    siblings = F.transform(F.filter(F.concat("proof", "group_proof"), lambda s: s.isNotNull()), _hex)
    return rows.select("doc_id", "leaf", "subroot", "root", _digest(F.array_join(siblings, "")).alias("proof_sha256"), "folded_root", "verified")
