"""Sharding by fixed virtual slots.

Each record is hashed into one of a fixed number of slots. Bytes are added up per slot, and a
versioned map gives each slot to a shard. Rebalancing edits the map: it writes the next version in
which some slots have moved, and only the records of those slots move.

A slot depends on id, size and crc of a record. Rows that are equal in all three, and so many that
they outweigh a slot, are dealt over all slots by their place in the table; as they are equal, it
does not matter which of them goes where.

The slot table has ``slots`` rows whatever the size of the input, so it may be broadcast, and the
map is made by one fold over that table. Records are never gathered by shard: positions in a shard
come from a running count inside one slot plus the start of the slot in its shard.

Defined results: a null text counts no bytes and a null crc of the empty text; a null id is hashed
like a value; repeated rows are records of their own; an empty table gives an empty result; other
columns of the input are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.llm.common import shared_folder, stored, table
from parlance.llm.registry import register

SLOTS = 4096
SHARDS = 8
#: Rows of one id, size and crc are dealt on to all slots where they are more than this, and more than a quarter of a slot's share.
COPIES = 16


def slot_of(*key: str | Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record; fixed for ever, also when shards are added."""
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of every slot, empty slots included: (vslot, rows, bytes)."""
    found = records.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    every = records.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").select(
        "vslot", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )


def _least_loaded(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int")


def even_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 before anything is counted: slots dealt in turn, (version, vslot, shard)."""
    slot = F.col("id").cast("int")
    return spark.range(0, slots, 1, 1).select(F.lit(1).alias("version"), slot.alias("vslot"), (slot % shards).alias("shard"))


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1: slots from large to small, each to the shard with the fewest bytes so far.

    One fold over the slot table, whose length is fixed: (version, vslot, shard).
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col("bytes"), (-F.col("vslot")).alias("minus"))), asc=False)

    def place(state: Column, slot: Column) -> Column:
        to = _least_loaded(state["loads"])
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == to - 1, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["given"], F.array(F.struct((-slot["minus"]).alias("vslot"), (to - 1).alias("shard")))).alias("given"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("loads"),
        F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("given"),
    )
    folded = sizes.agg(ordered.alias("slots")).select(F.aggregate("slots", start, place)["given"].alias("given"))
    return folded.select(F.explode("given").alias("g")).select(F.lit(1).alias("version"), "g.vslot", "g.shard")


def rebalanced(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for ``shards`` shards, moving no more slots than needed.

    From each shard that holds more than the mean, its smallest slots beyond the mean are taken
    and given to the shards with the fewest bytes. A slot that is not taken keeps its shard.
    """
    loads = slot_map.join(sizes, "vslot")
    mean = F.sum("bytes").over(Window.partitionBy("version")) / shards
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    marked = loads.withColumn("mean", mean).withColumn("upto", F.sum("bytes").over(by_size))
    moving = (F.col("upto") > F.col("mean")) | (F.col("shard") >= shards)
    kept = marked.filter(~moving).groupBy("shard").agg(F.sum("bytes").alias("load"))
    base = (
        slot_map.sparkSession.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"))
        .join(kept, "shard", "left").agg(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))).alias("base"))
    )
    slots = marked.filter(moving).agg(
        F.sort_array(F.collect_list(F.struct(F.col("bytes"), (-F.col("vslot")).alias("minus"))), asc=False).alias("slots")
    )

    def place(state: Column, slot: Column) -> Column:
        to = _least_loaded(state["loads"])
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == to - 1, load + slot["bytes"]).otherwise(load)).alias("loads"),
            F.concat(state["given"], F.array(F.struct((-slot["minus"]).alias("vslot"), (to - 1).alias("to")))).alias("given"),
        )

    start = F.struct(
        F.transform("base", lambda b: b["load"].cast("bigint")).alias("loads"),
        F.expr("cast(array() as array<struct<vslot:int,to:int>>)").alias("given"),
    )
    moved = base.crossJoin(slots).select(F.explode(F.aggregate("slots", start, place)["given"]).alias("g")).select("g.*")
    return slot_map.join(F.broadcast(moved), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").alias("shard")
    )


def save_map(slot_map: DataFrame, folder: str | None = None) -> DataFrame:
    """Store one version of a map; earlier versions stay beside it."""
    spark = slot_map.sparkSession
    folder = folder or f"{shared_folder(spark)}/llm-slot-map-{uuid.uuid4().hex}"
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(folder)
    return spark.read.schema("vslot int, shard int, version int").parquet(folder)


def placed(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Records with their shard and their place in it, counted from 0 without gaps.

    ``records`` needs vslot and the columns of ``order`` (doc_id, size, text_crc32). The running
    count sorts one slot at a time and can spill; :func:`slotted` keeps slots near one in ``slots`` of
    all records.
    """
    counted = records.groupBy("vslot").agg(F.count("*").alias("rows")).join(F.broadcast(slot_map), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("vslot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    return (
        records.withColumn("place", place)
        .join(F.broadcast(starts), "vslot")
        .withColumn("slot", (F.col("first") + F.col("place") - 1).cast("bigint"))
        .drop("first", "place")
    )


def measured(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, size, text_crc32) of every document, and ``more``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), *more)


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``records`` (with doc_id, size, text_crc32) and their slot, as a stored table.

    The list of crowded keys has 4 ``slots`` rows at most, since each holds over one in 4 ``slots`` of all
    rows, so it is broadcast.
    """
    key = F.xxhash64("doc_id", "size", "text_crc32")
    counts = stored(records.groupBy(key.alias("key")).agg(F.count("*").alias("n")), "copies")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = counts.filter(F.col("n") > max(COPIES, total // (4 * slots))).select(F.col("key").alias("crowded"))
    row = F.struct(*records.columns)
    held = records.select(key.alias("key"), F.monotonically_increasing_id().alias("place"), row.alias("row"))
    salt = F.when(F.col("crowded").isNotNull(), F.col("place")).otherwise(F.lit(-1))
    placed = held.join(F.broadcast(crowded), F.col("key") == F.col("crowded"), "left").select(
        "row.*", slot_of("key", salt, slots=slots).alias("vslot")
    )
    return stored(placed, "slotted")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of every document."""
    return slotted(measured(docs))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, parts: int = 4) -> None:
    """Write whole documents into folders ``shard=N``; slots are dealt over ``parts`` files a shard."""
    whole = slotted(measured(docs, F.struct(*docs.columns).alias("doc")))
    keyed = whole.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    keyed.repartition("shard", F.col("vslot") % parts).select("doc.*", "shard").write.partitionBy("shard").parquet(path)


@register("op10_shard_virtual_slots")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes.

    The first version of the map deals slots in turn; the second is its edit by the bytes of the slots.
    """
    records = sized(table(spark, sf_dir, "documents"))
    first = even_map(spark)
    maps = save_map(first.unionByName(rebalanced(first, stored(slot_sizes(records), "slots"), SHARDS)))
    slot_map = maps.filter("version = 2").select("vslot", "shard")
    return placed(records, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )
