"""The ledger over increments and rule versions; shards of near equal bytes whatever the ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.llm import secrets, sharding

TOKEN = "token=abcdefgh12345"


def test_a_new_rule_version_gives_each_span_once(spark):
    docs = spark.createDataFrame([(1, TOKEN), (2, None)], "doc_id long, text string")
    ledger, findings = secrets.advance(docs)
    ledger, findings = secrets.advance(docs, ledger, findings, rule_version=2)
    assert ledger.count() == 4
    for version in (1, 2):
        spans = {r.doc_id: r.spans for r in secrets.located(docs, findings, version).collect()}
        assert [(s.kind, s.start, s.end) for s in spans[1]] == [("assign", 0, 19)] and spans[2] is None
        assert {r.text for r in secrets.mask(docs, findings, rule_version=version).collect()} == {"[SECRET]", None}


def test_increments_scan_a_text_once(spark):
    rows = [(i, f"{TOKEN}{i % 5}", i % 3) for i in range(30)] + [(30, None, 1), (31, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, step int")
    ledger, findings = secrets.by_increments(docs, F.col("step"), 3)
    assert ledger.count() == ledger.select("blob").distinct().count() == 6
    assert findings.count() == 5
    whole = secrets.advance(docs)[1]
    assert sorted(map(tuple, findings.collect())) == sorted(map(tuple, whole.collect()))


def test_mask_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(TOKEN, "a", "b", "c", "d")], "text string, blob string, spans string, _blob string, _spans string")
    assert [tuple(r) for r in secrets.mask(docs, secrets.advance(docs)[1]).collect()] == [("[SECRET]", "a", "b", "c", "d")]


def _bytes_of_shards(spark, docs):
    records = sharding.sized(docs)
    first = sharding.even_map(spark)
    second = sharding.rebalanced(first, sharding.slot_sizes(records), sharding.SHARDS)
    placed = sharding.placed(records, second.select("vslot", "shard"))
    assert placed.count() == docs.count()
    for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect():
        assert r.n == r.d == r.m + 1
    return [r.b for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()]


def test_shards_are_even_with_a_third_of_null_ids(spark):
    docs = spark.range(30000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    )
    shares = _bytes_of_shards(spark, docs)
    assert len(shares) == 8 and max(shares) < 1.01 * min(shares)


def test_shards_are_even_with_a_third_of_equal_rows(spark):
    docs = spark.range(30000).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("same").alias("text"),
    )
    shares = _bytes_of_shards(spark, docs)
    assert len(shares) == 8 and max(shares) < 1.01 * min(shares)
