"""Blocked operators with tiny blocks against plain windows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parlance.operators.ordered import Layout, islands, lookup, overlap_join, prefix


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(s, f, rng.randint(0, 5)) for s in range(3) for f in sorted(rng.sample(range(400), 150))]
    return spark.createDataFrame(data, "s int, f long, v int").cache()


@pytest.mark.parametrize("block,fan", [(7, 3), (1, 2), (1000, 4)])
def test_prefix(rows, block, fan):
    got = prefix(
        rows, Layout(("s",), ("f",), f"f div {block}", fan),
        run=("sum", "v"), last=("lag", "v"), top=("max", "if(v > 3, f, null)"),
    )
    w = Window.partitionBy("s").orderBy("f")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select(
        "*", F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("run"), F.lag("v").over(w).alias("last"),
        F.max(F.expr("if(v > 3, f, null)")).over(earlier).alias("top"),
    )
    same(got, want)


@pytest.mark.parametrize("block,fan", [(7, 3), (1, 2), (1000, 4)])
@pytest.mark.parametrize("gap", [1, 4, 100])
def test_islands(rows, block, fan, gap):
    got = islands(
        rows, Layout(("s",), ("f",), f"f div {block}", fan), ["f"], f"cur.f - prev.f > {gap}", n=("sum", "1L"), top=("max", "v")
    ).selectExpr("s", "head.f as a", "tail.f as b", "n", "top")
    w = Window.partitionBy("s").orderBy("f")
    want = (
        rows.withColumn("p", F.lag("f").over(w))
        .withColumn("g", F.sum(F.expr(f"int(p is null or f - p > {gap})")).over(w))
        .groupBy("s", "g")
        .agg(F.min("f").alias("a"), F.max("f").alias("b"), F.count("*").alias("n"), F.max("v").alias("top"))
        .drop("g")
    )
    same(got, want)


def test_lookup_keeps_rows(rows, spark):
    per_key = spark.createDataFrame([(0, "a"), (1, "b")], "s int, name string")
    same(lookup(rows, per_key, ["s"]).select("s", "f", "v", "name"), rows.join(per_key, "s", "left").select("s", "f", "v", "name"))


def test_overlap_join(spark):
    rng = random.Random(2)
    a = spark.createDataFrame([(rng.randint(0, 2), i, x, x + rng.randint(0, 90)) for i, x in enumerate(rng.choices(range(500), k=80))], "k int, i int, a long, b long")
    b = spark.createDataFrame([(rng.randint(0, 2), i, x, x + rng.randint(0, 90)) for i, x in enumerate(rng.choices(range(500), k=80))], "k int, j int, c long, d long")
    got = overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), "a <= d and c <= b", 16).select("k", "i", "j")
    same(got, a.join(b, "k").filter("a <= d and c <= b").select("k", "i", "j"))


def test_one_key_with_most_rows(spark):
    """A key that holds nearly everything is worked on in many blocks, with the right totals."""
    n = 200_000
    hot = spark.range(n).selectExpr("if(id % 10 = 0, id div 10, 0L) as s", "id as f", "1L as v")
    layout = Layout(("s",), ("f",), "f div 256", 16)
    total = prefix(hot, layout, run=("sum", "v")).filter("s = 0")
    assert total.agg(F.max("run"), F.count("*"), F.countDistinct("run")).first()[1:] == (n * 9 // 10 + 1, n * 9 // 10 + 1)
    runs = islands(hot.filter("s = 0"), layout, ["f"], "cur.f - prev.f > 2", n=("sum", "1L"))
    assert runs.agg(F.count("*"), F.sum("n")).first()[:] == (1, n * 9 // 10 + 1)


def test_cut_keeps_the_configured_folder(spark):
    from parlance.lineage import cut, shared_dir

    before = shared_dir(spark)
    assert cut(spark.range(5)).count() == 5
    assert shared_dir(spark) == before
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert before == configured.rstrip("/")
