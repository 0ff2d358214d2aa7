"""Monotonic segments by functions of blocks against the rule row by row."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import assemble as A


def plain(rows, step):
    out, end = [], None
    for a, b in rows:
        a = a if end is None else max(a, end)
        end = b if b > a else a + step
        out.append((a, end))
    return out


def test_functions_of_blocks():
    rng = random.Random(1)
    for _ in range(400):
        n, step, spread = rng.randint(1, 12), rng.choice([1, 3, 10]), rng.choice([5, 20, 100])
        rows = [(rng.randint(-5, spread), rng.randint(-5, spread)) for _ in range(n)]
        bounds, results = A._block_function([a for a, _ in rows], [b for _, b in rows], step)
        assert bounds == sorted(set(bounds))
        for end in range(-12, spread + 12):
            want = end
            for a, b in rows:
                a = max(a, want)
                want = b if b > a else a + step
            found = next((r for c, r in zip(bounds, results, strict=True) if end < c), end + n * step)
            assert found == want, (rows, step, end)


@pytest.mark.parametrize("block", [1, 3, 16, 4096])
def test_sessions_over_blocks(spark, block):
    rng = random.Random(block)
    rows, want = [], []
    for session in ("a", "b", "c", "d"):
        rate = {"a": 0, "b": 400, "c": 1000, "d": 2500}[session]  # a never catches up, d always does
        times = [(i * rate + rng.randint(0, 3000), i * rate + rng.randint(0, 4000)) for i in range(60)]
        places = sorted(rng.sample(range(200), 60))
        rows += [(session, p, a, b) for p, (a, b) in zip(places, times, strict=True)]
        want += [(session, p, *x) for p, x in zip(places, plain(times, 1000), strict=True)]
    frame = spark.createDataFrame(rows, "session string, seg_idx long, start_ms long, end_ms long")
    assert sorted(map(tuple, A.monotonic_segments(frame, block=block).collect())) == sorted(want)
    assert A.monotonic_segments(frame.limit(0)).collect() == []


def test_one_long_session_is_many_tasks(spark):
    """A million rows that never catch up with the end before them."""
    n = 1_000_000
    frame = spark.range(n).select(F.lit(1).alias("session"), F.col("id").alias("seg_idx"), (F.col("id") % 977 * 500).alias("start_ms"), (F.col("id") % 613 * 700).alias("end_ms"))
    out = A.monotonic_segments(frame)
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(shares) == n and max(shares) < n / 3
    found = out.agg(F.sum("start_ms"), F.sum("end_ms"), F.max("end_ms")).first()
    want = plain([(i % 977 * 500, i % 613 * 700) for i in range(n)], 1000)
    assert tuple(found) == (sum(a for a, _ in want), sum(b for _, b in want), want[-1][1])
