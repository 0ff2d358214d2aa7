"""Word errors by columns of bits against the plain table."""

import random
import time

from parlance.operators import metrics


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_is_the_plain_one():
    rng = random.Random(3)
    for size in (0, 1, 2, 5, 63, 64, 65, 130):
        for _ in range(40):
            words = "abcdefgh"[: rng.randint(1, 8)]
            a = [rng.choice(words) for _ in range(rng.randint(0, size))]
            b = [rng.choice(words) for _ in range(rng.randint(0, size))] if rng.random() < 0.5 else [w for w in a if rng.random() < 0.9]
            assert metrics.edit_distance(a, b) == plain(a, b)


def test_long_pairs_are_quick():
    rng = random.Random(4)
    a = [f"w{rng.randint(0, 3000)}" for _ in range(20_000)]
    b = [w if rng.random() < 0.95 else "x" for w in a if rng.random() < 0.97]
    start = time.time()
    found = metrics.edit_distance(a, b)
    assert time.time() - start < 5 and 1000 < found < 3000


def test_awkward_pairs(spark):
    rows = [(1, ["a", "b"], None), (2, None, None), (3, [], ["x"]), (4, ["a", None, "c"], ["a", None]), (4, ["q"], ["q"])]
    frame = spark.createDataFrame(rows, "k int, reference array<string>, hypothesis array<string>")
    assert sorted((r.k, r.errors) for r in metrics.with_word_errors(frame).collect()) == [(1, 2), (2, 0), (3, 1), (4, 0), (4, 1)]
    rates = {r.k: (r.errors, r.words, r.wer) for r in metrics.word_error_rate(frame, "k").collect()}
    assert rates[4] == (1, 4, 0.25) and rates[3] == (1, 0, None)
