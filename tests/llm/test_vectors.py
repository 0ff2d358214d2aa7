"""Operators on embeddings against direct rules on small tables."""

import math

import numpy as np
import pytest

from parlance.llm import cosine, neighbours
from parlance.llm.components import components, spanning

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links string, count string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, "n", "l", "c", "v") for i, v, g in rows], SCHEMA)


def awkward(seed=0, n=160, size=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=size)
        rows.append((i, v.tolist(), int(rng.integers(0, 2))))
    for i in range(n, n + 60):
        base = rows[int(rng.integers(0, 4))]
        rows.append((i, (np.array(base[1]) * rng.uniform(0.5, 2) + rng.normal(size=size) * 0.08).tolist(), base[2]))
    rows += [(n + 60 + k, rows[5][1], rows[5][2]) for k in range(9)]
    rows += [
        (900, None, 1), (901, [0.0] * size, 1), (902, [float("nan")] + [1.0] * (size - 1), 1), (903, [float("inf")] + [1.0] * (size - 1), 0),
        (904, [None] + [1.0] * (size - 1), 0), (905, rows[5][1], None), (906, rows[5][1][:5], rows[5][2]), (907, [], 0), (100, rows[100][1], rows[100][2]),
    ]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


@pytest.mark.parametrize("tile", [2048, 16])
def test_cosine(spark, tile):
    rows = awkward()
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i], rows[j]
            if i != j and a[2] is not None and a[2] == b[2] and fine(a[1]) and fine(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                near[i, j] = x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.98
    root = spanning(n, *np.nonzero(near)) if near.any() else np.arange(n)
    want = sorted((rows[i][0], int(near[i].sum()), min(rows[j][0] for j in range(n) if root[j] == root[i])) for i in range(n))
    got = cosine.near_vectors(vectors(spark, rows), tile=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert max(w[1] for w in want) > 9


def test_cosine_without_ids_and_empty(spark):
    rows = [(None, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (None, [0.0, 1.0], 0), (7, [0.0, 2.0], 0), (8, [1.0, 1.0], 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in cosine.near_vectors(vectors(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 1, None), (None, 1, None), (None, 1, 7), (7, 1, 7), (8, 0, 8)], key=str)
    assert cosine.near_vectors(vectors(spark, [])).collect() == []


def brute_nearest(rows, queries, k=10):
    out = {}
    ok = {i: np.array(v) for i, v, _ in rows if fine(v)}
    for q in queries:
        ranked = sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out[q] = ranked[:k]
    return out


def test_nearest_small_blocks_are_exact(spark):
    rows = [r for r in awkward(1) if r[0] != 905]
    frame = vectors(spark, rows)
    got = neighbours.nearest(frame, frame.filter("vec_id % 20 = 0"), share=1.0, block=50).collect()
    want = brute_nearest(rows, [r[0] for r in rows if r[0] % 20 == 0 and fine(r[1])])
    for q, ranked in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, len(ranked) + 1))
        assert [r[1] for r in mine] == [i for _, i in ranked]
        assert np.allclose([r[2] for r in mine], [s for s, _ in ranked], rtol=0, atol=1e-12)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall(spark, sf):
    path = f"/root/testdata/sf{sf}/embeddings.parquet"
    table = spark.read.parquet(path).toPandas()
    x, ids = np.stack(table.embedding.to_numpy()).astype(float), table.vec_id.to_numpy()
    got = neighbours.op9(spark, f"/root/testdata/sf{sf}").toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits.append(len(set(ids[order]) & got[q]) / 10)
    assert np.mean(hits) >= 0.9 and neighbours.SHARE <= 0.3


def test_nearest_hot_vector_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(400)] + [(1000 + i, [1.0, 2.0, 3.0 + i], 0) for i in range(5)]
    frame = vectors(spark, rows)
    got = neighbours.nearest(frame, frame.filter("vec_id in (100, 300, 1004)")).collect()
    by = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (100, 300, 1004)}
    assert by[100] == list(range(10)) and by[300] == list(range(10)) and by[1004][0] == 1003
    assert neighbours.nearest(vectors(spark, []), vectors(spark, [])).collect() == []
    one = vectors(spark, rows[:1])
    assert neighbours.nearest(one, one).collect() == []


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(3, 3), (259, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in [7, *range(200, 260), 300]} == {7}
    assert 3 not in found
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []


def test_cosine_of_very_small_and_very_large_numbers(spark):
    rows = [(1, [1e-200, 1e-200], 0), (2, [1e200, 1.0001e200], 0), (3, [3.0, 3.0], 0), (4, [1e200, -1e200], 0), (5, [5e-324, 5e-324], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cosine.near_vectors(frame).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_forest_ranks_by_summed_prefixes():
    """Candidates are the rows with the longest shared prefixes over all trees, compared with a plain count."""
    rng = np.random.default_rng(4)
    points, asked = rng.normal(size=(300, 16)), rng.normal(size=(7, 16))
    forest = neighbours.Forest(points, trees=12, length=9)
    mine, theirs = forest.strings(points), forest.strings(asked)
    for q, found in enumerate(forest.candidates(asked, least=40, visits=12)):
        same = [[next((p for p in range(9, 0, -1) if a >> (9 - p) == b >> (9 - p)), 0) for a, b in zip(row, theirs[q], strict=True)] for row in mine]
        total = np.array(same).sum(axis=1)
        assert len(set(found)) == 40 and total[found].min() >= np.sort(total)[-40]
