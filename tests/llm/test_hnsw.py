import math

import numpy as np

from floodspark.llm import hnsw


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + extra)


def brute(rows, every, k):
    """All candidates by exact distance, of usable rows with a key."""
    good = [(i, np.float64(np.float32(v))) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for i, v in good:
        if i % every == 0:
            found = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in good if j != i and len(v) == len(w))
            out[i] = [(j, d) for d, j in found[:k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_over_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 24)) * 0.7
    rows = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(x)]
    vectors = frame(spark, rows).repartition(5)
    index = hnsw.build(vectors, shard_rows=700)
    assert index.count() == 5
    got = collected(hnsw.search(index, vectors.filter("vec_id % 20 = 0"), block_rows=40))
    want = brute(rows, 20, 10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.97 * 10 * len(want)
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (p[1], p[0]))
        assert all(abs(d - float(np.sqrt(((np.float64(np.float32(x[q])) - np.float64(np.float32(x[j]))) ** 2).sum()))) == 0 for j, d in found)


def test_walk_visits_part_of_a_shard():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 8)).astype(np.float32)
    nodes, layers = hnsw.graph(x, np.arange(4000))
    assert [len(n) for n in nodes] == sorted((len(n) for n in nodes), reverse=True) and len(nodes) >= 3
    assert all((layer < len(n)).all() and layer.shape[0] == len(n) for n, layer in zip(nodes, layers))
    places = hnsw.walk(x, nodes, layers, x[:200], 32)
    gaps = hnsw.pairwise(x[:200], x)
    want = np.argsort(gaps, 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(places, want)]) >= 9.8


def test_copies_ties_and_few_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same, 1) for i in range(0, 60)] + [(100, [1.0, 2.0, 4.0], 1), (101, [1.0, 2.0, 2.0], 1), (0, same, 1), (200, [1.0, 2.0], 2), (300, [5.0] * 4, 2), (301, [5.0] * 4, 2)]
    got = collected(hnsw.nearest_vectors(frame(spark, rows).repartition(3), every=10))
    want = brute(rows, 10, 10)
    assert got == {q: v for q, v in want.items() if v}
    assert got[20][0] == (0, 0.0) and [j for j, _ in got[0]] == list(range(1, 11)) and got[300] == [(301, 0.0)] and 200 not in got


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], None), (10, None, 1), (20, [0.0, 0.0], 1), (30, [nan, 1.0], 1), (40, [inf, 1.0], 1), (50, [None, 1.0], 1),
            (None, [1.0, 0.1], 1), (60, [], 1), (7, [0.5, 0.0], 1), (70, [-0.0, 1.0], 1), (80, [0.0, 1.0], 1)]
    vectors = frame(spark, [(*r, "x", 9, 1.5) for r in rows], ", dim string, rank int, score double")
    got = collected(hnsw.nearest_vectors(vectors, every=10))
    assert got == brute(rows, 10, 10) and set(got) == {0, 70, 80}
    assert hnsw.nearest_vectors(vectors.limit(0)).collect() == []
