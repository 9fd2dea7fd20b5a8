import math

import numpy as np
import pytest

from floodspark.llm import segments

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, n_positives=5, k=10):
    good = {(i, label, tuple(math.floor(256.0 * float(np.float32(x))) for x in v)) for i, v, label, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if len(w) == len(v)), key=lambda t: t[:2])
        for p, j, _ in [t for t in scored if t[2] == label and t[1] != i][:n_positives]:
            found = [(-n, m) for n, m, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p][:k]
            out += [(i, j, r + 1, m, -p, n) for r, (n, m) in enumerate(found)]
    return sorted(out)


def collected(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == names
    return sorted(tuple(r) for r in df.collect())


def vectors_of(seed, n, dim, labels, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    of = rng.integers(0, labels, n)
    x = centres[of] * 0.6 + rng.normal(size=(n, dim))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * scale
    return [(i, [float(c) for c in v], int(label)) for i, (v, label) in enumerate(zip(x, of))]


def test_against_all_pairs(spark):
    rows = vectors_of(2, 700, 24, 4)
    rows += [(1000 + i, rows[3][1], i % 2) for i in range(90)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = collected(segments.hard_negatives(frame, every=20, rows=64, block=7, lane=200))
    assert got == brute(rows, 20) and len(got) > 500


@pytest.mark.parametrize("dim", [1, 3, 64, 65])
def test_bounds_hold_and_tighten(dim):
    rng = np.random.default_rng(dim)
    a, b = (np.floor(rng.normal(size=(n, dim)) * 300 + rng.normal(size=(n, 1)) * 500) for n in (40, 50))
    exact, width = a @ b.T, np.inf
    for left, right in zip(segments.summaries(a), segments.summaries(b)):
        low, high = segments.bounds([x.astype(np.float32) for x in left], [x.astype(np.float32) for x in right])
        assert (low <= exact).all() and (exact <= high).all()
        assert (high - low).mean() <= width + 1
        width = (high - low).mean()


def test_summaries_leave_out_rows():
    rng = np.random.default_rng(4)
    near = np.floor(100 + rng.normal(size=(30, 32)))
    far = np.floor(-100 + rng.normal(size=(300, 32)))
    make = lambda t: segments.Block(dict(zip(("ids", "labels", "vectors", "summaries"), segments.binaries(np.arange(len(t)), np.zeros(len(t)), t.astype(np.int64))), size=len(t), dim=32))
    anchors, rows = make(near[:5]), make(np.concatenate([near, far]))
    a, r = segments.survivors(anchors, rows, np.arange(5), np.arange(330), np.full(5, 1e5), np.full(5, np.inf))
    assert len(a) == 5 and r.tolist() == list(range(30))


def test_large_components_stay_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(np.random.default_rng(1).normal(size=(60, 6)) * 2e5)]
    assert collected(segments.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=6)) == brute(rows, 6)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors_of(9, 40, 6, 2) + [(100, None, 1), (101, [nan] * 6, 1), (102, [inf] * 6, 1), (103, [None] * 6, 0), (None, [0.5] * 6, 1),
                                      (104, [0.5] * 6, None), (105, [0.0] * 6, 0), (110, [], 1), (120, [1.0, 2.0], 0), (121, [1.0, 2.0], 0), (122, [0.5, 1.0], 1)]
    rows += [rows[0], rows[0], (0, rows[1][1], 1), (0, rows[2][1], 0)]
    frame = spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA + ", dim long, part string, rank int")
    assert collected(segments.hard_negatives(frame, every=10)) == brute(rows, 10)
    assert collected(segments.hard_negatives(frame.limit(0))) == []
    lone = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], SCHEMA)
    assert collected(segments.hard_negatives(lone)) == []


def test_blocks_of_rows_are_not_shuffled(spark):
    rows = vectors_of(5, 400, 16, 3)
    whole = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = segments.stored(segments.packed(whole, 32), "blocks")
    anchors = segments.stored(segments.grouped_anchors(whole, 10, 8), "anchors")
    joined = segments.beside(blocks, anchors)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
    assert joined.count() == blocks.count() * anchors.count()


def test_many_anchors_in_a_block(spark):
    """A few anchors go first; where they keep most rows, all are compared."""
    rows = vectors_of(12, 300, 24, 3) + [(500 + i, [0.0] * 24, i % 3) for i in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert collected(segments.hard_negatives(frame, every=2, rows=64)) == brute(rows, 2)


def test_merged_lists_are_those_of_whole_tables():
    rng = np.random.default_rng(6)
    whole, few = segments.Top(7, 4), segments.Top(7, 4)
    for part in range(5):
        scores, ids = rng.integers(0, 9, (7, 12)), np.arange(12) + 12 * part
        scores[rng.random((7, 12)) < 0.6] = segments.NONE
        whole.add(np.arange(7), scores, ids)
        row, column = np.nonzero(scores > segments.NONE)
        if len(row):
            few.merge(row, scores[row, column], ids[column])
    full = whole.scores > segments.NONE
    assert (whole.scores == few.scores).all() and (whole.ids[full] == few.ids[full]).all()
