"""Links and components against all pairs; pruning; coinciding points."""

import numpy as np

from floodspark.llm import covertree


def brute(rows):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = x / np.sqrt(x @ x)
    links = {k: [m for m in good if m != k and len(good[m]) == len(good[k]) and good[k] @ good[m] >= 0.95] for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = None if i is None else min(rows[m][0] for m in seen)
        out.append((i, len(links.get(k, [])), least, i is None or least == i))
    return sorted(out, key=str)


def vectors(n, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(int(i), (centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.05, 0.2, 1.0])).tolist()) for i in range(n)]
    rows += [(n + k, rows[k % 5][1]) for k in range(40)]
    rows += [(n + 50 + k, (np.array(rows[k][1]) * 3).tolist()) for k in range(5)]
    nan, inf = float("nan"), float("inf")
    return rows + [(9001, None), (9002, [0.0] * dims), (9003, [nan] * dims), (9004, [inf] + [1.0] * (dims - 1)), (None, rows[0][1]), (9005, [1.0, 2.0]),
                   (9006, [2.0, 4.0]), (9007, []), (9008, [None] * dims)]


def result(frame):
    return sorted(map(tuple, frame.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_links(spark):
    rows = vectors(400)
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    want = brute(rows)
    assert result(covertree.near_vectors(frame, leaf=16, fan=8)) == want
    assert result(covertree.near_vectors(frame)) == want


def test_points_in_one_direction_are_cut(spark):
    rows = [(i, [float(i + 1), 0.0, 0.0]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(covertree.near_vectors(frame, leaf=8, fan=4)) == sorted(((i, 59, 0, i == 0) for i in range(60)), key=str)


def test_far_leaves_are_pruned(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(16)[i % 16] + rng.normal(size=16) * 0.01).tolist()) for i in range(640)]
    points, levels = covertree.build(covertree.unit_points(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), 40, 64)
    leaves = points.select("node").distinct().count()
    assert leaves >= 16
    assert covertree.leaf_pairs(points, levels, float(np.sqrt(0.1))).count() < leaves * leaves / 6


def test_cover_is_nested_and_covers():
    x = np.random.default_rng(2).normal(size=(300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small, large = covertree.cover(x, 16), covertree.cover(x, 64)
    assert (large[:len(small)] == small).all() or len(small) <= len(large)
    near = np.sqrt(((x[:, None] - x[large][None]) ** 2).sum(-1)).min(1)
    assert near.max() < 1.0


def test_no_rows(spark):
    assert covertree.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_all_pairs_of_leaves_without_a_shuffle(spark):
    """Where every leaf meets every other, leaves are read by parts; where few do, they are joined; both are whole."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=40))]) for i in range(300)]
    rows += [(300 + i, [float(x) for x in np.float32(np.array(rows[i][1]) + rng.normal(size=40) * 0.1)]) for i in range(80)]
    rows += [(400 + i, [float(x) for x in np.float32(np.array(rows[7][1]) + rng.normal(size=40) * 0.02)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    points, levels = covertree.build(covertree.unit_points(frame), 16, 64)
    pairs = covertree.leaf_pairs(points, levels, float(np.sqrt(0.1)))
    leaves = points.select("node").distinct().count()
    assert pairs.count() > 4 * leaves
    seen = []
    for few, exchanges in ((2.0, False), (1e9, True)):
        joined = covertree.compared(points, pairs, few)
        if not exchanges:
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" in plan and "Exchange" not in plan
        found = joined.mapInArrow(lambda batches: covertree._linked(batches, 0.95), "rep long, n long, low long")
        assert joined.count() == pairs.count()
        seen.append({r.rep: r.n for r in found.groupBy("rep").agg({"n": "sum"}).toDF("rep", "n").collect()})
    assert seen[0] == seen[1] == {i: n for i, n, _, _ in brute(rows) if n}
    assert len(points.select("vector").first()[0]) == 4 * 40


def test_marks_that_meet_are_drawn_anew(spark, monkeypatch):
    right = covertree.marked
    monkeypatch.setattr(covertree, "marked", lambda v, seed: right(v, seed) * 0 if seed < 1 else right(v, seed))
    rows = vectors(60)
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    assert result(covertree.near_vectors(frame)) == brute(rows)
