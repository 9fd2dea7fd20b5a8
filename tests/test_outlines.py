import math
import random

import pytest
from pyspark.sql import functions as F
from shapes import line_rows, points, ring_rows

from floodspark.operators import lines, outlines, spatial


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def cells_of(boxes):
    """Covered unit cells of boxes with whole corners, and their groups by shared sides."""
    cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
    groups, rest = 0, set(cells)
    while rest:
        groups, todo = groups + 1, [rest.pop()]
        while todo:
            i, j = todo.pop()
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in rest:
                    rest.remove(n)
                    todo.append(n)
    return len(cells), groups


def test_union_against_cells(spark):
    rng = random.Random(4)
    boxes = {p: [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 7), rng.randint(1, 7)) for _ in range(45)] for p in (1, 2)}
    table = None
    for p, some in boxes.items():
        rings = {i: square(*b) if i % 2 else square(*b)[::-1] for i, b in enumerate(some + some[:5])}
        rows = ring_rows(spark, rings).withColumn("package_id", F.lit(p))
        table = rows if table is None else table.unionByName(rows)
    merged = outlines.merged_outlines(table, 10.0, ["package_id"]).cache()
    got = {r.package_id: (r.n_footprints, round(r.covered_area, 6), r.n_outlines) for r in outlines.outline_counts(table, merged, ["package_id"]).collect()}
    assert got == {p: (50, *cells_of(b)) for p, b in boxes.items()}
    area = lambda r: sum(a.x * b.y - b.x * a.y for a, b in zip(r, r[1:])) / 2
    for r in merged.collect():
        assert (r.ring[0].x, r.ring[0].y) == (r.ring[-1].x, r.ring[-1].y) and (area(r.ring) < 0) == r.is_hole
        assert abs(area(r.ring)) == pytest.approx(r.area) and (r.outer is not None) == r.is_hole


def test_holes_islands_and_touching_corners(spark):
    frame = [square(0, 0, 30, 5), square(0, 25, 30, 5), square(0, 0, 5, 30), square(25, 0, 5, 30), square(12, 12, 3)]
    corner = [square(100, 0, 5), square(105, 5, 5)]
    table = ring_rows(spark, dict(enumerate([*frame, *corner, [(0, 50), (5, 50), (9, 50)], [(1, 1)]])))
    rows = sorted(outlines.merged_outlines(table).collect(), key=lambda r: -r.area)
    assert [(round(r.area, 6), r.is_hole) for r in rows] == [(900, False), (400, True), (25, False), (25, False), (9, False)]
    assert rows[1].outer == rows[0].ring_id and [len(r.ring) for r in rows] == [5] * 5
    assert outlines.merged_outlines(table.limit(0)).count() == 0


def test_rows_of_houses_merge(spark):
    """Sixty houses of which three pairs share a wall give fifty-seven outlines."""
    rings = {i: square(20 * i, 0, 10, 12) for i in range(57)} | {57 + k: square(20 * k + 10, 2, 6, 9) for k in (3, 10, 30)}
    table = ring_rows(spark, rings)
    row = outlines.outline_counts(table, outlines.merged_outlines(table)).first()
    assert (row.n_footprints, row.n_outlines, round(row.covered_area, 6)) == (60, 57, 57 * 120 + 3 * 54)


def test_long_ring(spark):
    n = 300
    ring = [(1000 * math.cos(2 * math.pi * k / n), 1000 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    got = outlines.merged_outlines(ring_rows(spark, {1: ring, 2: ring[::-1]}), tolerance=0.0).collect()
    assert len(got) == 1 and len(got[0].ring) == n + 1 and got[0].area == pytest.approx(n / 2 * 1e6 * math.sin(2 * math.pi / n), rel=1e-6)


def test_clusters_by_package(spark):
    table = ring_rows(spark, {i: square(4 * i, 0, 5) for i in range(6)}).withColumn("package_id", F.col("zone_id") % 2)
    got = {(r.package_id, r.zone_id): r.cluster for r in spatial.footprint_clusters(table, "zone_id", on=["package_id"]).collect()}
    assert got == {(i % 2, i): i for i in range(6)}
    assert {r.cluster for r in spatial.footprint_clusters(table, "zone_id").collect()} == {0}


def test_wide_ring_has_few_tiles(spark):
    """A ring of 100 km: tiles follow the outline, not the area of four million bins."""
    n, r = 40, 50_000.0
    ring = [(r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = ring_rows(spark, {1: ring, 2: square(10, 10, 30)})
    cover = spatial.ring_cover(rings, 50.0, 4).groupBy("level", "inner").agg(F.count("*").alias("n"), F.max(F.size("edges")).alias("e")).collect()
    assert sum(c.n for c in cover) < 40_000 and all(c.e == 0 for c in cover if c.inner) and max(c.e for c in cover) <= 6
    rng = random.Random(1)
    pts = [(i, rng.uniform(-r, r) * 1.05, rng.uniform(-r, r) * 1.05) for i in range(3000)]
    pts += [(3000 + k, x * (1 + d), y * (1 + d)) for k, (x, y) in enumerate(ring) for d in (-1e-9, 1e-9)]
    got = {(h.vid, h.zone_id) for h in spatial.points_in_polygons(points(spark, pts), rings).collect()}

    def inside(px, py, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
            if (ay > py) != (by > py) and px < ax + (py - ay) / (by - ay) * (bx - ax):
                odd = not odd
        return odd

    assert got == {(i, 1) for i, x, y in pts if inside(x, y, ring)} | {(i, 2) for i, x, y in pts if inside(x, y, square(10, 10, 30))}


def test_long_segment_has_few_bins(spark):
    segments = spatial.segments_of(line_rows(spark, {1: [(0, 0), (70_000, 70_001)], 2: [(3, 0), (3, 1000)], 3: [(0, 7), (1000, 7)], 4: [(5, 5), (5, 5)]}))
    bins = {r.line_id: r.n for r in spatial._segment_bins(segments, 50.0).groupBy("line_id").agg(F.count("*").alias("n")).collect()}
    assert bins[1] < 3 * 2 * 1401 and bins[2] <= 42 and bins[3] <= 42 and bins[4] == 1
    clipped = lines.clip_lines(line_rows(spark, {1: [(-70_000, -70_000), (70_000, 70_000)], 2: [(-5, 1), (5, 1)]}),
                               ring_rows(spark, {1: square(-50_000, -50_000, 100_000)}), "line_id", "zone_id").collect()
    assert sorted((r.line_id, round(r.x0, 3), round(r.x1, 3)) for r in clipped) == [(1, -50_000, 50_000), (2, -5, 5)]


def crossing(p, q):
    """Whether two segments with whole end points meet anywhere but in a common end point."""
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    (a, b), (c, d) = p, q
    if max(min(a[0], b[0]), min(c[0], d[0])) > min(max(a[0], b[0]), max(c[0], d[0])) or max(min(a[1], b[1]), min(c[1], d[1])) > min(max(a[1], b[1]), max(c[1], d[1])):
        return False
    s, t, u, v = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    if s * t < 0 and u * v < 0:
        return True
    on = lambda z, m, e: z == 0 and e not in m and min(m[0][0], m[1][0]) <= e[0] <= max(m[0][0], m[1][0]) and min(m[0][1], m[1][1]) <= e[1] <= max(m[0][1], m[1][1])
    return on(s, p, c) or on(t, p, d) or on(u, q, a) or on(v, q, b)


def planar(rows, width):
    """Segments in grid steps, all of them whole numbers, none crossing another."""
    whole = lambda v: round(v / width)
    segments = [((whole(r.x0), whole(r.y0)), (whole(r.x1), whole(r.y1))) for r in rows]
    assert all(abs(whole(v) * width - v) < 1e-6 for r in rows for v in (r.x0, r.y0, r.x1, r.y1))
    assert len({tuple(sorted(s)) for s in segments}) == len(segments)
    return not any(crossing(p, q) for i, p in enumerate(segments) for q in segments[:i])


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / ((dx * dx + dy * dy) or 1.0)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_dense_crossings_stay_in_place(spark):
    """A trunk crossed more often than the floor is wide: nothing moves by more than the floor, and nothing crosses."""
    wanted = {0: [(0.1, 0.13), (10.2, 0.13)]} | {k: [(0.3 * k, -4.0), (0.3 * k, 4.0)] for k in range(1, 31)}
    box = ring_rows(spark, {1: square(-50, -50, 100)})
    for package in (False, True):
        table = line_rows(spark, wanted, near_spacing={k: 2.0 for k in wanted})
        on = []
        if package:
            on = ["package_id"]
            table, box = (t.withColumn("package_id", F.explode(F.array(F.lit(1), F.lit(2)))) for t in (table, box))
        rows = lines.condition_breaklines(table, box, floor=0.5, on=on).collect()
        for p in {r.package_id for r in rows} if package else {None}:
            some = [r for r in rows if not package or r.package_id == p]
            assert planar(some, 0.5)
            for r in some:
                assert math.dist((r.x0, r.y0), (r.x1, r.y1)) >= 0.5 - 1e-9
                for q in ((r.x0, r.y0), (r.x1, r.y1), ((r.x0 + r.x1) / 2, (r.y0 + r.y1) / 2)):
                    assert min(distance(q, *line) for line in wanted.values()) <= 0.5
            for k, (a, b) in wanted.items():  # every line is still there along its whole length
                for i in range(21):
                    q = (a[0] + (b[0] - a[0]) * i / 20, a[1] + (b[1] - a[1]) * i / 20)
                    assert min(distance(q, (r.x0, r.y0), (r.x1, r.y1)) for r in some) <= 0.5


def test_random_lines_become_planar(spark):
    rng = random.Random(8)
    wanted = {k: [(rng.uniform(0, 20), rng.uniform(0, 20)) for _ in range(4)] for k in range(12)}
    rows = lines.condition_breaklines(line_rows(spark, wanted, near_spacing={k: 3.0 for k in wanted}), ring_rows(spark, {1: square(2, 2, 15)}), floor=0.4).collect()
    assert len(rows) > 100 and planar(rows, 0.4)


def test_query_of_conditioned_breaklines(spark):
    """The registered query over its whole table: planar, on the grid, near its own line, and along all of it inside the box."""
    from floodspark.plans.probes import lines as given
    from floodspark.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["condition_breaklines"](spark, sf).collect()
    assert planar(rows, 0.25)
    source = {r.line_id: ([(p.x, p.y) for p in r.line], r.near_spacing or 2.0) for r in given(spark, sf).collect()}
    for r in rows:
        line, spacing = source[r.line_id]
        assert math.dist((r.x0, r.y0), (r.x1, r.y1)) >= 0.25 - 1e-9
        assert min(distance((r.x0, r.y0), a, b) for a, b in zip(line, line[1:])) <= 0.25 + 0.25 * spacing
    left, low = (min(line[0][k] for line, _ in source.values()) for k in (0, 1))
    right, high = (max(line[2][k] for line, _ in source.values()) for k in (0, 1))
    for line, spacing in source.values():
        for a, b in zip(line, line[1:]):
            for i in range(1, 10):
                q = (a[0] + (b[0] - a[0]) * i / 10, a[1] + (b[1] - a[1]) * i / 10)
                if left + 1 < q[0] < right - 1 and low + 1 < q[1] < high - 1:
                    assert min(distance(q, (r.x0, r.y0), (r.x1, r.y1)) for r in rows) <= 0.25 + 0.25 * spacing


def test_bins_of_conditioned_lines_follow_their_segments(spark, monkeypatch):
    """Long lines close together: bins of the default width would hold most of their short segments at once."""
    sizes, cut = [], lines.node_lines
    monkeypatch.setattr(lines, "node_lines", lambda *a, **k: sizes.append(a[2] if len(a) > 2 else k.get("size", spatial.BIN)) or cut(*a, **k))
    table = line_rows(spark, {k: [(1, 1 + k), (49, 2 + k)] for k in range(20)}, near_spacing={k: 1.0 for k in range(20)})
    got = lines.condition_breaklines(table, ring_rows(spark, {7: [(0, 0), (50, 0), (50, 50), (0, 50)]}))
    assert sizes and sizes[0] <= 4.0 and got.select("line_id").distinct().count() == 20


@pytest.mark.parametrize("turn", range(4))
def test_rings_start_at_a_corner(spark, turn, monkeypatch):
    """Wherever the numbering of pieces begins, a vertex within a straight side does not stay."""
    ring = [(0, 0), (5, 0), (10, 0), (10, 10), (0, 10)]
    ring = ring[turn:] + ring[:turn]
    made = ring_rows(spark, {0: ring}).withColumnsRenamed({"zone_id": "ring_id"}).withColumn("n_pieces", F.lit(5))
    monkeypatch.setattr(outlines, "rings_of_pieces", lambda *a: made)
    got = outlines.merged_outlines(ring_rows(spark, {0: ring})).collect()
    assert [len(r.ring) for r in got] == [5] and got[0].ring[0] == got[0].ring[-1] and (got[0].ring[0].x, got[0].ring[0].y) == (0.0, 0.0)
