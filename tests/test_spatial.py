import math
import random

import pytest
from shapes import line_rows, points, ring_rows
from pyspark.sql import functions as F

from floodspark.operators import inputs, lines, nearest, spatial

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def inside(spark, ring, x, y, size=4.0):
    return spatial.points_in_polygons(points(spark, [(1, x, y)]), ring_rows(spark, {1: ring}), size).count() == 1


@pytest.mark.parametrize("ring,x,y,want", [
    (SQUARE, 5, 5, True), (SQUARE, 0, 0, False), (SQUARE, 5, 0, False), (SQUARE, 10, 5, False), (SQUARE, 11, 5, False),
    (SQUARE, -1, 5, False), ([(0, 0), (10, 0), (5, 10)], 4, 3, True), ([(0, 0), (10, 0), (5, 10)], 0, 10, False),
    ([(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)], 4.5, 6, False),
    ([(0, 0), (9, 0), (9, 9), (6, 9), (6, 3), (3, 3), (3, 9), (0, 9)], 7.5, 6, True)])
def test_strict_interior(spark, ring, x, y, want):
    assert inside(spark, ring, x, y) is want


def test_points_in_polygons_matches_brute_force(spark):
    rng = random.Random(3)
    rings = {}
    for k in range(6):
        cx, cy, n = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.randint(3, 25)
        rings[k] = [(cx + rng.uniform(5, 30) * math.cos(2 * math.pi * i / n), cy + rng.uniform(5, 30) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    pts = [(i, rng.uniform(-80, 80), rng.uniform(-80, 80)) for i in range(300)]

    def brute(ring, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
        return odd

    want = {(i, k) for i, x, y in pts for k, r in rings.items() if brute(r, x, y)}
    for size in (7.0, 50.0, 1000.0):
        got = spatial.points_in_polygons(points(spark, pts), ring_rows(spark, rings), size)
        assert {(r.vid, r.zone_id) for r in got.collect()} == want


def test_lines_inside(spark):
    table = line_rows(spark, {1: [(1, 1), (9, 9)], 2: [(1, 1), (11, 1)], 3: [], 4: [(0, 5), (5, 5)]})
    table = table.unionByName(spark.sql("select 5L line_id, array(struct(1D x, cast(null as double) y)) line"))
    got = {r.line_id: (r.inside, r.status) for r in
           spatial.lines_inside_polygon(table, ring_rows(spark, {7: SQUARE}), "line_id", "zone_id").collect()}
    assert got[1] == (True, "ok") and got[2] == (False, "ok") and got[3] == (False, "ok") and got[4] == (False, "ok")
    assert got[5][0] is None and got[5][1].startswith("error")


def test_breakline_bands(spark):
    pts = points(spark, [(1, 5, 1.5), (2, 5, 2.0), (3, 5, 3), (4, 5, 7.9), (5, 5, 16), (6, 5, 16.5)])
    got = {r.vid: round(r.target_area, 2) for r in spatial.breakline_grading(
        pts, line_rows(spark, {1: [(0, 0), (10, 0)]}, near_spacing={1: 2.0}), 20.0).collect()}
    assert got == {1: 1.73, 2: 1.73, 3: 6.93, 4: 27.71, 5: 110.85}
    zero = spatial.breakline_grading(pts, line_rows(spark, {1: [(0, 0), (10, 0)]}, near_spacing={1: 0.0}), 20.0)
    assert {r.vid for r in zero.collect()} == {1, 2, 3, 4, 5}


def test_band_of_a_place_far_from_the_origin(spark):
    """The place of sf0.1 that is two metres off but for rounding: the distance from the offset decides."""
    x, y, ax, ay, dx, dy = 420.0, 1330.5, 400.0, 1320.0, 60.0, 25.0
    u = ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)
    d = math.sqrt((x - ax - u * dx) ** 2 + (y - ay - u * dy) ** 2)
    assert d > 2.0 > math.hypot(x - (ax + u * dx), y - (ay + u * dy))
    got = spatial.breakline_grading(points(spark, [(1, x, y)]), line_rows(spark, {1: [(ax, ay), (ax + dx, ay + dy)]}, near_spacing={1: 2.0}), 20.0).first()
    assert got.distance == d and got.target_area == pytest.approx(4.0 * 4.0 * math.sqrt(3.0) / 4.0)


def test_clip_at_boundary(spark):
    box = [(0, 0), (100, 0), (100, 100), (0, 100)]
    got = lines.clip_lines(line_rows(spark, {1: [(-50, 50), (150, 50)], 2: [(200, 0), (200, 9)]}), ring_rows(spark, {1: box}), "line_id", "zone_id").collect()
    assert [(r.line_id, r.x0, r.x1) for r in got] == [(1, 0.0, 100.0)]


def test_clip_concave_gives_two_parts(spark):
    u = [(0, 0), (90, 0), (90, 90), (60, 90), (60, 30), (30, 30), (30, 90), (0, 90)]
    got = lines.clip_lines(line_rows(spark, {1: [(-10, 60), (100, 60)]}), ring_rows(spark, {1: u}), "line_id", "zone_id")
    assert sorted((round(r.x0, 6), round(r.x1, 6)) for r in got.collect()) == [(0, 30), (60, 90)]


def test_node_at_crossing(spark):
    table = line_rows(spark, {1: [(0, 0), (100, 100)], 2: [(0, 100), (100, 0)], 3: [(0, 100), (100, 0)]})
    got = sorted((r.line_id, r.x0, r.y0, r.x1, r.y1) for r in lines.node_lines(table, "line_id").collect())
    assert len(got) == 6 and {g[1:] for g in got if g[0] == 1} == {(0, 0, 50, 50), (50, 50, 100, 100)}
    assert [g[1:] for g in got if g[0] == 2] == [g[1:] for g in got if g[0] == 3]


def test_node_lines_in_crowded_bins(spark):
    rng = random.Random(5)
    segs = {i: [(rng.uniform(0, 10), rng.uniform(0, 10)), (rng.uniform(0, 10), rng.uniform(0, 10))] for i in range(40)}
    table = line_rows(spark, segs)
    count = lambda df: {r.line_id: r.n for r in df.groupBy("line_id").agg(F.count("*").alias("n")).collect()}
    crowded = count(lines.node_lines(table, "line_id", 50.0, limit=8, depth=4))
    assert crowded == count(lines.node_lines(table, "line_id", 50.0, limit=10 ** 6))

    def cross(p, q):
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = *p, *q
        det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det
        u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
        return 0 < t < 1 and 0 < u < 1

    assert crowded == {i: 1 + sum(cross(segs[i], segs[j]) for j in segs if j != i) for i in segs}


def test_densify(spark):
    got = spatial.densify_polyline(line_rows(spark, {1: [(0, 0), (25, 0), (25, 5)]}), "line_id", 10.0).orderBy("seg", "part").collect()
    assert [(round(r.x, 4), r.y) for r in got] == [(0, 0), (8.3333, 0), (16.6667, 0), (25, 0), (25, 5)]


def fold(pts, floor):
    if not pts:
        return None
    kept = [pts[0]]
    for p in pts[1:-1]:
        if math.dist(p, kept[-1]) >= floor:
            kept.append(p)
    if len(kept) >= 2 and math.dist(pts[-1], kept[-1]) < floor:
        kept[-1] = pts[-1]
    else:
        kept.append(pts[-1])
    length = sum(math.dist(a, b) for a, b in zip(kept, kept[1:]))
    return kept if length >= floor else None


def test_dedupe_against_fold(spark):
    rng = random.Random(1)
    table = {0: [(0, 0), (0.05, 0)], 1: [(0, 0), (0, 0), (5, 0), (10, 0), (10.1, 0)], 2: [(3, 3)]}
    for k in range(3, 30):
        x, pts = 0.0, []
        for _ in range(rng.randint(2, 30)):
            x += rng.uniform(0, 1)
            pts.append((x, rng.uniform(0, 0.5)))
        table[k] = pts
    got = {r.line_id: [(p.x, p.y) for p in r.line] for r in lines.dedupe_polyline(line_rows(spark, table), 0.5).collect()}
    assert got == {k: v for k, v in ((k, fold(p, 0.5)) for k, p in table.items()) if v}


def test_drop_collinear(spark):
    got = lines.drop_collinear(line_rows(spark, {1: [(0, 0), (5, 0.1), (10, 0)], 2: [(0, 0), (5, 3), (10, 0)]}), 2.0).collect()
    assert {r.line_id: len(r.line) for r in got} == {1: 2, 2: 3}


def test_segment_floor():
    assert lines.segment_floor() == 0.5 and lines.segment_floor(1.0) == 0.25 and lines.segment_floor(0.0) == 1e-3


def test_footprint_clusters(spark):
    box = lambda x, y, n=10: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    rings = {1: box(0, 0), 2: box(10, 0), 3: box(20, 10), 4: box(50, 50), 5: box(52, 52, 2), 6: box(80, 0), 7: box(300, 300)}
    got = {r.zone_id: r.cluster for r in spatial.footprint_clusters(ring_rows(spark, rings), "zone_id").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_components_of_long_chain_and_hub(spark):
    n = 200
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    hub = spark.range(1001, 1500).select(F.lit(1000).cast("long").alias("a"), F.col("id").alias("b"))
    nodes = spark.range(n).unionByName(spark.range(1000, 1501))
    got = spatial.connected_components(nodes, chain.unionByName(hub), "id").groupBy("cluster").count().collect()
    assert {r["cluster"]: r["count"] for r in got} == {0: 200, 1000: 500, 1500: 1}


def brute_knn(queries, pts, k):
    out = set()
    for q, qx, qy in queries:
        near = sorted(((px - qx) * (px - qx) + (py - qy) * (py - qy), p) for p, px, py in pts)[:k]
        out |= {(q, p, i + 1) for i, (_, p) in enumerate(near)}
    return out


@pytest.mark.parametrize("case", ["spread", "hot", "same", "few"])
def test_k_nearest_against_brute_force(spark, case, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(nearest, "LEAF_LIMIT", 32)
    spread = [(i, rng.uniform(0, 1000), rng.uniform(0, 300)) for i in range(300)]
    pts = {"spread": spread, "few": spread[:2],
           "hot": spread + [(1000 + i, 500 + rng.uniform(0, 1e-3), 100 + rng.uniform(0, 1e-3)) for i in range(150)],
           "same": spread + [(1000 + i, 400.0, 100.0) for i in range(150)]}[case]
    queries = [(i, rng.uniform(-200, 1200), rng.uniform(-100, 400)) for i in range(40)] + [(100, 400.0, 100.0), (101, 1e5, 1e5), (102, 500.0, 100.0)]
    got = nearest.k_nearest(points(spark, queries, "q"), points(spark, pts), 3, ["q"], "vid")
    assert {(r.q, r.vid, r["rank"]) for r in got.collect()} == brute_knn(queries, pts, 3)


def test_grid_knn_masks_and_weights(spark):
    v = spark.createDataFrame([(1, 5.0, 5.0, 4.0), (2, 15.0, 5.0, 8.0), (3, 25.0, 5.0, 0.0)], "vid long, x double, y double, z double")
    box = spark.createDataFrame([(0.0, 30.0, 0.0, 10.0)], "min_x double, max_x double, min_y double, max_y double")
    cells = nearest.grid_cells(box, 10.0)
    ring = ring_rows(spark, {1: [(0, 0), (20, 0), (20, 10), (0, 10)]})
    got = {r.col_no: r.value for r in nearest.grid_knn(v, cells, "z", k=2, boundary=ring).collect()}
    assert got[0] == 4.0 and got[1] == 8.0 and math.isnan(got[2])


def test_scorecard(spark):
    rows = [(1, 0.05), (2, -0.1), (3, 0.3), (4, 0.31)]
    peaks = spark.createDataFrame([(i, float(i * 10), 0.0, 10.0 + d) for i, d in rows], "vid long, x double, y double, peak_stage double")
    obs = spark.createDataFrame([(i, i * 10 + 0.5, 0.5, 10.0, 0.3000001) for i, _ in rows], "gauge_id long, x double, y double, field_stage double, tolerance double")
    total = nearest.score_totals(nearest.gauge_scorecard(obs, peaks)).first()
    assert (total.n, total.n_pass, total.all_pass) == (4, 3, False)
    assert total.bias == pytest.approx(0.14) and total.rmse == pytest.approx(math.sqrt(sum(d * d for _, d in rows) / 4))


def structures(spark, rows):
    table = [(i, m, h, [{"x": float(x), "y": float(y)} for x, y in r]) for i, m, h, r in rows]
    return spark.createDataFrame(table, "structure_id long, method string, raised_height double, ring array<struct<x:double,y:double>>")


def test_friction_precedence(spark):
    pts = points(spark, [(1, 5, 5), (2, 15, 5), (3, 50, 50)])
    s = structures(spark, [(1, "Mannings", None, SQUARE)])
    zones = ring_rows(spark, {1: [(0, 0), (20, 0), (20, 10), (0, 10)], 2: [(12, 0), (20, 0), (20, 10), (12, 10)]}).withColumn(
        "mannings", F.when(F.col("zone_id") == 1, 0.1).otherwise(0.02)).withColumn("seq", F.col("zone_id"))
    got = {r.vid: r.mannings for r in inputs.assign_friction(pts, s, zones).collect()}
    assert got == {1: 10.0, 2: 0.1, 3: 0.04}
    raster = spark.createDataFrame([(1, 0.5), (2, 0.6)], "vid long, n double")
    got = {r.vid: r.mannings for r in inputs.assign_friction(pts, s, zones, raster).collect()}
    assert got == {1: 10.0, 2: 0.6, 3: None}


def test_raised_adds_up(spark):
    pts = points(spark, [(1, 5, 5), (2, 8, 8), (3, 50, 50)]).withColumn("elevation", F.lit(1.0))
    s = structures(spark, [(1, "Raised", None, SQUARE), (2, "Raised", 2.0, [(7, 7), (9, 7), (9, 9), (7, 9)]), (3, "Reflective", 9.0, SQUARE)])
    got = {r.vid: r.elevation for r in inputs.apply_raised(pts, s).collect()}
    assert got == {1: 6.0, 2: 8.0, 3: 1.0}
    assert inputs.apply_raised(pts, s, 3.0).where("vid = 1").first().elevation == 4.0


def test_nodes_and_runoff(spark):
    catchments = ring_rows(spark, {1: SQUARE, 2: [(20, 0), (30, 0), (30, 10), (20, 10)], 3: [(40, 0), (50, 0), (50, 10), (40, 10)]}, "catchment_id").withColumn("package_id", F.lit(1))
    nodes = points(spark, [(7, 5, 5), (8, 22, 5), (9, 28, 5)], "node_id")
    got = {r.catchment_id: (r.n_nodes, r.node_id, r.status.split(":")[0]) for r in inputs.assign_nodes(catchments, nodes).collect()}
    assert got == {1: (1, 7, "ok"), 2: (2, None, "error"), 3: (0, None, "skipped")}
    rain = spark.createDataFrame([(1, 1, "3.6"), (2, 1, "99")], "feature_id long, package_id long, data string")
    flow = {r.catchment_id: r.flow_m3_s for r in inputs.catchment_runoff(catchments, rain).collect()}
    assert flow[1] == pytest.approx(1e-4)
    made = inputs.catchment_inflows(catchments, nodes, rain).collect()
    assert [(r.catchment_id, r.node_id) for r in made] == [(1, 7)]


def test_boundary_ring_of_square(spark):
    sides = {1: [(0, 0), (0, 10)], 2: [(0, 10), (10, 10)], 3: [(10, 10), (10, 0)], 4: [(10, 0), (0, 0)]}
    f = line_rows(spark, sides, "feature_id").withColumn("package_id", F.lit(1)).withColumn(
        "location", F.lit("External")).withColumn("boundary", F.concat(F.lit("side"), "feature_id"))
    ring = inputs.boundary_ring(f).orderBy("ring_seq").collect()
    assert len(ring) == 8 and [r.ring_seq for r in ring] == list(range(8))
    assert len({r.boundary for r in ring}) == 4
    # Clockwise from the upper left: each corner twice.
    assert [(r.x, r.y) for r in ring] == [(0, 10), (0, 10), (10, 10), (10, 10), (10, 0), (10, 0), (0, 0), (0, 0)]
    none = inputs.boundary_extent(f.withColumn("location", F.lit("Internal"))).first()
    assert none.status.startswith("error")
    assert inputs.boundary_ring(f.withColumn("crs", F.lit(None).cast("string"))).count() == 0


def test_condition_breaklines(spark):
    box = ring_rows(spark, {1: [(0, 0), (100, 0), (100, 100), (0, 100)]})
    table = line_rows(spark, {1: [(-50, 50), (20, 50.01), (150, 50)], 2: [(50, 10), (50, 10), (50, 90)], 3: [(5, 5), (5.05, 5)], 4: [(200, 200), (300, 300)]},
                      near_spacing={1: 10.0, 2: 10.0, 3: 10.0, 4: 10.0})
    got = lines.condition_breaklines(table, box).collect()
    assert {r.line_id for r in got} == {1, 2}
    length = lambda k: sum(math.dist((r.x0, r.y0), (r.x1, r.y1)) for r in got if r.line_id == k)
    assert length(1) == pytest.approx(100, abs=0.01) and length(2) == pytest.approx(80, abs=0.01)
    assert max(math.dist((r.x0, r.y0), (r.x1, r.y1)) for r in got) <= 10.0001
    ends = lambda k: {(round(x, 5), round(y, 5)) for r in got if r.line_id == k for x, y in ((r.x0, r.y0), (r.x1, r.y1))}
    assert len(ends(1) & ends(2)) == 1 and (50.0, 50.00) == tuple(round(v, 1) for v in (ends(1) & ends(2)).pop())


def test_densified_matches_table_form(spark):
    table = line_rows(spark, {1: [(0, 0), (25, 0), (25, 5)]})
    one = table.select(lines.densified(F.col("line"), F.lit(10.0)).alias("v")).first().v
    many = spatial.densify_polyline(table, "line_id", 10.0).orderBy("seg", "part").collect()
    assert [(round(p.x, 9), round(p.y, 9)) for p in one] == [(round(r.x, 9), round(r.y, 9)) for r in many]


def test_boundary_filters(spark):
    df = spark.createDataFrame([("External", "Time"), ("Internal", "Time"), ("External", "Reflective")], "location string, boundary string")
    assert inputs.external_boundaries(df).count() == 2 and inputs.time_boundaries(df).count() == 1


def test_copies_count_once_and_whole(spark):
    rings = {i: SQUARE for i in range(50)}
    pts = points(spark, [(1, 5, 5), (2, 50, 50)]).withColumn("elevation", F.lit(0.0))
    s = structures(spark, [(i, "Raised", 1.0, r) for i, r in rings.items()])
    assert {r.vid: (r.elevation, r.n_structures) for r in inputs.apply_raised(pts, s).collect()} == {1: (50.0, 50), 2: (0.0, 0)}
    assert inputs.raised_structures_hit(pts, s).count() == 50
    clusters = spatial.footprint_clusters(ring_rows(spark, rings), "zone_id")
    assert spatial.merged_counts(clusters).first() == (50, 1)
    nodes = points(spark, [(i, 5, 5) for i in range(20)], "node_id")
    assert {r.n_nodes for r in inputs.assign_nodes(ring_rows(spark, rings, "catchment_id"), nodes).collect()} == {20}


def test_unknown_methods_are_reported(spark):
    s = structures(spark, [(1, "Fenced", None, SQUARE), (2, None, None, SQUARE)])
    assert [(r.structure_id, r.method) for r in inputs.unknown_structures(s, ["structure_id"]).collect()] == [(1, "Fenced")]


def test_shuffle_size(spark):
    from floodspark.session import size_shuffles

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        assert size_shuffles(spark, 10 * 2 ** 40) == 81920 and spark.conf.get(key) == "81920"
    finally:
        spark.conf.unset(key)


def test_nearest_deals_queries_over_tasks(spark, monkeypatch):
    """The number of tasks follows the queries, so what one of them sorts does not."""
    rng = random.Random(8)
    at = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(200)]
    queries, places = points(spark, at, "gauge_id"), points(spark, [(k, y, x) for k, x, y in at])
    monkeypatch.setattr(nearest, "TASK_QUERIES", 10)
    found = nearest.k_nearest(queries, places, 1, ["gauge_id"], "vid")
    assert found.rdd.getNumPartitions() >= 20
    want = {k: min(at, key=lambda p: ((p[2] - x) ** 2 + (p[1] - y) ** 2, p[0]))[0] for k, x, y in at}
    assert {r.gauge_id: r.vid for r in found.collect()} == want
