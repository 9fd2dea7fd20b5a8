"""Packages that share an area, files read back whole, exact extremes, chords, overlaps, silences."""

import math

import pytest
from pyspark.sql import functions as F

from shapes import line_rows, points, ring_rows
from floodspark import sources
from floodspark.functions import epsg_code
from floodspark.operators import inputs, lines, nearest, ordered, results, spatial
from floodspark.streaming import live

BOX = [(0, 0), (10, 0), (10, 10), (0, 10)]


def packed(df, package):
    return df.withColumn("package_id", F.lit(package))


def test_no_package_touches_another(spark):
    cells = packed(points(spark, [(1, 5, 5)]), 1).union(packed(points(spark, [(1, 5, 5)]), 2)).withColumn("elevation", F.lit(0.0))
    house = packed(ring_rows(spark, {9: BOX}, "structure_id"), 1)
    on = ["package_id"]
    friction = inputs.assign_friction(cells, house.withColumn("method", F.lit("Mannings")), on=on)
    assert {(r.package_id, r.mannings) for r in friction.collect()} == {(1, 10.0), (2, 0.04)}
    raised = house.withColumn("method", F.lit("Raised")).withColumn("raised_height", F.lit(3.0))
    assert {(r.package_id, r.elevation) for r in inputs.apply_raised(cells, raised, on=on).collect()} == {(1, 3.0), (2, 0.0)}
    area = spatial.target_area(cells, house.withColumn("resolution", F.lit(1.0)), 5.0, on=on)
    assert {(r.package_id, r.target_area) for r in area.collect()} == {(1, 1.0), (2, 12.5)}
    both = house.union(packed(ring_rows(spark, {9: BOX}, "structure_id"), 2)).withColumnRenamed("structure_id", "zone_id")
    crossing = packed(line_rows(spark, {1: [(-5, 5), (15, 5)]}), 1)
    assert {r.package_id for r in spatial.clip_lines(crossing, both, "line_id", "zone_id", on=on).collect()} == {1}
    inside = spatial.lines_inside_polygon(packed(line_rows(spark, {1: [(1, 1), (2, 2)]}), 2), house, "line_id", "structure_id", on=on)
    assert inside.first().inside is False
    other = packed(line_rows(spark, {2: [(5, -5), (5, 15)]}), 2)
    assert spatial.node_lines(crossing.union(other), "line_id", on=on).count() == 2
    assert spatial.node_lines(crossing.union(other), "line_id").count() == 4
    nodes = packed(points(spark, [(4, 5, 5)], "node_id"), 2)
    assert inputs.assign_nodes(house.withColumnRenamed("structure_id", "catchment_id"), nodes, on=on).first().n_nodes == 0
    near = packed(line_rows(spark, {1: [(0, 0), (10, 0)]}), 1).withColumn("near_spacing", F.lit(1.0))
    assert {r.package_id for r in spatial.breakline_grading(cells, near, 20.0, on=on).collect()} == {1}


def test_runs_are_compared_pair_by_pair(spark):
    rows = [(p, s, 0, 0, float(p * s)) for p in (1, 2) for s in (10, 20)]
    a = spark.createDataFrame(rows, "pair long, step long, row_no long, col_no long, value double")
    got = results.compare_runs(a, a.withColumn("value", F.col("value") + F.col("pair")), ["pair"]).collect()
    assert sorted((r.pair, r.frame, r["diff"]) for r in got) == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 2.0), (2, 2, 2.0)]


def test_extremes_of_all_numbers(spark):
    rows = []
    for k in range(-30, 60):
        rows += [(f"up{k}", 10**16 + 1, 2.0**k), (f"up{k}", 3, math.nextafter(2.0**k, 0.0))]
    rows += [("neg", 1, -5.0), ("neg", 2, -1.0), ("big", 1, 1e300), ("big", 2, 1e301), ("tiny", 1, 1e-300), ("tiny", 2, 1e-299), ("tie", 8, 2.0), ("tie", 7, 2.0), ("nan", 1, float("nan")), ("nan", 2, 0.5)]
    df = spark.createDataFrame(rows, "k string, id long, v double")
    top = {r.k: r.at for r in ordered.row_at_extreme(df.withColumn("at", F.col("id")), ["k"], "v", "id", ["at"], True).collect()}
    assert all(top[f"up{k}"] == 10**16 + 1 for k in range(-30, 60))
    assert (top["neg"], top["big"], top["tiny"], top["tie"], top["nan"]) == (2, 2, 2, 7, 2)
    low = {r.k: r.at for r in ordered.row_at_extreme(df.withColumn("at", F.col("id")), ["k"], "v", "id", ["at"], False).collect()}
    assert (low["neg"], low["tie"], low["up3"]) == (1, 7, 3)
    by = {r.k: r.i for r in df.groupBy("k").agg(F.max_by("id", ordered.first_at_max(F.col("v"), F.col("id"))).alias("i")).collect()}
    assert by == top


def test_summaries_and_diagnostics_come_back_whole(spark, tmp_path):
    rows = spark.range(6).select(F.concat(F.lit("run_"), "id").alias("run_label"), F.lit("completed").alias("outcome"))
    doc = sources.nest_run_summary(rows)
    sources.write_run_summaries(doc.coalesce(1), str(tmp_path / "s"))
    pretty = '{\n  "schema_version": "1",\n  "run": {\n    "run_label": "run_9",\n    "outcome": "error"\n  }\n}\n'
    (tmp_path / "s" / "one.json").write_text(pretty)
    (tmp_path / "s" / "old.json").write_text('{"schema_version": "0", "run": {"run_label": "run_0"}}')
    back = {(r.run.run_label, r.status) for r in sources.read_run_summaries(spark, str(tmp_path / "s")).collect()}
    assert back == {(f"run_{k}", "ok") for k in (0, 1, 2, 3, 4, 5, 9)} | {("run_0", "error: schema version 0")}
    names = [f.name for f in sources.files.S.DIAGNOSTICS.fields]
    table = spark.range(8).select(F.concat(F.lit("1_1_"), F.col("id") % 2).alias("run"), (F.col("id") % 3).alias("batch_number"),
                                  *[F.col("id").cast(f.dataType).alias(f.name) for f in sources.files.S.DIAGNOSTICS.fields])
    sources.write_diagnostics(table, str(tmp_path / "d"), ("run", "batch_number"))
    got = sources.read_diagnostics(spark, str(tmp_path / "d")).select(table.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect())) and names[0] in got.columns


def test_curves_keep_their_shape(spark):
    arc = [(100 * math.cos(math.pi * k / 180), 100 * math.sin(math.pi * k / 180)) for k in range(181)]
    got = lines.drop_collinear(line_rows(spark, {1: arc, 2: [(0, 0), (5, 0), (10, 0)], 3: [(0, 0), (1, 1), (0, 0)], 4: [(1, 1)]}), 2.0)
    kept = {r.line_id: [(v.x, v.y) for v in r.line] for r in got.collect()}
    assert 10 < len(kept[1]) < 60 and len(kept[2]) == 2 and len(kept[3]) == 3 and len(kept[4]) == 1
    for x, y in arc:
        off = min(abs((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0])) / math.dist(a, b) for a, b in zip(kept[1], kept[1][1:])
                  if math.dist(a, (x, y)) <= math.dist(a, b) + 1e-9 and math.dist(b, (x, y)) <= math.dist(a, b) + 1e-9)
        assert off <= 0.5 + 1e-9


def test_overlapping_segments_are_cut_alike(spark):
    got = spatial.node_lines(line_rows(spark, {1: [(0, 0), (10, 0)], 2: [(5, 0), (15, 0)], 3: [(0, 5), (10, 5)]}), "line_id").collect()
    assert sorted((r.line_id, r.x0, r.x1) for r in got) == [(1, 0, 5), (1, 5, 10), (2, 5, 10), (2, 10, 15), (3, 0, 10)]


def test_gauges_without_a_place_have_a_status(spark):
    gauges = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, float("nan"), 0.0)], "gauge_id long, x double, y double")
    found = {r.gauge_id: (r.vid, r.status) for r in nearest.nearest_vertex(gauges, points(spark, [(7, 0, 0), (8, 9, 9)])).collect()}
    assert found == {1: (7, "ok"), 2: (None, "error: no coordinates"), 3: (None, "error: no coordinates")}


@pytest.mark.parametrize("files", [1, 5])
def test_every_silence_is_reported(spark, tmp_path, files):
    rows = [(1, k, t, "running") for k, t in enumerate([0, 60, 5 * 3600 + 60, 11 * 3600 + 60])] + [(2, 9, 20 * 3600, "running")]
    for k, part in enumerate([rows] if files == 1 else [[r] for r in rows]):
        table = spark.createDataFrame(part, "run_id long, seq long, s long, status string")
        table.select("run_id", "seq", F.timestamp_seconds("s").alias("ts"), "status").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "run_id long, seq long, ts timestamp, status string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = live.drain(spark, live.stuck_runs_stream(stream, 3600), "append").collect()
    if files == 1:
        assert sorted(r.last_event_us // 1_000_000 for r in got if r.run_id == 1) == [60, 5 * 3600 + 60, 11 * 3600 + 60]
    else:
        assert {r.run_id for r in got} == {1} and len(got) >= 2


def test_an_empty_stream_drains_to_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    stream = spark.readStream.schema("run_id long, ts timestamp").parquet(str(tmp_path / "none"))
    got = live.drain(spark, stream, "append")
    assert got.columns == ["run_id", "ts"] and got.count() == 0


def test_codes_are_trimmed(spark):
    got = spark.createDataFrame([(" EPSG:28355 ",), ("28355",)], "c string").select(epsg_code(F.col("c")).alias("e")).collect()
    assert [r.e for r in got] == [28355, 28355]


def test_a_crossing_near_a_vertex_leaves_lines_whole(spark):
    box = ring_rows(spark, {1: [(0, 0), (100, 0), (100, 100), (0, 100)]}, "zone_id")
    rows = {1: [(10, 50), (50, 50), (90, 50)], 2: [(50.1, 10), (50.1, 90)], 3: [(10, 50), (50, 50), (90, 50)]}
    table = line_rows(spark, rows, "line_id").withColumn("near_spacing", F.lit(40.0))
    got = lines.condition_breaklines(table, box, floor=1.0).collect()
    ends = {}
    for r in got:
        assert math.dist((r.x0, r.y0), (r.x1, r.y1)) >= 1.0
        for p in ((r.x0, r.y0), (r.x1, r.y1)):
            ends[p] = ends.get(p, 0) + 1
    assert len(got) == len({frozenset([(r.x0, r.y0), (r.x1, r.y1)]) for r in got})
    assert sorted(ends.values()) == [1, 1, 1, 1] + [2] * (len(ends) - 5) + [4]
    assert {r.line_id for r in got} == {1, 2}


def test_diagnostics_files_follow_the_rows_not_the_runs(spark, tmp_path):
    table = spark.range(600, numPartitions=6).select(F.concat(F.lit("1_1_"), F.col("id") % 60).alias("run"), (F.col("id") % 2).alias("batch_number"),
                                                     *[F.col("id").cast(f.dataType).alias(f.name) for f in sources.files.S.DIAGNOSTICS.fields])
    for k, (how, most) in enumerate([({"named": True}, 6), ({"partition_by": ("run", "batch_number")}, 60)]):
        sources.write_diagnostics(table, str(tmp_path / str(k)), **how)
        assert len(list((tmp_path / str(k)).rglob("part-*.csv"))) <= most
        got = sources.read_diagnostics(spark, str(tmp_path / str(k))).select(table.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect()))
