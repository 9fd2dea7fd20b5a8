import json
import os

import pytest
from pyspark.sql import functions as F

from floodspark import sources
from floodspark.operators import quality, runs
from floodspark.streaming import live


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def packages(tmp_path):
    root = str(tmp_path)
    line = {"type": "Feature", "id": "b1", "geometry": {"type": "LineString", "coordinates": [[0, 0], [0, 10]]},
            "properties": {"boundary": "Reflective", "location": "External"}}
    rain = {"type": "Feature", "id": "r1", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]},
            "properties": {"data": [{"timestamp": "2024-01-01T00:00:00Z", "value": 1.5}]}}
    crs = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::28355"}}
    write(f"{root}/a/scenario.json", json.dumps({"epsg": "EPSG:28355", "boundary": "b.geojson", "duration": 600, "rainfall": "r.geojson",
                                                  "friction": "gone.geojson", "id": 1, "run_id": 1, "project": 1, "extra_key": [1]}, indent=2))
    write(f"{root}/a/inputs/b.geojson", json.dumps({"type": "FeatureCollection", "crs": crs, "features": [line]}, indent=1))
    write(f"{root}/a/inputs/r.geojson", json.dumps({"type": "FeatureCollection", "crs": crs, "features": [rain]}))
    write(f"{root}/a/inputs/unlisted.geojson", json.dumps({"type": "FeatureCollection", "features": [line]}))
    write(f"{root}/b/scenario.json", json.dumps({"epsg": None, "boundary": "b.geojson", "duration": "600"}))
    write(f"{root}/c/scenario.json", "{not json")
    return root


def test_read_scenarios_and_features(spark, packages):
    s = sources.read_scenarios(spark, packages)
    assert {(r.package, r.valid) for r in s.collect()} == {("a", True), ("b", True), ("c", False)}
    assert s.where("package = 'a'").select(F.get_json_object("raw", "$.extra_key[0]")).first()[0] == "1"
    f = sources.read_features(spark, packages, s)
    rows = {(r.package, r.layer, r.status[:5]) for r in f.collect()}
    assert rows == {("a", "boundary", "ok"), ("a", "rainfall", "ok"), ("b", "boundary", "error"), ("c", "boundary", "error")}
    b = f.where("layer = 'boundary' and package = 'a'").first()
    assert (b.epsg_code, b.location, b.boundary) == (28355, "External", "Reflective")
    from floodspark.operators.forcing import classify_forcing

    assert classify_forcing(f.where("layer = 'rainfall'")).first().kind == "series"
    broken = quality.validate_scenarios(s, key="package", features=f.where("status = 'ok'"))
    assert {(r.package, r.field, r.rule) for r in broken.collect()} >= {("b", "epsg", "required"), ("b", "boundary", "features"), ("c", "duration", "required")}
    assert ("a",) not in {(r.package,) for r in broken.collect()}


def test_missing_scenarios_raise(spark, tmp_path):
    with pytest.raises(Exception):
        sources.read_scenarios(spark, str(tmp_path / "nowhere")).collect()


DIAG = {"sim_time_s": 60.0, "wall_time_s": 1.0, "n_steps": 10, "mean_dt_ms": 6000.0, "last_dt_ms": 100.0, "implied_max_speed_ms": 2.0, "wet_cells": 3,
        "wet_fraction": 0.75, "volume_m3": 2.9, "max_depth_m": 1.0, "max_speed_ms": 0.6, "peak_speed_x": 1.0, "peak_speed_y": 2.0, "mem_mb": 9.0}


def test_diagnostics_files(spark, tmp_path):
    text = "# 4 triangles | inradius min=0.577m\n" + ",".join(DIAG) + "\n" + ",".join(str(v) for v in DIAG.values()) + "\n"
    write(f"{tmp_path}/outputs_1_1_1/run_diagnostics_3.csv", text)
    d = sources.read_diagnostics(spark, str(tmp_path))
    r = d.first()
    assert d.count() == 1 and (r.wet_fraction, r.batch_number, r.run, r.n_steps) == (0.75, 3, "1_1_1", 10)
    sources.write_diagnostics(d, str(tmp_path / "out"), ("run",))
    back = spark.read.option("header", True).schema(d.drop("batch_number", "run").schema).csv(str(tmp_path / "out"))
    assert back.first().volume_m3 == 2.9
    streamed = live.drain(spark, sources.diagnostics_stream(spark, str(tmp_path / "outputs_1_1_1")).drop("run"), "append")
    assert streamed.count() == 1 and streamed.first().batch_number == 3


def test_run_summaries_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("run_1", "completed", 2, True, 50.0)], "run_label string, outcome string, n_yieldsteps long, stable boolean, min_dt_ms double")
    sources.write_run_summaries(sources.nest_run_summary(rows), str(tmp_path / "s"))
    back = sources.read_run_summaries(spark, str(tmp_path / "s"))
    assert back.select("run.outcome", "performance.min_dt_ms").first() == ("completed", 50.0)
    assert runs.stalled_runs is not None and back.first().schema_version == "1"


def test_point_and_observation_csv(spark, tmp_path):
    write(f"{tmp_path}/p/ring.csv", " 1.0 , 2.0\nx,y\n3,4\n\n5,6\n7\n")
    p = sources.read_point_csv(spark, f"{tmp_path}/p")
    assert [(r.x, r.y) for r in p.orderBy("seq").collect()] == [(1, 2), (3, 4), (5, 6)]
    ring = sources.ring_of_points(p).first().ring
    assert [(v.x, v.y) for v in ring] == [(1, 2), (3, 4), (5, 6), (1, 2)]
    write(f"{tmp_path}/o.csv", " id , stage \n1, 2.5\n")
    assert sources.read_observations(spark, f"{tmp_path}/o.csv").first().asDict() == {"id": 1.0, "stage": 2.5}


def test_features_and_inventory(spark, tmp_path):
    df = spark.createDataFrame([("p1", '{"type":"Feature"}'), ("p2", '{"type":"Feature","id":2}')], "package string, feature string")
    sources.write_features(df, str(tmp_path / "f"))
    sources.write_features(df, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).where("package = 'p1'").count() == 2
    files = sources.file_inventory(spark, str(tmp_path / "f"))
    assert files.columns == ["path", "length", "modificationTime"] and files.where("length > 0").count() == 4


def test_inventory_by_run_feeds_report_and_gaps(spark, tmp_path):
    from floodspark.operators import artefacts

    root = tmp_path / "it's 100%"
    for name in ("1_1_1/run_1_1_1.sww", "1_1_1/package.zip", "1_1_1/engine/main.py", "2_2_2/deep/scenario.json", "stray.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("abc")
    files = sources.file_inventory(spark, str(root), run="run_id")
    assert {(r.run_id, r.path, r.length) for r in files.collect()} == {
        ("1_1_1", "run_1_1_1.sww", 3), ("1_1_1", "package.zip", 3), ("1_1_1", "engine/main.py", 3), ("2_2_2", "deep/scenario.json", 3)}
    report = {(r.run_id, r.reason): r.n_files for r in artefacts.package_report(files).collect()}
    assert report[("1_1_1", "directory")] == 1 and report[("2_2_2", "kept")] == 1
    runs = files.select("run_id").distinct().withColumn("run_label", F.concat(F.lit("run_"), "run_id"))
    gaps = {(r.run_id, r.object_name) for r in artefacts.archive_gaps(runs, files).collect()}
    assert ("1_1_1", "run_1_1_1.sww") not in gaps and ("2_2_2", "run_2_2_2.sww") in gaps and ("2_2_2", "scenario.json") not in gaps


@pytest.mark.parametrize("extra,broken", [
    ('"name": 5', {("name", "text")}), ('"name": null', set()), ('"epsg": 32755', {("epsg", "text")}), ('"epsg": null', {("epsg", "text"), ("epsg", "required")}),
    ('"duration": null', {("duration", "integer"), ("duration", "required")}), ('"duration": "600"', set()), ('"id": null', {("id", "integer")}), ('"id": [1]', {("id", "integer")}),
    ('"resolution": null', set()), ('"resolution": {}', {("resolution", "number")}), ('"store_mesh": null', {("store_mesh", "boolean")}),
    ('"format_version": 1.0', {("format_version", "text")}), ('"model_start": []', {("model_start", "text")})])
def test_rules_by_json_type(spark, extra, broken):
    from floodspark.operators import quality

    fields = {"epsg": '"EPSG:32755"', "boundary": '"b.geojson"', "duration": "600"}
    name, value = (part.strip().strip('"') if k == 0 else part.strip() for k, part in enumerate(extra.split(":", 1)))
    raw = "{" + ", ".join(f'"{k}": {v}' for k, v in {**fields, name: value}.items()) + "}"
    columns = {**{k: v.strip('"') for k, v in fields.items()}, **({name: None} if value == "null" else {})}
    row = spark.createDataFrame([(9, columns["epsg"], columns["boundary"], columns["duration"], raw)],
                                "id long, epsg string, boundary string, duration string, raw string")
    assert {(r.field, r.rule) for r in quality.validate_scenarios(row).collect()} == broken


def test_mesh_and_state_tables(spark, tmp_path):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0)], "run_id long, vid long, x double, y double")
    t = spark.createDataFrame([(1, 0, 0, 1, 2)], "run_id long, tid long, v0 long, v1 long, v2 long")
    v.write.partitionBy("run_id").parquet(str(tmp_path / "m/vertices"))
    t.write.partitionBy("run_id").parquet(str(tmp_path / "m/triangles"))
    vertices, triangles = sources.read_mesh(spark, str(tmp_path / "m"))
    assert vertices.count() == triangles.count() == 1
    v.withColumn("t", F.lit(60)).write.partitionBy("run_id", "t").parquet(str(tmp_path / "s"))
    states = sources.read_vertex_states(spark, str(tmp_path / "s")).where("t = 60")
    assert "t" in states._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:60]


def land(spark, path, n, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(f"{path}/f{n}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_late_partial_never_replaces_final(spark, tmp_path):
    schema = "job_id string, partial boolean, seq long, s long, v double"
    for n, rows in enumerate([[("a", True, 1, 10, 1.0)], [("a", False, 2, 20, 2.0)], [("a", True, 3, 30, 3.0), ("b", True, 1, 30, 9.0)]]):
        land(spark, str(tmp_path), n, rows, schema)
    got = live.drain(spark, live.resource_ledger(stream(spark, str(tmp_path), schema)), "update", ["job_id"])
    assert {r.job_id: r.v for r in got.collect()} == {"a": 2.0, "b": 9.0}


def test_heartbeats_keep_state_between_batches(spark, tmp_path):
    schema = "run_id long, seq long, s long"
    for n, times in enumerate([[0, 500], [899, 900, 1000], [1799, 1800]]):
        land(spark, str(tmp_path), n, [(1, t, t) for t in times], schema)
    got = live.drain(spark, live.heartbeats_stream(stream(spark, str(tmp_path), schema)), "append")
    assert sorted(r.seq for r in got.collect()) == [0, 900, 1800]


def test_stuck_runs_by_event_time(spark, tmp_path):
    schema = "run_id long, status string, s long"
    for n, rows in enumerate([[(1, "running", 100), (2, "running", 100), (3, "completed", 100)], [(2, "running", 3000)], [(4, "running", 8000)]]):
        land(spark, str(tmp_path), n, rows, schema)
    got = live.drain(spark, live.stuck_runs_stream(stream(spark, str(tmp_path), schema)), "append")
    assert {(r.run_id, r.last_event_us) for r in got.collect()} == {(1, 100_000_000), (2, 3000_000_000)}


def test_windowed_peaks_drop_late_rows(spark, tmp_path):
    schema = "run_id long, phase string, rss_mib double, s long"
    day = 86400
    for n, rows in enumerate([[(1, "evolve", 5.0, 10), (1, None, 99.0, 20)], [(1, "evolve", 7.0, 3 * day)],
                              # Spark drops by the watermark the batch before last left, so one batch lies between.
                              [(1, "evolve", 1.0, 3 * day)], [(1, "evolve", 50.0, 30), (1, "evolve", 8.0, 3 * day + 1)]]):
        land(spark, str(tmp_path), n, rows, schema)
    got = live.drain(spark, live.phase_peaks_stream(stream(spark, str(tmp_path), schema)), "update", ["run_id", "phase", "window_start"])
    assert sorted(r.peak_rss for r in got.collect()) == [5.0, 8.0]


def test_failing_listener_does_not_stop_the_query(spark, tmp_path):
    schema = "run_id long, s long"
    for n in range(3):
        land(spark, str(tmp_path / "in"), n, [(n, n)], schema)
    seen = []

    def listener(batch, batch_id):
        seen.append(batch.count())
        if batch_id == 1:
            raise RuntimeError("listener broke")

    live.run_events(stream(spark, str(tmp_path / "in"), schema), listener, str(tmp_path / "c")).awaitTermination()
    assert seen == [1, 1, 1]


def test_typed_lines(spark):
    lines = ["status: running", "metric: memory_used=12", "file: raster -> a/b -> c.tif", "heartbeat: 12.5% complete, eta=90s", "heartbeat: 0.0% complete",
             "12.5% | 1m 20s | mem: 41.2% | disk: 7.0% | 2024-01-01T00:00:00 | steps=480 dt=125ms vmax=2.10m/s v_impl=2.2m/s wet=23% vol=1234m³", "Building domain..."]
    got = live.typed_events(spark.createDataFrame([(m,) for m in lines], "message string")).collect()
    assert [r.kind for r in got] == ["status", "metric", "file", "heartbeat", "heartbeat", "progress", "log"]
    assert (got[2].key, got[2].value) == ("raster", "a/b -> c.tif") and (got[3].pct, got[3].eta_s) == (12.5, 90) and got[4].eta_s is None
    p = got[5]
    assert (p.n_steps, p.dt_ms, p.vmax, p.v_impl, p.wet_pct, p.volume) == (480, 125.0, 2.1, 2.2, 23.0, 1234.0)


def test_run_summary_lines_without_version_or_broken_keep_their_rows(spark, tmp_path):
    good, bare, cut = '{"schema_version": "%s", "run": {"run_label": "g"}}' % sources.files.S.SUMMARY_SCHEMA_VERSION, '{"run": {"run_label": "b"}}', '{"schema_version": "1", "run": {"run_'
    files = {"mixed": [good, bare, "", cut, good], "bare": [bare, bare, bare], "cut_first": [cut, bare, bare], "array": ["[", good + ",", good, "]"],
             "whole": json.dumps(json.loads(good), indent=1).split("\n"), "whole_bare": json.dumps(json.loads(bare), indent=1).split("\n")}
    for name, rows in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(rows) + "\n")
    of = lambda name: sorted(r.status for r in sources.read_run_summaries(spark, str(tmp_path / name)).collect())
    missing, broken = "error: schema version missing", "error: broken JSON"
    assert {name: of(name) for name in files} == {
        "mixed": [broken, missing, "ok", "ok"], "bare": [missing] * 3, "cut_first": [broken, missing, missing], "array": ["ok", "ok"],
        "whole": ["ok"], "whole_bare": [missing]}
