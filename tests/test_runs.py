import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.operators import artefacts, forcing, inputs, mesh, ordered, quality, results, runs, telemetry

CELLS = "run_id long, t long, cell_id long, stage double, elevation double, xmom double, ymom double, area double, inradius double, x double, y double, is_full boolean, dt double"


def cell_state(spark, full=(True,) * 4, stage=(1.0, 0.5, 0.2, 4.9), dt=0.1):
    elevation, xm, ym = (0.0, 0.0, 0.0, 5.0), (0.5, 0.2, 0.05, 0.0), (0.3, 0.1, 0.02, 0.0)
    rows = [(1, 60, i, stage[i], elevation[i], xm[i], ym[i], math.sqrt(3), math.sqrt(3) / 3, float(i), float(10 * i), full[i], dt)
            for i in range(4)]
    return spark.createDataFrame(rows, CELLS)


def test_flow_diagnostics(spark):
    r = results.flow_diagnostics(cell_state(spark)).first()
    assert (r.wet_cells, r.wet_fraction) == (3, 0.75)
    assert r.volume_m3 == pytest.approx(1.7 * math.sqrt(3)) and r.max_depth_m == 1.0
    assert r.max_speed_ms == pytest.approx(math.hypot(0.5, 0.3)) and (r.peak_speed_x, r.peak_speed_y) == (0.0, 0.0)
    assert r.implied_max_speed_ms == pytest.approx(0.9 * math.sqrt(3) / 3 / 0.1)


def test_flow_ghosts_dry_and_ties(spark):
    ghost = results.flow_diagnostics(cell_state(spark, full=(False, True, True, True))).first()
    assert ghost.wet_cells == 2 and ghost.wet_fraction == pytest.approx(2 / 3) and ghost.max_depth_m == 0.5
    dry = results.flow_diagnostics(cell_state(spark, stage=(0.0, 0.0, 0.0, 5.0))).first()
    assert (dry.wet_cells, dry.volume_m3, dry.implied_max_speed_ms, dry.max_speed_ms) == (0, 0.0, 0.0, 0.0)
    unknown = cell_state(spark).drop("is_full")
    assert results.flow_diagnostics(unknown).first().wet_cells == 3
    tied = cell_state(spark).withColumn("xmom", F.lit(1.0)).withColumn("ymom", F.lit(0.0)).withColumn("stage", F.col("elevation") + 1)
    first = results.flow_diagnostics(tied).first()
    assert (first.peak_speed_x, first.max_speed_ms) == (0.0, 1.0)


def test_order_number_keeps_the_order_of_doubles(spark):
    rng = random.Random(2)
    values = [0.0, 1e-9, 0.5, 1.0, 2.0, 4.0, 90.0, 1e6, 1e20] + [rng.uniform(0, 50) for _ in range(200)]
    values += [math.nextafter(v, math.inf) for v in values if v]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, id long")
    got = [r.v for r in df.orderBy(ordered.first_at_min(F.col("v"), F.col("id"))).collect()]
    assert got == sorted(values)
    nan = spark.createDataFrame([(float("nan"), 1), (None, 2), (3.0, 4), (3.0, 3)], "v double, id long")
    assert nan.agg(F.max_by("id", ordered.first_at_max(F.col("v"), F.col("id")))).first()[0] == 3


def test_output_quantities_and_clip(spark):
    q = {r.cell_id: r for r in results.output_quantities(cell_state(spark)).collect()}
    assert q[0].velocity == pytest.approx(math.hypot(0.5, 0.3)) and q[3].velocity == 0.0
    clipped = {r.cell_id: (r.stage, r.clipped) for r in results.clip_dry(cell_state(spark)).collect()}
    assert clipped[3] == (5.0, True) and clipped[0] == (1.0, False)


def test_peak_ignores_nan(spark):
    df = spark.createDataFrame([(1, 1, float("nan")), (1, 1, 2.0), (1, 2, float("nan"))], "run_id long, cell_id long, stage double")
    got = {r.cell_id: r.max_stage for r in results.peak_envelope(df, ["stage"]).collect()}
    assert got == {1: 2.0, 2: None}


def diag(spark, rows):
    cols = "run_id long, t long, last_dt_ms double, n_steps long, mean_dt_ms double, implied_max_speed_ms double, wet_fraction double, volume_m3 double, max_depth_m double, max_speed_ms double, peak_speed_x double, peak_speed_y double, mem_mb double"
    return spark.createDataFrame([(1, t, dt, n, 60.0 / n * 1000, imp, 0.1, 5.0, 1.0, sp, float(t), 0.0, 7.0) for t, dt, n, imp, sp in rows], cols)


@pytest.mark.parametrize("rows,duration,outcome,stable", [
    ([(60, 100, 10, 2, 1), (120, 50, 20, 3, 2)], 120, "completed", True), ([(60, 100, 10, 2, 1), (120, 5, 20, 25, 2)], 600, "unstable", False),
    ([(60, 100, 10, 2, 1)], 600, "incomplete", True), ([(60, 100, 10, 2, 1)], None, "completed", True), ([(594, 9, 1, 20, 1)], 600, "completed", False)])
def test_run_outcomes(spark, rows, duration, outcome, stable):
    d = diag(spark, [(t, float(dt), n, float(i), float(s)) for t, dt, n, i, s in rows])
    r = runs.run_summary(d, None if duration is None else F.lit(float(duration))).first()
    assert (r.outcome, r.stable) == (outcome, stable)


def test_run_summary_first_of_equals(spark):
    r = runs.run_summary(diag(spark, [(60, 100.0, 10, 3.0, 2.0), (120, 50.0, 30, 5.0, 2.0), (180, 50.0, 20, 5.0, 1.0)])).first()
    assert (r.min_dt_at_sim_s, r.max_implied_speed_at_sim_s, r.peak_speed_x, r.first_dt_ms) == (120.0, 120.0, 60.0, 100.0)
    assert r.timestep_collapse_ratio == 0.5 and r.total_internal_steps == 60 and r.mean_dt_ms == pytest.approx(3000.0)


def test_step_deltas_never_below_one(spark):
    df = spark.createDataFrame([(1, 60, 10), (1, 120, 10), (1, 180, 40)], "run_id long, t long, total_steps long")
    assert [r.n_steps for r in results.step_deltas(df, F.lit(60.0)).orderBy("t").collect()] == [10, 1, 30]


def test_progress(spark):
    df = spark.createDataFrame([(0.0, 600.0, 5.0), (150.0, 600.0, 10.0)], "t double, duration double, elapsed double")
    assert [(r.pct, r.eta_s) for r in runs.progress_eta(df).orderBy("t").collect()] == [(0.0, None), (25.0, 30)]


def tri(spark, corners):
    v, t = [], []
    for i, c in enumerate(corners):
        v += [(1, 3 * i + j, float(x), float(y)) for j, (x, y) in enumerate(c)]
        t.append((1, i, 3 * i, 3 * i + 1, 3 * i + 2))
    return (spark.createDataFrame(v, "mesh_id long, vid long, x double, y double"),
            spark.createDataFrame(t, "mesh_id long, tid long, v0 long, v1 long, v2 long"))


def test_mesh_quality(spark):
    q = mesh.mesh_qa(*tri(spark, [[(0, 0), (1, 0), (0, 1)], [(0, 0), (100, 0), (0, 100)], [(0, 0), (100, 0), (200, 1)]]), keys=["mesh_id"]).first()
    assert (q.triangle_count, q.node_count, q.duplicate_node_count, q.sliver_count) == (3, 9, 3, 1)
    assert q.min_triangle_area == 0.5 and q.has_degenerate_triangles is False
    bad = mesh.mesh_qa(*tri(spark, [[(0, 0), (0, 0), (0, 1)]]), keys=["mesh_id"]).first()
    assert bad.has_degenerate_triangles is True


def test_empty_mesh(spark):
    v, t = tri(spark, [[(0, 0), (1, 0), (0, 1)]])
    q = mesh.mesh_qa(v, t.limit(0), keys=["mesh_id"]).first()
    assert (q.triangle_count, q.node_count, q.min_angle_deg, q.aspect_ratio_max) == (0, 3, 0.0, 0.0)
    assert mesh.area_histogram(v, t.limit(0), keys=["mesh_id"]).count() == 0
    one = mesh.mesh_qa(v.drop("mesh_id"), t.drop("mesh_id").limit(0)).first()
    assert one.triangle_count == 0


def test_histogram_counts_every_triangle(spark):
    meshes = tri(spark, [[(0, 0), (s, 0), (0, s)] for s in (0.01, 1, 3, 50, 5000, 1e5)])
    h = mesh.area_histogram(*meshes, keys=["mesh_id"]).collect()
    assert len(h) == 21 and sum(r["count"] for r in h) == 6


def test_fingerprint_ignores_numbering(spark):
    a = [[(0, 0), (1, 0), (0, 1)], [(1, 0), (1, 1), (0, 1)]]
    b = [[(0, 1), (1, 0), (1, 1)], [(0, 1), (0, 0), (1, 0)]]
    c = [[(0, 0), (1, 0), (0, 1)], [(1, 0), (1, 1.00001), (0, 1)]]
    fp = lambda m: mesh.mesh_fingerprint(*tri(spark, m), keys=["mesh_id"]).first().fingerprint
    assert fp(a) == fp(b) != fp(c)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(4)
    groups = {1: [1.0, 2.0, 4.0, 8.0], 2: list(rng.exponential(size=5000)), 3: [7.0] * 999 + [8.0], 4: [3.0], 5: list(np.round(rng.normal(size=60000), 3))}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r for r in ordered.exact_percentiles(df, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p99": 0.99}, accuracy=1000).collect()}
    for k, vs in groups.items():
        assert got[k].p5 == pytest.approx(np.percentile(vs, 5)) and got[k].p50 == pytest.approx(np.median(vs)) and got[k].p99 == pytest.approx(np.percentile(vs, 99))
    assert got[1].p5 == pytest.approx(1.15)


def test_number_rows_and_carry(spark):
    rng = random.Random(8)
    rows = [(k, t, None if rng.random() < 0.6 else float(t)) for k in (1, 2) for t in sorted(rng.sample(range(1000), 80))]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    numbered = ordered.number_rows(df, ["k"], F.floor(F.col("t") / 50), [F.col("t")])
    for k in (1, 2):
        assert [r.rn for r in numbered.where(F.col("k") == k).orderBy("t").collect()] == list(range(1, 81))
    for back in (False, True):
        for skip in (False, True):
            got = {(r.k, r.t): r.o and r.o.v for r in ordered.carry(
                df, ["k"], F.floor(F.col("t") / 50), ["t"], {"v": F.col("v")}, F.col("v").isNotNull(),
                None if back else "o", "o" if back else None, skip).collect()}
            for k, t, _ in rows:
                seen = [v for kk, tt, v in rows if kk == k and v is not None and (
                    (tt > t if skip else tt >= t) if back else (tt < t if skip else tt <= t))]
                assert got[k, t] == ((min(seen) if back else max(seen)) if seen else None)


def series(spark, rows):
    df = spark.createDataFrame(rows, "series_id string, s string, value double")
    return df.select("series_id", F.to_timestamp("s").alias("ts"), "value")


def windows(spark, rows):
    df = spark.createDataFrame(rows, "series_id string, s string, n_steps long, constant double")
    return df.select("series_id", F.to_timestamp("s").alias("start_ts"), "n_steps", "constant")


def test_align_exact_then_fill(spark):
    s = series(spark, [("a", "2024-01-01 00:00:30", 1.0), ("a", "2024-01-01 00:00:40.5", 9.0), ("a", "2023-12-31 23:59:00", 8.0),
                       ("a", "2024-01-01 00:00:50", 2.0), ("a", "2024-01-01 00:01:01", 7.0)])
    w = windows(spark, [("a", "2024-01-01 00:00:00", 60, None), ("b", "2024-01-01 00:00:00", 2, 5.0)])
    got = forcing.align_forcing(s, w)
    a = [r.value for r in got.where("series_id = 'a'").orderBy("step").collect()]
    assert a == [None] * 30 + [1.0] * 20 + [2.0] * 11
    assert [r.value for r in got.where("series_id = 'b'").orderBy("step").collect()] == [5.0] * 3
    asked = spark.createDataFrame([("a", 30.9), ("a", 29.9), ("a", 60.0), ("a", 61.0), ("a", -0.5), ("b", 2.0), ("c", 0.0), ("a", None)],
                                  "series_id string, t_s double")
    at = {(r.series_id, r.t_s): r.value for r in forcing.forcing_at(forcing.forcing_anchors(s, w), asked).collect()}
    assert at == {("a", 30.9): 1.0, ("a", 29.9): None, ("a", 60.0): 2.0, ("a", 61.0): None, ("a", -0.5): None, ("b", 2.0): 5.0,
                  ("c", 0.0): None, ("a", None): None}
    assert forcing.duplicate_samples(s.unionByName(s.limit(1))).count() == 1


def test_gap_is_reported_only_without_overlap(spark):
    s = series(spark, [("old", "1994-01-01 00:00:00", 1.0), ("ok", "2024-01-01 00:00:00", 1.0), ("late", "2024-01-01 00:00:30", 1.0)])
    w = windows(spark, [(n, "2024-01-01 00:00:00", 60, None) for n in ("old", "ok", "late")])
    gaps = forcing.forcing_gaps(s, w).collect()
    assert [g.series_id for g in gaps] == ["old"] and gaps[0].window_end.second == 0 and gaps[0].window_end.minute == 1


def test_long_series_over_many_buckets(spark):
    s = spark.range(0, 30000, 7000).select(F.lit("a").alias("series_id"), F.timestamp_seconds(F.col("id") + 1704067200).alias("ts"), F.col("id").cast("double").alias("value"))
    got = forcing.align_forcing(s, windows(spark, [("a", "2024-01-01 00:00:00", 30000, None)]))
    assert got.where(F.col("value") != F.floor(F.col("step") / 7000) * 7000).count() == 0 and got.count() == 30001


def test_constant_over_a_year_of_seconds(spark):
    """Neither the grid nor the lookup makes an array or a task of a whole run; a lookup makes no grid at all."""
    year = 366 * 86400
    s = series(spark, [("x", "2024-01-01", 1.0)]).limit(0)
    w = windows(spark, [("a", "2024-01-01", year, 3.0)])
    runs = forcing.forcing_anchors(s, w)
    assert runs.count() == 1
    asked = spark.createDataFrame([("a", 0.0), ("a", year - 0.5), ("a", float(year)), ("a", year + 1.0)], "series_id string, t_s double")
    found = forcing.forcing_at(runs, asked)
    assert "Generate" not in found._jdf.queryExecution().toString()
    assert {r.t_s: r.value for r in found.collect()} == {0.0: 3.0, year - 0.5: 3.0, float(year): 3.0, year + 1.0: None}
    grid = forcing.align_forcing(s, windows(spark, [("a", "2024-01-01", 2_000_000, 3.0)]))
    tasks = grid.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi")).collect()
    assert sum(r.n for r in tasks) == 2_000_001 and min(r.lo for r in tasks) == 0 and max(r.hi for r in tasks) == 2_000_000
    assert len(tasks) > 1 and max(r.n for r in tasks) < 1_500_000


def test_forcing_at_asks_the_window_it_names(spark):
    s = series(spark, [("a", "2024-01-01 00:00:10", 1.0), ("a", "2024-01-02 00:00:10", 2.0)])
    w = windows(spark, [("a", "2024-01-01", 60, None), ("a", "2024-01-02", 60, None)])
    runs = forcing.forcing_anchors(s, w)
    asked = spark.createDataFrame([("a", 20.0, "2024-01-02")], "series_id string, t_s double, s string")
    assert [r.value for r in forcing.forcing_at(runs, asked.withColumn("start_ts", F.to_timestamp("s"))).collect()] == [2.0]
    assert sorted(r.value for r in forcing.forcing_at(runs, asked).collect()) == [1.0, 2.0]


def at_boundary(spark, features, times):
    f = spark.createDataFrame(features, "package_id long, feature_id string, data string")
    t = spark.createDataFrame(times, "package_id long, t_s double")
    return f, t, {(r.package_id, r.t_s): (r.stage, r.xmom, r.ymom, r.status) for r in forcing.time_boundary(f, t, bucket_s=40).collect()}


def samples(*rows):
    return json.dumps([{"timestamp": f"2020-01-01T00:0{t // 60}:{t % 60:02d}+00:00", "value": v} for t, v in rows])


@pytest.mark.parametrize("data,wanted", [
    ("2.5", {0: 2.5, 100: 2.5, 99999: 2.5}), ("3", {50: 3.0}), ("0", {0: 0.0}), ('"4.4"', {0: 4.4}), ("4.4", {-1: 4.4}),
    (samples((0, 0.0), (60, 6.0)), {0: 0.0, 60: 6.0, 30: 3.0}), (samples((0, 1.0), (60, 5.0)), {-100: 1.0, 99999: 5.0}),
    (samples((0, 0.0), (30, 3.0), (60, 0.0)), {0: 0.0, 30: 3.0, 60: 0.0, 45: 1.5}), (samples((0, "7.5")), {-3: 7.5, 0: 7.5, 3: 7.5}),
    (samples((0, 0.0), (30, 3.0), (30, 9.0), (60, 0.0)), {15: 1.5, 30: 9.0, 45: 4.5}), (samples((30, 1.0), (60, 2.0)), {0: 1.0, 15: 1.5})])
def test_time_boundary_by_kind_of_data(spark, data, wanted):
    f, t, got = at_boundary(spark, [(1, "bdy.1", data)], [(1, float(s)) for s in wanted])
    assert got == {(1, float(s)): (v, 0.0, 0.0, "ok") for s, v in wanted.items()}
    assert forcing.time_boundary_issues(f, t).count() == 0


@pytest.mark.parametrize("data,reason,stage", [
    ("not_a_number", "not a number", None), ("[]", "no list of samples", None), ('[{"value": 1.0}]', "sample without time or value", None),
    ('[{"timestamp": "2020-01-01T00:00:00Z"}]', "sample without time or value", None), ("{}", "not a number", None),
    ('[{"timestamp": "some day", "value": 1}]', "sample without time or value", None),
    ('[{"timestamp": "2020-01-01T00:00:00Z", "value": "high"}]', "sample without time or value", None), ("", "not a number", None),
    (None, "no data", 0.0), ("null", "no data", 0.0)])
def test_time_boundary_errors(spark, data, reason, stage):
    f, t, got = at_boundary(spark, [(1, "bdy.1", data)], [(1, 0.0)])
    assert got == {(1, 0.0): (stage, stage, stage, reason)}
    assert [tuple(r) for r in forcing.time_boundary_issues(f, t).collect()] == [(1, "bdy.1", "error", reason)]


def test_time_boundary_takes_the_first_feature_of_each_package(spark):
    two = samples((0, 0.0), (60, 6.0))
    features = [(1, "bdy.2", "99"), (1, "bdy.1", "1"), (1, None, "77"), (2, "bdy.1", two), (4, "bdy.1", two), (4, "bdy.1", two)]
    f, t, got = at_boundary(spark, features, [(1, 10.0), (2, 10.0), (2, None), (3, 10.0), (4, 20.0), (None, 1.0)])
    assert got == {(1, 10.0): (1.0, 0.0, 0.0, "ok"), (2, 10.0): (1.0, 0.0, 0.0, "ok"), (2, None): (None, None, None, "ok"),
                   (3, 10.0): (None, None, None, "no feature"), (4, 20.0): (2.0, 0.0, 0.0, "ok"), (None, 1.0): (None, None, None, "no feature")}
    issues = {tuple(r) for r in forcing.time_boundary_issues(f, t.where("package_id is not null")).collect()}
    assert issues == {(1, "bdy.1", "warning", "several features"), (3, None, "error", "no feature"), (4, "bdy.1", "warning", "several features")}
    assert forcing.time_boundary(f.limit(0), t).where("status = 'no feature'").count() == 6
    assert forcing.time_boundary(f, t.limit(0)).count() == 0


def test_time_boundary_keeps_repeated_times_and_extra_columns(spark):
    f = spark.createDataFrame([(1, "a", samples((0, 0.0), (60, 6.0)))], "package_id long, feature_id string, data string")
    t = spark.createDataFrame([(1, 30.0, "x"), (1, 30.0, "x"), (1, 30.0, "y")], "package_id long, t_s double, kind string")
    assert sorted((r.kind, r.stage) for r in forcing.time_boundary(f, t).collect()) == [("x", 3.0), ("x", 3.0), ("y", 3.0)]


@pytest.mark.parametrize("t,want", [(-5, 0.0), (0, 0.0), (30, 3.0), (60, 6.0), (99, 6.0)])
def test_time_boundary(spark, t, want):
    s = series(spark, [("b", "2024-01-01T00:00:00Z", 0.0), ("b", "2024-01-01T00:01:00Z", 6.0)])
    q = spark.createDataFrame([("b", float(t))], "series_id string, t_s double")
    assert forcing.interpolate_boundary(s, q, bucket_s=20).first().stage == want


def test_boundary_without_values_is_zero(spark):
    q = spark.createDataFrame([("none", 5.0)], "series_id string, t_s double")
    assert forcing.interpolate_boundary(series(spark, [("b", "2024-01-01", 1.0)]), q).first().stage == 0.0


@pytest.mark.parametrize("data,kind,constant", [
    (None, "missing", None), ("50", "constant", 50.0), ('"50.0"', "constant", 50.0), ("50.0", "constant", 50.0), ("null", "missing", None),
    ("heavy", "invalid", None), ("[]", "invalid", None), ('[{"timestamp":"2024-01-01T00:00:00Z","value":1}]', "series", None),
    ('[{"timestamp":"2024-01-01T00:00:00Z"}]', "invalid", None), ('[{"value":1}]', "invalid", None), ("1d", "invalid", None)])
def test_forcing_kind(spark, data, kind, constant):
    r = forcing.classify_forcing(spark.createDataFrame([(data,)], "data string")).first()
    assert (r.kind, r.constant) == (kind, constant)


def test_catchment_conflicts(spark):
    rain = spark.createDataFrame([(1, 1, "3"), (2, 1, "3"), (3, 2, None), (4, 3, '[{"timestamp":"2024-01-01","value":1}]'), (5, 4, "3")],
                                 "feature_id long, package_id long, data string")
    own = spark.createDataFrame([(1,), (2,), (3,), (4,)], "package_id long")
    assert {(r.package_id, r.reason.split()[0]) for r in forcing.catchment_conflicts(rain, own).collect()} == {(1, "multiple"), (2, "first"), (3, "first")}


def test_mass_balance(spark):
    w = windows(spark, [("rain", "2024-01-01", 300, 40.0), ("in", "2024-01-01", 300, 0.001)])
    none = series(spark, [("x", "2024-01-01", 1.0)]).limit(0)
    kind = F.when(F.col("series_id") == "rain", "rainfall").otherwise("inflow")
    got = {r.series_id: r.expected_m3 for r in forcing.forcing_volume(forcing.forcing_anchors(none, w), kind, F.lit(100.0)).collect()}
    assert got["rain"] == pytest.approx(0.33333333) and got["in"] == pytest.approx(0.3)
    e = spark.createDataFrame([("a", 1.0, 1.019), ("b", 1.0, 1.03), ("c", 0.0, 0.0)], "series_id string, expected_m3 double, observed_m3 double")
    passed = forcing.mass_balance(e.drop("observed_m3"), e.drop("expected_m3")).collect()
    assert {r.series_id: r.passed for r in passed} == {"a": True, "b": False, "c": True}


def test_user_forcing_is_any_column(spark):
    times = spark.range(3).select(F.col("id").cast("double").alias("t_s"))
    assert [r.value for r in forcing.apply_user_forcing(times, F.col("t_s") * 2).orderBy("t_s").collect()] == [0.0, 2.0, 4.0]


def test_validation(spark):
    cols = "id string, run_id string, project string, epsg string, boundary string, duration string, format_version string, resolution string, raw string"
    rows = [("1", "1", "1", "EPSG:28355", "b", "600", "1.0", "5", "{}"), ("2", "1", "1", None, "b", "600.5", "2.0", "x", "{}"),
            ("3", "0", "1", "EPSG:28355", "b", "600", None, None, '{"format_version":null}')]
    got = {(r.id, r.field, r.rule) for r in quality.validate_scenarios(spark.createDataFrame(rows, cols)).collect()}
    assert got == {("2", "epsg", "required"), ("2", "duration", "integer"), ("2", "format_version", "supported"), ("2", "resolution", "number"), ("3", "format_version", "text")}
    report = quality.validate_scenarios(spark.createDataFrame(rows, cols), "report")
    assert ("3", "run_id", "reportable") in {(r.id, r.field, r.rule) for r in report.collect()}


@pytest.mark.parametrize("path,reason", [
    ("outputs/run_1_1_1_depth_max.tif", None), ("scenario.json", None), ("inputs/b.geojson", None), ("engine/x.py", "directory"),
    ("outputs/checkpoints/a/b.pickle", "directory"), ("videos/a.mp4", "directory"), ("package.zip", "package"), ("1_1_1_results.zip", "package"),
    ("outputs/run_1.sww", "series"), ("a.msh", "mesh"), ("o/run_depth_Time_000060.tif", "step raster"), ("o/run_Time_.txt", None), ("checkpoints", None)])
def test_package_members(spark, path, reason):
    df = spark.createDataFrame([(path,)], "path string")
    assert artefacts.package_members(df, F.lit("1_1_1_results.zip")).first().reason == reason


def test_archive_gaps(spark):
    r = spark.createDataFrame([(1, "run_1_1_1")], "run_id long, run_label string")
    have = spark.createDataFrame([(1, "o/run_1_1_1.sww"), (1, "scenario.json"), (1, "o/run_1_1_1_stage_max.tif")], "run_id long, path string")
    assert {x.object_name for x in artefacts.archive_gaps(r, have).collect()} == {
        "package.zip", "run_1_1_1_depth_max.tif", "run_1_1_1_velocity_max.tif", "run_1_1_1_depthIntegratedVelocity_max.tif"}


@pytest.mark.parametrize("sha,version,want", [
    ("57a64abcdef", "3.3.1.dev1+g57A64AB", "match"), ("57a6", "3.3.1+g57a64ab", "match"), ("ffff", "3.3.1+g57a64ab", "mismatch"), (None, "3+g57a64ab", "not checked"), ("57a6", "3.3.1", "not checked")])
def test_provenance(spark, sha, version, want):
    df = spark.createDataFrame([(sha, version)], "sha string, v string")
    assert artefacts.check_provenance(df, F.col("sha"), F.col("v")).first().provenance == want


def test_structures_and_zone(spark):
    df = spark.createDataFrame([("Reflective",), ("Mannings",), ("Raised",), (None,), ("Other",)], "method string")
    assert [r.treatment for r in inputs.route_structures(df).collect()] == ["hole", "friction", "elevation", "ignored", "unknown"]
    crs = inputs.with_utm_zone(spark.createDataFrame([("EPSG:28355",), ("4326",), (None,)], "epsg string"), inputs.crs_dimension(spark))
    assert {r.epsg: (r.zone, r.zone_status[:5]) for r in crs.collect()} == {"EPSG:28355": (55, "ok"), "4326": (None, "error"), None: (None, "error")}
    texts = spark.createDataFrame([("EPSG:7855",), ("EPSG:2193",), ("urn:ogc:def:crs:EPSG::5555",), ("4326",)], "epsg string")
    named = spark.createDataFrame([(7855, "GDA2020 / MGA zone 55"), (5555, "Somewhere / ZONE  7 (east)"), (2193, "NZGD2000"), (4326, None)],
                                  "epsg_code int, crs_name string")
    got = {r.epsg: (r.zone, r.zone_status) for r in inputs.with_utm_zone(texts, named).collect()}
    assert got == {"EPSG:7855": (55, "ok"), "urn:ogc:def:crs:EPSG::5555": (7, "ok"), "EPSG:2193": (None, "error: not a UTM zone"),
                   "4326": (None, "error: not a UTM zone")}
    assert inputs.with_utm_zone(texts, inputs.crs_dimension(spark)).where("epsg = 'EPSG:7855'").first().hemisphere == "south"


def test_grid_resolution(spark):
    s = spark.createDataFrame([(1, 8.0), (2, 8.0), (3, None), (4, 0.0)], "id long, resolution double")
    m = spark.createDataFrame([(1, 4.0), (1, 2.0)], "id long, region_resolution double")
    assert {r.id: r.grid_resolution for r in inputs.grid_resolution(s, m).collect()} == {1: 2.0, 2: 8.0, 3: 1000.0, 4: 1000.0}


def test_phases(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "mesh-gen"), (1, "2024-01-01 00:00:10", 2, None), (1, "2024-01-03 00:00:00", 3, "evolve"),
                               (1, "2024-01-03 00:00:05", 4, "mesh-gen"), (1, "2024-01-03 00:00:06", 5, "evolve")], "run_id long, s string, seq long, phase string")
    e = e.withColumn("ts", F.to_timestamp("s"))
    got = {(r.level, r.stage, r.phase): r.seconds for r in telemetry.phase_durations(e, "2024-01-03 00:00:10").collect()}
    assert got == {("phase", "build", "mesh-gen"): 11.0, ("phase", "solve", "evolve"): 9.0, ("stage", "build", None): 11.0,
                   ("stage", "solve", None): 9.0, ("run", None, None): 20.0}


def test_heartbeats_whatever_the_buckets(spark):
    rng = random.Random(6)
    rows = [(k, i, t) for k in (1, 2) for i, t in enumerate(sorted(rng.uniform(0, 40000) for _ in range(150)))]
    rows += [(3, i, 7.0 * (i // 2)) for i in range(4000)] + [(4, 0, 5.0), (4, 1, 100_000.0), (4, 2, 100_001.0), (4, 3, 100_900.0)]
    df = spark.createDataFrame(rows, "run_id long, seq long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("long"))).drop("s")
    df = df.unionByName(spark.sql("SELECT CAST(NULL AS LONG) run_id, 1L seq, timestamp_micros(5L) ts UNION ALL SELECT 9L, 1L, NULL"))
    want, last = set(), {}
    for k, i, t in rows:
        us = int(t * 1000000)
        if k not in last or us - last[k] >= 900_000_000:
            want.add((k, i))
            last[k] = us
    for bucket in (1, 3, 1024):
        assert {(r.run_id, r.seq) for r in telemetry.heartbeats(df, bucket=bucket).collect()} == want
    assert telemetry.heartbeats(df.limit(0)).count() == 0


def test_latest_row_prefers_final(spark):
    rows = [("a", True, 1, 5.0), ("a", False, 2, 6.0), ("a", True, 3, 7.0), ("b", True, 1, 1.0), ("b", True, 2, 2.0), (None, False, 1, 0.0), ("", False, 1, 0.0)]
    df = spark.createDataFrame(rows, "job_id string, partial boolean, seq long, v double").withColumn("ts", F.timestamp_seconds("seq"))
    assert {r.job_id: r.v for r in telemetry.latest_resource_row(df).collect()} == {"a": 6.0, "b": 2.0}


def raster(spark, values, nodata=-9999.0):
    cells = spark.createDataFrame([("r", i // 10, i % 10, v) for i, v in enumerate(values)], "raster_id string, row_no long, col_no long, value double")
    head = spark.createDataFrame([("r", 0.0, 10.0, 1.0, 1.0, nodata)], "raster_id string, x0 double, y0 double, dx double, dy double, nodata double")
    return results.georeference_cells(head, cells)


@pytest.mark.parametrize("row,col,value,nodata,hits", [
    (5, 5, -9999.0, -9999.0, 1), (0, 0, -9999.0, -9999.0, 0), (5, 5, float("nan"), None, 1), (5, 5, float("nan"), float("nan"), 1), (5, 5, -9999.0, None, 0), (2, 1, -9999.0, -9999.0, 1)])
def test_nodata_guard(spark, row, col, value, nodata, hits):
    from shapes import ring_rows

    values = [1.0] * 100
    values[row * 10 + col] = value
    ring = ring_rows(spark, {1: [(2, 2), (7, 2), (7, 7), (2, 7)]})
    got = results.raster_nodata_in_boundary(raster(spark, values, nodata), ring, size=3.0).collect()
    assert sum(r.n_nodata for r in got) == hits


def test_cell_centres(spark):
    c = raster(spark, [1.0] * 100).where("row_no = 0 and col_no = 3").first()
    assert (c.x, c.y, c.min_x, c.max_y) == (3.5, 9.5, 3.0, 10.0)


def test_compare_pairs_frames_by_rank(spark):
    cols = "step long, row_no long, col_no long, value double"
    a = spark.createDataFrame([(0, 0, 0, 1.0), (60, 0, 0, 2.0), (120, 0, 0, 3.0)], cols)
    b = spark.createDataFrame([(0, 0, 0, 1.5), (50, 0, 0, 5.0)], cols)
    got = {r.frame: (r["diff"], r.status[:2]) for r in results.compare_runs(a, b).collect()}
    assert got == {1: (0.5, "ok"), 2: (3.0, "ok"), 3: (None, "er")}
    assert results.value_range(b.withColumn("raster_id", F.lit("b"))).first().max_value == 5.0


def test_peak_phase_of_equal_peaks_is_the_first(spark):
    rows = [(1, 10, "evolve", 5.0), (1, 11, "raster-read", 5.0), (1, 12, "mesh-gen", 4.0), (1, 13, "evolve", 5.0), (2, 20, "raster-read", None),
            (2, 21, "evolve", 1.0), (3, 30, "evolve", None)]
    samples = spark.createDataFrame(rows, "run_id long, seq long, phase string, rss_mib double")
    peaks = telemetry.phase_peaks(samples, order="seq")
    assert {(r.run_id, r.phase): r.peak_at for r in peaks.collect()}[(1, "evolve")] == 10
    empty = spark.createDataFrame([], "run_id long, stage string, seconds double")
    outcomes = spark.createDataFrame([], "run_id long, outcome string")
    got = runs.resource_corpus(spark.range(1, 4).withColumnRenamed("id", "run_id"), peaks, empty, outcomes)
    assert {r.run_id: (r.peak_rss, r.peak_phase) for r in got.collect()} == {1: (5.0, "evolve"), 2: (1.0, "evolve"), 3: (None, None)}


def test_worst_cell_of_congruent_ones(spark):
    """Radii of congruent cells differ in the last place; the lowest cell counts."""
    cells = spark.createDataFrame([(1, 7, 10.0, 0.0, 0.7268300928671005, 30.0), (1, 8, 20.0, 0.0, 0.7268300928671004, 30.0), (1, 9, 30.0, 0.0, 0.9, 30.0)],
                                  "mesh_id long, cell_id long, x double, y double, inradius double, min_angle double")
    got = mesh.mesh_inradius_stats(cells, ["mesh_id"]).first()
    assert (got.worst_x, got.inradius_min, got.inradius_median) == (10.0, 0.7268300928671004, 0.7268300928671005)
