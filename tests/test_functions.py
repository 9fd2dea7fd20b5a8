import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from floodspark import functions as fn

slow = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(col.alias("v")).first().v


def square(n, close=False):
    pts = [(0, 0), (n, 0), (n, n), (0, n)] + ([(0, 0)] if close else [])
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])


def test_ring_area_open_and_closed(spark):
    assert one(spark, fn.ring_area(square(10))) == 100.0
    assert one(spark, fn.ring_area(square(10, close=True))) == 100.0


def test_close_ring_is_idempotent(spark):
    assert one(spark, F.size(fn.close_ring(square(3)))) == 5
    assert one(spark, F.size(fn.close_ring(fn.close_ring(square(3))))) == 5


def test_line_length(spark):
    assert one(spark, fn.line_length(square(10))) == 30.0


@pytest.mark.parametrize("kind,coords,size", [
    ("LineString", "[[0,0],[1,1]]", 2), ("MultiLineString", "[[[0,0],[1,1]],[[2,2],[3,3],[4,4]]]", 5),
    ("MultiLineString", "[[[0,0],[1,1]]]", 2), ("LineString", "[]", 0), ("LineString", "null", 0)])
def test_flatten_line(spark, kind, coords, size):
    g = f'{{"type":"{kind}","coordinates":{coords}}}'
    assert one(spark, F.size(fn.flatten_line(F.col("g"))), g=g) == size


@pytest.mark.parametrize("kind,coords,size,multi", [
    ("Polygon", "[[[0,0],[1,0],[1,1],[0,0]],[[9,9],[8,8],[7,7]]]", 4, False),
    ("MultiPolygon", "[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,6],[7,7]]]]", 4, True),
    ("MultiPolygon", "[]", 0, False), ("Polygon", "null", 0, False)])
def test_outer_ring(spark, kind, coords, size, multi):
    g = f'{{"type":"{kind}","coordinates":{coords}}}'
    assert one(spark, F.size(fn.outer_ring(F.col("g"))), g=g) == size
    assert bool(one(spark, fn.is_multi_polygon(F.col("g")), g=g)) is multi


@slow
@given(st.integers(min_value=0, max_value=10 ** 7))
def test_yieldstep_property(spark, duration):
    got = one(spark, fn.yieldstep(F.lit(duration)))
    assert got == min(max(duration // 100, 60), 1800)


@pytest.mark.parametrize("duration,step", [(600, 60), (6100, 61), (86400, 864), (10 ** 6, 1800)])
def test_yieldstep(spark, duration, step):
    assert one(spark, fn.yieldstep(F.lit(duration))) == step


@pytest.mark.parametrize("base,height,want", [
    (1, 1, 0), (-1, 1, math.pi), (-1, -1, math.pi), (1, -1, 2 * math.pi), (0, 1, 0), (1, 0, 0), (-1, 0, 0), (0, 0, 0)])
def test_polar_correction(spark, base, height, want):
    assert one(spark, fn.polar_correction(F.lit(float(base)), F.lit(float(height)))) == want


def test_doubling_bands(spark):
    assert one(spark, fn.doubling_bands(F.lit(2.0), F.lit(20.0))) == [2.0, 4.0, 8.0, 16.0]
    assert one(spark, fn.doubling_bands(F.lit(2.0), F.lit(16.0))) == [2.0, 4.0, 8.0]
    assert one(spark, fn.doubling_bands(F.lit(20.0), F.lit(20.0))) == []


def test_rain_rate(spark):
    # 36 mm/h on one square metre is a hundredth of a litre per second.
    assert one(spark, fn.mm_per_hr_to_m_per_s(F.lit(36.0))) == pytest.approx(1e-5)


@pytest.mark.parametrize("text,want", [("EPSG:28355", 28355), ("28355", 28355), ("urn:ogc:def:crs:EPSG::32755", 32755), ("none", None)])
def test_epsg_code(spark, text, want):
    assert one(spark, fn.epsg_code(F.col("t")), t=text) == want


@pytest.mark.parametrize("version,want", [("3.3.1.dev123+g57a64ab", "57a64ab"), ("3.3.1", None), ("unknown", None)])
def test_version_sha(spark, version, want):
    assert one(spark, fn.version_sha(F.col("t")), t=version) == want


@pytest.mark.parametrize("path,step,quantity", [
    ("o/run_1_depth_Time_000060.tif", 60, "depth"), ("o/run_1_depthIntegratedVelocity_001200.tif", 1200, "depthIntegratedVelocity"),
    ("o/run_1_stage_max.tif", None, "stage"), ("scenario.json", None, None), ("o/run_1_depth_000060.png", None, None),
    ("o/run_1_depth_000060.tif.aux.xml", None, None), ("o/run_1_depth_max.TIF", None, None)])
def test_raster_names(spark, path, step, quantity):
    assert one(spark, fn.step_of(F.col("p")), p=path) == step
    assert one(spark, fn.quantity_of(F.col("p")), p=path) == quantity


def test_text_lines(spark):
    line = one(spark, fn.diag_line(*[F.lit(v) for v in (480, 125.0, 2.1, 2.2, 0.23, 1234.0)]))
    assert line == "steps=480 dt=125ms vmax=2.10m/s v_impl=2.2m/s wet=23% vol=1234m³"
    mesh = one(spark, fn.mesh_line(*[F.lit(v) for v in (100530, 0.278, 0.4, 0.476, 28.01, 10.0, 20.0)]))
    assert mesh == "100,530 triangles | inradius min=0.278m p5=0.400m median=0.476m | min_angle=28.0° | worst at (10, 20)"


@pytest.mark.parametrize("text,is_null,complete", [
    ("{}", True, None), ("not json", True, None), ("[1]", True, None),
    ('{"core":{"sha":"57a64ab"},"tool":{"sha":"abc"}}', False, True), ('{"core":{"sha":"57a64ab"},"tool":{"sha":null}}', False, False),
    ('{"core":{"sha":123}}', False, False), ('{"core":7}', False, False)])
def test_manifest(spark, text, is_null, complete):
    got = one(spark, fn.normalise_manifest(F.col("m")), m=text)
    assert (got is None) is is_null
    if not is_null:
        assert got.complete is complete and got.provenance_source == "container"


def test_inflow_feature(spark):
    import json

    f = json.loads(one(spark, fn.inflow_feature(F.lit("node-A"), F.lit(5.0), F.lit(5.0), F.lit(1e-4))))
    assert f["id"] == "inf_16_inflow_01.node-A"
    assert f["geometry"]["coordinates"] == [[-5.0, 5.0], [15.0, 5.0]]
    assert float(f["properties"]["data"]) == 1e-4 and f["properties"]["description"] is None


def test_iso_time_without_zone_is_utc(spark):
    a = one(spark, F.unix_seconds(fn.iso_timestamp(F.col("t"))), t="2024-01-01T00:00:00")
    b = one(spark, F.unix_seconds(fn.iso_timestamp(F.col("t"))), t="2024-01-01T10:00:00+10:00")
    assert a == b == 1704067200
    assert one(spark, F.unix_seconds(fn.valid_time(fn.iso_timestamp(F.col("t")), F.lit(60))), t="2024-01-01T00:00:00Z") == 1704067260
