import json

from floodspark import sources


def feature(i, **props):
    return {"type": "Feature", "id": f"layer.{i}", "properties": props, "geometry": {"type": "Point", "coordinates": [i, i + 0.5]}}


def collection(features, **more):
    return {"type": "FeatureCollection", "name": "x", **more, "features": features}


CRS = {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::28356"}}


def rows(spark, path):
    got = sources.read_feature_files(spark, str(path)).collect()
    return {(r.path.rsplit("/", 1)[1], r.feature_no): r for r in got}, len(got)


def test_layouts_of_one_collection(spark, tmp_path):
    """However a file is written, its features come out alike and in order."""
    awkward = [feature(0, method='says "Feature" and {"type":"Feature"}', kind="Feature"), feature(1, method=None, raised_height="2.5", near_spacing=3),
               {**feature(2, mannings=0.04), "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 0]], [[1, 1], [2, 1], [1, 2], [1, 1]]]}},
               {**feature(3, resolution="fine"), "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}},
               {**feature(4), "geometry": None, "properties": None}]
    plain = awkward[1:]
    turned = [{k: f[k] for k in ("id", "properties", "geometry", "type")} for f in awkward]
    (tmp_path / "tight.geojson").write_text(json.dumps(collection(plain, crs=CRS), separators=(",", ":")))
    (tmp_path / "wide.geojson").write_text(json.dumps(collection(plain, crs=CRS), indent=4))
    (tmp_path / "tail.geojson").write_text(json.dumps({**collection(plain), "crs": CRS}))
    (tmp_path / "odd.geojson").write_text(json.dumps(collection(awkward, crs=CRS)))
    (tmp_path / "turned.geojson").write_text(json.dumps(collection(turned, crs=CRS)))
    (tmp_path / "none.geojson").write_text(json.dumps(collection([], crs=CRS)))
    (tmp_path / "broken.geojson").write_text("{")
    found, n = rows(spark, tmp_path)
    assert n == 3 * 4 + 2 * 5
    for name, first in (("tight", 1), ("wide", 1), ("tail", 1), ("odd", 0), ("turned", 0)):
        some = [found[f"{name}.geojson", k] for k in range(5 - first)][1 - first:]
        assert [r.feature_id for r in some] == [f"layer.{k}" for k in (1, 2, 3, 4)] and {r.epsg_code for r in some} == {28356}
        assert (some[0].method, some[0].raised_height, some[0].near_spacing, some[0].x, some[0].y) == (None, 2.5, 3.0, 1.0, 1.5)
        assert [(p.x, p.y) for p in some[1].ring] == [(0, 0), (4, 0), (4, 3), (0, 0)] and some[1].mannings == 0.04 and some[1].line is None
        assert [p.x for p in some[2].line] == [0, 1, 2, 3] and some[2].resolution is None and some[2].ring is None
        assert (some[3].geometry, some[3].x, some[3].ring) == (None, None, None)
    assert found["odd.geojson", 0].method == found["turned.geojson", 0].method == 'says "Feature" and {"type":"Feature"}'


def test_a_large_file_is_many_tasks(spark, tmp_path):
    many = [feature(i, method="m" * (i % 700), mannings=i) for i in range(20_000)]
    (tmp_path / "large.geojson").write_text(json.dumps(collection(many, crs=CRS)))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(1 << 20))
        found, n = rows(spark, tmp_path)
        raw = spark.read.option("lineSep", '"Feature"').text(str(tmp_path))
        assert raw.rdd.getNumPartitions() >= 8
    finally:
        spark.conf.set(key, before)
    assert n == 20_000
    assert all((found["large.geojson", i].feature_id, found["large.geojson", i].mannings, len(found["large.geojson", i].method), found["large.geojson", i].epsg_code)
               == (f"layer.{i}", i, i % 700, 28356) for i in range(20_000))
