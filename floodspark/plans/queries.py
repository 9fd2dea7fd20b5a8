"""Registered queries: one per operator, each over whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import line_length, normalise_manifest, ring_area, rounded
from ..operators import artefacts, forcing, inputs, lines as polylines, mesh, nearest, outlines, quality, results, runs, spatial, telemetry
from ..schemas import DIAGNOSTICS
from ..session import configure, shared_dir
from ..sources import nest_run_summary, read_diagnostics, read_run_summaries, write_diagnostics, write_run_summaries
from ..sources import read_feature_files as read_feature_files_of, write_diagnostics_files
from ..streaming import live
from .probes import lines, view, zones

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2024-02-01 00:00:00"
HOUR = 3600


def _flat(df: DataFrame) -> DataFrame:
    """Plain output types: BIGINT, DOUBLE to six decimals, times as epoch microseconds."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _flat(fn(spark, sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


# Runs and their cell states -------------------------------------------------

def _cells(spark, d, stream=False):
    return view(spark, d, "p_cell_state", stream)


def _diagnostics(spark, d):
    diag = results.flow_diagnostics(_cells(spark, d))
    diag = diag.withColumn("total_steps", (F.col("t") / 60 * (50 + F.col("run_id") % 13)).cast("bigint"))
    return results.step_deltas(diag, F.lit(60.0))


def _summaries(spark, d):
    duration = F.max(F.when(F.col("run_id") % 3 == 0, F.lit(420)).otherwise(F.lit(600)))
    s = runs.run_summary(_diagnostics(spark, d), duration, wall_s=F.sum(F.col("n_steps") / 10.0))
    return (s.withColumn("resolution", F.col("run_id") % 3)
            .withColumn("cpu_model", F.concat(F.lit("cpu"), F.col("run_id") % 2)))


@query
def flow_diagnostics(spark, d):
    return results.flow_diagnostics(_cells(spark, d))


@query
def flow_diagnostics_live(spark, d):
    cells = _cells(spark, d, True).withColumn("at", F.timestamp_seconds("t"))
    return live.drain(spark, live.flow_diagnostics_stream(cells, at="at"), "update", ["run_id", "t"])


@query
def step_deltas(spark, d):
    return _diagnostics(spark, d).select("run_id", "t", "total_steps", "n_steps", "mean_dt_ms")


@query
def run_summary(spark, d):
    return _summaries(spark, d).drop("resolution", "cpu_model", "peak_mem_mb")


@query
def run_summary_documents(spark, d):
    doc = nest_run_summary(_summaries(spark, d).withColumn("run_label", F.concat(F.lit("run_"), "run_id")))
    text = doc.select(F.to_json(F.struct("*")).alias("j"))
    back = text.select(F.from_json("j", doc.schema).alias("s"))
    return back.select("s.run.run_label", "s.run.outcome", "s.model.n_yieldsteps", "s.stability.stable",
                       "s.performance.min_dt_ms", "s.schema_version")


@query
def run_summary_files(spark, d):
    """Summaries written and read back, several a file."""
    doc = nest_run_summary(_summaries(spark, d).withColumn("run_label", F.concat(F.lit("run_"), "run_id")))
    path = f"{shared_dir(spark).rstrip('/')}/summaries-{uuid.uuid4().hex}"
    write_run_summaries(doc, path)
    return read_run_summaries(spark, path).select(
        "run.run_label", "run.outcome", "model.n_yieldsteps", "stability.stable", "performance.min_dt_ms", "schema_version", "status")


def _diagnostics_rows(spark, d):
    flow = results.flow_diagnostics(_cells(spark, d))
    fields = {"t": "sim_time_s", "wet_fraction": "wet_fraction", "volume_m3": "volume_m3", "last_dt_ms": "last_dt_ms"}
    rows = flow.select(F.col("run_id").cast("string").alias("run"), F.floor(F.col("t") / 3600).cast("bigint").alias("batch_number"), "wet_cells",
                       *[F.col(a).cast("double").alias(b) for a, b in fields.items()])
    for f in DIAGNOSTICS.fields:
        rows = rows if f.name in rows.columns else rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    return rows


def _read_back(spark, path):
    return read_diagnostics(spark, path).select("run", "batch_number", "wet_cells", "sim_time_s", "wet_fraction", "volume_m3")


@query
def diagnostics_files(spark, d):
    """Flow figures written as diagnostics and read back, many runs a file; ``diagnostics_sink`` writes one a run and batch."""
    path = f"{shared_dir(spark).rstrip('/')}/diagnostics-{uuid.uuid4().hex}"
    write_diagnostics(_diagnostics_rows(spark, d), path, named=True)
    return _read_back(spark, path)


@query
def diagnostics_sink(spark, d):
    """The same through the sink with one numbered file a run and batch, mesh summary included."""
    path = f"{shared_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    write_diagnostics_files(_diagnostics_rows(spark, d).withColumn("mesh_summary", F.concat(F.lit("run "), "run")), path)
    return _read_back(spark, path)


@query
def stalled_runs(spark, d):
    return runs.stalled_runs(_summaries(spark, d))


@query
def throughput_by_resolution(spark, d):
    return runs.throughput_by_resolution(_summaries(spark, d)).drop("peak_mem_mb")


@query
def compare_hosts(spark, d):
    return runs.compare_hosts(_summaries(spark, d)).drop("peak_mem_mb")


@query
def clip_dry(spark, d):
    return results.clip_counts(_cells(spark, d), ["run_id"])


@query
def peak_envelope(spark, d):
    return results.peak_envelope(results.output_quantities(_cells(spark, d)))


@query
def output_quantities(spark, d):
    q = results.output_quantities(_cells(spark, d))
    return q.groupBy("run_id", "t").agg(
        F.sum("depth").alias("sum_depth"), F.sum("velocity").alias("sum_velocity"),
        F.sum("depthIntegratedVelocity").alias("sum_div"), F.count_if(F.col("velocity") == 0).alias("n_still"))


@query
def progress_eta(spark, d):
    return runs.progress_eta(view(spark, d, "p_eta")).select("id", "pct", "eta_s")


@query
def resource_corpus(spark, d):
    peaks = telemetry.phase_peaks(view(spark, d, "p_phase_events"), order="seq")
    spans = telemetry.phase_durations(view(spark, d, "p_phase_events"), NOW).where("level = 'phase'")
    outcomes = _summaries(spark, d).select("run_id", "outcome")
    features = view(spark, d, "p_features").select(
        "run_id", runs.feature_value(F.col("bag"), "triangle_count", "bigint").alias("triangle_count"),
        runs.feature_value(F.col("bag"), "min_area").alias("min_area"))
    return runs.resource_corpus(features, peaks, spans, outcomes)


# Meshes ---------------------------------------------------------------------

def _mesh(spark, d):
    return view(spark, d, "p_vertices"), view(spark, d, "p_triangles")


@query
def mesh_qa(spark, d):
    return mesh.mesh_qa(*_mesh(spark, d), keys=["mesh_id"])


@query
def area_histogram(spark, d):
    return mesh.area_histogram(*_mesh(spark, d), keys=["mesh_id"])


@query
def mesh_inradius_stats(spark, d):
    return mesh.mesh_inradius_stats(mesh.triangle_cells(*_mesh(spark, d), keys=["mesh_id"]), ["mesh_id"])


@query
def mesh_wkt(spark, d):
    return mesh.triangles_to_wkt(*_mesh(spark, d), keys=["mesh_id"])


@query
def mesh_fingerprint(spark, d):
    return mesh.mesh_fingerprint(*_mesh(spark, d), keys=["mesh_id"])


@query
def boundary_types(spark, d):
    from .probes import table

    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("boundary_type"))
    return mesh.boundary_types(edges, ["run_id"]).withColumn("boundary_types", F.concat_ws(",", "boundary_types"))


# Spatial assignment -----------------------------------------------------------

@query
def points_in_zones(spark, d):
    hits = spatial.points_in_polygons(view(spark, d, "p_vertices"), zones(spark, d).select("zone_id", "ring"))
    return hits.select("vid", "zone_id")


@query
def lines_inside(spark, d):
    return spatial.lines_inside_polygon(lines(spark, d), zones(spark, d), "line_id", "zone_id")


@query
def route_structures(spark, d):
    return inputs.route_structures(zones(spark, d)).select("zone_id", "method", "treatment")


@query
def assign_friction(spark, d):
    z = zones(spark, d)
    friction = z.withColumn("seq", F.col("zone_id"))
    return inputs.assign_friction(view(spark, d, "p_vertices"), z, friction).select("vid", "mannings")


@query
def assign_friction_raster(spark, d):
    raster = view(spark, d, "p_vertices").where("elevation >= 1").select("vid", (F.col("elevation") / 100).alias("n"))
    return inputs.assign_friction(view(spark, d, "p_vertices"), zones(spark, d), None, raster).select("vid", "mannings")


@query
def apply_raised(spark, d):
    return inputs.apply_raised(view(spark, d, "p_vertices"), zones(spark, d), structure_key="zone_id").select(
        "vid", "elevation", "raised_by", "n_structures")


def _fleet(df, key):
    """Two packages over one area."""
    return df.withColumn("package_id", F.col(key) % 2)


@query
def assign_friction_fleet(spark, d):
    z = _fleet(zones(spark, d), "zone_id")
    return inputs.assign_friction(_fleet(view(spark, d, "p_vertices"), "vid"), z, z.withColumn("seq", F.col("zone_id")), on=["package_id"]).select(
        "package_id", "vid", "mannings")


@query
def apply_raised_fleet(spark, d):
    cells, z = _fleet(view(spark, d, "p_vertices"), "vid"), _fleet(zones(spark, d), "zone_id")
    return inputs.apply_raised(cells, z, structure_key="zone_id", on=["package_id"]).select("package_id", "vid", "elevation", "n_structures")


@query
def target_area_fleet(spark, d):
    cells, z = _fleet(view(spark, d, "p_vertices"), "vid"), _fleet(zones(spark, d), "zone_id")
    return spatial.target_area(cells, z, 5.0, on=["package_id"]).select("package_id", "vid", "target_area")


@query
def nearest_vertex_fleet(spark, d):
    return nearest.nearest_vertex(_fleet(view(spark, d, "p_gauges"), "gauge_id"), _fleet(view(spark, d, "p_vertices"), "vid"), on=["package_id"])


@query
def target_area(spark, d):
    return spatial.target_area(view(spark, d, "p_vertices"), zones(spark, d), 5.0).select("vid", "target_area")


@query
def assign_nodes(spark, d):
    nodes = view(spark, d, "p_gauges").withColumnRenamed("gauge_id", "node_id")
    z = zones(spark, d).withColumnRenamed("zone_id", "catchment_id")
    return inputs.assign_nodes(z, nodes).select("catchment_id", "n_nodes", "node_id", "status")


@query
def breakline_grading(spark, d):
    return spatial.breakline_grading(view(spark, d, "p_vertices"), lines(spark, d), 20.0)


@query
def clip_lines(spark, d):
    parts = polylines.clip_lines(lines(spark, d), zones(spark, d), "line_id", "zone_id")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return parts.where("t0 < t1").groupBy("line_id", "seg", "zone_id").agg(F.round(F.sum(length), 4).alias("inside_length"))


@query
def node_lines(spark, d):
    pieces = polylines.node_lines(lines(spark, d), "line_id")
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return pieces.groupBy("line_id", "seg").agg(F.count(F.lit(1)).alias("n_pieces"), F.round(F.sum(length), 4).alias("length"))


@query
def densify_polyline(spark, d):
    dense = spatial.densify_polyline(lines(spark, d), "line_id", 10.0)
    return dense.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


@query
def dedupe_polyline(spark, d):
    kept = polylines.dedupe_polyline(lines(spark, d), 60.0)
    return kept.select("line_id", F.size("line").alias("n_vertices"), line_length(F.col("line")).alias("length"))


@query
def drop_collinear(spark, d):
    kept = polylines.drop_collinear(lines(spark, d), 40.0)
    return kept.select("line_id", F.size("line").alias("n_vertices"), line_length(F.col("line")).alias("length"))


@query
def footprint_clusters(spark, d):
    return spatial.footprint_clusters(zones(spark, d).where("method = 'Reflective'"), "zone_id")


@query
def footprint_clusters_fleet(spark, d):
    return spatial.footprint_clusters(_halves(zones(spark, d).where("method = 'Reflective'")), "zone_id", on=["package_id"])


def _halves(z):
    """Two packages of neighbouring zones over one area."""
    return z.withColumn("package_id", F.floor(F.col("zone_id") / 4) % 2)


@query
def merged_outlines(spark, d):
    z = _halves(zones(spark, d).where("method = 'Reflective'"))
    return outlines.outline_counts(z, outlines.merged_outlines(z, on=["package_id"]), ["package_id"])


@query
def condition_breaklines(spark, d):
    low, high = (F.struct(f(x).alias("x"), f(y).alias("y")) for f, x, y in ((F.min, "x0", "y0"), (F.max, "x2", "y2")))
    box = view(spark, d, "p_lines").agg(low.alias("a"), high.alias("b")).select(F.lit(1).cast("bigint").alias("zone_id"), F.array(
        "a", F.struct(F.col("b.x").alias("x"), F.col("a.y").alias("y")), "b", F.struct(F.col("a.x").alias("x"), F.col("b.y").alias("y"))).alias("ring"))
    return polylines.condition_breaklines(lines(spark, d), box)


@query
def read_feature_files(spark, d):
    """Zones written as feature collections, one file a package, and read back as typed features."""
    z = zones(spark, d)
    corners = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.array(p["x"], p["y"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("zone_id").alias("id"), F.struct("method", "raised_height", "mannings", "resolution").alias("properties"),
                       F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates")).alias("geometry"))
    files = z.groupBy((F.floor(F.col("zone_id") / 50)).alias("package")).agg(F.array_sort(F.collect_list(F.struct("zone_id", feature.alias("f")))).alias("f"))
    crs = F.struct(F.lit("name").alias("type"), F.struct(F.lit("urn:ogc:def:crs:EPSG::28356").alias("name")).alias("properties"))
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), crs.alias("crs"), F.transform("f", lambda r: r["f"]).alias("features")))
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    files.select("package", text.alias("value")).write.partitionBy("package").text(path)
    got = read_feature_files_of(spark, path, "part-*")
    return got.select(F.regexp_extract("path", r"package=(\d+)", 1).cast("bigint").alias("package"), "feature_no", F.col("feature_id").cast("bigint").alias("zone_id"),
                      "epsg_code", "method", "raised_height", "mannings", "resolution", (F.size("ring") - 1).alias("n_corners"), ring_area(F.col("ring")).alias("area"))


@query
def nearest_vertex(spark, d):
    return nearest.nearest_vertex(view(spark, d, "p_gauges"), view(spark, d, "p_vertices"))


def _peaks(spark, d):
    at = view(spark, d, "p_vertices").select("vid", "x", "y")
    peak = results.peak_envelope(_cells(spark, d), ["stage"], ["cell_id"])
    return at.join(peak.select(F.col("cell_id").alias("vid"), F.col("max_stage").alias("peak_stage")), "vid")


@query
def gauge_scorecard(spark, d):
    return nearest.gauge_scorecard(view(spark, d, "p_gauges"), _peaks(spark, d)).select(
        "gauge_id", "vid", "distance", "peak_stage", "diff", "passed")


@query
def gauge_score_totals(spark, d):
    scored = nearest.gauge_scorecard(view(spark, d, "p_gauges"), _peaks(spark, d))
    return nearest.score_totals(scored.withColumn("tier", F.col("field_stage").cast("bigint")), ["tier"])


@query
def grid_knn(spark, d):
    v = view(spark, d, "p_vertices")
    box = v.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    z = zones(spark, d)
    cells = nearest.grid_cells(box, 25.0)
    grid = nearest.grid_knn(v, cells, "elevation", boundary=z, holes=z.where("method = 'Reflective'"))
    return grid.select("row_no", "col_no", F.when(~F.isnan("value"), F.col("value")).alias("value"))


# Rasters ----------------------------------------------------------------------

def _raster_cells(spark, d):
    cells = view(spark, d, "p_raster")
    frame = cells.select("raster_id").distinct().select(
        "raster_id", *[F.lit(v).alias(n) for n, v in (("x0", 0.0), ("y0", 0.0), ("dx", 10.0), ("dy", -10.0), ("nodata", -9999.0))])
    return results.georeference_cells(frame, cells)


@query
def raster_nodata_in_boundary(spark, d):
    found = results.raster_nodata_in_boundary(_raster_cells(spark, d), zones(spark, d), ["raster_id", "step"])
    return found.select("raster_id", "step", "zone_id", "n_nodata")


@query
def compare_runs(spark, d):
    cells = view(spark, d, "p_raster")
    side = lambda r: cells.where(F.col("raster_id") == r).drop("raster_id")
    both = results.compare_runs(side("a"), side("b"))
    return both.select("frame", "row_no", "col_no", F.when(~F.isnan("diff"), F.col("diff")).alias("diff"), "status")


@query
def value_range(spark, d):
    return results.value_range(view(spark, d, "p_raster"), ["raster_id", "step"])


# Forcing ----------------------------------------------------------------------

def _forcing(spark, d):
    return view(spark, d, "p_series"), view(spark, d, "p_windows")


@query
def align_forcing(spark, d):
    return forcing.align_forcing(*_forcing(spark, d), step_s=HOUR)


@query
def forcing_gaps(spark, d):
    return forcing.forcing_gaps(*_forcing(spark, d), step_s=HOUR)


def _times(spark, d):
    from .probes import table

    # The odd fraction keeps interpolated values off the edges of rounding.
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("u"), "user_id").alias("series_id"), "event_id",
                    (F.col("event_id") * 37 % 1728000 + F.lit(1.0) / 9973).alias("t_s"))


@query
def forcing_at(spark, d):
    runs = forcing.forcing_anchors(*_forcing(spark, d), step_s=HOUR)
    return forcing.forcing_at(runs, _times(spark, d), HOUR).select("series_id", "event_id", "value")


@query
def interpolate_boundary(spark, d):
    out = forcing.interpolate_boundary(view(spark, d, "p_series"), _times(spark, d).select("series_id", "t_s").distinct())
    return out.select("series_id", "t_s", "stage", "xmom")


def _boundary_times(spark, d):
    return view(spark, d, "p_boundary_times")


@query
def time_boundary(spark, d):
    out = forcing.time_boundary(view(spark, d, "p_time_features"), _boundary_times(spark, d))
    return out.select("package_id", "event_id", "t_s", "stage", "ymom", "status")


@query
def time_boundary_issues(spark, d):
    return forcing.time_boundary_issues(view(spark, d, "p_time_features"), _boundary_times(spark, d))


@query
def mass_balance(spark, d):
    anchors = forcing.forcing_anchors(*_forcing(spark, d), step_s=HOUR)
    digit = F.substring("series_id", -1, 1)
    kind = F.when(digit == "7", F.lit("rainfall")).when(digit == "8", F.lit("catchment")).otherwise(F.lit("inflow"))
    area = F.when(digit == "7", F.lit(2.5e6)).otherwise(F.lit(1.25e6))
    expected = forcing.forcing_volume(anchors, kind, area, HOUR)
    return forcing.mass_balance(expected, view(spark, d, "p_volumes"), 0.25).select(
        "series_id", F.round("expected_m3", 3).alias("expected_m3"), F.round("relative_error", 5).alias("relative_error"), "passed")


@query
def classify_forcing(spark, d):
    c = forcing.classify_forcing(view(spark, d, "p_rainfall"))
    return c.select("feature_id", "kind", "constant", F.when(F.col("kind") == "series", F.size("series")).alias("n_samples"))


def _catchments(spark, d):
    return zones(spark, d).withColumnRenamed("zone_id", "catchment_id")


@query
def catchment_conflicts(spark, d):
    return forcing.catchment_conflicts(view(spark, d, "p_rainfall"), _catchments(spark, d))


@query
def catchment_runoff(spark, d):
    return inputs.catchment_runoff(_catchments(spark, d), view(spark, d, "p_rainfall")).select("catchment_id", "flow_m3_s")


@query
def catchment_inflows(spark, d):
    nodes = view(spark, d, "p_gauges").withColumnRenamed("gauge_id", "node_id")
    found = inputs.catchment_inflows(_catchments(spark, d), nodes, view(spark, d, "p_rainfall"))
    text = F.col("feature")
    return found.select("catchment_id", "node_id", "flow_m3_s", F.get_json_object(text, "$.id").alias("inflow_id"),
                        F.get_json_object(text, "$.geometry.coordinates[0][0]").cast("double").alias("start_x"))


# Scenarios ----------------------------------------------------------------------

@query
def validate_scenarios(spark, d):
    return quality.validate_scenarios(view(spark, d, "p_scenarios"), "report")


@query
def run_names(spark, d):
    return artefacts.with_run_names(view(spark, d, "p_scenarios")).select(
        "id", "run_label", "output_dir", "result_zip", "archive_prefix")


@query
def yieldstep(spark, d):
    return inputs.with_yieldstep(view(spark, d, "p_scenarios")).select("id", "yieldstep_s")


@query
def utm_zone(spark, d):
    return inputs.with_utm_zone(view(spark, d, "p_scenarios"), inputs.crs_dimension(spark)).select(
        "id", "epsg_code", "zone", "hemisphere", "zone_status")


@query
def grid_resolution(spark, d):
    regions = view(spark, d, "p_zones").select(F.col("package_id").alias("id"), F.col("resolution").alias("region_resolution"))
    return inputs.grid_resolution(view(spark, d, "p_scenarios"), regions).select("id", "grid_resolution")


@query
def boundary_extent(spark, d):
    return inputs.boundary_extent(lines(spark, d))


@query
def boundary_ring(spark, d):
    ring = inputs.boundary_ring(lines(spark, d), feature="line_id")
    return ring.select("package_id", "ring_seq", "line_id", "vertex", "boundary", "x", "y")


# Artefacts ----------------------------------------------------------------------

@query
def package_report(spark, d):
    return artefacts.package_report(view(spark, d, "p_files"))


@query
def archive_gaps(spark, d):
    files = view(spark, d, "p_files")
    have = files.select("run_id").distinct().withColumn("run_label", F.concat(F.lit("run_"), "run_id"))
    return artefacts.archive_gaps(have, files)


@query
def raster_catalogue(spark, d):
    keyed = artefacts.catalogue_key(view(spark, d, "p_files"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return artefacts.catalogue_extents(keyed)


@query
def catalogue_skips(spark, d):
    files = artefacts.catalogue_key(view(spark, d, "p_files"))
    have = files.select("run_id").distinct().withColumn(
        "model_start", F.when(F.col("run_id") % 4 != 0, F.lit("2024-01-01T00:00:00Z")))
    return artefacts.catalogue_skips(have, files)


@query
def check_provenance(spark, d):
    m = view(spark, d, "p_manifests").withColumn("p", normalise_manifest(F.col("manifest")))
    out = artefacts.check_provenance(m, F.col("p.core.sha"), F.col("installed_version"))
    return out.select("run_id", F.col("p.complete").alias("complete"), F.col("p.core.git_url").alias("git_url"),
                      "manifest_sha", "installed_sha", "provenance")


# Telemetry ------------------------------------------------------------------------

@query
def phase_peaks(spark, d):
    return telemetry.phase_peaks(view(spark, d, "p_phase_events"))


@query
def phase_spans(spark, d):
    return telemetry.phase_spans(view(spark, d, "p_phase_events"), NOW).select("run_id", "seq", "phase", "span_us")


@query
def phase_durations(spark, d):
    return telemetry.phase_durations(view(spark, d, "p_phase_events"), NOW)


@query
def phase_peaks_windowed(spark, d):
    stream = live.phase_peaks_stream(view(spark, d, "p_phase_events", True))
    return live.drain(spark, stream, "update", ["run_id", "phase", "window_start"])


@query
def latest_resource_row(spark, d):
    return telemetry.latest_resource_row(view(spark, d, "p_resource_rows"))


@query
def resource_ledger(spark, d):
    return live.drain(spark, live.resource_ledger(view(spark, d, "p_resource_rows", True)), "update", ["job_id"])


@query
def latest_progress(spark, d):
    return live.drain(spark, live.latest_progress(view(spark, d, "p_progress", True)), "update", ["run_id"])


@query
def instability_alerts(spark, d):
    return live.drain(spark, live.instability_alerts(view(spark, d, "p_live_diagnostics", True)), "update", ["run_id"])


@query
def heartbeats(spark, d):
    return telemetry.heartbeats(view(spark, d, "p_progress")).select("run_id", "seq", "ts")


@query
def heartbeats_live(spark, d):
    return live.drain(spark, live.heartbeats_stream(view(spark, d, "p_progress", True)), "append").select("run_id", "seq", "us")


@query
def stuck_runs(spark, d):
    return telemetry.stuck_runs(view(spark, d, "p_progress"), 86400, ("error", "purchase"), NOW)


@query
def stuck_runs_live(spark, d):
    stream = live.stuck_runs_stream(view(spark, d, "p_progress", True), 3600, ("error", "purchase"))
    return live.drain(spark, stream, "append")


@query
def typed_events(spark, d):
    return live.typed_events(view(spark, d, "p_log")).drop("message", "run_id", "ts")


@query
def typed_events_live(spark, d):
    typed = live.typed_events(view(spark, d, "p_log", True)).groupBy("run_id", "kind").agg(F.count(F.lit(1)).alias("n_events"))
    return live.drain(spark, typed, "update", ["run_id", "kind"])
