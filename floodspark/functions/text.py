"""String, JSON and time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["run_label", "result_zip_name", "archive_prefix", "version_sha", "step_of", "quantity_of",
           "file_name", "parent_dirs", "file_stem", "diag_line", "mesh_line", "normalise_manifest",
           "inflow_feature", "iso_timestamp", "valid_time", "epsg_code"]


def run_label(project: Column, scenario: Column, run_id: Column) -> Column:
    return F.concat_ws("_", F.lit("run"), project, scenario, run_id)


def result_zip_name(project: Column, scenario: Column, run_id: Column) -> Column:
    return F.concat(F.concat_ws("_", project, scenario, run_id), F.lit("_results.zip"))


def archive_prefix(project: Column, scenario: Column, run_id: Column) -> Column:
    return F.concat(F.lit("cold-archive/"), F.concat_ws("_", project, scenario, run_id), F.lit("/"))


def _match(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def version_sha(version: Column) -> Column:
    """Commit in the local part of a version (``1.2+gabc123``), else null."""
    return _match(version, r"\+g([0-9a-fA-F]+)")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def step_of(path: Column) -> Column:
    """The six-digit step that ends a raster's name; null for files that are no raster."""
    return F.when(F.endswith(path, F.lit(".tif")), _match(file_stem(path), r"(\d{6})$").cast("bigint"))


def quantity_of(path: Column) -> Column:
    """Longest known quantity followed by a step or by ``max`` in a raster's name; null for files that are no raster."""
    return F.when(F.endswith(path, F.lit(".tif")), _match(
        file_stem(path), r"_(depthIntegratedVelocity|depth|velocity|stage)_(?:Time_)?(?:\d{6}|max)$"))


def epsg_code(text: Column) -> Column:
    return _match(F.trim(text), r"^(?:EPSG:|.*:)?(\d+)$").cast("int")


def diag_line(n_steps, last_dt_ms, max_speed, implied, wet_fraction, volume) -> Column:
    return F.format_string(
        "steps=%d dt=%.0fms vmax=%.2fm/s v_impl=%.1fm/s wet=%.0f%% vol=%.0fm³",
        n_steps, last_dt_ms, max_speed, implied, wet_fraction * 100, volume)


def mesh_line(n, rmin, p5, median, min_angle, x, y) -> Column:
    return F.format_string(
        "%,d triangles | inradius min=%.3fm p5=%.3fm median=%.3fm | min_angle=%.1f° | worst at (%.0f, %.0f)",
        n, rmin, p5, median, min_angle, x, y)


def normalise_manifest(manifest: Column, components=("core", "tool")) -> Column:
    """Provenance struct of a build manifest; null when it is empty or not an object."""
    parsed = F.try_parse_json(manifest)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT<") & (F.schema_of_variant(parsed) != "OBJECT<>")

    def text(path: str) -> Column:
        value = F.try_variant_get(parsed, path, "string")
        return F.when(value != "", value)

    parts = [
        F.struct(text(f"$.{c}.git_url").alias("git_url"), text(f"$.{c}.sha").alias("sha"),
                 F.lit("container").alias("source")).alias(c)
        for c in components
    ]
    complete = F.lit(True)
    for c in components:
        complete = complete & text(f"$.{c}.sha").isNotNull()
    return F.when(is_object, F.struct(
        *parts, F.lit("container").alias("provenance_source"), complete.alias("complete"),
        text("$.image_digest").alias("image_digest"), text("$.jobdef").alias("jobdef")))


def inflow_feature(node_id: Column, x: Column, y: Column, flow: Column) -> Column:
    """GeoJSON text of a surface inflow: a 20 m line across the node."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.concat(F.lit("inf_16_inflow_01."), node_id.cast("string")).alias("id"),
        F.struct(F.lit("LineString").alias("type"),
                 F.array(F.array(x - 10.0, y), F.array(x + 10.0, y)).alias("coordinates")).alias("geometry"),
        F.lit("the_geom").alias("geometry_name"),
        F.struct(F.lit(1).alias("fid"), F.lit("Surface").alias("type"),
                 flow.cast("string").alias("data"),
                 F.lit(None).cast("string").alias("description")).alias("properties"),
    ), {"ignoreNullFields": "false"})


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text as a timestamp; a text without zone is UTC (the session zone)."""
    return F.try_to_timestamp(text)


def valid_time(start: Column, step_s: Column) -> Column:
    return F.timestamp_add("SECOND", step_s, start)
