"""Model inputs: boundaries, structures, roughness, catchments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import epsg_code, inflow_feature, line_centroid, mm_per_hr_to_m_per_s, ring_area, yieldstep
from .forcing import classify_forcing, first_feature
from .ordered import number_rows
from .spatial import BIN, points_in_polygons


def external_boundaries(features: DataFrame) -> DataFrame:
    return features.where(F.col("location") == "External")


def time_boundaries(features: DataFrame) -> DataFrame:
    return external_boundaries(features).where(F.col("boundary") == "Time")


def route_structures(structures: DataFrame) -> DataFrame:
    """Adds treatment: what a structure's method does to the model."""
    m = F.col("method")
    return structures.withColumn("treatment", F.when(m.isNull(), F.lit("ignored"))
                                 .when(m == "Reflective", F.lit("hole")).when(m == "Mannings", F.lit("friction"))
                                 .when(m == "Raised", F.lit("elevation")).otherwise(F.lit("unknown")))


def with_yieldstep(scenarios: DataFrame) -> DataFrame:
    return scenarios.withColumn("yieldstep_s", yieldstep(F.col("duration")))


def with_epsg(df: DataFrame, text: str = "epsg") -> DataFrame:
    return df.withColumn("epsg_code", epsg_code(F.col(text)))


def crs_dimension(spark) -> DataFrame:
    """UTM zones by code: 326zz north, 327zz south, 283zz and 78zz the Australian grids (zones 46 to 59)."""
    zones = spark.range(1, 61).select(F.col("id").cast("int").alias("zone"))
    part = lambda base, name, hemi, rows: rows.select(
        (F.lit(base) + F.col("zone")).cast("int").alias("epsg_code"), "zone", F.lit(hemi).alias("hemisphere"),
        F.concat(F.lit(name), F.col("zone")).alias("crs_name"))
    return (part(32600, "WGS 84 / UTM zone ", "north", zones)
            .unionByName(part(32700, "WGS 84 / UTM zone ", "south", zones))
            .unionByName(part(28300, "GDA94 / MGA zone ", "south", zones.where("zone between 46 and 59")))
            .unionByName(part(7800, "GDA2020 / MGA zone ", "south", zones.where("zone between 46 and 59"))))


def with_utm_zone(df: DataFrame, crs: DataFrame, text: str = "epsg") -> DataFrame:
    """Adds epsg_code, zone, hemisphere and zone_status by a CRS table with one row a code.

    A CRS without a zone, or a table without that column, is read by its
    ``crs_name`` ("... zone 55", any case). The table is the caller's and may
    be of any size, so how to join it is left to Spark.
    """
    have = set(crs.columns)
    zone = F.col("zone").cast("int") if "zone" in have else F.lit(None).cast("int")
    if "crs_name" in have:
        zone = F.coalesce(zone, F.nullif(F.regexp_extract("crs_name", r"(?i)zone\s+(\d+)", 1), F.lit("")).try_cast("int"))
    hemisphere = F.col("hemisphere") if "hemisphere" in have else F.lit(None).cast("string")
    found = with_epsg(df, text).join(
        crs.select("epsg_code", zone.alias("zone"), hemisphere.alias("hemisphere")), "epsg_code", "left")
    return found.withColumn("zone_status", F.when(F.col("zone").isNotNull(), F.lit("ok"))
                            .when(F.col("epsg_code").isNull(), F.lit("error: no CRS"))
                            .otherwise(F.lit("error: not a UTM zone")))


def grid_resolution(scenarios: DataFrame, mesh_regions: DataFrame, key: str = "id") -> DataFrame:
    """Finest region resolution, else the scenario's, else 1000 m (a zero counts as absent)."""
    finest = mesh_regions.groupBy(key).agg(F.min("region_resolution").alias("_finest"))
    own = F.when(F.col("resolution") != 0, F.col("resolution"))
    return scenarios.join(finest, key, "left").withColumn(
        "grid_resolution", F.coalesce("_finest", own, F.lit(S.DEFAULT_GRID_RESOLUTION_M))).drop("_finest")


def boundary_extent(features: DataFrame, package: str = "package_id") -> DataFrame:
    """Extent and centre of the external boundary; a package without one is an error row."""
    ext = external_boundaries(features).select(package, F.explode("line").alias("p"))
    found = ext.groupBy(package).agg(
        F.min("p.x").alias("min_x"), F.max("p.x").alias("max_x"), F.min("p.y").alias("min_y"), F.max("p.y").alias("max_y"))
    everyone = features.select(package).distinct()
    return (everyone.join(found, package, "left")
            .withColumn("mid_x", F.col("max_x") - (F.col("max_x") - F.col("min_x")) / 2)
            .withColumn("mid_y", F.col("max_y") - (F.col("max_y") - F.col("min_y")) / 2)
            .withColumn("status", F.when(F.col("max_x").isNull(), F.lit("error: no external boundary coordinates"))
                        .otherwise(F.lit("ok"))))


def boundary_ring(features: DataFrame, package: str = "package_id", feature: str = "feature_id",
                  sectors: int = 256) -> DataFrame:
    """Boundary vertices clockwise around the package's centre, each with its tag.

    Features have a vertex array ``line``, ``location``, ``boundary`` and,
    where known, ``crs``; without a crs a package has no ring. The order is
    numbered by angular sector, so one large package is many small sorts.
    """
    ext = external_boundaries(features)
    if "crs" in features.columns:
        ext = ext.where(F.col("crs").isNotNull())
    middle = boundary_extent(features, package).where("status = 'ok'").select(package, "mid_x", "mid_y")
    placed = ext.join(middle, package).withColumn("_c", line_centroid(F.col("line"))).withColumn(
        "line_angle", F.atan2(F.col("_c.y") - F.col("mid_y"), F.col("_c.x") - F.col("mid_x")))
    v = placed.select(package, feature, "boundary", "line_angle", "mid_x", "mid_y", F.posexplode("line").alias("vertex", "p"))
    v = v.select(package, feature, "boundary", "line_angle", "vertex", F.col("p.x").alias("x"), F.col("p.y").alias("y"),
                 F.atan2(F.col("p.y") - F.col("mid_y"), F.col("p.x") - F.col("mid_x")).alias("angle"))
    sector = F.floor((F.lit(math.pi) - F.col("angle")) / F.lit(2 * math.pi / sectors))
    order = [F.col("angle").desc(), F.col("line_angle").desc(), F.col(feature), F.col("vertex")]
    return number_rows(v, [package], sector, order, "ring_seq").withColumn("ring_seq", F.col("ring_seq") - 1)


def _zones(structures: DataFrame | None, zones: DataFrame | None, on: Sequence[str] = ()) -> DataFrame | None:
    parts = []
    if structures is not None:
        parts.append(structures.where(F.col("method") == "Mannings").select(
            *on, "ring", F.lit(S.BUILDING_MANNINGS_N).alias("n"), F.lit(0).alias("layer"), F.lit(0).cast("bigint").alias("seq")))
    if zones is not None:
        parts.append(zones.select(*on, "ring", F.col("mannings").cast("double").alias("n"), F.lit(1).alias("layer"),
                                  F.col("seq").cast("bigint").alias("seq")))
    if not parts:
        return None
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def assign_friction(cells: DataFrame, structures: DataFrame | None = None, zones: DataFrame | None = None,
                    raster: DataFrame | None = None, key: str = "vid", size: float = BIN,
                    on: Sequence[str] = ()) -> DataFrame:
    """Manning's n per cell; ``on`` names columns that must agree, such as the package.

    Structures come first, then friction zones in feature order (``seq``),
    then the default. With a raster (key, n) zones do not apply and a cell
    that nothing covers has no value.
    """
    on = list(on)
    patches = _zones(structures, None if raster is not None else zones, on)
    out = cells
    if patches is not None:
        order = F.col("layer") * F.lit(2 ** 62) + F.col("seq")
        # Copies of a ring count once, with the value of the first.
        rings = patches.withColumn("_o", order).groupBy(*on, "ring").agg(F.min_by("n", "_o").alias("n"), F.min("_o").alias("_o"))
        hits = points_in_polygons(cells.select(*on, key, "x", "y"), rings, size, on)
        chosen = hits.groupBy(*on, key).agg(F.min_by("n", "_o").alias("_patch"))
        out = out.join(chosen, [*on, key], "left")
    else:
        out = out.withColumn("_patch", F.lit(None).cast("double"))
    if raster is not None:
        out = out.join(raster.select(*on, key, F.col("n").alias("_base")), [*on, key], "left")
        return out.withColumn("mannings", F.coalesce("_patch", "_base")).drop("_patch", "_base")
    return out.withColumn("mannings", F.coalesce("_patch", F.lit(S.DEFAULT_MANNINGS_N))).drop("_patch")


def raised_hits(cells: DataFrame, structures: DataFrame, default_height: float | None = None, key: str = "vid",
                structure_key: str = "structure_id", size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Pairs (cell, Raised structure, height) with the cell strictly inside."""
    return points_in_polygons(cells.select(*on, key, "x", "y"), _raised(structures, default_height, structure_key, on), size, on).select(
        *on, key, structure_key, "height")


def _raised(structures: DataFrame, default_height: float | None, structure_key: str, on: Sequence[str] = ()) -> DataFrame:
    fallback = S.BURN_HEIGHT_M if default_height is None else float(default_height)
    return structures.where(F.col("method") == "Raised").select(
        *on, structure_key, "ring", F.coalesce(F.col("raised_height").cast("double"), F.lit(fallback)).alias("height"))


def raised_structures_hit(cells: DataFrame, structures: DataFrame, key: str = "vid", structure_key: str = "structure_id",
                          size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Cells inside each Raised structure; one that holds no cell has no row."""
    return raised_hits(cells, structures, None, key, structure_key, size, on).groupBy(*on, structure_key).agg(F.count(F.lit(1)).alias("n_cells"))


def apply_raised(cells: DataFrame, structures: DataFrame, default_height: float | None = None, key: str = "vid",
                 structure_key: str = "structure_id", size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Bed raised by every footprint a cell lies in; overlapping footprints add up."""
    on = list(on)
    rings = _raised(structures, default_height, structure_key, on).groupBy(*on, "ring").agg(
        F.sum("height").alias("height"), F.count(F.lit(1)).alias("_n"))
    lift = points_in_polygons(cells.select(*on, key, "x", "y"), rings, size, on).groupBy(*on, key).agg(
        F.sum("height").alias("raised_by"), F.sum("_n").alias("n_structures"))
    return (cells.join(lift, [*on, key], "left")
            .withColumn("raised_by", F.coalesce("raised_by", F.lit(0.0)))
            .withColumn("n_structures", F.coalesce("n_structures", F.lit(0).cast("bigint")))
            .withColumn("elevation", F.col("elevation") + F.col("raised_by")))


def assign_nodes(catchments: DataFrame, nodes: DataFrame, key: str = "catchment_id", node_key: str = "node_id",
                 size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """The one node inside each catchment; none is skipped, several are an error."""
    # Nodes at one place are counted together before they meet the catchments.
    on = list(on)
    places = nodes.groupBy(*on, "x", "y").agg(F.count(F.lit(1)).alias("_n"), F.min(node_key).alias(node_key))
    hits = points_in_polygons(places, catchments.select(*on, key, "ring"), size, on)
    per = hits.groupBy(*on, key).agg(F.sum("_n").alias("n_nodes"), F.min(node_key).alias("_node"), F.min_by("x", node_key).alias("_nx"), F.min_by("y", node_key).alias("_ny"))
    n = F.coalesce("n_nodes", F.lit(0).cast("bigint"))
    one = F.col("n_nodes") == 1
    return (catchments.join(per, [*on, key], "left").withColumn("n_nodes", n)
            .withColumn(node_key, F.when(one, F.col("_node")))
            .withColumn("node_x", F.when(one, F.col("_nx"))).withColumn("node_y", F.when(one, F.col("_ny")))
            .withColumn("status", F.when(F.col("n_nodes") == 0, F.lit("skipped: no node")).when(one, F.lit("ok"))
                        .otherwise(F.lit("error: more than one node"))).drop("_node", "_nx", "_ny"))


def catchment_runoff(catchments: DataFrame, rainfall: DataFrame, package: str = "package_id",
                     index: str = "feature_id") -> DataFrame:
    """Steady discharge of each catchment under its package's first rainfall (mm/h)."""
    first = first_feature(classify_forcing(rainfall).select(package, index, "constant"), package, index)
    return catchments.join(first.select(package, "constant").where(F.col("constant").isNotNull()), package).withColumn(
        "flow_m3_s", mm_per_hr_to_m_per_s(F.col("constant")) * ring_area(F.col("ring"))).drop("constant")


def catchment_inflows(catchments: DataFrame, nodes: DataFrame, rainfall: DataFrame, key: str = "catchment_id",
                      node_key: str = "node_id", package: str = "package_id", index: str = "feature_id") -> DataFrame:
    """A surface inflow feature at the node of every catchment that has exactly one and some runoff."""
    on = [package] if package in nodes.columns else []
    assigned = assign_nodes(catchments, nodes, key, node_key, on=on).where("status = 'ok'")
    flows = catchment_runoff(assigned, rainfall, package, index).where(F.col("flow_m3_s") > 0)
    return flows.select(package, key, node_key, "node_x", "node_y", "flow_m3_s",
                        inflow_feature(F.col(node_key), F.col("node_x"), F.col("node_y"), F.col("flow_m3_s")).alias("feature"))


def with_geometry_area(df: DataFrame, ring: str = "ring") -> DataFrame:
    return df.withColumn("area", ring_area(F.col(ring)))


def unknown_structures(structures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Structures whose method no treatment knows, as data-quality rows."""
    return route_structures(structures).where("treatment = 'unknown'").select(*keys, "method")


def diamond(cx: Column, cy: Column, h: Column) -> Column:
    """Ring of a square standing on a corner: centre (cx, cy), half diagonal h."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(cx - h, cy), p(cx, cy - h), p(cx + h, cy), p(cx, cy + h))
