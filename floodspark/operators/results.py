"""Cell states, frames and rasters of finished runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from .ordered import row_at_extreme
from .spatial import BIN, bin_of, points_in_polygons, _segment_bins
from ..functions import inside_ring, ring_edges


def with_wet_flag(cells: DataFrame) -> DataFrame:
    """Adds depth and wet: deeper than a millimetre and not a ghost cell."""
    full = F.coalesce(F.col("is_full"), F.lit(True)) if "is_full" in cells.columns else F.lit(True)
    return (cells.withColumn("depth", F.col("stage") - F.col("elevation"))
            .withColumn("is_full", full)
            .withColumn("wet", (F.col("depth") > S.WET_THRESHOLD_M) & F.col("is_full")))


def output_quantities(cells: DataFrame, min_height: float = S.MIN_ALLOWED_HEIGHT_M) -> DataFrame:
    """Adds depth, velocity and depthIntegratedVelocity; still water below ``min_height``."""
    depth = F.col("stage") - F.col("elevation")
    speed = F.when(depth >= min_height, F.sqrt(F.col("xmom") / depth * (F.col("xmom") / depth) + F.col("ymom") / depth * (F.col("ymom") / depth))).otherwise(F.lit(0.0))
    return (cells.withColumn("depth", depth).withColumn("velocity", speed)
            .withColumn("depthIntegratedVelocity", F.col("depth") * F.col("velocity")))


def clip_dry(cells: DataFrame) -> DataFrame:
    """Cells with a stage under the bed are lifted to the bed; ``clipped`` marks them."""
    return (cells.withColumn("clipped", F.col("stage") < F.col("elevation"))
            .withColumn("stage", F.greatest("stage", "elevation")))


def clip_counts(cells: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return clip_dry(cells).groupBy(*keys).agg(
        F.count_if("clipped").alias("n_clipped"), F.sum(F.col("stage") - F.col("elevation")).alias("depth_sum"),
        F.count(F.lit(1)).alias("n_cells"))


def flow_diagnostics(cells: DataFrame, cfl: float = 0.9, keys: Sequence[str] = ("run_id", "t")) -> DataFrame:
    """Flow figures per run and step.

    ``cells`` carries stage, elevation, momenta, area, inradius, place and
    ``dt``, the last internal time step in seconds. Depth is taken over all
    full cells, the rest over wet ones; the first cell wins a tie in speed.
    """
    keys = list(keys)
    c = with_cell_speed(cells)
    figures = step_figures()
    out = c.groupBy(*keys).agg(*[{"sum": F.sum, "max": F.max, "min": F.min}[how](value).alias(name)
                                 for name, (how, value) in figures.items()])
    at = row_at_extreme(c, keys, "speed", "cell_id", ["x", "y"], True)
    return flow_columns(out.join(at, keys, "left"), keys, cfl)


def with_cell_speed(cells: DataFrame) -> DataFrame:
    """Adds depth, wet and, for wet cells, speed."""
    deep = F.greatest("depth", F.lit(S.WET_THRESHOLD_M))
    speed = F.sqrt(F.col("xmom") / deep * (F.col("xmom") / deep) + F.col("ymom") / deep * (F.col("ymom") / deep))
    return with_wet_flag(cells).withColumn("speed", F.when(F.col("wet"), speed))


def step_figures() -> dict[str, tuple[str, Column]]:
    """What a step's cells add up to: name, how values merge, and the value of a cell."""
    wet = lambda v: F.when(F.col("wet"), v)
    return {"wet_cells": ("sum", F.col("wet").cast("int")), "_full": ("sum", F.col("is_full").cast("int")),
            "_volume": ("sum", wet(F.col("depth") * F.col("area"))), "_depth": ("max", F.when(F.col("is_full"), F.col("depth"))),
            "_speed": ("max", F.col("speed")), "_r": ("min", wet(F.col("inradius"))), "_dt": ("max", F.col("dt"))}


def flow_columns(steps: DataFrame, keys: Sequence[str], cfl: float = 0.9) -> DataFrame:
    """Flow figures from the merged ``step_figures`` and the place x, y of the fastest cell."""
    zero = F.lit(0.0)
    count = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint"))
    return steps.select(
        *keys, count("wet_cells").alias("wet_cells"), (count("wet_cells") / F.greatest(F.lit(1), count("_full"))).alias("wet_fraction"),
        F.coalesce("_volume", zero).alias("volume_m3"), F.coalesce("_depth", zero).alias("max_depth_m"),
        F.coalesce("_speed", zero).alias("max_speed_ms"),
        F.coalesce("x", zero).alias("peak_speed_x"), F.coalesce("y", zero).alias("peak_speed_y"),
        F.coalesce(F.col("_r") * cfl / F.greatest("_dt", F.lit(1e-12)), zero).alias("implied_max_speed_ms"),
        (F.col("_dt") * 1000.0).alias("last_dt_ms"))


def step_deltas(steps: DataFrame, yieldstep: Column, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Internal steps since the previous row and their mean length in milliseconds.

    Rows are yield steps; a run has about a hundred, so a run is a small group.
    """
    before = Window.partitionBy(*keys).orderBy("t")
    n = F.greatest(F.lit(1).cast("bigint"), F.col("total_steps") - F.coalesce(F.lag("total_steps").over(before), F.lit(0)))
    return steps.withColumn("n_steps", n).withColumn("mean_dt_ms", yieldstep / F.col("n_steps") * 1000.0)


def peak_envelope(cells: DataFrame, quantities: Sequence[str] = S.OUTPUT_QUANTITIES,
                  keys: Sequence[str] = ("run_id", "cell_id")) -> DataFrame:
    """Largest value over time per cell and quantity; NaN counts as missing."""
    valid = lambda q: F.when(~F.isnan(q), F.col(q))
    return cells.groupBy(*keys).agg(*[F.max(valid(q)).alias(f"max_{q}") for q in quantities])


def valid_value(value: str = "value") -> Column:
    finite = ~F.isnan(value) & (F.abs(F.col(value)) < F.lit(float("inf")))
    return F.when(finite, F.col(value))


def value_range(cells: DataFrame, keys: Sequence[str] = ("raster_id",)) -> DataFrame:
    """Shared colour scale: zero to the largest valid value."""
    return cells.groupBy(*keys).agg(F.max(valid_value()).alias("max_value")).withColumn("min_value", F.lit(0.0))


def with_nodata_flag(cells: DataFrame) -> DataFrame:
    """Adds is_nodata: NaN, or equal to the raster's finite declared tag."""
    tag = F.when(~F.isnan("nodata"), F.col("nodata"))
    flag = F.isnan("value") | F.coalesce(F.col("value") == tag, F.lit(False))
    return cells.withColumn("is_nodata", F.coalesce(flag, F.lit(False)))


def georeference_cells(rasters: DataFrame, cells: DataFrame, key: str = "raster_id") -> DataFrame:
    """Centre and rectangle of each cell; y falls from the top row when dy is positive."""
    g = cells.join(rasters.select(key, "x0", "y0", "dx", "dy", "nodata"), key)
    left, top = F.col("x0") + F.col("col_no") * F.col("dx"), F.col("y0") - F.col("row_no") * F.col("dy")
    right, bottom = left + F.col("dx"), top - F.col("dy")
    return (g.withColumn("min_x", F.least(left, right)).withColumn("max_x", F.greatest(left, right))
            .withColumn("min_y", F.least(top, bottom)).withColumn("max_y", F.greatest(top, bottom))
            .withColumn("x", (F.col("min_x") + F.col("max_x")) / 2).withColumn("y", (F.col("min_y") + F.col("max_y")) / 2)
            .drop("x0", "y0", "dx", "dy"))


def _segment_meets_box() -> Column:
    """Separating-axis test of an edge against a cell rectangle, edges of the box included."""
    mx, my = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    hx, hy = (F.col("max_x") - F.col("min_x")) / 2, (F.col("max_y") - F.col("min_y")) / 2
    nx, ny = F.col("by") - F.col("ay"), F.col("ax") - F.col("bx")
    apart = F.abs(nx * (mx - F.col("ax")) + ny * (my - F.col("ay"))) > F.abs(nx) * hx + F.abs(ny) * hy
    return (~apart & (F.least("ax", "bx") <= F.col("max_x")) & (F.greatest("ax", "bx") >= F.col("min_x"))
            & (F.least("ay", "by") <= F.col("max_y")) & (F.greatest("ay", "by") >= F.col("min_y")))


def raster_nodata_in_boundary(cells: DataFrame, rings: DataFrame, raster_keys: Sequence[str] = ("raster_id",),
                              ring_key: str = "zone_id", size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Number of nodata cells each boundary touches, per raster; zero counts are left out.

    ``on`` names columns of rasters and boundaries that must agree, such as the package.

    A cell is touched when an edge of the ring meets its rectangle or when it
    lies wholly inside, which its centre then shows. Only nodata cells travel.
    """
    raster_keys, on = list(raster_keys), list(on)
    cell = list(dict.fromkeys([*on, *raster_keys, "row_no", "col_no"]))
    bad = with_nodata_flag(cells).where("is_nodata").select(*cell, "x", "y", "min_x", "max_x", "min_y", "max_y")
    edges = (rings.select(*on, ring_key, F.explode(ring_edges(F.col("ring"))).alias("e"))
             .select(*on, ring_key, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"),
                     F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")))
    in_bins = (bad.withColumn("gx", F.explode(F.sequence(bin_of(F.col("min_x"), size), bin_of(F.col("max_x"), size))))
               .withColumn("gy", F.explode(F.sequence(bin_of(F.col("min_y"), size), bin_of(F.col("max_y"), size)))))
    touched = in_bins.join(_segment_bins(edges, size), [*on, "gx", "gy"]).where(_segment_meets_box()).select(*cell, ring_key)
    inside = points_in_polygons(bad, rings.select(*on, ring_key, "ring"), size, on).select(*cell, ring_key)
    both = touched.unionByName(inside).distinct()
    return both.groupBy(*dict.fromkeys([*on, *raster_keys]), ring_key).agg(F.count(F.lit(1)).alias("n_nodata")).withColumn(
        "message", F.format_string("raster %s has %d nodata cells inside the boundary",
                                   F.concat_ws("/", *raster_keys), F.col("n_nodata")))


def frame_order(frames: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Frame number by step. Distinct (raster, step) rows only, so groups stay small."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(step))
    return frames.select(*keys, step).distinct().withColumn("frame", rank)


def compare_runs(a: DataFrame, b: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """|b − a| per cell and frame, frames paired by rank of their step.

    ``on`` names columns of both that tell pairs of runs apart. Frames or
    cells on one side only give a row with ``status`` unmatched.
    """
    on = list(on)

    def framed(df, side):
        order = frame_order(df.withColumn("_s", F.lit(side)), ["_s", *on])
        return df.join(order.drop("_s"), [*on, "step"]).select(
            *on, "frame", "row_no", "col_no", F.col("step").alias(f"step_{side}"), F.col("value").alias(f"value_{side}"))

    both = framed(a, "a").join(framed(b, "b"), [*on, "frame", "row_no", "col_no"], "full")
    matched = F.col("step_a").isNotNull() & F.col("step_b").isNotNull()
    return both.withColumn("diff", F.abs(F.col("value_b") - F.col("value_a"))).withColumn(
        "status", F.when(matched, F.lit("ok")).otherwise(F.lit("error: unmatched")))
