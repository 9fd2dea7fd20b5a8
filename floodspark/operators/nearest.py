"""Exact nearest neighbours by descent through counted bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import checkpointed
from .spatial import points_in_polygons

STEP = 2  # a bin has 4 by 4 children
LEAF_TARGET = 16
LEAF_LIMIT = 1024
MAX_LEVEL = 12
TASK_QUERIES = 16384


def _gap(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), low - v, v - high)


def _far(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.abs(v - low), F.abs(v - high))


def k_nearest(queries: DataFrame, points: DataFrame, k: int, query_key: Sequence[str], point_key: str,
              on: Sequence[str] = ()) -> DataFrame:
    """The k nearest points of every query: (query key, point key, d2, rank).

    Ties go to the lowest point key. Points are counted in nested bins with
    tight boxes. Each query starts at the finest level whose 3 by 3 bins hold k
    points, keeps the bins that can still hold one of its k nearest, and
    descends into their children. Only leaf bins that survive meet the points,
    so a crowded place is compared bin by bin, never point by point.
    """
    on, query_key = list(on), list(query_key)
    points = points.select(*on, point_key, "x", "y")
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
                     F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    if not box.n:
        kept = queries.select(*on, *query_key).join(points.select(*on, point_key).limit(0), on) if on else \
            queries.select(*query_key).limit(0).withColumn(point_key, F.lit(None).cast(points.schema[point_key].dataType))
        return kept.withColumn("d2", F.lit(0.0)).withColumn("rank", F.lit(1))
    x0, y0 = float(box.x0), float(box.y0)
    side = max(float(box.x1) - x0, float(box.y1) - y0, 1e-9) * (1 + 1e-9)
    top = max(1, math.ceil(math.log(max(box.n / LEAF_TARGET, 1.0), 4 ** STEP)))

    def index(v: Column, origin: float, level) -> Column:
        size = F.lit(side) / F.pow(F.lit(2.0 ** STEP), level if isinstance(level, Column) else F.lit(float(level)))
        return F.floor((v - F.lit(origin)) / size).cast("bigint")

    def leaves(level: int) -> DataFrame:
        return (points.withColumn("ix", index(F.col("x"), x0, level)).withColumn("iy", index(F.col("y"), y0, level))
                .groupBy(*on, "ix", "iy").agg(
                    F.count(F.lit(1)).alias("n"), F.min("x").alias("bx0"), F.max("x").alias("bx1"),
                    F.min("y").alias("by0"), F.max("y").alias("by1")))

    while True:
        finest = checkpointed(leaves(top))
        fullest = finest.agg(F.max("n")).first()[0]
        if fullest <= LEAF_LIMIT or top >= MAX_LEVEL:
            break
        top += 1
    if fullest > LEAF_LIMIT:
        # Many points at one place: only the k lowest keys of a place can be among the k nearest.
        place = Window.partitionBy(*on, "x", "y").orderBy(point_key)
        points = points.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r")
        finest = checkpointed(leaves(top))

    shrink = F.pow(F.lit(2.0 ** STEP), F.lit(float(top)) - F.col("level"))
    bins = checkpointed(
        finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        .withColumn("ix", F.floor(F.col("ix") / shrink).cast("bigint"))
        .withColumn("iy", F.floor(F.col("iy") / shrink).cast("bigint"))
        .groupBy(*on, "level", "ix", "iy").agg(
            F.sum("n").alias("n"), F.min("bx0").alias("bx0"), F.max("bx1").alias("bx1"),
            F.min("by0").alias("by0"), F.max("by1").alias("by1")))

    near = F.sequence(F.lit(-1), F.lit(1))
    around = (bins.select(*on, "level", "ix", "iy", "n")
              .withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
              .groupBy(*on, "level", (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"))
              .agg(F.sum("n").alias("n")).where(F.col("n") >= k).drop("n"))
    queries = queries.select(*on, *query_key, F.col("x").alias("qx"), F.col("y").alias("qy"))
    placed = (queries.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
              .withColumn("ix", index(F.col("qx"), x0, F.col("level").cast("double")))
              .withColumn("iy", index(F.col("qy"), y0, F.col("level").cast("double"))))
    started = (placed.join(around, [*on, "level", "ix", "iy"])
               .groupBy(*on, *query_key, "qx", "qy").agg(F.max("level").alias("level")))
    outside = queries.join(started.select(*on, *query_key), [*on, *query_key], "left_anti")
    size = F.lit(side) / F.pow(F.lit(2.0 ** STEP), F.col("level").cast("double"))
    reach = size * (2 * 2 ** 0.5 * (1 + 1e-9))
    span = lambda v, o: F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((v - reach - F.lit(o)) / size).cast("bigint")),
                                   F.greatest(F.lit(0).cast("bigint"), F.floor((v + reach - F.lit(o)) / size).cast("bigint")))
    entry = (started.withColumn("ix", F.explode(span(F.col("qx"), x0)))
             .withColumn("iy", F.explode(span(F.col("qy"), y0))))
    entry = entry.where(
        F.pow(_gap(F.col("qx"), x0 + F.col("ix") * size, x0 + (F.col("ix") + 1) * size), 2)
        + F.pow(_gap(F.col("qy"), y0 + F.col("iy") * size, y0 + (F.col("iy") + 1) * size), 2) <= reach * reach * (1 + 1e-9))
    zero = F.lit(0).cast("bigint")
    entry = checkpointed(entry.unionByName(
        outside.withColumn("level", F.lit(0)).withColumn("ix", zero).withColumn("iy", zero)))

    # Dealt anew at each level: a task sorts one level of a bounded number of queries, not all levels of a share that grows with them.
    tasks = max(entry.sparkSession.sparkContext.defaultParallelism, -(-entry.count() // TASK_QUERIES))
    per_query = Window.partitionBy(*on, *query_key)
    children = F.sequence(F.lit(0), F.lit(2 ** STEP - 1))
    alive = None
    for level in range(top + 1):
        here = entry.where(F.col("level") == level).drop("level")
        if alive is not None:
            down = (alive.withColumn("cx", F.explode(children)).withColumn("cy", F.explode(children))
                    .withColumn("ix", F.col("ix") * 2 ** STEP + F.col("cx"))
                    .withColumn("iy", F.col("iy") * 2 ** STEP + F.col("cy")).drop("cx", "cy"))
            here = here.unionByName(down)
        met = here.join(bins.where(F.col("level") == level).drop("level"), [*on, "ix", "iy"])
        near2 = F.pow(_gap(F.col("qx"), F.col("bx0"), F.col("bx1")), 2) + F.pow(_gap(F.col("qy"), F.col("by0"), F.col("by1")), 2)
        far2 = F.pow(_far(F.col("qx"), F.col("bx0"), F.col("bx1")), 2) + F.pow(_far(F.col("qy"), F.col("by0"), F.col("by1")), 2)
        met = met.withColumn("near2", near2).withColumn("far2", far2).repartition(tasks, *on, *query_key)
        held = F.sum("n").over(per_query.orderBy("far2").rangeBetween(Window.unboundedPreceding, 0))
        met = met.withColumn("_held", held)
        enough = F.min(F.when(F.col("_held") >= k, F.col("far2"))).over(per_query)
        met = met.withColumn("_reach", enough).where(F.col("_reach").isNull() | (F.col("near2") <= F.col("_reach") * (1 + 1e-12)))
        alive = met.select(*on, *query_key, "qx", "qy", "ix", "iy")
    leaf = points.withColumn("ix", index(F.col("x"), x0, top)).withColumn("iy", index(F.col("y"), y0, top))
    d2 = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))
    pairs = alive.join(leaf, [*on, "ix", "iy"]).withColumn("d2", d2).repartition(tasks, *on, *query_key)
    best = Window.partitionBy(*on, *query_key).orderBy("d2", point_key)
    return (pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select(*on, *query_key, point_key, "d2", "rank"))


def nearest_vertex(gauges: DataFrame, vertices: DataFrame, gauge_key: str = "gauge_id",
                   vertex_key: str = "vid", on: Sequence[str] = ()) -> DataFrame:
    """Nearest vertex of each gauge with its distance, lowest index on ties.

    A gauge without two finite coordinates, or with no vertex to compare, is a row whose ``status`` says so.
    """
    on = list(on)
    placed = lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.coalesce(F.isnan(c), F.lit(True))
    good = placed(F.col("x")) & placed(F.col("y"))
    near = k_nearest(gauges.where(good), vertices.where(good), 1, [gauge_key], vertex_key, on).withColumn(
        "distance", F.sqrt("d2")).drop("d2", "rank")
    status = (F.when(~F.col("_good"), F.lit("error: no coordinates")).when(F.col(vertex_key).isNull(), F.lit("error: no vertex"))
              .otherwise(F.lit("ok")))
    return (gauges.select(*on, gauge_key, good.alias("_good")).join(near, [*on, gauge_key], "left")
            .withColumn("status", status).drop("_good"))


def grid_cells(box: DataFrame, resolution: float, keys: Sequence[str] = ()) -> DataFrame:
    """Cell centres (row_no, col_no, x, y) of a regular grid over each box, top row first."""
    r = float(resolution)
    rows = F.greatest(F.lit(1), F.ceil((F.col("max_y") - F.col("min_y")) / r)).cast("bigint")
    cols = F.greatest(F.lit(1), F.ceil((F.col("max_x") - F.col("min_x")) / r)).cast("bigint")
    lines = box.withColumn("_c", cols).withColumn("row_no", F.explode(F.sequence(F.lit(0).cast("bigint"), rows - 1)))
    # Spread the rows before they become cells: a box alone is one input row.
    lines = lines.repartition(*keys, "row_no")
    return (lines.withColumn("col_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1)))
            .select(*keys, "row_no", "col_no", (F.col("min_x") + (F.col("col_no") + 0.5) * r).alias("x"),
                    (F.col("max_y") - (F.col("row_no") + 0.5) * r).alias("y")))


def grid_knn(vertices: DataFrame, cells: DataFrame, value: str, k: int = S.K_NEAREST,
             boundary: DataFrame | None = None, holes: DataFrame | None = None,
             vertex_key: str = "vid", on: Sequence[str] = ()) -> DataFrame:
    """Inverse-distance mean of the k nearest vertices per cell.

    Cells outside the boundary or inside a hole are NaN; a vertex at the cell
    centre gives its value unweighted.
    """
    on = list(on)
    cell = [*on, "row_no", "col_no"]
    vertices = checkpointed(vertices.select(*on, vertex_key, "x", "y", value))  # read for the box, each level and the leaves
    wanted = cells
    if boundary is not None:
        wanted = points_in_polygons(cells, boundary.select(*on, "ring"), on=on).select(*cell, "x", "y").dropDuplicates(cell)
    if holes is not None:
        hit = points_in_polygons(wanted, holes.select(*on, "ring"), on=on).select(*cell).distinct()
        wanted = wanted.join(hit, cell, "left_anti")
    if wanted is not cells:
        wanted = checkpointed(wanted)
    near = k_nearest(wanted, vertices, k, cell[-2:], vertex_key, on).join(vertices.select(*on, vertex_key, value), [*on, vertex_key])
    weight = F.when(F.col("d2") > 0, 1.0 / F.sqrt("d2"))
    mixed = near.groupBy(*cell).agg(
        F.max(F.when(F.col("d2") == 0, F.struct(-F.col("rank"), F.col(value)))).alias("_same"),
        (F.sum(weight * F.col(value)) / F.sum(weight)).alias("_mean"))
    mixed = mixed.select(*cell, F.coalesce(F.col(f"_same.{value}"), "_mean").alias("value"))
    return cells.join(mixed, cell, "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def gauge_scorecard(observations: DataFrame, peaks: DataFrame, gauge_key: str = "gauge_id",
                    vertex_key: str = "vid", on: Sequence[str] = ()) -> DataFrame:
    """Per gauge: simulated peak at the nearest vertex against the field stage.

    ``on`` names columns that must agree, such as the run. Gauges without a place or vertex are not scored.
    """
    on = list(on)
    peaks = checkpointed(peaks.select(*on, vertex_key, "x", "y", "peak_stage"))
    near = nearest_vertex(observations, peaks.select(*on, vertex_key, "x", "y"), gauge_key, vertex_key, on).where("status = 'ok'").drop("status")
    scored = (observations.join(near, [*on, gauge_key]).join(peaks.select(*on, vertex_key, "peak_stage"), [*on, vertex_key])
              .withColumn("diff", F.col("peak_stage") - F.col("field_stage")))
    return scored.withColumn("passed", F.abs("diff") <= F.col("tolerance"))


def score_totals(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of passes, bias and root mean square error of a scorecard."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_pass"),
        F.bool_and("passed").alias("all_pass"), F.avg("diff").alias("bias"),
        F.sqrt(F.avg(F.col("diff") * F.col("diff"))).alias("rmse"))
