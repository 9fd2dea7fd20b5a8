"""Merged outlines of footprints that overlap or touch.

All outlines are cut where they meet, so pieces share only end points. A piece is part of the merged outline when
exactly one side of it is covered: pieces that two footprints run along in opposite ways cancel, and so do pieces inside
another footprint. What is left forms closed rings, which are numbered by pointer doubling: every round doubles the
distance that a piece sees along its ring, so a ring of n pieces takes about log2(n) rounds and no task walks it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signed_area
from ..session import checkpointed
from .lines import drop_collinear
from .spatial import BIN, node_lines, outlines, points_in_polygons

__all__ = ["merged_outlines", "outline_counts", "rings_of_pieces"]


def _node(x: str, y: str) -> Column:
    return F.struct(F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _boundary(shapes: DataFrame, size: float, on: list[str]) -> DataFrame:
    """Directed pieces (a, b) of the merged outline, the covered side on the left."""
    turned = shapes.withColumn("ring", F.when(signed_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring")))
    cut = node_lines(outlines(turned).select(*on, "_shape", "line"), "_shape", size, on=on)
    pieces = cut.select(*on, "_shape", _node("x0", "y0").alias("a"), _node("x1", "y1").alias("b")).where("a <> b")
    pieces = checkpointed(pieces.select(*on, "_shape", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") < F.col("b")).alias("up")))
    single = pieces.groupBy(*on, "lo", "hi").agg(F.bool_or("up").alias("up"), F.bool_or(~F.col("up")).alias("down")).where("up <> down")
    single = checkpointed(single.drop("down"))
    middles = single.select(*on, "lo", "hi", ((F.col("lo.x") + F.col("hi.x")) / 2).alias("x"), ((F.col("lo.y") + F.col("hi.y")) / 2).alias("y"))
    # A footprint does not cover its own edge, whatever rounding makes of the edge's midpoint.
    covered = (points_in_polygons(middles, shapes.select(*on, "_shape", "ring"), size, on).select(*on, "lo", "hi", "_shape")
               .join(pieces, [*on, "lo", "hi", "_shape"], "left_anti").select(*on, "lo", "hi").distinct())
    left = single.join(covered, [*on, "lo", "hi"], "left_anti")
    return left.select(*on, F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).alias("b"))


def rings_of_pieces(pieces: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Rings of directed pieces (a, b) that form closed chains: ``ring_id``, ``n_pieces`` and the vertex array ``ring``.

    Where several chains meet in a place, a piece goes on with the next one clockwise, so the covered sectors around
    the place stay apart and footprints that touch in one point keep rings of their own.
    """
    on = list(on)
    pieces = checkpointed(pieces.select(*on, "a", "b").withColumn("id", F.monotonically_increasing_id()))
    angle = lambda p, q: F.atan2(F.col(f"{q}.y") - F.col(f"{p}.y"), F.col(f"{q}.x") - F.col(f"{p}.x"))
    leaving = pieces.select(*on, F.col("a").alias("at"), angle("a", "b").alias("angle"), F.lit(1).alias("kind"), "id")
    coming = pieces.select(*on, F.col("b").alias("at"), angle("b", "a").alias("angle"), F.lit(0).alias("kind"), "id")
    around = Window.partitionBy(*on, "at").orderBy("angle", "kind", "id")
    out = F.when(F.col("kind") == 1, F.col("id"))
    before = F.last(out, True).over(around.rowsBetween(Window.unboundedPreceding, -1))
    round_ = F.last(out, True).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = leaving.unionByName(coming).withColumn("next", F.coalesce(before, round_)).where("kind = 0").select("id", "next")
    # (least id ahead, steps to it) over 1, 2, 4, … pieces; a round that changes no least id has seen every ring whole.
    seen = checkpointed(links.select("id", F.col("next").alias("to"), F.struct(F.col("id").alias("first"), F.lit(0).cast("bigint").alias("steps")).alias("least")))
    step = 1
    while True:
        ahead = seen.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.struct(
            F.col("least.first").alias("first"), (F.col("least.steps") + step).alias("steps")).alias("_least"))
        seen = checkpointed(seen.join(ahead, "to").select(
            "id", F.col("_to").alias("to"), F.least("least", "_least").alias("least"), (F.col("_least.first") < F.col("least.first")).alias("moved")))
        if not seen.where("moved").limit(1).count():
            break
        seen, step = seen.drop("moved"), 2 * step
    # The first piece has 0 steps, the one after it the most.
    place = F.when(F.col("least.steps") == 0, F.lit(-(1 << 62))).otherwise(-F.col("least.steps"))
    vertices = pieces.join(seen.select("id", "least"), "id").select(*on, F.col("least.first").alias("ring_id"), F.struct(place.alias("_o"), F.col("a").alias("p")).alias("v"))
    rings = vertices.groupBy(*on, "ring_id").agg(F.array_sort(F.collect_list("v")).alias("_v"))
    return rings.select(*on, "ring_id", F.size("_v").alias("n_pieces"), F.transform("_v", lambda v: v["p"]).alias("ring"))


def merged_outlines(footprints: DataFrame, size: float = BIN, on: Sequence[str] = (), tolerance: float = 0.01) -> DataFrame:
    """Outlines of the union of the footprints (``ring``), per package where ``on`` names its columns.

    One row per ring: ``ring_id``, ``is_hole``, ``outer`` (the ring around a hole), ``area`` (of the ring as it was
    merged) and the closed vertex array ``ring``, freed of vertices within ``tolerance`` of the line that replaces them.
    Footprints that share an edge or area become one; those that touch in one point stay apart. Repeated footprints
    count once; rings without area give nothing; a ring must not cross itself. Places are told apart to 1e-6.
    """
    on = list(on)
    shapes = footprints.where(F.size("ring") > 2).select(*on, "ring").distinct().where(signed_area(F.col("ring")) != 0)
    shapes = checkpointed(shapes.withColumn("_shape", F.monotonically_increasing_id()))
    rings = rings_of_pieces(_boundary(shapes, size, on), on).withColumn("_area", signed_area(F.col("ring")))
    rings = checkpointed(rings.where("n_pieces > 2"))
    outer = rings.where("_area > 0").select(*on, F.col("ring_id").alias("outer"), F.col("_area").alias("_around"), "ring")
    first = rings.where("_area < 0").select(*on, "ring_id", F.get("ring", F.lit(0)).alias("p")).select(*on, "ring_id", "p.x", "p.y")
    around = (points_in_polygons(first, outer, size, on).groupBy(*on, "ring_id")
              .agg(F.min_by("outer", F.struct("_around", "outer")).alias("outer")))
    # A ring starts wherever numbering began; its least place is a corner, which smoothing must keep anyway.
    start = F.array_position("ring", F.array_min("ring")).cast("int")
    turned = rings.withColumn("ring", F.concat(F.slice("ring", start, F.size("ring") - start + 1), F.slice("ring", F.lit(1), start - 1)))
    closed = turned.withColumn("line", F.concat("ring", F.slice("ring", 1, 1)))
    smooth = drop_collinear(closed, 4.0 * tolerance)
    return smooth.join(around, [*on, "ring_id"], "left").select(
        *on, "ring_id", (F.col("_area") < 0).alias("is_hole"), "outer", F.abs("_area").alias("area"), F.col("line").alias("ring"))


def outline_counts(footprints: DataFrame, merged: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Footprints before and outlines after merging, and the area they cover, holes taken off."""
    on = list(on)
    before = footprints.groupBy(*on).agg(F.count(F.lit(1)).alias("n_footprints"))
    area = F.sum(F.when(F.col("is_hole"), -F.col("area")).otherwise(F.col("area")))
    after = merged.groupBy(*on).agg(F.count_if(~F.col("is_hole")).alias("n_outlines"), area.alias("covered_area"))
    none = F.lit(0).cast("bigint")
    joined = before.join(after, on, "left") if on else before.join(after)
    return joined.select(*on, "n_footprints", F.coalesce("n_outlines", none).alias("n_outlines"), F.coalesce("covered_area", F.lit(0.0)).alias("covered_area"))
