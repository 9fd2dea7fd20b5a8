"""Geometry column functions.

A vertex is ``STRUCT<x DOUBLE, y DOUBLE>``, a line or ring an array of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

__all__ = ["edge_length", "line_length", "ring_area", "signed_area", "triangle_area", "triangle_angles",
           "polar_correction", "close_ring", "ring_edges", "flatten_line", "outer_ring",
           "geometry_point", "is_multi_polygon", "point_segment_distance", "ray_crosses",
           "on_segment", "inside_ring", "line_centroid"]

VERTICES = "array<struct<x:double,y:double>>"


def edge_length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def _pairs(line: Column) -> Column:
    """Consecutive vertex pairs of a line as structs (a, b)."""
    n = F.size(line)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
    ).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def line_length(line: Column) -> Column:
    return F.aggregate(
        _pairs(line), F.lit(0.0),
        lambda acc, p: acc + edge_length(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"]))


def close_ring(ring: Column) -> Column:
    """Repeat the first vertex at the end unless the ring is closed already."""
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, F.lit(-1))
    return (F.when(F.size(ring) == 0, ring)
            .when((first["x"] == last["x"]) & (first["y"] == last["y"]), ring)
            .otherwise(F.concat(ring, F.array(first))))


def ring_edges(ring: Column) -> Column:
    """Edges (a, b) of a ring, the closing edge included."""
    return _pairs(close_ring(ring))


def signed_area(ring: Column) -> Column:
    """Enclosed area, positive where the ring runs counter-clockwise, relative to the first vertex so that large map coordinates cancel."""
    origin = F.get(ring, F.lit(0))
    twice = F.aggregate(
        ring_edges(ring), F.lit(0.0),
        lambda acc, e: acc + ((e["a"]["x"] - origin["x"]) * (e["b"]["y"] - origin["y"])
                              - (e["b"]["x"] - origin["x"]) * (e["a"]["y"] - origin["y"])))
    return twice / 2.0


def ring_area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def triangle_area(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) * 0.5


def _angle(a: Column, b: Column, opposite: Column) -> Column:
    denominator = F.greatest(a * b * 2.0, F.lit(S.EDGE_EPS))
    cosine = (a * a + b * b - opposite * opposite) / denominator
    return F.degrees(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))


def triangle_angles(l0: Column, l1: Column, l2: Column) -> Column:
    """The three interior angles in degrees from the three edge lengths."""
    return F.array(_angle(l2, l0, l1), _angle(l0, l1, l2), _angle(l1, l2, l0))


def polar_correction(base: Column, height: Column) -> Column:
    return (F.when((base < 0) & (height != 0), F.lit(math.pi))
            .when((base > 0) & (height < 0), F.lit(2 * math.pi))
            .otherwise(F.lit(0.0)))


def _coordinates(geometry: Column, depth: int) -> Column:
    text = F.get_json_object(geometry, "$.coordinates")
    return F.from_json(text, "array<" * depth + "double" + ">" * depth)


def _kind(geometry: Column) -> Column:
    return F.get_json_object(geometry, "$.type")


def _as_vertices(points: Column) -> Column:
    return F.coalesce(
        F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))),
        F.array().cast(VERTICES))


def flatten_line(geometry: Column) -> Column:
    """Vertices of a line; the parts of a multi-part line are joined in order."""
    return F.when(_kind(geometry) == "MultiLineString",
                  _as_vertices(F.flatten(_coordinates(geometry, 3)))
                  ).otherwise(_as_vertices(_coordinates(geometry, 2)))


def outer_ring(geometry: Column) -> Column:
    """Outer ring of a polygon, or of the first part of a multi-part polygon."""
    return F.when(_kind(geometry) == "MultiPolygon",
                  _as_vertices(F.get(F.get(_coordinates(geometry, 4), F.lit(0)), F.lit(0)))
                  ).otherwise(_as_vertices(F.get(_coordinates(geometry, 3), F.lit(0))))


def is_multi_polygon(geometry: Column) -> Column:
    """True where outer_ring leaves further parts unused."""
    return (_kind(geometry) == "MultiPolygon") & (F.size(_coordinates(geometry, 4)) > 1)


def geometry_point(geometry: Column) -> Column:
    xy = _coordinates(geometry, 1)
    return F.struct(F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, ((px - ax) * dx + (py - ay) * dy) / squared).otherwise(F.lit(0.0))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    # The offset first: a sum with a start far from the origin would lose digits of the distance.
    ox, oy = px - ax - along * dx, py - ay - along * dy
    return F.sqrt(ox * ox + oy * oy)


def ray_crosses(px, py, ax, ay, bx, by) -> Column:
    """The ray from the point towards +x crosses the edge (half-open in y)."""
    straddles = (ay > py) != (by > py)
    rise = F.when(by == ay, F.lit(1.0)).otherwise(by - ay)
    return straddles & (px < ax + (py - ay) / rise * (bx - ax))


def on_segment(px, py, ax, ay, bx, by) -> Column:
    cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    return ((cross == 0.0)
            & (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx))
            & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by)))


def inside_ring(px: Column, py: Column, edges: Column) -> Column:
    """Strict interior test against an array of edges (a, b).

    Only the edges that can meet the point's ray to +x need to be present.
    """
    hit = F.exists(edges, lambda e: on_segment(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))
    crossings = F.size(F.filter(
        edges, lambda e: ray_crosses(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    return ~hit & (crossings % 2 == 1)


def line_centroid(line: Column) -> Column:
    """Length-weighted centroid; the mean vertex when the line has no length."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"))

    def add(acc, p):
        w = edge_length(p["a"]["x"], p["a"]["y"], p["b"]["x"], p["b"]["y"])
        return F.struct((acc["x"] + (p["a"]["x"] + p["b"]["x"]) / 2 * w).alias("x"),
                        (acc["y"] + (p["a"]["y"] + p["b"]["y"]) / 2 * w).alias("y"),
                        (acc["w"] + w).alias("w"))

    def count(acc, p):
        return F.struct((acc["x"] + p["x"]).alias("x"), (acc["y"] + p["y"]).alias("y"),
                        (acc["w"] + 1.0).alias("w"))

    weighted = F.aggregate(_pairs(line), zero, add)
    plain = F.aggregate(line, zero, count)
    chosen = F.when(weighted["w"] > 0, weighted).otherwise(plain)
    return F.struct((chosen["x"] / chosen["w"]).alias("x"), (chosen["y"] / chosen["w"]).alias("y"))
