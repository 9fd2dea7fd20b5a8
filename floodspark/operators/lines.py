"""Conditioning of polylines, each line one row with its vertex array.

A feature's geometry arrives as one value in one row, so these need no
shuffle: the vertices of a line are already together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import edge_length, line_length
from ..functions.geometry import VERTICES
from ..session import checkpointed
from .spatial import BIN, _segment_bins, clip_lines, held, node_lines

__all__ = ["segment_floor", "dedupe_polyline", "drop_collinear", "densified", "joined_parts", "condition_breaklines", "snap_rounded",
           "clip_lines", "node_lines"]


def segment_floor(finest_spacing: float | None = None) -> float:
    finest = S.DEFAULT_NEAR_SPACING_M if finest_spacing is None else finest_spacing
    return max(1e-3, min(S.MIN_SEGMENT_M, finest / 4))


def _apart(a: Column, b: Column) -> Column:
    return edge_length(a["x"], a["y"], b["x"], b["y"])


def dedupe_polyline(lines: DataFrame, floor: float | Column, line: str = "line") -> DataFrame:
    """Drops inner vertices closer than ``floor`` to the last one kept.

    Both ends stay; a kept vertex too close to the last end gives way to it.
    Lines shorter than the floor go.
    """
    v = F.col(line)
    n = F.size(v)
    inner = F.slice(v, F.lit(2), F.greatest(F.lit(0), n - 2))
    kept = F.aggregate(
        inner, F.slice(v, F.lit(1), F.lit(1)).cast(VERTICES),
        lambda acc, p: F.when(_apart(F.element_at(acc, F.lit(-1)), p) >= floor, F.concat(acc, F.array(p))).otherwise(acc))
    last = F.element_at(v, F.lit(-1))
    rest = [c for c in lines.columns if c != line]
    out = lines.where(n > 0).select(*rest, line, held(kept).alias("_kept"))
    near_end = (F.size("_kept") >= 2) & (_apart(F.element_at(F.col("_kept"), F.lit(-1)), last) < floor)
    head = F.when(near_end, F.slice("_kept", F.lit(1), F.size("_kept") - 1)).otherwise(F.col("_kept"))
    out = out.withColumn(line, F.concat(head, F.array(last))).drop("_kept")
    return out.where((F.size(line) >= 2) & (line_length(F.col(line)) >= floor))


def _chord_keep(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices stay so that every other one lies within the tolerance of the chord that replaces it."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        px, py, dx, dy = x[a + 1:b] - x[a], y[a + 1:b] - y[a], x[b] - x[a], y[b] - y[a]
        length = np.hypot(dx, dy)
        off = np.abs(dx * py - dy * px) / length if length > 0 else np.hypot(px, py)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _chord_places(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for xs, ys, tolerances in batches:
        yield pd.Series([None if x is None or len(x) == 0 else np.flatnonzero(
            _chord_keep(np.asarray(x, float), np.asarray(y, float), float(t))).astype(np.int32) for x, y, t in zip(xs, ys, tolerances)])


def drop_collinear(lines: DataFrame, spacing: float | Column, line: str = "line") -> DataFrame:
    """Removes inner vertices within a quarter of the spacing of the chord that then stands for them.

    The chord is that of the line as it comes out, so a curve keeps its shape. One Arrow batch function over whole
    lines: cutting at the farthest vertex has no form among the built-in functions.
    """
    tol = F.lit(S.COLLINEAR_FRACTION) * (spacing if isinstance(spacing, Column) else F.lit(float(spacing)))
    v = F.col(line)
    coordinate = lambda name: F.transform(v, lambda p: p[name].cast("double"))
    places = _chord_places(coordinate("x"), coordinate("y"), tol.cast("double"))
    out = lines.withColumn("_places", places)
    return out.withColumn(line, F.when(F.size(v) > 0, F.transform("_places", lambda i: F.get(v, i))).otherwise(v)).drop("_places")


def densified(line: Column, spacing: Column) -> Column:
    """The line with every segment split evenly to at most ``spacing``."""
    n = F.size(line)

    def steps(a: Column, b: Column) -> Column:
        parts = F.greatest(F.lit(1), F.ceil(_apart(a, b) / spacing)).cast("int")
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(
            (a["x"] + (b["x"] - a["x"]) * i / parts).alias("x"), (a["y"] + (b["y"] - a["y"]) * i / parts).alias("y")))

    inner = F.flatten(F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), steps))
    return F.when(n >= 2, F.concat(inner, F.slice(line, n, F.lit(1)))).otherwise(line)


def joined_parts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments that continue one another (seg, t0 order) as one vertex array per part.

    The pieces of one line came from one row, so they fit in one again.
    """
    w = Window.partitionBy(*keys).orderBy("seg", "t0")
    breaks = (F.lag("x1").over(w) != F.col("x0")) | (F.lag("y1").over(w) != F.col("y0"))
    numbered = segments.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(
        "part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("seg", "t0", "x0", "y0", "x1", "y1"))).alias("_p"))
    start = F.transform(F.slice("_p", F.lit(1), F.lit(1)), lambda p: F.struct(p["x0"].alias("x"), p["y0"].alias("y")))
    rest = F.transform("_p", lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y")))
    return pieces.select(*keys, "part", F.concat(start, rest).alias("line"))


def _floor_column(finest: Column) -> Column:
    return F.greatest(F.lit(1e-3), F.least(F.lit(S.MIN_SEGMENT_M), finest / 4))


def condition_breaklines(breaklines: DataFrame, boundary: DataFrame, key: str = "line_id", ring_key: str = "zone_id",
                         default_spacing: float = S.DEFAULT_NEAR_SPACING_M, floor: float | None = None,
                         on: Sequence[str] = ()) -> DataFrame:
    """Breaklines ready for a mesher, as segments that meet only at their ends.

    Clipped to the boundary, freed of collinear jitter, densified to each
    line's ``near_spacing``, deduplicated, cut at every crossing, and rounded
    to a grid as wide as the floor (``snap_rounded``): no place moves by more
    than the floor, and no segment is shorter. ``on`` names columns that must
    agree, such as the package; the default floor follows the package's finest
    spacing.
    """
    on = list(on)
    spacing = F.when(F.col("near_spacing") > 0, F.col("near_spacing")).otherwise(F.lit(float(default_spacing)))
    wanted = breaklines.where(F.size("line") >= 2).withColumn("_s", F.greatest(spacing, F.lit(1e-6)))
    if floor is None:
        floors = wanted.groupBy(*on).agg(_floor_column(F.min("_s")).alias("_floor"))
        wanted = wanted.join(floors, on) if on else wanted.withColumn("_floor", F.lit(floors.first()["_floor"]))
    else:
        wanted = wanted.withColumn("_floor", F.lit(float(floor)))
    parts = joined_parts(clip_lines(wanted, boundary, key, ring_key, on=on), [*on, key, ring_key])
    parts = checkpointed(parts.join(wanted.select(*on, key, "_s", "_floor"), [*on, key]))
    ident = [key, ring_key, "part"]
    # Each step is held, as the next one names the line many times over.
    straight = drop_collinear(parts, F.col("_s")).select(*on, *ident, "_s", "_floor", held(F.col("line")).alias("line"))
    dense = straight.select(*on, *ident, "_floor", held(densified(F.col("line"), F.col("_s"))).alias("line"))
    ready = checkpointed(dedupe_polyline(dense, F.col("_floor")).select(*on, "_floor", F.struct(*ident).alias("_id"), "line"))
    floors = ready.select(*on, "_floor").distinct()
    # Bins follow the length of what densifying left, so a bin holds a few segments however long the lines are.
    mean = ready.agg(F.sum(line_length(F.col("line"))) / F.sum(F.size("line") - 1)).first()[0]
    cut = node_lines(ready, "_id", min(BIN, 2 * mean) if mean else BIN, on=on)
    cut = cut.join(floors, on) if on else cut.withColumn("_floor", F.lit((floors.first() or [1.0])[0]))
    pieces = snap_rounded(cut.select(*on, "_id", "seg", "t0", "x0", "y0", "x1", "y1", "_floor"), "_floor", on)
    # Lines that lie on one another leave one piece, that of the least key.
    a, b = (F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (0, 1))
    first = pieces.groupBy(*on, F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).agg(
        F.min(F.struct("_id", "seg", "t0", "place", "x0", "y0", "x1", "y1")).alias("_p"))
    return first.select(*on, "_p._id.*", "_p.seg", *[F.col(f"_p.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])


def snap_rounded(pieces: DataFrame, width: str, on: Sequence[str] = ()) -> DataFrame:
    """Pieces that share only end points, rounded to a grid with cells of ``width`` without crossing anew.

    Cells are centred on multiples of the width; one with an end point is hot. Every piece goes through the centres of
    all hot cells that it meets, in order, so it moves by at most
    0.71 of the width and stays on its side of every end point; pieces between
    two centres are at least as long as the width. ``place`` numbers them
    within the piece (x0, y0, x1, y1) that they come from.
    """
    on, shape = list(on), ["ax", "ay", "bx", "by"]
    rest = [c for c in pieces.columns if c not in ("x0", "y0", "x1", "y1")]
    scaled = checkpointed(pieces.withColumn("_n", F.monotonically_increasing_id())
                          .withColumns({n: F.col(c) / F.col(width) + 0.5 for n, c in zip(shape, ("x0", "y0", "x1", "y1"))}).drop("x0", "y0", "x1", "y1"))
    ends = F.explode(F.array(*[F.struct(F.floor(x).alias("gx"), F.floor(y).alias("gy")) for x, y in (("ax", "ay"), ("bx", "by"))]))
    # Pieces meet hot cells in blocks about as wide as a piece is long, not cell by cell; a cell is in one block.
    length = scaled.agg(F.avg(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay")))).first()[0]
    block = max(1, min(16, round(length or 1)))
    place = [F.floor(F.col(g) / block).alias(f"_{g}") for g in ("gx", "gy")]
    hot = scaled.select(*on, ends.alias("c")).select(*on, "c.*").distinct().select(*on, *place, "gx", "gy")
    blocks = _segment_bins(scaled.select(*on, "_n", *shape), float(block)).withColumnsRenamed({"gx": "_gx", "gy": "_gy"})
    passed = blocks.join(hot, [*on, "_gx", "_gy"]).drop("_gx", "_gy")

    def between(a: str, b: str, g: str) -> tuple[Column, Column]:
        """Parameters at which the piece enters and leaves a cell's column or row; nulls where it never does."""
        d = F.nullif(F.col(b) - F.col(a), F.lit(0.0))
        t, u = (F.col(g) - F.col(a)) / d, (F.col(g) + 1 - F.col(a)) / d
        within = (F.col(a) >= F.col(g)) & (F.col(a) <= F.col(g) + 1)
        always = d.isNull() & within
        return (F.when(always, F.lit(0.0)).when(d.isNotNull(), F.least(t, u)), F.when(always, F.lit(1.0)).when(d.isNotNull(), F.greatest(t, u)))

    (tx, ux), (ty, uy) = between("ax", "bx", "gx"), between("ay", "by", "gy")
    start = lambda p, q: (F.floor(p) == F.col("gx")) & (F.floor(q) == F.col("gy"))
    enter = F.when(start("ax", "ay"), F.lit(-1.0)).when(start("bx", "by"), F.lit(3.0)).when(
        tx.isNotNull() & ty.isNotNull(), F.greatest(tx, ty, F.lit(0.0)) + F.least(ux, uy, F.lit(1.0)))
    leaves = F.when(start("ax", "ay") | start("bx", "by"), F.lit(True)).otherwise(F.greatest(tx, ty, F.lit(0.0)) <= F.least(ux, uy, F.lit(1.0)))
    met = passed.withColumn("_t", enter).where(F.col("_t").isNotNull() & leaves)
    chain = met.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("_t", "gx", "gy"))).alias("_c"))
    n = F.size("_c")
    steps = F.when(n >= 2, F.zip_with(F.slice("_c", F.lit(1), n - 1), F.slice("_c", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    joined = scaled.select(*rest, "_n").join(chain, "_n").select(*rest, F.posexplode(steps).alias("place", "_s"))
    centre = lambda side, axis: F.col(f"_s.{side}.{axis}") * F.col(width)
    return joined.select(*rest, "place", centre("a", "gx").alias("x0"), centre("a", "gy").alias("y0"), centre("b", "gx").alias("x1"), centre("b", "gy").alias("y1"))
