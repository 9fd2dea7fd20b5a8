"""Spatial joins: binned equi-joins followed by exact tests.

Rings are cut into tiles that carry only the edges a point in the tile can
need. A ring of few bins has one tile per bin, so a point is looked up once; a
wide one is covered by tiles of several levels, large and without edges inside,
small along its outline, and a point is looked up once per level. Segments are
listed in the bins they pass. Nothing is broadcast by hand: Spark broadcasts a
side only where its measured size allows, and splits skewed bins at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import doubling_bands, inside_ring, point_segment_distance, ring_edges, target_triangle_area
from ..session import checkpointed
from .ordered import carry

BIN = 50.0


def bin_of(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("bigint")


def bin_range(low: Column, high: Column, size: float) -> Column:
    return F.sequence(bin_of(low, size), bin_of(high, size))


def held(value: Column) -> Column:
    """The value itself, computed once: a generator keeps the optimizer from repeating it."""
    return F.explode(F.array(value))


def _reach(edges: Column, axis: str, part: str) -> Column:
    of = F.least if part == "min" else F.greatest
    ends = F.transform(edges, lambda e: of(e["a"][axis], e["b"][axis]))
    return F.array_min(ends) if part == "min" else F.array_max(ends)


def ring_tiles(rings: DataFrame, size: float = BIN) -> DataFrame:
    """One row per ring and bin with the edges that decide points of that bin.

    An edge matters in a bin when it shares the bin's y span and is not wholly
    left of the bin. A bin without such edges is outside the ring: no row.
    """
    rest = [c for c in rings.columns if c != "ring"]
    size = float(size)
    flat = rings.where(F.size("ring") > 2).select(*rest, held(ring_edges(F.col("ring"))).alias("_e"))
    rows = flat.select(*rest, "_e", F.explode(bin_range(_reach(F.col("_e"), "y", "min"), _reach(F.col("_e"), "y", "max"), size)).alias("by"))
    low, high = F.col("by") * size, (F.col("by") + 1) * size
    row = F.filter("_e", lambda e: (F.least(e["a"]["y"], e["b"]["y"]) <= high) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= low))
    rows = rows.select(*rest, "by", held(row).alias("_row")).where(F.size("_row") > 0)
    tiles = rows.select(*rest, "by", "_row", F.explode(bin_range(_reach(F.col("_row"), "x", "min"), _reach(F.col("_row"), "x", "max"), size)).alias("bx"))
    edges = F.filter("_row", lambda e: F.greatest(e["a"]["x"], e["b"]["x"]) >= F.col("bx") * size)
    return tiles.select(*rest, "bx", "by", held(edges).alias("edges"))


def _top_level(extent: Column, size: float) -> Column:
    """The level whose tiles, each four times as wide as one below, a ring of this extent starts from: about eight a side."""
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(extent, F.lit(size)) / (8.0 * size)) / F.log(F.lit(4.0)))).cast("int")


def _extent(edges: Column) -> Column:
    return F.greatest(_reach(edges, "x", "max") - _reach(edges, "x", "min"), _reach(edges, "y", "max") - _reach(edges, "y", "min"))


def _meets_tile(e: Column, left: Column, low: Column, width: float) -> Column:
    """Whether an edge may meet a square; a hair too often rather than too rarely."""
    hair, half = width * 1e-6, width / 2.0
    nx, ny = e["b"]["y"] - e["a"]["y"], e["a"]["x"] - e["b"]["x"]
    off = F.abs(nx * (left + half - e["a"]["x"]) + ny * (low + half - e["a"]["y"]))
    return ((off <= (F.abs(nx) + F.abs(ny)) * (half + hair))
            & (F.least(e["a"]["x"], e["b"]["x"]) <= left + width + hair) & (F.greatest(e["a"]["x"], e["b"]["x"]) >= left - hair)
            & (F.least(e["a"]["y"], e["b"]["y"]) <= low + width + hair) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= low - hair))


def ring_cover(rings: DataFrame, size: float, top: int) -> DataFrame:
    """Tiles of levels 0 (bins) to ``top``, each four times as wide as one below, that cover each ring.

    A tile that no edge meets is wholly inside, and has no edges, or wholly outside, and is left out. Others are cut
    in sixteen down to bins, whose ``edges`` decide as those of ``ring_tiles`` do. So the number of tiles of a ring
    follows its outline, not its area; each level is its own set of rows, so no task makes all tiles of a ring.
    """
    rest = [c for c in rings.columns if c != "ring"]
    flat = (rings.where(F.size("ring") > 2).select(*rest, held(ring_edges(F.col("ring"))).alias("edges"))
            .withColumn("_top", F.least(_top_level(_extent(F.col("edges")), size), F.lit(top))))
    out, cut = None, None
    for level in range(top, -1, -1):
        width = size * 4.0 ** level
        own = flat.where(F.col("_top") == level)
        for axis, name in (("x", "bx"), ("y", "by")):
            own = own.withColumn(name, F.explode(bin_range(_reach(F.col("edges"), axis, "min"), _reach(F.col("edges"), axis, "max"), width)))
        here = own.drop("_top") if cut is None else own.drop("_top").unionByName(cut)
        left, low = F.col("bx") * width, F.col("by") * width
        ahead = F.filter("edges", lambda e: (F.least(e["a"]["y"], e["b"]["y"]) <= low + width) & (F.greatest(e["a"]["y"], e["b"]["y"]) >= low)
                         & (F.greatest(e["a"]["x"], e["b"]["x"]) >= left))
        here = here.select(*rest, "bx", "by", held(ahead).alias("edges")).where(F.size("edges") > 0)
        here = here.withColumn("_meets", F.exists("edges", lambda e: _meets_tile(e, left, low, width))).withColumn("level", F.lit(level))
        whole = here.where(~F.col("_meets") & inside_ring(left + width / 2, low + width / 2, F.col("edges")))
        tiles = whole.withColumn("edges", F.slice("edges", 1, 0)).withColumn("inner", F.lit(True))
        met = here.where("_meets")
        if level == 0:
            tiles = tiles.unionByName(met.withColumn("inner", F.lit(False)))
        else:
            sixteen = met.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(15))))
            cut = sixteen.select(*rest, (F.col("bx") * 4 + F.col("_k") % 4).alias("bx"), (F.col("by") * 4 + F.floor(F.col("_k") / 4)).alias("by"), "edges")
        tiles = tiles.drop("_meets")
        out = tiles if out is None else out.unionByName(tiles)
    return out


def points_in_polygons(points: DataFrame, rings: DataFrame, size: float = BIN,
                       on: Sequence[str] = ()) -> DataFrame:
    """Pairs (point, ring) with the point strictly inside the ring.

    ``on`` names columns that must agree, such as the package. Points need x
    and y, rings a vertex array ``ring``; all other columns pass through.
    """
    size = float(size)
    edges = rings.where(F.size("ring") > 2).select(held(ring_edges(F.col("ring"))).alias("_e"))
    top = edges.agg(F.max(_top_level(_extent(F.col("_e")), size))).first()[0] or 0
    placed = points.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    inside = inside_ring(F.col("x"), F.col("y"), F.col("_edges"))
    named = {"bx": "_tx", "by": "_ty", "edges": "_edges", "level": "_level", "inner": "_inner"}
    if top == 0:
        binned = placed.withColumn("_tx", bin_of(F.col("x"), size)).withColumn("_ty", bin_of(F.col("y"), size))
        return binned.join(ring_tiles(rings, size).withColumnsRenamed(named), [*on, "_tx", "_ty"]).where(inside).drop("_tx", "_ty", "_edges")
    width = F.lit(size) * F.pow(F.lit(4.0), F.col("_level"))
    binned = (placed.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("_tx", F.floor(F.col("x") / width).cast("bigint"))
              .withColumn("_ty", F.floor(F.col("y") / width).cast("bigint")))
    pairs = binned.join(ring_cover(rings, size, top).withColumnsRenamed(named), [*on, "_level", "_tx", "_ty"])
    return pairs.where(F.col("_inner") | inside).drop(*named.values())


def lines_inside_polygon(lines: DataFrame, rings: DataFrame, key: str, ring_key: str,
                         size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Per line and ring it meets: are all of the line's vertices strictly inside?

    ``lines`` holds a vertex array ``line``. A line without vertices is inside
    nothing, a vertex that lacks a number is an ``error`` row.
    """
    wrong = F.exists("line", lambda p: p["x"].isNull() | p["y"].isNull())
    sized = lines.select(*on, key, "line", F.size("line").cast("bigint").alias("n_vertices"), F.coalesce(wrong, F.lit(False)).alias("_bad"))
    vertices = sized.where(~F.col("_bad")).select(*on, key, "n_vertices", F.inline("line"))
    hits = points_in_polygons(vertices, rings.select(*on, ring_key, "ring"), size, on)
    counts = hits.groupBy(*on, key, ring_key).agg(F.count(F.lit(1)).alias("_n"))
    inside = F.when(~F.col("_bad"), F.coalesce(F.col("_n") == F.col("n_vertices"), F.lit(False)))
    status = F.when(F.col("_bad"), F.lit("error: vertex is not a pair of numbers")).otherwise(F.lit("ok"))
    return sized.join(counts, [*on, key], "left").select(
        *on, key, ring_key, F.coalesce("_n", F.lit(0).cast("bigint")).alias("n_inside"), inside.alias("inside"), status.alias("status"))


def segments_of(lines: DataFrame, line: str = "line") -> DataFrame:
    """Segments (seg, ax, ay, bx, by) of each line, its other columns kept."""
    rest = [c for c in lines.columns if c != line]
    n = F.size(line)
    pairs = F.when(n >= 2, F.zip_with(
        F.slice(F.col(line), F.lit(1), n - 1), F.slice(F.col(line), F.lit(2), n - 1),
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))))
    return lines.select(*rest, F.posexplode(pairs).alias("seg", "_s")).select(*rest, "seg", "_s.*")


def _segment_bins(segments: DataFrame, size: float, grow: Column | float = 0.0) -> DataFrame:
    """The bins (gx, gy) that a segment passes, or comes within ``grow`` of, column by column.

    Their number follows the segment's length, not its box. A hair is added, so rounding loses no bin.
    """
    grow = (grow if isinstance(grow, Column) else F.lit(float(grow))) + F.lit(size * 1e-6)
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = segments.withColumn("gx", F.explode(bin_range(low - grow, high + grow, size)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    share = lambda x: F.when(dx != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("ax")) / F.nullif(dx, F.lit(0.0)))))
    from_ = F.coalesce(F.col("ay") + share(F.col("gx") * size - grow) * dy, F.col("ay"))
    to = F.coalesce(F.col("ay") + share((F.col("gx") + 1) * size + grow) * dy, F.col("by"))
    return columns.withColumn("gy", F.explode(bin_range(F.least(from_, to) - grow, F.greatest(from_, to) + grow, size)))


def target_area(points: DataFrame, mesh_regions: DataFrame, base_resolution: float, key: str = "vid",
                size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Smallest area limit at each point: half the squared base resolution or a region's."""
    base = base_resolution * base_resolution / 2.0
    regions = mesh_regions.groupBy(*on, "ring").agg(F.min("resolution").alias("resolution"))  # copies of a ring meet a point once
    hits = points_in_polygons(points.select(*on, key, "x", "y"), regions, size, on)
    finest = hits.groupBy(*on, key).agg(F.min("resolution").alias("_finest"))
    return points.join(finest, [*on, key], "left").withColumn(
        "target_area", F.least(F.coalesce("_finest", F.lit(base)), F.lit(base))).drop("_finest")


def breakline_grading(points: DataFrame, breaklines: DataFrame, far: float, key: str = "vid",
                      on: Sequence[str] = ()) -> DataFrame:
    """Finest graded area at each point near a breakline.

    A point within h·2^k of a line (the smallest such band, band < far) wants
    the area of a triangle of that side; the smallest over all lines wins.
    Breaklines hold ``line`` and ``near_spacing`` (0 or null: the default).
    """
    near = F.when(F.col("near_spacing") > 0, F.col("near_spacing")).otherwise(F.lit(S.DEFAULT_NEAR_SPACING_M))
    lines = (breaklines.withColumn("_bands", doubling_bands(near.cast("double"), F.lit(float(far))))
             .where(F.size("_bands") > 0).withColumn("_reach", F.array_max("_bands")))
    size = max(float(far), 1.0)
    segments = segments_of(lines.select(*on, "line", "_bands", "_reach")).drop("seg").distinct()
    cut = _segment_bins(segments, size, F.col("_reach"))
    binned = (points.select(*on, key, "x", "y")
              .withColumn("gx", bin_of(F.col("x"), size)).withColumn("gy", bin_of(F.col("y"), size)))
    distance = point_segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    pairs = binned.join(cut, [*on, "gx", "gy"]).withColumn("_d", distance).where(F.col("_d") <= F.col("_reach"))
    pairs = pairs.withColumn("_band", F.array_min(F.filter("_bands", lambda b: b >= F.col("_d"))))
    return pairs.groupBy(*on, key).agg(
        F.min("_d").alias("distance"), target_triangle_area(F.min("_band")).alias("target_area"))


def clip_lines(lines: DataFrame, rings: DataFrame, key: str, ring_key: str, size: float = BIN,
               on: Sequence[str] = ()) -> DataFrame:
    """Parts of each line strictly inside each ring, as segments.

    Every segment is cut where it crosses the ring's edges; a piece stays when
    its midpoint is inside. Only segments and edges that pass a common bin are
    compared; a cut found in several bins is one value of the set of cuts.
    """
    on = list(on)
    ends = ["ax", "ay", "bx", "by"]
    segments = segments_of(lines.select(*on, key, "line"))
    edges = (rings.where(F.size("ring") > 2).select(*on, ring_key, F.explode(ring_edges(F.col("ring"))).alias("e"))
             .select(*on, ring_key, F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")))
    near = _segment_bins(edges, size).select(*on, ring_key, "gx", "gy", *[F.col(c).alias(f"e_{c}") for c in ends])
    met = _segment_bins(segments, size).join(near, [*on, "gx", "gy"])
    ex, ey = F.col("e_bx") - F.col("e_ax"), F.col("e_by") - F.col("e_ay")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    det = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    t = ((F.col("e_ax") - F.col("ax")) * ey - (F.col("e_ay") - F.col("ay")) * ex) / det
    u = ((F.col("e_ax") - F.col("ax")) * dy - (F.col("e_ay") - F.col("ay")) * dx) / det
    cuts = (met.where(det.isNotNull()).withColumn("t", t).withColumn("u", u)
            .where(F.col("t").between(0.0, 1.0) & F.col("u").between(0.0, 1.0))
            .groupBy(*on, key, "seg", ring_key, *ends).agg(F.collect_set(F.round("t", 12)).alias("_cuts")))
    split = cuts.withColumn("_t", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), "_cuts"))))
    parts = split.select(*on, key, "seg", ring_key, *ends, F.explode(F.zip_with(
        F.slice("_t", F.lit(1), F.size("_t") - 1), F.slice("_t", F.lit(2), F.size("_t") - 1),
        lambda a, b: F.struct(a.alias("t0"), b.alias("t1")))).alias("_p"))
    middle = (F.col("_p.t0") + F.col("_p.t1")) / 2
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t
    # Pieces are looked up in their own ring, segments that a ring does not cut in every ring.
    own = points_in_polygons(parts.withColumn("x", at("ax", "bx", middle)).withColumn("y", at("ay", "by", middle)),
                             rings.select(*on, ring_key, "ring"), size, [*on, ring_key])
    whole = segments.withColumn("x", at("ax", "bx", F.lit(0.5))).withColumn("y", at("ay", "by", F.lit(0.5)))
    uncut = (points_in_polygons(whole, rings.select(*on, ring_key, "ring"), size, on)
             .join(cuts.select(*on, key, "seg", ring_key), [*on, key, "seg", ring_key], "left_anti")
             .withColumn("_p", F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"))))
    kept = own.select(*on, key, "seg", ring_key, *ends, "_p").unionByName(uncut.select(*on, key, "seg", ring_key, *ends, "_p"))
    return kept.select(*on, key, "seg", ring_key, F.col("_p.t0").alias("t0"), F.col("_p.t1").alias("t1"),
                       at("ax", "bx", F.col("_p.t0")).alias("x0"), at("ay", "by", F.col("_p.t0")).alias("y0"),
                       at("ax", "bx", F.col("_p.t1")).alias("x1"), at("ay", "by", F.col("_p.t1")).alias("y1"))


def split_hot_bins(segments: DataFrame, size: float, limit: int, depth: int, on: Sequence[str] = ()) -> DataFrame:
    """Segments in bins, a bin with more than ``limit`` of them halved up to ``depth`` times.

    The bins of all levels together tile the plane, so each place belongs to
    exactly one (level, gx, gy). Only crowded bins are cut and written again;
    without any, one count is all this costs.
    """
    done, level, step, place = None, 0, float(size), [*on, "gx", "gy"]
    rest = _segment_bins(segments, step)
    while True:
        hot = rest.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*place)
        last = level == depth
        if not last:
            hot = checkpointed(hot)
            last = not hot.limit(1).count()
        calm = (rest if last else rest.join(hot, place, "left_anti")).withColumn("level", F.lit(level))
        done = calm if done is None else done.unionByName(calm)
        if last:
            return done
        step, level = step / 2, level + 1
        crowded = (rest.join(hot, place, "left_semi")
                   .withColumnRenamed("gx", "_px").withColumnRenamed("gy", "_py"))
        rest = checkpointed(_segment_bins(crowded, step).where(
            (F.floor(F.col("gx") / 2) == F.col("_px")) & (F.floor(F.col("gy") / 2) == F.col("_py"))).drop("_px", "_py"))


def crossings(segments: DataFrame, key: Sequence[str], size: float = BIN, limit: int = 512,
              depth: int = 6, on: Sequence[str] = ()) -> DataFrame:
    """Points where two segments cross or touch, once per pair, with both parameters.

    Segments that lie on one another have no single crossing: the end points
    of each that the other holds count, so both are cut into equal pieces.
    """
    key, on = list(key), list(on)
    shape = [c for c in ("ax", "ay", "bx", "by") if c not in key]
    bins = split_hot_bins(segments.select(*on, *key, *shape), size, limit, depth, on)
    a = bins.select(*on, F.struct(*key).alias("a"), "level", "gx", "gy",
                    *[F.col(c).alias(f"a_{c}") for c in ("ax", "ay", "bx", "by")])
    b = bins.select(*on, F.struct(*key).alias("b"), "level", "gx", "gy",
                    *[F.col(c).alias(f"b_{c}") for c in ("ax", "ay", "bx", "by")])
    pairs = a.join(b, [*on, "level", "gx", "gy"]).where(
        (F.col("a") < F.col("b"))
        & (F.greatest("a_ax", "a_bx") >= F.least("b_ax", "b_bx")) & (F.greatest("b_ax", "b_bx") >= F.least("a_ax", "a_bx"))
        & (F.greatest("a_ay", "a_by") >= F.least("b_ay", "b_by")) & (F.greatest("b_ay", "b_by") >= F.least("a_ay", "a_by")))
    dx, dy = F.col("a_bx") - F.col("a_ax"), F.col("a_by") - F.col("a_ay")
    ex, ey = F.col("b_bx") - F.col("b_ax"), F.col("b_by") - F.col("b_ay")
    ox, oy = F.col("b_ax") - F.col("a_ax"), F.col("b_ay") - F.col("a_ay")
    det = F.nullif(dx * ey - dy * ex, F.lit(0.0))
    met = (pairs.where(det.isNotNull())
           .withColumn("t", (ox * ey - oy * ex) / det).withColumn("u", (ox * dy - oy * dx) / det)
           .where(F.col("t").between(0.0, 1.0) & F.col("u").between(0.0, 1.0)))
    # The crossing, held inside both boxes so that rounding cannot move it out of every common bin.
    hold = lambda v, c: F.greatest(F.least(v, F.greatest(f"a_a{c}", f"a_b{c}"), F.greatest(f"b_a{c}", f"b_b{c}")),
                                   F.least(f"a_a{c}", f"a_b{c}"), F.least(f"b_a{c}", f"b_b{c}"))
    met = (met.withColumn("x", hold(F.col("a_ax") + F.col("t") * dx, "x"))
           .withColumn("y", hold(F.col("a_ay") + F.col("t") * dy, "y")))
    cell = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    own = met.where((F.floor(F.col("x") / cell) == F.col("gx")) & (F.floor(F.col("y") / cell) == F.col("gy")))
    # Overlaps: parallel segments on one line, each met by the end points of the other.
    flat = pairs.where(det.isNull() & (dx * oy - dy * ox == 0.0))
    along = lambda x, y, side: (
        ((x - F.col(f"{side}_ax")) * (F.col(f"{side}_bx") - F.col(f"{side}_ax")) + (y - F.col(f"{side}_ay")) * (F.col(f"{side}_by") - F.col(f"{side}_ay")))
        / F.nullif((F.col(f"{side}_bx") - F.col(f"{side}_ax")) * (F.col(f"{side}_bx") - F.col(f"{side}_ax"))
                   + (F.col(f"{side}_by") - F.col(f"{side}_ay")) * (F.col(f"{side}_by") - F.col(f"{side}_ay")), F.lit(0.0)))
    ends = F.explode(F.array(*[F.struct(F.col(f"{s}_{e}x").alias("x"), F.col(f"{s}_{e}y").alias("y")) for s in "ab" for e in "ab"])).alias("p")
    shared = (flat.select("*", ends).withColumn("x", F.col("p.x")).withColumn("y", F.col("p.y"))
              .withColumn("t", along(F.col("x"), F.col("y"), "a")).withColumn("u", along(F.col("x"), F.col("y"), "b"))
              .where(F.col("t").between(0.0, 1.0) & F.col("u").between(0.0, 1.0)))
    shared = shared.where((F.floor(F.col("x") / cell) == F.col("gx")) & (F.floor(F.col("y") / cell) == F.col("gy")))
    return own.unionByName(shared, allowMissingColumns=True).select(*on, "a", "b", "t", "u", "x", "y")


def node_lines(lines: DataFrame, key: str, size: float = BIN, limit: int = 512, depth: int = 6,
               on: Sequence[str] = ()) -> DataFrame:
    """Cut every segment where it meets another, so segments share only end points.

    Copies of a segment are one shape: shapes are compared, and their cuts
    joined back to every segment of that shape.
    """
    on = list(on)
    segments = segments_of(lines.select(*on, key, "line"))
    ends = ["ax", "ay", "bx", "by"]
    shapes = segments.select(*on, *ends).distinct()
    met = crossings(shapes, ends, size, limit, depth, on)
    cut = met.select(*on, "a.*", F.col("t"), "x", "y").unionByName(met.select(*on, "b.*", F.col("u").alias("t"), "x", "y"))
    key = [*on, key]
    cuts = segments.join(cut, [*on, *ends]).select(*key, "seg", "t", "x", "y")
    inner = cuts.where((F.col("t") > 0) & (F.col("t") < 1))
    both_ends = segments.select(*key, "seg", F.explode(F.array(
        F.struct(F.lit(0.0).alias("t"), F.col("ax").alias("x"), F.col("ay").alias("y")),
        F.struct(F.lit(1.0).alias("t"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p"))
    nodes = (inner.unionByName(both_ends.select(*key, "seg", "p.*"))
             .groupBy(*key, "seg", F.round("x", 6).alias("_rx"), F.round("y", 6).alias("_ry"))
             .agg(F.min_by(F.struct("t", "x", "y"), F.col("t")).alias("p"))
             .select(*key, "seg", "p.*"))
    # A segment met by very many others is split by parameter, not ordered in one task.
    share = F.floor(F.col("t") * 16)
    linked = carry(nodes, [*key, "seg"], share, ["t"], {c: F.col(c) for c in ("t", "x", "y")}, after="n", exclude_current=True)
    return linked.where(F.col("n").isNotNull()).select(
        *key, "seg", F.col("t").alias("t0"), "n.t", F.col("x").alias("x0"), F.col("y").alias("y0"),
        F.col("n.x").alias("x1"), F.col("n.y").alias("y1")).withColumnRenamed("t", "t1")


def densify_polyline(lines: DataFrame, key: str, spacing: float) -> DataFrame:
    """Vertices of each line with every segment split evenly to at most ``spacing``."""
    segments = segments_of(lines.select(key, "line"))
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    parts = F.greatest(F.lit(1), F.ceil(length / F.lit(float(spacing)))).cast("bigint")
    # The closing vertex of a line belongs to its last segment only.
    n = F.size("line")
    ends = lines.where(n >= 2).select(key, (n - 1).cast("int").alias("seg"), F.lit(0).cast("bigint").alias("part"),
                                      F.element_at("line", -1).alias("_p"))
    steps = segments.withColumn("_n", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    f = F.col("part") / F.col("_n")
    inner = steps.select(key, "seg", "part", (F.col("ax") + (F.col("bx") - F.col("ax")) * f).alias("x"),
                         (F.col("ay") + (F.col("by") - F.col("ay")) * f).alias("y"))
    return inner.unionByName(ends.select(key, "seg", "part", "_p.x", "_p.y"))


def outlines(footprints: DataFrame) -> DataFrame:
    """Footprints as closed lines: ``line`` in place of ``ring``."""
    return footprints.withColumn("line", F.when(F.size("ring") > 0, F.concat(F.transform(ring_edges(F.col("ring")), lambda e: e["a"]), F.slice("ring", 1, 1)))).drop("ring")


def footprint_edges(footprints: DataFrame, key: str, size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of footprints that touch or overlap (a < b); ``on`` names columns that must agree, such as the package."""
    on = list(on)
    segments = segments_of(outlines(footprints).select(*on, key, "line"))
    met = crossings(segments, [key, "seg"], size, on=on)
    touching = met.where(F.col(f"a.{key}") != F.col(f"b.{key}")).select(
        *on, F.least(f"a.{key}", f"b.{key}").alias("a"), F.greatest(f"a.{key}", f"b.{key}").alias("b"))
    corners = segments.select(*on, F.col(key).alias("_own"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    within = points_in_polygons(corners, footprints.select(*on, key, "ring"), size, on).where(F.col("_own") != F.col(key)).select(
        *on, F.least("_own", key).alias("a"), F.greatest("_own", key).alias("b"))
    return touching.unionByName(within).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Smallest reachable key per node, by alternating large-star and small-star steps.

    Both steps only take minima per node, which combine before the shuffle, so
    a hub with very many neighbours is no special case. Each round is written
    to the shared folder. The loop ends when every link hangs a node with one
    parent on a root, which is exact.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = checkpointed(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (large.join(small_low, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
                 .unionByName(small_low.select(F.col("m").alias("a"), "b")).where("a <> b").distinct())
        links = checkpointed(small)
        deeper = links.join(links.select(F.col("b").alias("_b")), F.col("a") == F.col("_b"), "left_semi").limit(1).count()
        if not deeper and not links.groupBy("b").count().where("count > 1").limit(1).count():
            break
    root = links.groupBy(F.col("b").alias(key)).agg(F.min("a").alias("cluster"))
    return nodes.join(root, key, "left").withColumn("cluster", F.coalesce("cluster", key))


def footprint_clusters(footprints: DataFrame, key: str, size: float = BIN, on: Sequence[str] = ()) -> DataFrame:
    """Cluster label per footprint; footprints that touch share one. ``on`` names columns that must agree, such as the package.

    Copies of a footprint stand as one shape, that of the lowest key.
    """
    on = list(on)
    shapes = footprints.groupBy(*on, "ring").agg(F.min(key).alias(key))
    edges = footprint_edges(shapes, key, size, on)
    if on:  # a key counts within its package only
        named = F.struct(*on, key)
        shapes = shapes.withColumn("_node", named)
        edges = edges.select(F.struct(*on, F.col("a").alias(key)).alias("a"), F.struct(*on, F.col("b").alias(key)).alias("b"))
        labels = connected_components(shapes.select("_node"), edges, "_node").select(
            *[F.col(f"_node.{c}").alias(c) for c in on], F.col(f"_node.{key}").alias("_shape"), F.col(f"cluster.{key}").alias("cluster"))
    else:
        labels = connected_components(shapes.select(key), edges, key).withColumnRenamed(key, "_shape")
    shape_of = footprints.select(*on, key, "ring").join(shapes.select(*on, "ring", F.col(key).alias("_shape")), [*on, "ring"]).select(*on, key, "_shape")
    return shape_of.join(labels, [*on, "_shape"]).select(*on, key, "cluster")


def merged_counts(clusters: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Footprints before and clusters after merging."""
    return clusters.groupBy(*on).agg(F.count(F.lit(1)).alias("n_footprints"), F.count_distinct("cluster").alias("n_clusters"))
