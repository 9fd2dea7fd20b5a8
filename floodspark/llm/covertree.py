"""Near-duplicate embeddings by a dual traversal of a cover tree.

Unit vectors are hung into a tree: a node's points are dealt to centres that cover a sample of them within half its
radius, nested into a quarter and so on until there are enough; each child's own radius is then measured. Every level
is one round of Spark jobs, and nodes too large for one task are dealt in parts. The traversal starts with the root
against itself and replaces a pair of nodes by pairs of their children, dropping those whose centres are farther apart
than both radii and the threshold allow. What is left are pairs of small leaves, compared exactly.

Points travel as they were given (four bytes a component where those are single precision) and are scaled where they are
used. Where most pairs of leaves are left, tasks read the leaves of two parts of the table and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodspark.llm.common import BASE, discard, mix, runs, shuffles_freed, stored
from floodspark.llm.components import components

SLACK = 1e-9
POINT = "rep long, copies long, mark long, vector binary, node string, reach double"
SKETCH = 16


def _matrix(blobs) -> np.ndarray:
    blobs = list(blobs)
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _units(blob: bytes, n: int, node: str) -> np.ndarray:
    """Unit vectors in double precision of ``n`` points below ``node``, whose root tells the number of dimensions."""
    dim = int(node.split("/")[0][1:])
    x = np.frombuffer(blob, np.float32 if len(blob) == 4 * dim * n else np.float64).reshape(n, dim).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def cover(sample: np.ndarray, most: int) -> np.ndarray:
    """Indices of nested centres: for halving radii, each point farther than the radius from all centres becomes one.

    Stops at the level that has a quarter of ``most`` or more, and never takes more than ``most``.
    """
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    radius = far.max()
    while radius > SLACK and len(chosen) < max(2, most // 4):
        radius /= 2
        while len(chosen) < most and far.max() > radius:
            k = int(np.argmax(far))
            chosen.append(k)
            far = np.minimum(far, _distances(sample, sample[k:k + 1])[:, 0])
    return np.array(chosen)


def usable(vectors: DataFrame, key: str, column: str) -> tuple[Column, Column]:
    """The vector, in single precision where it is given so, and whether it takes part with its key."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    narrow = vectors.schema[column].dataType == T.ArrayType(T.FloatType(), vectors.schema[column].dataType.containsNull)
    v = F.col(column).cast("array<float>" if narrow else "array<double>")
    return v, F.col(key).cast("long").isNotNull() & v.isNotNull() & F.forall(v, good) & F.exists(v, lambda x: x != 0)


def marked(v: Column, seed: int) -> Column:
    """A number that names a vector; ``seed`` gives other ones."""
    return F.xxhash64(v, F.lit(seed))


def unit_points(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", seed: int = 0) -> DataFrame:
    """The distinct usable vectors: least key, number of copies, mark, the vector as given, and root node.

    Null vectors and keys, zero vectors, and vectors with null or non-finite components are left out. There is a root
    for each number of dimensions.
    """
    v, takes_part = usable(vectors, key, column)
    each = vectors.filter(takes_part).select(F.col(key).cast("long").alias("rep"), v.alias("v")).groupBy("v").agg(
        F.min("rep").alias("rep"), F.count("*").alias("copies")).select("rep", "copies", marked(F.col("v"), seed).alias("mark"), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, dims = batch.column(3), batch.column(3).value_lengths().to_numpy()
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(dims)]) * values.itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), len(dims), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), blobs.cast(pa.binary()), pa.array([f"d{n}" for n in dims], pa.string()),
                                              pa.array([2.0] * len(dims), pa.float64())], names=["rep", "copies", "mark", "vector", "node", "reach"])

    return each.mapInArrow(work, POINT)


def build(points: DataFrame, leaf: int = 4096, fan: int = 256, share: int = 20_000) -> tuple[DataFrame, list[DataFrame]]:
    """The points with their leaf, and for each level the table of its nodes: parent, child, centre, radius.

    A node of more than ``leaf`` points is split by centres from ``fan`` of its points, about two for each leaf that it
    needs; parts of about ``share`` points are dealt by one task each. A node whose points all coincide is cut by number.
    """
    levels = []
    with shuffles_freed(points.sparkSession):
        points = stored(points, "points")
        while (split := _split(points, leaf, fan, share)) is not None:
            discard(points)
            points, level = split
            levels.append(level)
    return points, levels


def _split(points: DataFrame, leaf: int, fan: int, share: int) -> tuple[DataFrame, DataFrame] | None:
    """The points after large nodes were split, and the table of the new nodes; None if no node is large."""
    sizes = points.groupBy("node").agg(F.count("*").alias("size")).filter(F.col("size") > leaf)
    sizes = stored(sizes, "sizes")
    if not sizes.limit(1).count():
        return None
    first = Window.partitionBy("node").orderBy(F.xxhash64("rep"), "rep", "mark")
    large = points.join(sizes, "node")
    names = points.join(sizes, "node").select("node", "size", "rep", "mark").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= fan)
    sample = names.join(points.select("node", "mark", "vector"), ["node", "mark"])
    centres = stored(sample.groupBy("node", "size").applyInPandas(lambda g: _centres(g, fan, leaf), "node string, size long, child string, centre binary"), "centres")
    parts = F.ceil(F.col("size") / share).cast("int")
    dealt = large.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).select("node", "part", "rep", "copies", "mark", "vector")
    beside = centres.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("node", "part", "child", "centre")
    moved = dealt.groupBy("node", "part").cogroup(beside.groupBy("node", "part")).applyInPandas(_dealt, POINT)
    points = stored(points.join(sizes, "node", "left_anti").select(*moved.columns).union(moved), "points")
    radii = points.groupBy("node").agg(F.max("reach").alias("radius"))
    return points, stored(centres.join(radii, F.col("child") == radii["node"]).select(centres["node"], "child", "centre", "radius"), "level")


def _centres(group: pd.DataFrame, fan: int, leaf: int) -> pd.DataFrame:
    node, size = group["node"].iloc[0], int(group["size"].iloc[0])
    matrix = _units(b"".join(group.sort_values("k")["vector"]), len(group), node)
    chosen = cover(matrix, max(2, min(fan, -(-2 * size // leaf))))
    if len(chosen) == 1:
        chosen = np.zeros(-(-size // leaf), np.int64)
    return pd.DataFrame({"node": node, "size": size, "child": [f"{node}/{k}" for k in range(len(chosen))],
                         "centre": [matrix[k].tobytes() for k in chosen]})


def _dealt(mine: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Each point to its nearest centre; among equal centres by its key."""
    if mine.empty:
        return pd.DataFrame(columns=["rep", "copies", "mark", "vector", "node", "reach"])
    matrix, table = _units(b"".join(mine["vector"]), len(mine), mine["node"].iloc[0]), _matrix(centres["centre"])
    child = centres["child"].to_numpy()
    if len(table) > 1 and (table == table[0]).all():
        deep = np.uint64(len(child[0]))  # another deal at every level
        nearest = (mix(mine["rep"].to_numpy(np.int64).view(np.uint64) + deep * BASE) % np.uint64(len(table))).astype(np.int64)
    else:
        nearest = np.concatenate([np.argmax(matrix[k:k + 4096] @ table.T, 1) for k in range(0, len(matrix), 4096)])
    reach = np.sqrt(np.maximum(((matrix - table[nearest]) ** 2).sum(1), 0.0))
    return pd.DataFrame({**{c: mine[c] for c in ("rep", "copies", "mark", "vector")}, "node": child[nearest], "reach": reach})


def leaf_pairs(points: DataFrame, levels: list[DataFrame], distance: float) -> DataFrame:
    """Pairs of leaves (a, b) that may hold points within ``distance``, by descending both sides at once."""
    pairs = points.select(F.split("node", "/")[0].alias("a")).distinct().select("a", F.col("a").alias("b"))
    for level in levels:
        kids = level.groupBy("node").agg(F.collect_list(F.struct("child", "centre", "radius")).alias("kids"))
        joined = (pairs.join(kids.select(F.col("node").alias("a"), F.col("kids").alias("kids_a")), "a", "left")
                  .join(kids.select(F.col("node").alias("b"), F.col("kids").alias("kids_b")), "b", "left"))
        both = joined.filter("kids_a IS NOT NULL AND kids_b IS NOT NULL").select("a", "b", "kids_a", "kids_b").mapInArrow(
            lambda batches: _pruned(batches, distance), "a string, b string")
        known = _all_nodes(levels)
        one = joined.filter("(kids_a IS NULL) <> (kids_b IS NULL)").select(
            F.coalesce(F.when(F.col("kids_a").isNull(), F.col("a")), F.col("b")).alias("still"), F.coalesce("kids_a", "kids_b").alias("kids"))
        one = one.join(known, one["still"] == known["child"], "left").select("still", "centre", "radius", "kids")
        one = one.select(F.lit("").alias("a"), F.lit("-").alias("b"), F.array(F.struct(F.col("still").alias("child"), "centre", "radius")).alias("kids_a"),
                         F.col("kids").alias("kids_b")).mapInArrow(lambda batches: _pruned(batches, distance), "a string, b string")
        pairs = stored(both.union(one).union(joined.filter("kids_a IS NULL AND kids_b IS NULL").select("a", "b")), "pairs")
    return pairs


def _all_nodes(levels: list[DataFrame]) -> DataFrame:
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out.select("child", "centre", "radius")


def _pruned(batches: Iterator[pa.RecordBatch], distance: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_a, out_b = [], []
        for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            gap = _distances(_matrix(k["centre"] for k in left), _matrix(k["centre"] for k in right))
            reach = np.array([k["radius"] for k in left])[:, None] + np.array([k["radius"] for k in right])[None, :]
            near = gap <= reach + distance + SLACK
            if a == b:
                near = np.triu(near)
            i, j = np.nonzero(near)
            out_a += [left[k]["child"] for k in i]
            out_b += [right[k]["child"] for k in j]
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.string()), pa.array(out_b, pa.string())], names=["a", "b"])


BLOCK = "node string, mates array<string>, reps binary, copies binary, vectors binary, centres binary, sizes binary, reaches binary"


def _packed(group: pd.DataFrame, beside: pd.DataFrame) -> pd.DataFrame:
    """A leaf as one row, ordered by the nested centres of a cover of its own; ``sizes`` and ``reaches`` are by centre.

    ``mates`` names the leaves that it is compared with as the left one of a pair.
    """
    if group.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in BLOCK.split(", ")])
    units = _units(b"".join(group["vector"]), len(group), group["node"].iloc[0])
    centres = units[cover(units, 32)]
    gaps = _distances(units, centres)
    nearest = gaps.argmin(1)
    order = np.argsort(nearest, kind="stable")
    sizes = np.bincount(nearest, minlength=len(centres))
    reaches = np.zeros(len(centres))
    np.maximum.at(reaches, nearest, gaps.min(1))
    rows = group.iloc[order]
    return pd.DataFrame({"node": [group["node"].iloc[0]], "mates": [beside["mate"].tolist()], "reps": [rows["rep"].to_numpy(np.int64).tobytes()],
                         "copies": [rows["copies"].to_numpy(np.int64).tobytes()], "vectors": [b"".join(rows["vector"])],
                         "centres": [centres.tobytes()], "sizes": [sizes.astype(np.int64).tobytes()], "reaches": [reaches.tobytes()]})


class Leaf:
    """What a packed row holds, and what a sketch of its vectors needs."""

    def __init__(self, row: dict, side: str):
        whole = lambda name, kind=np.int64: np.frombuffer(row[f"{name}_{side}"], kind)
        self.name, self.reps, self.copies, sizes = row[side], whole("reps"), whole("copies"), whole("sizes")
        self.units = _units(row[f"vectors_{side}"], len(self.reps), self.name)
        self.centres = whole("centres", np.float64).reshape(len(sizes), -1)
        self.at, self.reach = np.concatenate([[0], np.cumsum(sizes)]), whole("reaches", np.float64)
        self.mean = self.units.mean(0)
        self.variance = np.einsum("ij,ij->j", self.units, self.units) / len(self.units) - self.mean ** 2

    def sketch(self, dims: np.ndarray) -> np.ndarray:
        """The components ``dims`` and the length of the rest: products of sketches are never below those of the vectors."""
        some = self.units[:, dims]
        rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", some, some), 0.0))
        return np.concatenate([some, rest[:, None]], 1).astype(np.float32)


def _marks(table: np.ndarray) -> np.ndarray:
    """Places of the true values of a table that has few: first of words of eight that hold some."""
    flat = table.ravel()
    if len(flat) < 4096:
        return np.flatnonzero(flat)
    ends = len(flat) // 8 * 8
    words = _marks(flat[:ends].view(np.uint64) != 0)
    word, byte = np.nonzero(flat[:ends].reshape(-1, 8)[words])
    return np.concatenate([words[word] * 8 + byte, np.flatnonzero(flat[ends:]) + ends])


def _pieces(close: np.ndarray, left: Leaf, right: Leaf, most: int = 256) -> Iterator[tuple[slice, slice]]:
    """Ranges of points of both leaves whose parts are ``close``; parts of one pattern go together up to ``most`` points."""
    i = 0
    while i < len(close):
        j = i + 1
        while j < len(close) and left.at[j + 1] - left.at[i] <= most and (close[j] == close[i]).all():
            j += 1
        for a, b in zip(*runs(close[i])):
            yield slice(left.at[i], left.at[j]), slice(right.at[a], right.at[b])
        i = j


def _near(left: Leaf, right: Leaf, cosine: float) -> tuple[np.ndarray | None, tuple[np.ndarray, np.ndarray] | None]:
    """Which points of two leaves are linked: places of both if links are few, else a table.

    Parts whose centres are too far apart are never compared; of other pairs those count whose sketches, of the
    components that differ most, allow a link.
    """
    near, listed, found, size = None, [], 0, len(left.units) * len(right.units)
    close = _distances(left.centres, right.centres) <= left.reach[:, None] + right.reach[None, :] + np.sqrt(2.0 - 2.0 * cosine) + SLACK
    sketches = None
    if left.units.shape[1] > 2 * SKETCH:
        dims = np.argsort(-(left.variance + right.variance + (left.mean - right.mean) ** 2), kind="stable")[:SKETCH]
        sketches = left.sketch(dims), np.ascontiguousarray(right.sketch(dims).T)
    for rows, columns in _pieces(close, left, right):
        places = None
        if sketches is not None:
            may = sketches[0][rows] @ sketches[1][:, columns] >= np.float32(cosine - 1e-5)
            if np.count_nonzero(may) * SKETCH <= may.size:
                row, column = np.divmod(_marks(may), may.shape[1])
                row, column = row + rows.start, column + columns.start
                linked = np.einsum("ij,ij->i", left.units[row], right.units[column]) >= cosine
                places = row[linked], column[linked]
        if places is None:
            part = left.units[rows] @ right.units[columns].T >= cosine
            row, column = np.nonzero(part)
            places = row + rows.start, column + columns.start
        found += len(places[0])
        listed.append(places)
        if near is None and found * SKETCH > size:
            near = np.zeros((len(left.units), len(right.units)), bool)
        if near is not None:
            for some in listed:
                near[some] = True
            listed = []
    if near is not None:
        return near, None
    return None, tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in listed)]) for k in (0, 1))


def _counted(left: Leaf, right: Leaf, near: np.ndarray, step: int = 512) -> tuple[np.ndarray, ...]:
    """Of many links: for each point of both sides the number of vectors linked with, and the least key it reaches."""
    top, same = np.iinfo(np.int64).max, left.name == right.name
    if same:
        np.fill_diagonal(near, False)
    n_a, n_b = np.zeros(len(left.reps)), np.zeros(len(right.reps))
    for i in range(0, len(n_a), step):
        part = near[i:i + step].astype(np.float64)
        n_a[i:i + step] = part @ right.copies
        n_b += left.copies[i:i + step] @ part
    low_a, low_b = left.reps.copy(), right.reps.copy()
    while n_a.any():
        new_a, new_b = low_a.copy(), low_b.copy()
        for i in range(0, len(n_a), step):
            part = near[i:i + step]
            new_a[i:i + step] = np.minimum(new_a[i:i + step], np.where(part, low_b[None, :], top).min(1))
            new_b = np.minimum(new_b, np.where(part, new_a[i:i + step, None], top).min(0))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    return n_a, n_b, low_a, low_b


def _listed(left: Leaf, right: Leaf, places: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The same of few links, given as places."""
    i, j = places
    same = left.name == right.name
    if same:
        i, j = i[i != j], j[i != j]
    n_a = np.bincount(i, right.copies[j], len(left.reps))
    n_b = np.bincount(j, left.copies[i], len(right.reps))
    low_a, low_b = left.reps.copy(), right.reps.copy()
    while len(i):
        new_a, new_b = low_a.copy(), low_b.copy()
        np.minimum.at(new_a, i, low_b[j])
        np.minimum.at(new_b, j, new_a[i])
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == low_a).all() and (new_b == low_b).all():
            break
        low_a, low_b = new_a, new_b
    return n_a, n_b, low_a, low_b


def _linked(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Of each leaf pair: how many vectors each point is linked with across the pair, and a tree over linked points."""
    left, seen = None, {}
    for batch in batches:
        at = {name: k for k, name in enumerate(batch.schema.names)}

        def opened(k: int, side: str) -> Leaf:
            return Leaf({name: batch.column(i)[k].as_py() for name, i in at.items() if name.endswith(side)}, side)

        for k in range(batch.num_rows):
            a, b = (batch.column(at[side])[k].as_py() for side in "ab")
            left = left if left is not None and left.name == a else opened(k, "a")
            if a != b and b not in seen:
                if len(seen) == 24:
                    seen.pop(next(iter(seen)))
                seen[b] = opened(k, "b")
            right = left if a == b else seen[b]
            near, places = _near(left, right, cosine)
            n_a, n_b, low_a, low_b = _counted(left, right, near) if places is None else _listed(left, right, places)
            rows = [(left.reps, n_a, low_a)] if left is right else [(left.reps, n_a, low_a), (right.reps, n_b, low_b)]
            rep, n, low = (np.concatenate(x) for x in zip(*rows))
            keep = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].astype(np.int64), pa.int64()) for x in (rep, n, low)], names=["rep", "n", "low"])


def compared(points: DataFrame, pairs: DataFrame, few: float = 2.0) -> DataFrame:
    """Each pair of leaves as one row with both packed leaves.

    Up to ``few`` pairs a leaf are joined by name. More would ship every leaf many times over: then tasks read parts of
    the table of leaves against parts of it, and no leaf is shuffled. A hash says which of two leaves is the left one.
    """
    u, w = F.least("a", "b"), F.greatest("a", "b")
    turned = F.pmod(F.xxhash64(u, w), F.lit(2)) == 1
    mates = pairs.select(F.when(turned, w).otherwise(u).alias("of"), F.when(turned, u).otherwise(w).alias("mate"))
    many = pairs.count() > few * points.select("node").distinct().count()
    beside = mates if many else mates.limit(0)
    with shuffles_freed(points.sparkSession):
        blocks = stored(points.groupBy("node").cogroup(beside.groupBy("of")).applyInPandas(_packed, BLOCK), "blocks", rows=4)
    side = lambda name: blocks.select(*(F.col(c).alias(name if c == "node" else f"{c}_{name}") for c in blocks.columns))
    if many:
        joined = side("a").hint("shuffle_replicate_nl").join(side("b").drop("mates_b"), F.array_contains("mates_a", F.col("b")))
    else:
        joined = pairs.join(side("a"), "a").join(side("b").drop("mates_b"), "b")
    return joined.drop("mates_a")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, leaf: int = 4096, fan: int = 256) -> DataFrame:
    """One row per vector: vec_id, n_links (others with a cosine of at least ``cosine``), component_id, kept.

    Copies of a vector are one point with a count. Vectors that are null, zero, or hold null or non-finite components
    link with nothing, and neither do vectors of different lengths. A null vec_id links with nothing, has no
    component_id and is kept. Other columns, labels included, are ignored.
    """
    distance = float(np.sqrt(2.0 - 2.0 * cosine))
    for seed in count():
        points, levels = build(unit_points(vectors, seed=seed), leaf, fan)
        if not points.groupBy("mark").count().filter("count > 1").limit(1).count():  # each mark names one vector
            break
        discard(points)
    with shuffles_freed(vectors.sparkSession):
        pairs = stored(leaf_pairs(points, levels, distance), "pairs")
        found = stored(compared(points, pairs).mapInArrow(lambda batches: _linked(batches, cosine), "rep long, n long, low long"), "found")
        counts = points.select("rep", "mark", "copies").join(found.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left")
        placed = counts.join(components(found, "rep", "low"), counts["rep"] == F.col("node"), "left").select(
            "mark", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
        placed = stored(placed, "placed")
    v, takes_part = usable(vectors, "vec_id", "embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(takes_part, marked(v, seed)).alias("mark"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return rows.join(placed, "mark", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                    component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
