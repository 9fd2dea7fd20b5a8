"""Nearest vectors by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt by hash into shards of bounded size. A shard's graph has nested layers, each about a
sixteenth of the one below; a node is linked with near nodes that lie in different directions, and back. Layers are
flat arrays of neighbour places, -1 where a node has fewer. Blocks of queries walk every shard: greedily down to the
lowest layer, there with a beam; many queries take each step together. What the shards find is merged by distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm.common import BASE, mix, stored

LINKS, TRIED, BEAM = 16, 48, 96
INDEX = "dim int, shard long, size long, vectors binary, ids binary, ends binary, nodes binary, layers binary"
BLOCK = "dim int, block long, query_ids binary, queries binary"
FOUND = "query_id long, vec_id long, score double"


def usable(column: str) -> Column:
    """Whether a vector takes part: not null, not zero, and all components finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(column, bad) & F.exists(column, lambda x: x != 0)


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two tables, or of two stacks of tables."""
    gap = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    return np.maximum(gap, 0)


def spread(gaps: np.ndarray, apart: np.ndarray, links: int) -> np.ndarray:
    """Which candidates each node links with: nearest first, those nearer to the node than to any taken before.

    ``gaps`` (nodes, candidates) is ascending, ``apart`` holds the candidates' distances from each other. Where this
    leaves a node with fewer than ``links``, its nearest others fill up.
    """
    n, tried = gaps.shape
    taken, nearest = np.zeros((n, tried), bool), np.full((n, tried), np.inf, gaps.dtype)
    for k in range(tried):
        take = (gaps[:, k] < nearest[:, k]) & np.isfinite(gaps[:, k]) & (taken.sum(1) < links)
        taken[:, k] = take
        nearest[take] = np.minimum(nearest[take], apart[take, k])
    room = links - taken.sum(1)
    rest = ~taken & np.isfinite(gaps)
    return taken | (rest & (np.cumsum(rest, 1) <= room[:, None]))


def linked_layer(vectors: np.ndarray, links: int, width: int, tried: int = TRIED, step: int = 512) -> np.ndarray:
    """Neighbour places (nodes, width) of one layer, by spread over the nearest ``tried`` nodes, with links back."""
    n = len(vectors)
    if n < 2:
        return np.full((n, width), -1, np.int32)
    tried, near = min(tried, n - 1), []
    for i in range(0, n, step):
        gaps = pairwise(vectors[i:i + step], vectors)
        rows = np.arange(len(gaps))
        gaps[rows, rows + i] = np.inf
        places = np.argpartition(gaps, tried - 1, 1)[:, :tried]
        gaps = gaps[rows[:, None], places]
        order = np.argsort(gaps, 1, kind="stable")
        places, gaps = places[rows[:, None], order], gaps[rows[:, None], order]
        taken = spread(gaps, pairwise(vectors[places], vectors[places]), links)
        row, k = np.nonzero(taken)
        near.append((row + i, places[row, k], gaps[row, k]))
    a, b, gap = (np.concatenate(x) for x in zip(*near))
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    back, gap = np.repeat([0, 1], len(a)), np.concatenate([gap, gap])
    order = np.lexsort((back, dst, src))
    src, dst, back, gap = src[order], dst[order], back[order], gap[order]
    new = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
    src, dst, back, gap = src[new], dst[new], back[new], gap[new]
    order = np.lexsort((gap, back, src))
    src, dst = src[order], dst[order]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    out = np.full((n, width), -1, np.int32)
    keep = place < width
    out[src[keep], place[keep]] = dst[keep]
    return out


def graph(vectors: np.ndarray, keys: np.ndarray, links: int = LINKS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places of the nodes of each layer, lowest first, and their neighbours as places within the layer.

    The layer of a node comes from the hash of its key; the lowest layer holds all nodes and has twice the links.
    """
    draws = (mix(keys.astype(np.int64).view(np.uint64) * BASE) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
    top = np.floor(-np.log(np.maximum(draws, 2.0 ** -53)) / np.log(links)).astype(np.int64)
    nodes, layers = [], []
    for layer in range(int(top.max()) + 1):
        here = np.flatnonzero(top >= layer)
        nodes.append(here.astype(np.int32))
        layers.append(linked_layer(vectors[here], links, 2 * links if layer == 0 else links))
    return nodes, layers


def _descend(vectors, norms, nodes, layers, queries) -> np.ndarray:
    """The place in the lowest layer from which each query starts: the nearest node seen on the way down."""
    at = np.zeros(len(queries), np.int64)
    for layer in range(len(layers) - 1, 0, -1):
        here, near = nodes[layer], layers[layer]
        moving = np.arange(len(queries))
        gap = norms[here[at]] - 2 * np.einsum("ij,ij->i", vectors[here[at]], queries)
        while len(moving):
            step = near[at[moving]]
            places = here[step]
            gaps = np.where(step >= 0, norms[places] - 2 * np.einsum("ikj,ij->ik", vectors[places], queries[moving]), np.inf)
            best = gaps.argmin(1)
            row = np.arange(len(moving))
            nearer = gaps[row, best] < gap[moving]
            gap[moving[nearer]] = gaps[row, best][nearer]
            at[moving[nearer]] = step[row, best][nearer]
            moving = moving[nearer]
        at = here[at] if layer == 1 else np.searchsorted(nodes[layer - 1], here[at])
    return at


def walk(vectors: np.ndarray, nodes: list, layers: list, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Places (queries, beam) that a beam search ends with, -1 where there are fewer. All arrays are single precision."""
    n, q = len(vectors), len(queries)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    start = _descend(vectors, norms, nodes, layers, queries)
    gaps, places = np.full((q, beam), np.inf, np.float32), np.full((q, beam), -1, np.int64)
    done, seen = np.ones((q, beam), bool), np.zeros((q, n), bool)
    active = np.arange(q)
    gaps[:, 0] = norms[start] - 2 * np.einsum("ij,ij->i", vectors[start], queries)
    places[:, 0], done[:, 0], seen[active, start] = start, False, True
    while True:
        open_gaps = np.where(done[active], np.inf, gaps[active])
        best = open_gaps.argmin(1)
        go = np.isfinite(open_gaps[np.arange(len(active)), best])
        active, best = active[go], best[go]
        if not len(active):
            return places
        done[active, best] = True
        step = layers[0][places[active, best]].astype(np.int64)
        new = (step >= 0) & ~seen[active[:, None], step]
        row, k = np.nonzero(new)
        seen[active[row], step[row, k]] = True
        found = np.full(step.shape, np.inf, np.float32)
        found[row, k] = norms[step[row, k]] - 2 * np.einsum("ij,ij->i", vectors[step[row, k]], queries[active[row]])
        all_gaps = np.concatenate([gaps[active], found], 1)
        all_places = np.concatenate([places[active], np.where(new, step, -1)], 1)
        all_done = np.concatenate([done[active], ~new], 1)
        keep = np.argpartition(all_gaps, beam - 1, 1)[:, :beam]
        gaps[active], places[active], done[active] = (np.take_along_axis(x, keep, 1) for x in (all_gaps, all_places, all_done))


def _built(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph as one row: vectors, keys of each with their ends, and for each layer its nodes and neighbours."""
    group = group.sort_values("rep")
    vectors = np.array(group["v"].to_list())
    nodes, layers = graph(vectors.astype(np.float32), group["rep"].to_numpy())
    ids = group["ids"].to_list()
    return pd.DataFrame({
        "dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1], "size": len(vectors), "vectors": [vectors.astype(np.float64).tobytes()],
        "ids": [np.concatenate(ids).astype(np.int64).tobytes()], "ends": [np.cumsum([len(x) for x in ids]).astype(np.int64).tobytes()],
        "nodes": [b"".join([np.int32([len(nodes)]).tobytes(), np.array([len(x) for x in nodes], np.int32).tobytes(), *(x.tobytes() for x in nodes)])],
        "layers": [b"".join(x.tobytes() for x in layers)]})


def opened(row, links: int = LINKS) -> tuple:
    """The arrays of a stored shard: vectors, ids, ends, nodes by layer, neighbours by layer."""
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["size"], -1)
    numbers = np.frombuffer(row["nodes"], np.int32)
    sizes = numbers[1:1 + numbers[0]]
    nodes = np.split(numbers[1 + numbers[0]:], np.cumsum(sizes)[:-1])
    widths = [2 * links] + [links] * (len(sizes) - 1)
    flat = np.split(np.frombuffer(row["layers"], np.int32), np.cumsum(sizes * widths)[:-1])
    return (vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64), nodes,
            [x.reshape(-1, w) for x, w in zip(flat, widths)])


def nearest_of_shard(shard: tuple, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM, step: int = 1024) -> pd.DataFrame:
    """The ``k`` nearest keys that a walk of the shard finds for each query, its own left out, by exact distance, then key."""
    vectors, ids, ends, nodes, layers = shard
    single = vectors.astype(np.float32)
    starts = np.concatenate([[0], ends[:-1]])
    out = []
    for i in range(0, len(queries), step):
        mine, own = queries[i:i + step], query_ids[i:i + step]
        places = walk(single, nodes, layers, mine.astype(np.float32), beam)
        row, column = np.nonzero(places >= 0)
        place = places[row, column]
        gap = vectors[place] - mine[row]
        score = np.sqrt((gap * gap).sum(1))
        many = ends[place] - starts[place]
        at = np.repeat(starts[place], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, score, key = np.repeat(row, many), np.repeat(score, many), ids[at]
        other = key != own[row]
        row, score, key = row[other], score[other], key[other]
        order = np.lexsort((key, score, row))
        row, score, key = row[order], score[order], key[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append(pd.DataFrame({"query_id": own[row[first]], "vec_id": key[first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def points(vectors: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Distinct usable vectors: v, dim, rep (least key), ids (the k + 1 least keys; no further copy can be among k nearest)."""
    rows = _rows(vectors, key, column).groupBy("v", "vec_id").agg(F.lit(1).alias("one"))
    first = Window.partitionBy("v").orderBy("vec_id")
    limit = k + 1
    least = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
    return least.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v"))


def _rows(vectors: DataFrame, key: str, column: str) -> DataFrame:
    return vectors.filter(F.col(key).isNotNull() & usable(column)).select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))


def build(vectors: DataFrame, k: int = 10, shard_rows: int = 4096, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The stored graphs: one row per shard of about ``shard_rows`` distinct vectors of one length."""
    sizes = _rows(vectors, key, column).groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    dealt = points(vectors, k, key, column).join(sizes, "dim").select("dim", F.pmod(F.xxhash64("rep"), "shards").alias("shard"), "rep", "ids", "v")
    return stored(dealt.groupBy("dim", "shard").applyInPandas(_built, INDEX), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, block_rows: int = 4096, lane: int = 2,
           key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest that the graphs hold for each query row, its own key left out.

    A task takes ``lane`` shards and one block of queries. Rows that repeat key and vector are one query; a key with
    several vectors asks for each and gets its ``k`` best of all.
    """
    asked = _rows(queries, key, column).groupBy("v", "vec_id").agg(F.lit(1).alias("one")).withColumn("dim", F.size("v"))
    many = asked.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    dealt = asked.join(many, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    blocks = stored(dealt.groupBy("dim", "block").applyInPandas(_block, BLOCK), "blocks")
    lanes = index.groupBy("dim").agg((F.max("shard") / lane).cast("long").alias("last"))
    of_block = blocks.select(F.col("dim").alias("of_dim"), F.col("block").alias("of_block"))
    shards = index.join(of_block, F.col("dim") == F.col("of_dim")).withColumn("lane", (F.col("shard") / lane).cast("long")).select(
        *index.columns, F.col("of_block").alias("block"), "lane")
    asked = blocks.join(lanes, "dim").withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")

    def work(mine: pd.DataFrame, them: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or them.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids = np.frombuffer(them["query_ids"].iloc[0], np.int64)
        vectors = np.frombuffer(them["queries"].iloc[0], np.float64).reshape(len(ids), -1)
        return pd.concat([nearest_of_shard(opened(row), ids, vectors, k, beam) for row in mine.to_dict("records")])

    keys = ("dim", "block", "lane")
    found = shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(work, FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"dim": group["dim"].iloc[:1], "block": group["block"].iloc[:1], "query_ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                         "queries": [np.array(group["v"].to_list(), np.float64).tobytes()]})


def nearest_vectors(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` nearest vectors, by Euclidean distance, of each row whose vec_id is divisible by ``every``.

    query_id, rank (from 1; ties by smaller vec_id), vec_id, score (the distance in double precision). Distances are
    exact, the choice is the graphs'. Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do rows without vec_id; vectors of different lengths are never compared. Copies of a vector are one node, each
    with its own rank in the result. Rows that repeat vec_id and vector are one. With fewer candidates all are
    returned. Empty table: no rows. Other columns are ignored.
    """
    index = build(vectors, k)
    return search(index, vectors.filter(F.col("vec_id") % every == 0), k)
