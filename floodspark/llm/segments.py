"""Hard negatives by inner product, found through segment summaries.

A vector is cut into 1, 2, 4, … segments of equal length. Of each segment its mean and its deviation (the norm of what is
left without the mean) are stored. For a segment of s components the product of two vectors is s times the product of
their means, plus or minus at most the product of their deviations, so sums over segments bound the inner product from
both sides. Finer segments are looked at only for what the coarser ones leave open, and exact scores come last.

Rows lie in packed blocks; so do anchors. A task reads some blocks of rows one after the other and holds a few blocks of
anchors with what they have found so far; blocks of rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm.common import discard, shuffles_freed, stored

PACKED = "dim int, part long, size int, ids binary, labels binary, vectors binary, summaries binary"
POSITIVES = "dim int, part long, anchor_id long, twin long, vec_id long, score long"
NEGATIVES = "anchor_id long, twin long, place long, positive_id long, positive_score long, vec_id long, score long"
EXACT = 2.0 ** 52
FIRST = 16


def finite(column: str) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(column).isNotNull() & ~F.exists(column, bad)


def cuts(dim: int) -> list[np.ndarray]:
    """Starts of the segments of each level: 1, 2, 4, … of nearly equal length, down to about four components."""
    out, parts = [], 1
    while parts == 1 or dim >= 4 * parts:
        out.append(np.unique(np.arange(parts) * dim // parts))
        parts *= 2
    return out


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level: weighted means (mean times the root of the segment's length) and deviations, by vector and segment."""
    rows, dim = vectors.shape
    out = []
    for starts in cuts(dim) if dim else []:
        sizes = np.diff(np.append(starts, dim))
        sums = np.add.reduceat(vectors, starts, axis=1)
        rest = vectors - np.repeat(sums / sizes, sizes, axis=1)
        out.append((sums / np.sqrt(sizes), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))))
    return out


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of two tables of one level, widened by what single precision can take."""
    a, b = ([x.astype(np.float64) for x in side] for side in (a, b))
    middle, reach = a[0] @ b[0].T, a[1] @ b[1].T
    longest = [np.sqrt((side[0] ** 2 + side[1] ** 2).sum(1).max(initial=0)) for side in (a, b)]
    slack = 1e-6 * longest[0] * longest[1] + 1e-6
    return middle - reach - slack, middle + reach + slack


def binaries(ids: np.ndarray, labels: np.ndarray, table: np.ndarray) -> list[bytes]:
    """Ids, labels, integer vectors (32 bits each where they fit) and summaries (single precision) of a packed row."""
    numbers = [x for level in summaries(table.astype(np.float64)) for x in level]
    blob = np.concatenate(numbers, 1).astype(np.float32) if numbers else np.zeros(0)
    narrow = table.size == 0 or max(-int(table.min()), int(table.max())) < 2 ** 31
    return [ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), table.astype(np.int32 if narrow else np.int64).tobytes(), blob.tobytes()]


class Block:
    """Ids, labels, integer vectors and segment summaries of one packed row, by ascending id."""

    def __init__(self, row: dict):
        n = row["size"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.integers = np.frombuffer(row["vectors"], np.int64 if len(row["vectors"]) > 4 * n * row["dim"] else np.int32).reshape(n, row["dim"]).astype(np.int64)
        self.vectors = self.integers.astype(np.float64)
        self.most = np.abs(self.vectors).max(initial=0)
        numbers, self.levels = np.frombuffer(row["summaries"], np.float32).reshape(n, -1), []
        for starts in cuts(row["dim"]) if row["dim"] else []:
            k = len(starts)
            self.levels.append((numbers[:, :k], numbers[:, k:2 * k]))
            numbers = numbers[:, 2 * k:]

    def level(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x[rows] for x in self.levels[k])

    def products(self, rows: np.ndarray, other: Block, columns: np.ndarray) -> np.ndarray:
        """Exact integer inner products: by doubles (and as such) where those are exact, else by 64-bit integers."""
        if self.most * other.most * max(self.vectors.shape[1], 1) < EXACT:
            return self.vectors[rows] @ other.vectors[columns].T
        return self.integers[rows] @ other.integers[columns].T

    def scores(self, rows: np.ndarray, other: Block, columns: np.ndarray) -> np.ndarray:
        return self.products(rows, other, columns).astype(np.int64)


def survivors(anchors: Block, rows: Block, a: np.ndarray, r: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and rows of which some pair may score from ``low`` to ``high`` (by anchor), by ever finer segments.

    A few of many anchors go first: where each of them stays and more than half of the rows do, all anchors keep at
    least those rows, and everything is compared.
    """
    if len(a) > 4 * FIRST:
        some = a[::len(a) // FIRST]
        still, kept = survivors(anchors, rows, some, r, low, high)
        if len(still) == len(some) and 2 * len(kept) > len(r):
            return a, r
    for k in range(len(anchors.levels)):
        if not len(a) or not len(r):
            break
        least, most = bounds(anchors.level(k, a), rows.level(k, r))
        open_pairs = (most >= low[a][:, None]) & (least <= high[a][:, None])
        a, r = a[open_pairs.any(1)], r[open_pairs.any(0)]
    return a, r


NONE = np.iinfo(np.int64).min + 1


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and place (from 0) of the ``k`` highest scores of each row; among equal ones the first columns."""
    if scores.size == 0:
        return (np.zeros(0, np.int64),) * 3
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] if k < scores.shape[1] else scores.min(1)
    take = (scores >= edge[:, None]) & (scores > NONE)
    for i in np.flatnonzero(take.sum(1) > k):
        level = np.flatnonzero(scores[i] == edge[i])
        take[i, level[k - int((scores[i] > edge[i]).sum()):]] = False
    row, column = np.nonzero(take)
    rank = np.lexsort((column, -scores[row, column], row))
    row, column = row[rank], column[rank]
    return row, column, np.arange(len(row)) - np.searchsorted(row, row)


class Top:
    """The ``k`` highest scores so far of each of ``n`` lists."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.full((n, k), NONE, np.int64), np.zeros((n, k), np.int64)

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        row, column, place = best(scores, self.k)
        if not len(row):
            return
        new_scores, new_ids = np.full((len(lists), self.k), NONE, np.int64), np.zeros((len(lists), self.k), np.int64)
        new_scores[row, place], new_ids[row, place] = scores[row, column], ids[column]
        all_scores, all_ids = np.concatenate([self.scores[lists], new_scores], 1), np.concatenate([self.ids[lists], new_ids], 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.scores[lists], self.ids[lists] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def merge(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """The same for a few scores, each with its list."""
        touched = np.unique(lists)
        lists = np.concatenate([np.repeat(touched, self.k), lists])
        scores, ids = (np.concatenate([old[touched].ravel(), new]) for old, new in ((self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < self.k
        self.scores[lists[keep], place[keep]], self.ids[lists[keep], place[keep]] = scores[keep], ids[keep]

    def least(self) -> np.ndarray:
        """What a score must reach to enter a list."""
        return self.scores[:, -1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column = np.nonzero(self.scores > NONE)
        return row, self.ids[row, column], self.scores[row, column]


def packed(vectors: DataFrame, rows: int = 4096) -> DataFrame:
    """Blocks of at most ``rows`` labelled vectors of one length, with integer components and segment summaries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, dims = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2))
            flat = batch.column(3)
            values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for i in range(0, len(mine), rows):
                    at = mine[i:i + rows]
                    at = at[np.argsort(ids[at], kind="stable")]
                    table = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)], pa.int32()), pa.array([int(ids[at].min())], pa.int64()), pa.array([len(at)], pa.int32()),
                         *(pa.array([x], pa.binary()) for x in binaries(ids[at], labels[at], table))],
                        names=["dim", "part", "size", "ids", "labels", "vectors", "summaries"])

    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                          F.size("embedding").alias("dim"), whole.alias("v")).mapInArrow(work, PACKED)


def grouped_anchors(vectors: DataFrame, every: int, rows: int) -> DataFrame:
    """Packed blocks of about ``rows`` anchors of one length, dealt by hash of their key: ``block`` numbers those of a length."""
    anchors = vectors.filter(F.col("vec_id") % every == 0).withColumn("dim", F.size("embedding"))
    many = anchors.groupBy("dim").agg(F.ceil(F.count("*") / rows).alias("blocks"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    dealt = anchors.join(many, "dim").select("dim", F.pmod(F.xxhash64("vec_id"), "blocks").alias("part"), "vec_id", F.col("label").cast("long").alias("label"), whole.alias("v"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "label"], kind="stable")
        table = np.array(group["v"].to_list(), np.int64).reshape(len(group), -1)
        made = binaries(group["vec_id"].to_numpy(), group["label"].to_numpy(), table)
        return pd.DataFrame([(group["dim"].iloc[0], group["part"].iloc[0], len(group), *made)],
                            columns=["dim", "part", "size", "ids", "labels", "vectors", "summaries"])

    return dealt.groupBy("dim", "part").applyInPandas(pack, PACKED)


def beside(blocks: DataFrame, anchors: DataFrame, together: int = 8, waves: int = 4) -> DataFrame:
    """Every block of rows with every block of anchors of the same length.

    A task reads its blocks of rows one by one against at most about ``together`` blocks of anchors, which alone are
    shuffled. There are about ``waves`` tasks a core, so that lists of found rows are few.
    """
    parts = max(1, -(-anchors.count() // together))
    lanes = max(1, -(-blocks.sparkSession.sparkContext.defaultParallelism * waves // parts))
    side = anchors.select(*(F.col(c).alias(f"of_{c}") for c in anchors.columns)).repartition(parts)
    return blocks.coalesce(lanes).hint("shuffle_replicate_nl").join(side, F.col("dim") == F.col("of_dim"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, tuple[int, int], dict]]:
    """Block of rows, name of the block of anchors, and its columns, not yet read."""
    held, rows = None, None
    for batch in batches:
        at = {name: k for k, name in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            cell = {name: batch.column(i)[k] for name, i in at.items()}
            given = {name: cell[name].as_py() for name in ("dim", "size", "ids", "labels", "vectors")}
            if given != held:
                held, rows = given, Block({**given, "summaries": cell["summaries"].as_py()})
            yield rows, (cell["of_dim"].as_py(), cell["of_part"].as_py()), {name[3:]: value for name, value in cell.items() if name.startswith("of_")}


def _read(cells: dict) -> dict:
    return {name: cell.as_py() for name, cell in cells.items()}


def positives(joined: DataFrame, k: int = 5) -> DataFrame:
    """For each anchor its ``k`` best other rows of its label, numbered by ``place``; ``twin`` tells anchors of one key apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {}
        for rows, name, of in _pairs(batches):
            if name not in states:
                anchors = Block(_read(of))
                states[name] = anchors, Top(len(anchors.ids), k)
            anchors, top = states[name]
            for label in np.unique(anchors.labels):
                a, r = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
                low = top.least().astype(np.float64)
                a, r = survivors(anchors, rows, a, r, low, np.full(len(low), np.inf))
                if len(a) and len(r):
                    scores = anchors.scores(a, rows, r)
                    scores[anchors.ids[a][:, None] == rows.ids[r][None, :]] = NONE
                    top.add(a, scores, rows.ids[r])
        for name, (anchors, top) in states.items():
            yield told(name, anchors, top)

    def told(name: tuple, anchors: Block, top: Top) -> pa.RecordBatch:
        row, ids, scores = top.found()
        columns = [np.full(len(row), name[1]), anchors.ids[row], _twin(anchors)[row], ids, scores]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), name[0]), pa.int32()), *(pa.array(x, pa.int64()) for x in columns)],
                                          names=["dim", "part", "anchor_id", "twin", "vec_id", "score"])

    found = joined.mapInArrow(work, POSITIVES)
    first = Window.partitionBy("anchor_id", "twin").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(first).cast("long")).filter(F.col("place") <= k)


def _twin(anchors: Block) -> np.ndarray:
    """Names an anchor row by label and vector, so that rows of one key are told apart."""
    numbers = np.concatenate([anchors.labels[:, None], anchors.integers], 1).view(np.uint64)
    with np.errstate(over="ignore"):
        weights = np.cumprod(np.full(numbers.shape[1], 0x9E3779B97F4A7C15, np.uint64))
        return (numbers * weights).sum(1, dtype=np.uint64).view(np.int64)


def negatives(joined: DataFrame, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """For each anchor and positive the ``k`` best rows of another label, scoring ``low`` to ``high`` hundredths of the positive.

    ``joined`` carries for each block of anchors its positives as ``of_found``: anchor_id, twin, place, vec_id, score.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = {}
        for rows, name, of in _pairs(batches):
            if name not in states:
                states[name] = opened(_read(of))
            anchors, found, owner, slots, top = states[name]
            scores_of = found["score"]
            least, most = -(-low * scores_of // 100), high * scores_of // 100
            enough = np.maximum(least, top.least())
            floor, ceiling = np.full(len(anchors.ids), -NONE), np.full(len(anchors.ids), NONE)
            can = enough <= most
            np.minimum.at(floor, owner[can], enough[can])
            np.maximum.at(ceiling, owner[can], most[can])
            a, r = np.flatnonzero(floor <= ceiling), np.arange(len(rows.ids))
            a, r = survivors(anchors, rows, a, r, floor.astype(np.float64), ceiling.astype(np.float64))
            for i in range(0, len(a) if len(r) else 0, 128):
                mine = a[i:i + 128]
                scores = anchors.products(mine, rows, r)
                may = (scores >= floor[mine].astype(scores.dtype)[:, None]) & (scores <= ceiling[mine].astype(scores.dtype)[:, None])
                row, column = np.divmod(np.flatnonzero(may), len(r))
                apart = anchors.labels[mine[row]] != rows.labels[r[column]]
                row, column = row[apart], column[apart]
                score, of_row = scores[row, column].astype(np.int64), slots[mine[row]]
                entry, slot = np.nonzero(of_row >= 0)
                to, score, ids = of_row[entry, slot], score[entry], rows.ids[r[column[entry]]]
                fits = (score >= enough[to]) & (score <= most[to])
                if fits.any():
                    top.merge(to[fits], score[fits], ids[fits])
        for anchors, found, owner, _, top in states.values():
            yield told(anchors, found, owner, top)

    def opened(of: dict) -> tuple:
        anchors = Block(of)
        kind = [(n, np.int64) for n in ("anchor_id", "twin", "place", "vec_id", "score")]
        found = np.array([tuple(p[n] for n, _ in kind) for p in of["found"] or []], kind)
        named = {pair: i for i, pair in enumerate(zip(anchors.ids.tolist(), _twin(anchors).tolist()))}
        owner = np.array([named[p] for p in zip(found["anchor_id"].tolist(), found["twin"].tolist())], np.int64)
        order = np.argsort(owner, kind="stable")
        place = np.arange(len(owner)) - np.searchsorted(owner[order], owner[order])
        slots = np.full((len(anchors.ids), int(place.max(initial=-1)) + 1), -1, np.int64)  # the lists of each anchor
        slots[owner[order], place] = order
        return anchors, found, owner, slots, Top(len(found), k)

    def told(anchors: Block, found: np.ndarray, owner: np.ndarray, top: Top) -> pa.RecordBatch:
        row, ids, scores = top.found()
        columns = (*(np.ascontiguousarray(found[n])[row] for n in ("anchor_id", "twin", "place", "vec_id", "score")), ids, scores)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns],
                                          names=["anchor_id", "twin", "place", "positive_id", "positive_score", "vec_id", "score"])

    found = joined.mapInArrow(work, NEGATIVES)
    first = Window.partitionBy("anchor_id", "twin", "place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def hard_negatives(vectors: DataFrame, every: int = 100, n_positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
                   rows: int = 4096, block: int = 1024, lane: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows whose vec_id ``every`` divides.

    Scores are integer inner products of components floor(256 x). An anchor's positives are its ``n_positives`` best
    other rows of its label; for each, the first ``k`` rows of another label with a score of ``low`` to ``high``
    hundredths of the positive's are returned, best first, ties by smaller vec_id. All rows are compared, in blocks.

    Rows without vec_id, label or vector, or with a null or non-finite component take no part; a row that repeats
    vec_id, label and vector counts once; rows that share only vec_id are each an anchor, and never their own positive.
    Only vectors of one length are compared. An anchor without positives or negatives gives no rows, and neither does a
    positive with a score below 0. Empty table: no rows. Other columns are ignored. Sums beyond 64 bits wrap around.
    A file of blocks holds ``lane`` rows.
    """
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    whole = whole.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    with shuffles_freed(vectors.sparkSession):
        whole = stored(whole.groupBy("vec_id", "label", "embedding").agg(F.lit(1).alias("one")).drop("one"), "vectors")
        blocks = stored(packed(whole, rows), "blocks", rows=max(1, lane // rows))
        anchors = stored(grouped_anchors(whole, every, block), "anchors")
        discard(whole)
        found = positives(beside(blocks, anchors), n_positives)
        listed = found.groupBy("dim", "part").agg(F.collect_list(F.struct("anchor_id", "twin", "place", "vec_id", "score")).alias("found"))
        asked = stored(anchors.join(listed, ["dim", "part"]), "asked")
    return negatives(beside(blocks, asked), k, low, high)
