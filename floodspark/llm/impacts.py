"""Ranked lexical search over posting lists in geometric blocks.

Documents are kept by shard. Within a shard every term has a posting list, and a list of some length is cut into blocks
of similar documents: some of its members are centres, and each document joins the centre nearest to it in a small
random projection. A block is summarised by the largest impact of each term in any of its documents, exactly. A query
goes through its terms' lists, the most telling first; what a block could reach at most follows from its summary, and a
block is left out only if that is below the score that a document must have by then. All other documents are scored in
full. The best of each shard are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodspark.llm.common import byte_table, mix, stored, text_blocks, utf8, word_hashes

TERM_BYTES = byte_table(inside=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
ITEMS = "item_id long, terms binary"
POSTINGS = "doc_ids array<long>, sizes binary, ends binary, terms binary, counts binary"
COUNTED = "term int, n long"
FOUND = "place int, doc_id long, score long"
BLOCK, SKETCH, CELLS = 64, 16, 1 << 22


def item_terms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, terms): the distinct terms of each item as sorted 64-bit hashes; rows with equal keys and terms are one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for _, _, block, bounds in text_blocks(*utf8(batch.column(1))):
                words, _, _, counts = word_hashes(block, bounds, TERM_BYTES)
                terms += [np.unique(words[end - n:end]).tobytes() for n, end in zip(counts.tolist(), np.cumsum(counts).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary())], names=["item_id", "terms"])

    return items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(work, ITEMS).distinct()


def postings(docs: DataFrame, vocabulary: np.ndarray, shard_docs: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Term counts of all documents, one row per run of at most ``shard_docs``.

    ``sizes`` are the documents' term counts, repeats included; ``ends``, ``terms`` (places in the sorted ``vocabulary``)
    and ``counts`` hold, document after document, the terms that the vocabulary has. A null text has no terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for i, j, block, bounds in text_blocks(*utf8(batch.column(1))):
                words, _, _, counts = word_hashes(block, bounds, TERM_BYTES)
                place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                hit = known[place] == words if len(known) else np.zeros(len(words), bool)
                home = np.repeat(np.arange(j - i), counts)
                pair, times = np.unique(home[hit] * max(len(known), 1) + place[hit], return_counts=True)
                home, term = pair // max(len(known), 1), pair % max(len(known), 1)
                ends = np.searchsorted(home, np.arange(j - i), "right")
                for k in range(0, j - i, shard_docs):
                    stop = min(k + shard_docs, j - i)
                    first = ends[k - 1] if k else 0
                    blobs = (counts[k:stop].astype(np.int64), (ends[k:stop] - first).astype(np.int64),
                             term[first:ends[stop - 1]].astype(np.int32), times[first:ends[stop - 1]].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0).slice(i + k, stop - k).to_pylist()], pa.list_(pa.int64())),
                         *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["doc_ids", "sizes", "ends", "terms", "counts"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, POSTINGS)


def corpus_counts(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and for each vocabulary term the documents that hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, terms, holding = 0, 0, np.zeros(n_terms, np.int64)
        for batch in batches:
            for sizes, listed in zip(batch.column(0), batch.column(1)):
                sizes = np.frombuffer(sizes.as_py(), np.int64)
                documents, terms = documents + int((sizes > 0).sum()), terms + int(sizes.sum())
                holding += np.bincount(np.frombuffer(listed.as_py(), np.int32), minlength=n_terms)
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some]), pa.int32()), pa.array(np.concatenate([[documents, terms], holding[some]]), pa.int64())],
                                         names=["term", "n"])

    found = index.select("sizes", "terms").mapInArrow(work, COUNTED).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    holding = np.zeros(n_terms, np.int64)
    inside = found["term"] >= 0
    holding[found["term"][inside].to_numpy()] = found["n"][inside].to_numpy()
    total = lambda k: int(found["n"][found["term"] == k].sum())
    return total(-1), total(-2), holding


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * holding + 1))).astype(np.int64)


def sketches(terms: np.ndarray, impacts: np.ndarray, ends: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """A random projection of each document's impacts, of length 1."""
    codes = mix(np.arange(1, int(terms.max(initial=0)) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    signs = ((codes[:, None] >> np.arange(size, dtype=np.uint64)) & np.uint64(1)).astype(np.float32) * 2 - 1
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros((len(ends), size), np.float32)
    some = ends > starts
    if some.any():
        out[some] = np.add.reduceat(signs[terms] * impacts[:, None].astype(np.float32), starts[some])
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def entries(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of some documents, and which of them each belongs to."""
    many = ends - starts
    home = np.repeat(np.arange(len(many)), many)
    return np.arange(many.sum()) + np.repeat(starts - np.cumsum(many) + many, many), home


class Blocks:
    """A posting list in blocks of similar documents, with coordinatewise largest impacts."""

    def __init__(self, docs: np.ndarray, shard: Shard, block: int):
        centres = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // block)).astype(np.int64)]
        of = (shard.sketch[docs] @ shard.sketch[centres].T).argmax(1)
        order = np.argsort(of, kind="stable")
        self.docs, of = docs[order], of[order]
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        self.starts, self.ends = first, np.append(first[1:], len(docs))
        n, parts, step = len(first), [], max(1, CELLS // shard.n_terms)
        for i in range(0, n, step):
            j = min(i + step, n)
            mine = self.docs[self.starts[i]:self.ends[j - 1]]
            at, home = entries(shard.starts[mine], shard.ends[mine])
            mark = np.repeat(np.arange(j - i), self.ends[i:j] - self.starts[i:j])[home]
            top = np.zeros(shard.n_terms * (j - i), np.int32)
            np.maximum.at(top, shard.terms[at] * np.int64(j - i) + mark, shard.impacts[at].astype(np.int32))
            cell = np.flatnonzero(top)
            parts.append((cell // (j - i), cell % (j - i) + i, top[cell]))
        term, self.block, self.top = (np.concatenate(x) for x in zip(*parts))
        if len(parts) > 1:
            order = np.argsort(term, kind="stable")
            term, self.block, self.top = term[order], self.block[order], self.top[order]
        self.block = self.block.astype(np.int32)
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        self.terms, self.from_, self.to = term[first], first, np.append(first[1:], len(term))

    def reach(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The most that any document of each block can score by these terms."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        place, home = entries(self.from_[at[here]], self.to[at[here]])
        out = np.zeros(len(self.starts), np.int64)
        np.add.at(out, self.block[place], weight[terms[here]][home] * self.top[place].astype(np.int64))
        return out

    def members(self, chosen: np.ndarray) -> np.ndarray:
        return self.docs[entries(self.starts[chosen], self.ends[chosen])[0]]


class Shard:
    """Documents with their impacts, the posting lists of their terms, and the blocks of the longer lists."""

    def __init__(self, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, length: int, n_terms: int, block: int = BLOCK):
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1]])
        self.terms, self.n_terms, self.block = terms.astype(np.int64), max(n_terms, 1), block
        home = np.repeat(np.arange(len(ends)), self.ends - self.starts)
        norm = 10 + (90 * sizes.astype(np.int64) * documents) // max(length, 1)
        times = counts.astype(np.int64)
        self.impacts = (1_000_000_000 * times) // (1000 * times + 8 * norm[home])
        self.sketch = sketches(self.terms, self.impacts, self.ends)
        order = np.argsort(self.terms, kind="stable")
        self.listed = home[order]
        self.list_ends = np.searchsorted(self.terms[order], np.arange(n_terms), "right")
        self.list_starts = np.concatenate([[0], self.list_ends[:-1]]) if n_terms else self.list_ends
        self.most = np.zeros(self.n_terms, np.int64)
        np.maximum.at(self.most, self.terms, self.impacts)
        self.blocks = {int(t): Blocks(self.list_of(t), self, block) for t in np.flatnonzero(self.list_ends - self.list_starts > block)}
        self.seen, self.stamp = np.zeros(len(ends), np.int64), 0
        self.scored = self.skipped = 0

    def list_of(self, term: int) -> np.ndarray:
        return self.listed[self.list_starts[term]:self.list_ends[term]]

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at, home = entries(self.starts[docs], self.ends[docs])
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, home, weight[self.terms[at]] * self.impacts[at])
        return out

    def search(self, terms: np.ndarray, weight: np.ndarray, enough: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Documents with their scores, list after list, among them all that score ``enough`` or more and could be of
        the ``k`` best. ``weight`` holds the weights of ``terms`` at their places and 0 elsewhere."""
        self.stamp += 1
        ceiling = weight[terms] * self.most[terms]
        order = np.argsort(-ceiling, kind="stable")
        terms, left = terms[order], np.cumsum(ceiling[order][::-1])[::-1]
        best = np.zeros(0, np.int64)
        for i, term in enumerate(terms.tolist()):
            if left[i] < enough:
                return
            blocks = self.blocks.get(term)
            if blocks is None:
                docs = self.list_of(term)
            else:
                # A document of this list that also holds an earlier term was scored there or cannot be among the best.
                chosen = np.flatnonzero(blocks.reach(terms[i:], weight) >= enough)
                self.skipped += len(blocks.starts) - len(chosen)
                docs = blocks.members(chosen)
            docs = docs[self.seen[docs] != self.stamp]
            if not len(docs):
                continue
            self.seen[docs] = self.stamp
            scores = self.scores(docs, weight)
            self.scored += len(docs)
            keep = scores >= enough
            if keep.any():
                yield docs[keep], scores[keep]
                best = np.sort(np.concatenate([best, scores[keep]]))[-k:]
                if len(best) == k:
                    enough = max(enough, int(best[0]))


class Best:
    """The ``k`` highest-scoring documents so far; equal scores by ascending key, null keys last."""

    def __init__(self, k: int):
        self.k, self.scores, self.nulls, self.ids = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        scores, nulls, ids = (np.concatenate(x) for x in ((self.scores, scores), (self.nulls, nulls), (self.ids, ids)))
        order = np.lexsort((ids, nulls, -scores))[:self.k]
        self.scores, self.nulls, self.ids = scores[order], nulls[order], ids[order]

    def enough(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1


def _shards(batches: Iterator[pa.RecordBatch], docs: int) -> Iterator[tuple]:
    """Rows of ``postings`` put together to about ``docs`` documents: keys, null keys, sizes, ends, terms, counts."""
    held, n = [], 0

    def joined() -> tuple:
        keys, *rest = zip(*held)
        keys = pa.concat_arrays(keys)
        sizes, ends, terms, counts = (list(x) for x in rest)
        shift = np.cumsum([0] + [len(t) for t in terms[:-1]])
        return (keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), np.concatenate(sizes),
                np.concatenate([e + s for e, s in zip(ends, shift)]), np.concatenate(terms), np.concatenate(counts))

    for batch in batches:
        for k in range(batch.num_rows):
            blobs = [np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in ((1, np.int64), (2, np.int64), (3, np.int32), (4, np.int32))]
            if n and n + len(blobs[0]) > docs:
                yield joined()
                held, n = [], 0
            held.append((batch.column(0)[k].values, *blobs))
            n += len(blobs[0])
    if held:
        yield joined()


def search(index: DataFrame, asked: list[np.ndarray], documents: int, length: int, weight: np.ndarray, k: int = 10, shard_docs: int = 8192, block: int = BLOCK) -> DataFrame:
    """(place, doc_id, score): the best ``k`` documents of each task for each of ``asked`` (places of terms)."""
    shared = index.sparkSession.sparkContext.broadcast((asked, weight))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, all_weights = shared.value
        best, mine = [Best(k) for _ in items], np.zeros(max(len(all_weights), 1), np.int64)
        for keys, nulls, *columns in _shards(batches, shard_docs):
            shard = Shard(*columns, documents, length, len(all_weights), block)
            for found, terms in zip(best, items):
                mine[terms] = all_weights[terms]
                for docs, scores in shard.search(terms, mine, found.enough(), k):
                    found.add(scores, nulls[docs], keys[docs])
                mine[terms] = 0
        place = np.repeat(np.arange(len(items)), [len(b.scores) for b in best])
        whole = lambda name, kind: np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place, pa.int32()), pa.array(whole("ids", np.int64), pa.int64(), mask=whole("nulls", bool)), pa.array(whole("scores", np.int64), pa.int64())],
            names=["place", "doc_id", "score"])

    return index.mapInArrow(work, FOUND)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, most_terms: int = 200_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``k`` documents with the highest score above 0.

    Scores are integers: a term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact 10**9 tf div (1000 tf +
    8 m) with m = 10 + 90 n N div L; every distinct term of an item counts once. Equal scores are ranked by ascending
    doc_id. Items are asked in blocks of about ``most_terms`` terms, so that neither driver nor task holds more; the
    index of a block covers its terms, the corpus counts cover all documents.

    A null or empty text has no terms; an item without terms, or whose terms no document has, gives no rows. Repeated
    document rows are documents of their own; a null doc_id comes last among equal scores. Items that repeat key and
    terms are one; items that share only the key are ranked one by one under it; a null item_id is a key like others.
    Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = stored(item_terms(items).filter(F.length("terms") > 0), "items")
    size = wanted.agg(F.sum(F.length("terms") / 8)).first()[0] or 0
    n_blocks = max(1, -(-int(size) // most_terms))
    parts = []
    for b in range(n_blocks):
        rows = [(r["item_id"], np.frombuffer(bytes(r["terms"]), np.uint64))
                for r in wanted.filter(F.pmod(F.xxhash64("terms", "item_id"), F.lit(n_blocks)) == b).toLocalIterator()]
        if not rows:
            continue
        vocabulary = np.unique(np.concatenate([t for _, t in rows]))
        index = stored(postings(docs, vocabulary), "postings")
        documents, length, holding = corpus_counts(index, len(vocabulary))
        asked = [np.searchsorted(vocabulary, t) for _, t in rows]
        found = search(index, asked, documents, length, weights(documents, holding), k)
        names = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(rows)], "place int, item_id long")
        first = Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
        parts.append(best.join(names, "place").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
