"""Benchmark decontamination over a positional inverted index.

The index is split by document: each row of it holds some documents, their sorted terms and, for each term, the
positions of its tokens. A phrase is found inside a row by taking the postings of its rarest term, moving them back
by the term's place in the phrase, and keeping what the moved postings of the next rarest terms also hold. Nothing is
shuffled: a row answers for its own documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import byte_table, stored, text_blocks, utf8, word_hashes

WORD_BYTES = byte_table(inside=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
INDEX = "name string, doc_ids array<long>, n_words binary, terms binary, counts binary, steps binary"
FOUND = "doc_id long, n_words long, n_hit long, items array<long>, starts array<long>, lengths array<long>"
WINDOW = 10


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id", row_bytes: int = 1 << 23) -> DataFrame:
    """Token postings of all documents, one row per run of documents of about ``row_bytes``.

    Terms are 64-bit hashes of words; positions are kept as steps from one posting to the next. A null text has no
    words; a null or repeated key is kept as it is. Words are ``WORD_BYTES`` after A-Z became a-z. ``name`` differs between
    all rows, also of several indexes: this index, the partition and the place in it.
    """
    made = uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for i, j, block, bounds in text_blocks(*utf8(batch.column(1)), size=row_bytes):
                words, _, _, counts = word_hashes(block, bounds, WORD_BYTES)
                order = np.argsort(words, kind="stable")
                ordered = words[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(words) else order
                each = np.diff(np.append(first, len(words)))
                steps = np.diff(order, prepend=0)
                blobs = [counts.astype("<i8"), ordered[first].astype("<u8"), each.astype("<i4"), steps.astype("<i4")]
                n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{made}:{here}:{n}"], pa.string()), pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                     *(pa.array([b.tobytes()], pa.binary()) for b in blobs)],
                    names=["name", "doc_ids", "n_words", "terms", "counts", "steps"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, INDEX)


def phrase_windows(items: DataFrame, text: str = "text", key: str = "item_id", width: int = WINDOW) -> DataFrame:
    """(item, terms): every run of ``width`` words of an item; an item of fewer, but not none, is one phrase."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, block, bounds in text_blocks(*utf8(batch.column(1))):
                words, _, _, counts = word_hashes(block, bounds, WORD_BYTES)
                at = np.concatenate([[0], np.cumsum(counts)])
                rows = [(keys[i + k], words[a:a + min(width, at[k + 1] - at[k])].tobytes())
                        for k in range(j - i) for a in range(at[k], at[k] + max(at[k + 1] - at[k] - width + 1, min(at[k + 1] - at[k], 1)))]
                item, terms = zip(*rows) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(terms, pa.binary())], names=["item", "terms"])

    return (items.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text"))
            .filter("item IS NOT NULL").mapInArrow(work, "item long, terms binary"))


class IndexRow:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.n_words = np.frombuffer(row["n_words"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<u8")
        counts = np.frombuffer(row["counts"], "<i4").astype(np.int64)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.positions = np.cumsum(np.frombuffer(row["steps"], "<i4"), dtype=np.int64)
        self.doc_starts = np.concatenate([[0], np.cumsum(self.n_words)])

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term here, -1 where no document has it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, place: int) -> np.ndarray:
        return self.positions[self.starts[place]:self.ends[place]]

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, positions, "right") - 1

    def phrase(self, places: np.ndarray) -> np.ndarray:
        """Where the phrase of these terms starts: offset-adjusted lists from the rarest term on."""
        counts = self.ends[places] - self.starts[places]
        order = np.argsort(counts, kind="stable")
        found = self.postings(places[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            listed = self.postings(places[k])
            at = np.searchsorted(listed, found + k)
            found = found[listed[np.minimum(at, len(listed) - 1)] == found + k]
        found = found[found >= 0]
        return found[self.documents(found) == self.documents(found + len(places) - 1)]

    def near(self, places: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``span`` tokens away in the same document."""
        counts = self.ends[places] - self.starts[places]
        order = np.argsort(counts, kind="stable")
        found = self.postings(places[order[0]])
        for k in order[1:]:
            home = self.documents(found)
            low = np.maximum(found - span, self.doc_starts[home])
            high = np.minimum(found + span, self.doc_starts[home + 1] - 1)
            listed = self.postings(places[k])
            found = found[np.searchsorted(listed, low) < np.searchsorted(listed, high, "right")]
        return found


def _phrase_blocks(phrases: DataFrame, block: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The phrases in runs of about ``block``, so that neither driver nor task ever holds more."""
    phrases = stored(phrases, "phrases")
    n = max(1, -(-phrases.count() // block))
    for k in range(n):
        part = phrases.filter(F.pmod(F.xxhash64("terms"), F.lit(n)) == k).groupBy("terms").agg(F.collect_set("item").alias("items"))
        yield [(sorted(r["items"]), np.frombuffer(bytes(r["terms"]), np.uint64)) for r in part.toLocalIterator()]


def search(index: DataFrame, phrases: DataFrame, span: int | None = None, block: int = 200_000) -> DataFrame:
    """One row per indexed document with what it holds of the phrases.

    ``items``, ``starts`` and ``lengths`` list the matches: item, first word and length in words; ``n_hit`` counts the
    words inside matches. With ``span`` a match is a place of the phrase's rarest term that has all others within so
    many words, listed with length 1. Phrases are searched in blocks; results of several blocks are joined by document,
    for which the index should be stored: it is read once a block.
    """
    parts = []
    for wanted in _phrase_blocks(phrases, block):
        shared = index.sparkSession.sparkContext.broadcast(_tabled(wanted))
        parts.append(index.mapInArrow(_searcher(shared, span), f"doc_row string, {FOUND}"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    if len(parts) == 1:
        return rows.drop("doc_row")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[[0]].copy()
        items, starts, lengths = (np.concatenate(list(group[c])).astype(np.int64) for c in ("items", "starts", "lengths"))
        one["items"], one["starts"], one["lengths"] = [items], [starts], [lengths]
        one["n_hit"] = int(_covered(int(one["n_words"].iloc[0]), starts, lengths).sum())
        return one

    return rows.groupBy("doc_row").applyInPandas(merge, f"doc_row string, {FOUND}").drop("doc_row")


def _tabled(wanted: list[tuple[list[int], np.ndarray]]) -> tuple:
    terms = np.unique(np.concatenate([t for _, t in wanted])) if wanted else np.zeros(0, np.uint64)
    width = max((len(t) for _, t in wanted), default=0)
    places = np.full((len(wanted), width), -1, np.int64)
    for k, (_, t) in enumerate(wanted):
        places[k, :len(t)] = np.searchsorted(terms, t)
    return terms, places, [i for i, _ in wanted]


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change)[:n] > 0


def _searcher(shared, span: int | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, places, items = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = IndexRow(batch.slice(k, 1).to_pylist()[0])
                here = np.append(row.find(terms), -1)
                all_here = ((here[places] >= 0) | (places < 0)).all(1) if len(places) else np.zeros(0, bool)
                hits = []
                for q in np.flatnonzero(all_here):
                    phrase = here[places[q][places[q] >= 0]]
                    found = row.phrase(phrase) if span is None else row.near(phrase, span)
                    if len(found):
                        size = len(phrase) if span is None else 1
                        for item in items[q]:
                            hits.append((np.full(len(found), item), found, np.full(len(found), size)))
                yield _found_rows(row, hits, batch.column("name")[k].as_py())

    return work


def _found_rows(row: IndexRow, hits: list, name: str) -> pa.RecordBatch:
    n = len(row.doc_ids)
    item, start, size = (np.concatenate(x).astype(np.int64) for x in zip(*hits)) if hits else (np.zeros(0, np.int64),) * 3
    home = row.documents(start)
    order = np.lexsort((item, start, home))
    item, start, size, home = item[order], start[order], size[order], home[order]
    hit = _covered(int(row.doc_starts[-1]), start, size)
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[row.doc_starts])
    bounds = pa.array(np.searchsorted(home, np.arange(n + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (item, start - row.doc_starts[home], size)]
    ids = pa.array([f"{name}:{k}" for k in range(n)], pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(row.doc_ids, pa.int64()), pa.array(row.n_words, pa.int64()),
                                       pa.array(n_hit, pa.int64()), *lists],
                                      names=["doc_row", "doc_id", "n_words", "n_hit", "items", "starts", "lengths"])


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window of ``width`` item words),
    items (those with occurring windows), starts and lengths of the matches.

    Null or empty text has no words and no hits; an item without words or with a null key asks for nothing; an empty
    benchmark hits nothing; repeated rows each get their own result; other columns are ignored.
    """
    index = stored(build_index(docs), "postings")
    return search(index, phrase_windows(items, width=width))
