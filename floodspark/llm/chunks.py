"""Substring deduplication by content-defined chunks.

A gear rolling hash covers the last 32 bytes. A chunk ends where the hash is greater than at all 32 places before and
at none of the 32 after it less: the rule looks at nothing but nearby bytes, so after an insertion the cuts fall in
step again within a chunk. Chunks with equal digests are copies; the first keeps its place, later ones go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import mix, stored, text_blocks, utf8
from floodspark.llm.spans import row_key, without_ranges

GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)
REACH, LONGEST = 32, 1024
CHUNKS = "doc_id long, doc_row long, place int, at long, size int, high long, low long, again boolean"


def gear_hashes(gears: np.ndarray) -> np.ndarray:
    """The rolling hash at each place: the gears of the last 32 bytes, each shifted by its distance."""
    out = gears.copy()
    for k in (1, 2, 4, 8, 16):
        out[k:] += out[:-k].copy() << np.uint32(k)
    return out


def chunk_ends(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Where the chunks of each text end, from its own start; a text without bytes has none.

    No chunk ends inside a character, nor is any longer than ``LONGEST`` bytes by more than one character.
    """
    n = len(at) - 1
    room = 2 * REACH
    lead = at[:-1] + room * np.arange(1, n + 1)
    size = np.diff(at)
    where = np.arange(len(data)) + np.repeat(lead - at[:-1], size)
    gears = np.zeros(int(at[-1]) + room * (n + 1), np.uint32)
    gears[where] = GEAR[data]
    hashes = np.zeros(len(gears), np.uint32)
    inside = np.ones(len(data), bool)
    inside[:-1] = (data[1:] & 0xC0) != 0x80
    allowed = where[inside]
    hashes[allowed] = gear_hashes(gears)[allowed]
    most = hashes.copy()
    for k in (1, 2, 4, 8, 16):
        most[:-k] = np.maximum(most[:-k], most[k:].copy())
    cut = np.zeros(len(hashes), bool)
    cut[REACH:-REACH - 1] = (hashes[REACH:-REACH - 1] > most[:-2 * REACH - 1]) & (hashes[REACH:-REACH - 1] >= most[REACH + 1:-REACH])
    found = np.flatnonzero(cut)
    first, last = np.searchsorted(found, lead), np.searchsorted(found, lead + size)
    for k in range(n):
        if size[k]:
            ends = found[first[k]:last[k]] - lead[k] + 1
            if not len(ends) or ends[-1] != size[k]:
                ends = np.append(ends, size[k])
            yield _split_long(ends, data[at[k]:at[k + 1]])
        else:
            yield np.zeros(0, np.int64)


def _split_long(ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    sizes = np.diff(ends, prepend=0)
    if sizes.max() <= LONGEST:
        return ends
    more = [np.arange(e - s + LONGEST, e, LONGEST) for e, s in zip(ends[sizes > LONGEST], sizes[sizes > LONGEST])]
    cuts = np.concatenate(more)
    for _ in range(3):
        cuts = np.where((text[np.minimum(cuts, len(text) - 1)] & 0xC0) == 0x80, np.minimum(cuts + 1, len(text)), cuts)
    return np.union1d(ends, cuts)


def with_chunks(docs: DataFrame) -> DataFrame:
    """The chunks of every document: place in it, first byte, size, digest, and whether it held the same one before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            for i, j, block, bounds in text_blocks(data, at):
                counts, starts, sizes, digests, again = [], [], [], [], []
                raw = block.tobytes()
                for k, ends in enumerate(chunk_ends(block, bounds)):
                    size = np.diff(ends, prepend=0)
                    start = ends - size
                    base, seen = int(bounds[k]), set()
                    for a, b in zip((start + base).tolist(), (ends + base).tolist()):
                        digest = hashlib.blake2b(raw[a:b], digest_size=16).digest()
                        digests.append(digest)
                        again.append(digest in seen)
                        seen.add(digest)
                    counts.append(len(ends))
                    starts.append(start)
                    sizes.append(size)
                rows = np.repeat(np.arange(i, j), counts)
                pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                picked = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(picked), batch.column(1).take(picked), pa.array(place, pa.int32()),
                     pa.array(np.concatenate(starts), pa.int64()), pa.array(np.concatenate(sizes), pa.int32()),
                     pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(again, pa.bool_())],
                    names=["doc_id", "doc_row", "place", "at", "size", "high", "low", "again"])

    return docs.select("doc_id", "doc_row", "text").mapInArrow(work, CHUNKS)


def deduplicated(docs: DataFrame, least_bytes: int = 64) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_chunks, n_repeated, n_removed, n_spans, kept (the bytes that stay).

    A chunk is repeated if its digest occurs elsewhere, in the same document or another, and it stands in a run of such
    chunks of ``least_bytes`` or more: shorter ones are common phrases, not passages. All but the first of its
    occurrences, by doc_id and place, are removed. Null or empty text: no chunks. A null doc_id comes after all others;
    different rows of one doc_id, or of none, follow one another by the hash of their text.
    Rows that repeat a doc_id with its text count as one document and get the same result; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc_row", row_key())
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "doc_row")
    chunks = stored(with_chunks(docs), "chunks")
    each = chunks.groupBy("high", "low").agg(F.min(order)["doc_row"].alias("first_row"), F.max("again").alias("within"),
                                             F.min("doc_row").alias("low_row"), F.max("doc_row").alias("high_row"))
    repeated = stored(each.filter("within OR low_row < high_row").select("high", "low", "first_row"), "repeated")
    hit = chunks.join(repeated, ["high", "low"]).select(
        "doc_row", "at", (F.col("at") + F.col("size")).alias("end"), ((F.col("doc_row") == F.col("first_row")) & ~F.col("again")).alias("first")).distinct()
    listed = hit.groupBy("doc_row").agg(F.array_sort(F.collect_list(F.struct("at", "end", "first"))).alias("hits"))
    counted = chunks.groupBy("doc_row").agg((F.max("place") + 1).cast("long").alias("n_chunks"))
    cuts = listed.mapInArrow(lambda batches: _cuts(batches, least_bytes), "doc_row long, n_repeated long, cut array<struct<start:long,end:long>>")
    facts = stored(counted.join(cuts, "doc_row", "left"), "cuts")
    return without_ranges(docs, facts, "n_chunks", "n_repeated")


def _cuts(batches: Iterator[pa.RecordBatch], least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Chunks in long enough runs of repeated ones, and which of them go."""
    for batch in batches:
        counts, cuts = [], []
        for hits in batch.column(1).to_pylist():
            n, cut, run = 0, [], []
            for h in [*hits, {"at": -1, "end": -1, "first": True}]:
                if run and run[-1]["end"] != h["at"]:
                    if run[-1]["end"] - run[0]["at"] >= least_bytes:
                        n += len(run)
                        cut += [{"start": r["at"], "end": r["end"]} for r in run if not r["first"]]
                    run = []
                run.append(h)
            counts.append(n)
            cuts.append(cut)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(cuts, kind)], names=["doc_row", "n_repeated", "cut"])
