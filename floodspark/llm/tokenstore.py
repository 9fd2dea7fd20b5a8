"""Token ids in shards with a minimal perfect hash index.

A store is a table of shards in ascending key order. A shard holds raw little-endian ids of its documents, where each
document begins, and an index over its keys: a minimal perfect hash (hash and displace) gives each key its own slot,
the slot holds a 32-bit fingerprint and the document's place. A lookup hashes the key, compares one fingerprint and
slices the payload; its time does not depend on the number of keys.
"""

from __future__ import annotations

import os
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import kept, mix, scratch

STORE = ("part long, chunk long, part_start long, n_docs long, n_ids long, n_null long, first_key long, last_key long, width int, "
         "keys binary, bounds binary, displacements binary, slots binary, fingerprints binary, payload binary")
READ = "doc_id long, start long, n_tokens long, ids binary"
RARE = re.compile(r"[^\S \n]|\x00")
BOUNDARY = re.compile(r"(?<=\S)(?= \S)")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class TextEncoder:
    """Ids of texts by the tokenizers library, unit by unit; remembers units up to ``limit`` bytes of text and ids.

    A unit begins at a space or line end between two other characters: the byte-level pre-tokenizer never joins what
    stands before such a place with what follows, so the units' ids in turn are the text's ids. Texts with any other
    white space, or with several white spaces in a row, are cut at single spaces only. Once the memory is full, what is
    remembered stays, and new units serve the texts at hand only.
    """

    def __init__(self, tokenizer_file: str, limit: int = 160_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.held = Tokenizer.from_file(tokenizer_file), limit, 0
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes that each id stands for: a byte-level token has one character per byte.
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        #: Units without the space before them; a zero byte stands for a line end instead of the space.
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {"": b""}

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Units as they are, then units after a space or line end."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n") or text[:1] in (" ", "\n") or RARE.search(text):
            return BOUNDARY.split(text), []
        first, *rest = text.replace("\n", " \0").split(" ")
        return [first], rest

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        found = [(list(map(self.plain.get, plain)), list(map(self.spaced.get, spaced))) for plain, spaced in cut]
        gaps = [k for k, (a, b) in enumerate(found) if None in a or None in b]
        if gaps:
            plain = list({u for k in gaps for u, f in zip(cut[k][0], found[k][0]) if f is None})
            spaced = list({u for k in gaps for u, f in zip(cut[k][1], found[k][1]) if f is None})
            plain = dict(zip(plain, self._encoded(plain)))
            spaced = dict(zip(spaced, self._in_a_row(["\n" + u[1:] if u[0] == "\0" else " " + u for u in spaced])))
            for k in gaps:
                found[k] = tuple([new[u] if f is None else f for u, f in zip(units, have)] for new, units, have in zip((plain, spaced), cut[k], found[k]))
            for kept_, new in ((self.plain, plain), (self.spaced, spaced)):
                size = sum(len(u) + len(i) + 200 for u, i in new.items())
                if self.held + size <= self.limit:
                    kept_.update(new)
                    self.held += size
        return [b"".join(chain(a, b)) for a, b in found]

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 10_000):
            yield from (self._bytes(found.ids) for found in self.tokenizer.encode_batch_fast(texts[k:k + 10_000], add_special_tokens=False))

    def _in_a_row(self, texts: list[str], step: int = 4000) -> Iterator[bytes]:
        """Ids of units that begin with a space or line end: many are encoded as one text, and cut where their bytes end."""
        for k in range(0, len(texts), step):
            some = texts[k:k + step]
            whole = "".join(some)
            ids = self.tokenizer.encode(whole, add_special_tokens=False).ids
            ends = np.cumsum([len(t) for t in some] if whole.isascii() else [len(t.encode()) for t in some])
            done = np.cumsum(self.sizes[ids])
            cuts = np.minimum(np.searchsorted(done, ends), max(len(ids) - 1, 0))
            if not len(ids) or (done[cuts] != ends).any():  # an id that stands for other bytes than its own
                yield from self._encoded(some)
                continue
            blob, at = self._bytes(ids), ((cuts + 1) * self.width).tolist()
            yield from (blob[a:b] for a, b in zip([0, *at], at))


def _hashed(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + GOLDEN)


def _slots_of(hashes: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    """The slot of each hash: straight from the table where a bucket has one key, else by its displacement."""
    d = displacements[hashes % np.uint64(len(displacements))]
    moved = mix(hashes ^ (d.astype(np.uint64) * GOLDEN)) % np.uint64(n)
    return np.where(d < 0, -d - 1, moved.astype(np.int64))


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements, and the slot of each of the distinct keys: a bijection onto 0 .. n - 1.

    Buckets of two keys on average are placed from the largest down; a displacement is tried until its keys fall on
    free slots of their own, and single keys take what is left.
    """
    n = len(keys)
    hashes = _hashed(keys)
    table = np.zeros(max(1, n // 2), np.int64)
    bucket = (hashes % np.uint64(len(table))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(len(table) + 1))
    sizes = np.diff(starts)
    taken = np.zeros(n, bool)
    tries = np.arange(64, dtype=np.uint64)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[:np.searchsorted(-sizes[by_size], -1)]:
        mine = hashes[order[starts[b]:starts[b + 1]]]
        base = np.uint64(0)
        while True:
            place = (mix(mine[:, None] ^ ((base + tries) * GOLDEN)) % np.uint64(n)).astype(np.int64)
            free = ~taken[place].any(0)
            if len(mine) == 2:
                free &= place[0] != place[1]
            elif free.any():
                ordered = np.sort(place, 0)
                free &= (ordered[1:] != ordered[:-1]).all(0)
            if free.any():
                k = int(np.argmax(free))
                table[b] = int(base) + k
                taken[place[:, k]] = True
                break
            base += np.uint64(64)
    single = np.flatnonzero(sizes == 1)
    table[single] = -np.flatnonzero(~taken)[:len(single)] - 1
    return table, _slots_of(hashes, table, n)


def write_store(docs: DataFrame, tokenizer_file: str, path: str | None = None, end_id: int = 0, shard_ids: int = 1 << 22) -> DataFrame:
    """Encode the documents and write their shards in ascending key order; returns the store.

    Each document's ids end with ``end_id``. A shard is closed once it holds ``shard_ids``. Null text is empty: the
    end id alone. Null keys come first and are no part of the index; rows that repeat a key lie side by side and are
    found together. Other columns are never read. The file named must be there on every executor.
    """
    path = path or scratch(docs.sparkSession, "store")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("tokenizer", tokenizer_file), None, lambda: TextEncoder(tokenizer_file))
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        part, chunk, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ids: list[bytes] = []
        held = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                encoded = [e + end for e in encoder.encode([t or "" for t in some.column(1).to_pylist()])]
                keys += some.column(0).to_pylist()
                ids += encoded
                held += sum(map(len, encoded)) // encoder.width
                if held >= shard_ids:
                    yield _shard(part, chunk, start, encoder.width, keys, ids)
                    start, chunk, keys, ids, held = start + held, chunk + 1, [], [], 0
        if keys:
            yield _shard(part, chunk, start, encoder.width, keys, ids)

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(work, STORE).write.option("compression", "zstd").parquet(path))
    return docs.sparkSession.read.schema(STORE).parquet(path)


def _shard(part: int, chunk: int, start: int, width: int, keys: list, ids: list[bytes]) -> pa.RecordBatch:
    n_null = sum(k is None for k in keys)
    known = np.array(keys[n_null:], np.int64)
    distinct, first, copies = np.unique(known, return_index=True, return_counts=True)
    bounds = np.concatenate([[0], np.cumsum([len(i) // width for i in ids])]).astype("<i8")
    table, place = perfect_hash(distinct) if len(distinct) else (np.zeros(1, np.int64), np.zeros(0, np.int64))
    slots, marks = np.zeros((len(distinct), 2), "<i4"), np.zeros(len(distinct), "<u4")
    slots[place, 0], slots[place, 1] = first + n_null, copies
    marks[place] = _fingerprints(distinct)
    blobs = [known.astype("<i8"), bounds, table.astype("<i4"), slots, marks]
    numbers = [part, chunk, start, len(keys), int(bounds[-1]), n_null, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None]
    return pa.RecordBatch.from_arrays(
        [*(pa.array([v], pa.int64()) for v in numbers), pa.array([width], pa.int32()),
         *(pa.array([b.tobytes()], pa.binary()) for b in blobs), pa.array([b"".join(ids)], pa.binary())],
        names=[c.split()[0] for c in STORE.split(", ")])


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(_hashed(keys) + GOLDEN) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """One shard, opened."""

    def __init__(self, row: dict):
        self.row = row
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.table = np.frombuffer(row["displacements"], "<i4").astype(np.int64)
        self.slots = np.frombuffer(row["slots"], "<i4").reshape(-1, 2)
        self.marks = np.frombuffer(row["fingerprints"], "<u4")
        self.ids = np.frombuffer(row["payload"], f"<u{row['width']}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; none where the fingerprint differs.

        A key that is not there passes for one that is with a chance of 2**-32.
        """
        if not len(self.marks):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = _slots_of(_hashed(keys), self.table, len(self.marks))
        there = self.marks[slot] == _fingerprints(keys)
        return self.slots[slot, 0].astype(np.int64), np.where(there, self.slots[slot, 1], 0)

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.bounds[k]:self.bounds[k + 1]].astype("<u4")


def _part_starts(store: DataFrame) -> tuple[dict[int, int], list[tuple[int, int | None, int | None]]]:
    """Where each written partition begins in the whole, and its key range; one row per partition of the write."""
    parts = store.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min("first_key").alias("low"), F.max("last_key").alias("high")).orderBy("part").collect()
    starts, at = {}, 0
    for p in parts:
        starts[p["part"]] = at
        at += p["n"]
    return starts, [(p["part"], p["low"], p["high"]) for p in parts]


def _documents(shard: Shard, start: int, keys: np.ndarray) -> Iterator[tuple]:
    first, copies = shard.find(keys)
    for key, k, n in zip(keys.tolist(), first.tolist(), copies.tolist()):
        for j in range(k, k + n):
            ids = shard.document(j)
            yield key, start + int(shard.bounds[j]), len(ids), ids.tobytes()


def read_store(store: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, each found by its key; null keys by their place."""
    starts, _ = _part_starts(store)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                shard, start = Shard(row), starts[row["part"]] + row["part_start"]
                nulls = [(None, start + int(shard.bounds[j]), len(ids := shard.document(j)), ids.tobytes()) for j in range(row["n_null"])]
                keys = np.unique(np.frombuffer(row["keys"], "<i8"))
                yield _rows(nulls)
                for a in range(0, len(keys), 2000):
                    yield _rows(list(_documents(shard, start, keys[a:a + 2000])))

    return store.mapInArrow(work, READ)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found) if found else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def lookup(store: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the wanted keys; keys that are not stored give no row.

    A key goes to the partitions whose range holds it, and is found there by the index, without a search.
    """
    starts, ranges = _part_starts(store)
    ranges = [r for r in ranges if r[1] is not None]
    lows, highs = [r[1] for r in ranges], [r[2] for r in ranges]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(ranges[p][0], k) for k in batch.column(0).to_pylist() for p in range(bisect_left(highs, k), bisect_right(lows, k))]
            part, wanted = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(wanted, pa.int64())], names=["part", "key"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                yield _rows(list(_documents(Shard(row), starts[row["part"]] + row["part_start"], np.array(row["wanted"], np.int64))))

    wanted = keys.select(F.col(key).cast("long").alias("key")).filter("key IS NOT NULL").distinct().mapInArrow(route, "part long, key long")
    return store.join(wanted.groupBy("part").agg(F.collect_list("key").alias("wanted")), "part").mapInArrow(work, READ)


def with_checksums(found: DataFrame) -> DataFrame:
    """The unsigned crc32 of the ids as little-endian unsigned 32-bit integers instead of the ids."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
