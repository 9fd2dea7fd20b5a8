"""Exact removal of long repeated substrings: threshold-bounded interval expansion on Burrows-Wheeler transforms.

Any 400-byte string holds an anchor, the place of the least hash among its 64-byte strings, at a distance that its
bytes alone decide. So all occurrences of a repeated string lie around equal anchors, and the strings around one
anchor are compared apart from all others. The distinct surroundings of an anchor (its contexts, each with its number
of occurrences) go to one task; there a Burrows-Wheeler transform is built over the contexts of many anchors, and
backward extension, breadth first, derives the common prefixes of neighbouring suffixes by increasing value. It stops
at the minimum length: what has no value by then is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import BYTE_CODES, mix, runs, shuffles_freed, stored, text_blocks, utf8
from floodspark.llm.spans import row_key, without_ranges

LENGTH, GRAM = 400, 64
HAND = np.uint64(0x9FB21C651E98DF25)
PLACES = "doc_row long, anchor long, at long, first int, last int, name long"
CONTEXTS = "anchor long, name long, first int, last int, copies long, crowded boolean, text binary"
FOUND = "anchor long, name long, marks array<struct<first:int,last:int>>"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place (a power of two) by doubling; short at the end."""
    out, k, power = BYTE_CODES[data], 1, np.array([HAND])
    while k < gram:
        longer = out[:max(len(out) - k, 0)] * power + out[k:]
        out, k, power = longer, 2 * k, power * power
    return mix(out)


def windows(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with the same anchor in one text: first and last start, the anchor's place and hash.

    The anchor of a window is its gram of least hash, the leftmost of equal ones.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, gram)
    if len(hashes) >= 1 << 24:
        cut = 1 << 23
        parts = []
        for a in range(0, len(data) - length + 1, cut):
            first, last, at, mark = windows(data[a:a + cut + length - 1], length, gram)
            parts.append((first + a, last + a, at + a, mark))
        return tuple(np.concatenate(x) for x in zip(*parts))
    least = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    wide, k = length - gram + 1, 1
    while 2 * k <= wide:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if wide > k:
        least = np.minimum(least[:len(least) - (wide - k)], least[wide - k:])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return first, last, place[first], hashes[place[first]]


def _digests(data: bytes, first: np.ndarray, last: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64 bits that name a context among those of its anchor: its bytes and where its first and last window lie."""
    out = [hashlib.blake2b(data[a:b + length], digest_size=8, salt=(p - a).to_bytes(8, "little") + (p - b).to_bytes(8, "little")).digest()
           for a, b, p in zip(first.tolist(), last.tolist(), at.tolist())]
    return np.frombuffer(b"".join(out), "<i8")


def with_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each anchor of each document: its hash, place, the distances of its first and last window, and its context's name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for i, j, block, bounds in text_blocks(*utf8(batch.column(1))):
                parts = []
                for k in range(j - i):
                    text = block[bounds[k]:bounds[k + 1]]
                    first, last, at, mark = windows(text, length)
                    if len(first):
                        parts.append((np.full(len(first), keys[i + k]), mark.view(np.int64), at, at - first, at - last,
                                      _digests(text.tobytes(), first, last, at, length)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int32() if n in (3, 4) else pa.int64())
                                                      for n, c in enumerate(zip(*parts))],
                                                     names=[c.split()[0] for c in PLACES.split(", ")])

    return docs.select("doc_row", "text").mapInArrow(work, PLACES)


def _packed(codes: np.ndarray) -> np.ndarray:
    """Seven codes from each place in 63 bits; what follows a 0 counts as 0."""
    n = len(codes)
    key, live = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(7):
        shifted = np.concatenate([codes[k:], np.zeros(min(k, n), np.uint16)])[:n]
        key = (key << np.uint64(9)) | np.where(live, shifted, np.uint16(0))
        live &= shifted > 0
    return key


def suffix_order(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of the texts in order of their first ``depth`` bytes or more: places, start of each text, codes.

    Codes are bytes plus one; a 0 ends each text and differs from every other. Ranks of 7 bytes are packed, then doubled;
    the rank of a group of equal ones is its first place in the order, so only open groups change.
    """
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8).astype(np.uint16) + np.uint16(1)
    codes[ends - 1] = 0
    n = len(codes)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    key = _packed(codes)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    open_, ordered, h = np.arange(n), key[order], 7
    while True:
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        open_ = open_[~(first & np.append(first[1:], True))]
        if h >= depth or not len(open_):
            break
        some = order[open_]
        after = np.where(left[some] > h, rank[np.minimum(some + h, n - 1)] + 1, 0)
        pair = (rank[some].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        order[open_] = some[by]
        ordered = pair[by]
        h *= 2
    return order, np.concatenate([[0], ends[:-1]]), codes


def short_prefixes(order: np.ndarray, codes: np.ndarray, at_most: int) -> np.ndarray:
    """Common prefixes of neighbours in the order as far as ``at_most``, -1 beyond; read off the codes, seven at once."""
    n, key = len(order), _packed(codes)
    value = np.full(n, -1, np.int32)
    value[0] = 0
    alive = np.arange(1, n)
    for k in range(0, at_most + 1, 7):
        a, b = key[np.minimum(order[alive - 1] + k, n - 1)], key[np.minimum(order[alive] + k, n - 1)]
        # A last code of 0 tells that a text ends here; equal keys then differ where it does.
        done = (a != b) | (a & np.uint64(511) == 0)
        x, y = (a ^ b)[done], a[done]
        equal = sum((x >> np.uint64(9 * j) == 0).astype(np.int32) for j in range(7))
        codes_left = sum((y >> np.uint64(9 * j) & np.uint64(511) > 0).astype(np.int32) for j in range(7))
        found = k + np.minimum(equal, codes_left)
        value[alive[done]] = np.where(found <= at_most, found, -1)
        alive = alive[~done]
    return value


def common_prefixes(order: np.ndarray, codes: np.ndarray, length: int, from_: int = 24) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, by increasing value; -1 from ``length`` on.

    Values below ``from_`` are read off. Then, level by level: a boundary b of value v between the suffixes whose
    preceding characters are the transform gives value v + 1 to the boundary between the suffixes c + i and c + j, where
    i < b <= j are neighbouring occurrences of c in the transform, unless it has a value. Where i and j are adjacent
    this is one step backwards; other pairs wait until the first boundary between them is found.
    """
    n = len(order)
    value = short_prefixes(order, codes, from_ - 1)
    before = codes[order - 1].astype(np.int64)
    before[order == 0] = 0
    back = np.empty(n, np.int64)
    by_char = np.argsort(before.astype(np.uint16), kind="stable")
    counts = np.bincount(codes.astype(np.int64), minlength=257)
    begins = np.cumsum(counts) - counts
    char_of = before[by_char]
    rank_in = np.arange(n) - np.searchsorted(char_of, char_of)
    back[by_char] = begins[char_of] + rank_in
    i, j = by_char[:-1], by_char[1:]
    pair = (char_of[1:] == char_of[:-1]) & (char_of[1:] > 0)
    i, j = i[pair], j[pair]
    target = back[j]
    open_ = value[target] < 0
    wide = open_ & (j > i + 1)
    i, j, target = i[wide], j[wide], target[wide]
    beside = np.concatenate([[False], (before[1:] == before[:-1]) & (before[1:] > 0)])
    frontier = np.flatnonzero(value == from_ - 1)
    level = from_ - 1
    while level + 1 < length and len(frontier):
        single = back[frontier[beside[frontier]]]
        level += 1
        single = single[value[single] < 0]
        value[single] = level
        if len(i):
            done = np.searchsorted(frontier, i, "right") < np.searchsorted(frontier, j, "right")
            hit = target[done]
            value[hit] = level
            i, j, target = i[~done], j[~done], target[~done]
            frontier = np.sort(np.concatenate([single, hit]))
        else:
            frontier = np.sort(single)
    return value


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its starts begin a string of ``length`` bytes that begins elsewhere in the texts too."""
    order, begins, codes = suffix_order(texts, length)
    value = common_prefixes(order, codes, length)
    same = np.concatenate([value < 0, [False]])
    marked = np.zeros(len(codes), bool)
    marked[order] = same[:-1] | same[1:]
    return [marked[b:b + max(len(t) - length + 1, 0)] for b, t in zip(begins.tolist(), texts)]


def _expanded(length: int, block_bytes: int):
    """Contexts, sorted by group, to repeated windows; groups are gathered into blocks and never cut."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        names, marks = [], []
        for (anchor, name, first, copies, _), found in zip(rows, repeated_starts([r[4] for r in rows], length)):
            if copies > 1:
                found = np.ones_like(found)
            a, b = runs(found)
            names.append((anchor, name))
            marks.append([{"first": first - x, "last": first - y + 1} for x, y in zip(a.tolist(), b.tolist())])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.int64()), pa.array([n[1] for n in names], pa.int64()),
                                           pa.array(marks, kind)], names=["anchor", "name", "marks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, group = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != group and held >= block_bytes:
                    yield flush(rows)
                    rows, held = [], 0
                group = row[0]
                if not rows or rows[-1][:2] != row[:2]:
                    rows.append(row)
                    held += len(row[4])
        if rows:
            yield flush(rows)

    return work


def _contexts(places: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of the distinct contexts of the anchors: anchor, name, distances of first and last window, copies, crowded, text."""
    each = places.groupBy("anchor", "name").agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_row", "at", "first", "last", "crowded")).alias("one"))
    wanted = (each.select("one.doc_row", F.struct("anchor", "name", "copies", "one.at", "one.first", "one.last", "one.crowded").alias("w"))
              .groupBy("doc_row").agg(F.collect_list("w").alias("wanted")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                rows = [(w["anchor"], w["name"], w["first"], w["last"], w["copies"], w["crowded"],
                         raw[w["at"] - w["first"]:w["at"] - w["last"] + length]) for w in wanted]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in CONTEXTS.split(", ")])

    return docs.select("doc_row", "text").join(wanted, "doc_row").select("text", "wanted").mapInArrow(cut, CONTEXTS)


def _split_places(places: DataFrame, docs: DataFrame, width: int, length: int) -> DataFrame:
    """Places cut into runs of at most ``width`` windows; the new anchor names the bytes that all windows of a run share."""
    wanted = places.groupBy("doc_row").agg(F.collect_list(F.struct("anchor", "at", "first", "last", "copies")).alias("wanted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [(w["anchor"], w["at"], min(w["first"], d + width - 1), max(w["last"], d), w["copies"]) for w in wanted
                         for d in range(w["last"] // width * width, w["first"] + 1, width)]
                names = [int.from_bytes(hashlib.blake2b(raw[at - a // width * width:at - a // width * width + length - width + 1],
                                                        digest_size=8, salt=(anchor & (1 << 64) - 1).to_bytes(8, "little"),
                                                        person=(a // width).to_bytes(8, "little")).digest(), "little", signed=True)
                         for anchor, at, a, b, _ in parts]
                at, first, last, copies = (np.array([x[k] for x in parts]) for k in (1, 2, 3, 4))
                columns = (np.full(len(parts), key), names, at, first, last, _digests(raw, at - first, at - last, at, length), copies)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in (3, 4) else pa.int64()) for n, c in enumerate(columns)],
                                                 names=[c.split()[0] for c in f"{PLACES}, copies long".split(", ")])

    return docs.join(wanted, "doc_row").select("doc_row", "text", "wanted").mapInArrow(work, f"{PLACES}, copies long")


def _shared(places: DataFrame, most_contexts: int) -> tuple[DataFrame, bool]:
    """Places whose anchor occurs again, whether it has several contexts and too many (crowded); whether any has too many."""
    stats = stored(places.groupBy("anchor").agg(F.sum("copies").alias("n"), F.min("name").alias("low"), F.max("name").alias("high"))
                   .filter("n > 1").select("anchor", "n", (F.col("low") < F.col("high")).alias("several")), "stats")
    shared = stored(places.join(stats, "anchor").select(*places.columns, "n", "several"), "shared")
    hot = stored(shared.filter(F.col("several") & (F.col("n") > most_contexts)).groupBy("anchor", "name").count()
                 .groupBy("anchor").count().filter(F.col("count") > most_contexts).select("anchor", F.lit(True).alias("crowded")), "hot")
    if not hot.limit(1).count():
        return shared.withColumn("crowded", F.lit(False)), False
    return shared.join(hot, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))), True


def _marks(contexts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """The repeated windows of contexts, as ranges of distances to the anchor."""
    return stored(contexts.select("anchor", "name", "first", "copies", "text").repartition("anchor").sortWithinPartitions("anchor", "name")
                  .mapInArrow(_expanded(length, block_bytes), FOUND), "marks").filter(F.size("marks") > 0)


def _crowded_marks(contexts: DataFrame, length: int, block_bytes: int, most_contexts: int) -> DataFrame:
    """The same of contexts whose anchors have too many: cut by where windows start, finer until no new anchor has too many.

    The contexts stand for the documents here, each with the number of its occurrences, so documents are not read again.
    """
    contexts = contexts.withColumn("doc_row", F.xxhash64("anchor", "name", F.lit(2)))
    places = contexts.select("doc_row", "anchor", F.col("first").cast("long").alias("at"), "first", "last", "name", "copies")
    width, found = length - GRAM + 1, []
    while True:
        width = max(1, width // 4)
        places = stored(_split_places(places, contexts, width, length), "split")
        shared, more = _shared(places, most_contexts if width > 1 else 1 << 62)
        ready = shared.filter("NOT crowded")
        several = ready.filter("several")
        found += [ready.filter("NOT several").select("doc_row", F.array(F.struct("first", "last")).alias("marks")),
                  several.select("doc_row", "anchor", "name").join(_marks(_contexts(several, contexts, length), length, block_bytes), ["anchor", "name"])
                  .select("doc_row", "marks")]
        if not more:
            break
        places = shared.filter("crowded").select(*places.columns)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return stored(contexts.select("doc_row", "anchor", "name").join(every, "doc_row").select("anchor", "name", "marks"), "crowded")


def without_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = 1 << 21, most_contexts: int = 2_500) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the bytes that stay.

    Removed is every byte inside a string of ``length`` bytes that starts anywhere else too, in the same document or
    another, judged on the input. Anchors with more than ``most_contexts`` distinct contexts are split by where their
    windows start and what those share, so that no task holds an unbounded group; it changes no result.

    Null and empty texts have no bytes. Rows that repeat a document are documents of their own: all lose what they
    share, which is everything from ``length`` bytes on; only one of them is searched. A null doc_id is kept; other
    columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc_row", row_key())
    with shuffles_freed(docs.sparkSession):
        # A row that occurs again is repeated as a whole: one of its copies stands for all beside other documents.
        twins = stored(rows.groupBy("doc_row").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("n_bytes"))
                       .filter("n > 1").select("doc_row", "n_bytes"), "twins")
        one = rows.join(twins, "doc_row", "left_semi").groupBy("doc_row").agg(F.min("text").alias("text"))
        docs = rows.join(twins, "doc_row", "left_anti").select("doc_row", "text").unionByName(one)
        places = stored(with_places(docs, length), "places").withColumn("copies", F.lit(1).cast("long"))
        every, more = _shared(places, most_contexts)
        several = every.filter("several")
        contexts = stored(_contexts(several, docs, length), "contexts")
        marks = _marks(contexts.filter("NOT crowded"), length, block_bytes)
        if more:
            marks = marks.unionByName(_crowded_marks(contexts.filter("crowded"), length, block_bytes, most_contexts))
    cut = lambda first, last: F.struct((F.col("at") - first).alias("start"), (F.col("at") - last + length).alias("end"))
    whole = every.filter("NOT several").select("doc_row", F.array(cut(F.col("first"), F.col("last"))).alias("cut"))
    part = several.select("doc_row", "at", "anchor", "name").join(marks, ["anchor", "name"]).select(
        "doc_row", F.transform("marks", lambda m: cut(m["first"], m["last"])).alias("cut"))
    ranges = whole.union(part).groupBy("doc_row").agg(F.flatten(F.collect_list("cut")).alias("cut"))
    entire = twins.filter(F.col("n_bytes") >= length).select("doc_row", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end"))).alias("cut"))
    return without_ranges(rows, ranges.join(twins, "doc_row", "left_anti").union(entire))
