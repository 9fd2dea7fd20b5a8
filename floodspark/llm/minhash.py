"""Near-duplicate documents by b-bit MinHash.

Every document is the set of its distinct five-word shingles. Documents with the same set form a class. Of each
class 128 minima are taken; bands of four minima give candidate pairs, the low four bits of each minimum are packed
as the signature, and the share of equal four-bit groups, corrected for chance equality, estimates the similarity.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import byte_table, mix, powers, stored, text_blocks, utf8, word_hashes
from floodspark.llm.components import components

WORD_BYTES = byte_table(outside=b" \t\n\x0b\x0c\r")
SHINGLE, MINIMA, BITS, ROWS = 5, 128, 4, 4
SEEDS = mix(np.arange(11, 11 + MINIMA, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SETS = "doc_id long, n_shingles long, set_high long, set_low long, signature binary, bands array<long>"


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    data, at = utf8(texts)
    weights = powers(width, np.uint64(0xD6E8FEB86659FD93))
    for _, _, block, bounds in text_blocks(data, at):
        words, _, _, counts = word_hashes(block, bounds, WORD_BYTES)
        ends = np.cumsum(counts)
        if len(words) >= width:
            whole = np.zeros(len(words) - width + 1, np.uint64)
            for j in range(width):
                whole += words[j:len(words) - width + 1 + j] * weights[j]
            whole = mix(whole)
        for n, end in zip(counts.tolist(), ends.tolist()):
            if n >= width:
                yield np.unique(whole[end - n:end - width + 1])
            elif n:
                short = (words[end - n:end] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
                yield mix(np.array([short ^ np.uint64(0x5851F42D4C957F2D)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """The least value of each of ``n`` multiplicative hash functions over a set, 32 bits each."""
    odd = SEEDS[:n] | np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(least, (shingles[i:i + 256, None] * odd).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def pack(values: np.ndarray, bits: int = BITS) -> bytes:
    """The low ``bits`` of each minimum, packed."""
    return np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Similarity of packed signatures: the share of equal groups less what chance makes equal (2**-bits)."""
    differ = np.bitwise_xor(a, b)
    if bits == 4:
        equal = ((differ & 15) == 0).sum(-1) + ((differ >> 4) == 0).sum(-1)
        total = 2 * a.shape[-1]
    else:
        groups = np.unpackbits(differ, axis=-1)
        groups = groups.reshape(*groups.shape[:-1], -1, bits)
        equal, total = (~groups.any(-1)).sum(-1), groups.shape[-2]
    chance = 2.0 ** -bits
    return (equal / total - chance) / (1 - chance)


def with_signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", bands: int = MINIMA // ROWS) -> DataFrame:
    """Shingle count, identity of the set, packed signature and band keys of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = powers(ROWS, np.uint64(0xA0761D6478BD642F))
        for batch in batches:
            rows = []
            for shingles in shingle_sets(batch.column(1)):
                if not len(shingles):
                    rows.append((0, 0, 0, None, []))
                    continue
                high, low = mix(shingles + np.uint64(1)).sum(dtype=np.uint64), mix(shingles ^ SEEDS[0]).sum(dtype=np.uint64)
                least = minima(shingles)
                keys = mix((least[:bands * ROWS].reshape(bands, ROWS).astype(np.uint64) * weights).sum(1, dtype=np.uint64)
                           + np.arange(bands, dtype=np.uint64) * SEEDS[1])
                rows.append((len(shingles), high.astype(np.int64), low.astype(np.int64), pack(least), keys.view(np.int64)))
            n, high, low, packed, keys = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_high", "set_low", "signature", "bands"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, SETS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets meet ``100 * intersection >= 75 * union``."""
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common > 0 and 100 * common >= 75 * (len(both) - common)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are linked.

    The texts of a pair travel; a set is made anew beside its partner, so no set is ever stored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = None, None
        for batch in batches:
            keep = []
            for i, (y, mine) in enumerate(zip(batch.column("y").to_pylist(), shingle_sets(batch.column("text_x")))):
                other = batch.column("text_y")[i]
                if last is None or y != last[0] or other != last[1]:
                    last, base = (y, other), next(shingle_sets(pa.array([other.as_py()], pa.string())))
                keep.append(linked(mine, base))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = (pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x")), "x")
              .join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y")), "y")
              .select("x", "y", "text_x", "text_y"))
    return joined.mapInArrow(work, "x long, y long")


def near_duplicates(docs: DataFrame, side: int = 1500, slack: float = 0.2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Two documents are linked when 100 * intersection >= 75 * union of their sets. Copies with the same set are one
    class and never form pairs. Each class is first compared with the least class of its buckets; buckets whose
    classes then still lie in different components are compared fully, in blocks of ``side`` classes, by estimate
    (those below 0.75 - ``slack`` are 5 standard deviations from a link) and then on their sets. A link of
    similarity 0.75 shares none of the 32 bands with a chance of 5e-6.

    Null or empty text: an empty set, linked with nothing. Null doc_id: linked with nothing, component_id null, kept.
    Rows that repeat a doc_id are one node. Empty table: no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(with_signatures(docs), "signed")
    classes = (signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
               .groupBy("n_shingles", "set_high", "set_low").agg(F.min(F.struct("doc_id", "signature", "bands")).alias("one"))
               .select("n_shingles", "set_high", "set_low", F.col("one.doc_id").alias("node"), "one.signature", "one.bands"))
    classes = stored(classes, "classes")
    entries = classes.select("node", F.explode("bands").alias("band"))
    shared = stored(entries.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size"))
                    .filter("least < most"), "shared")
    members = stored(entries.join(shared.select("band", "least", "size"), "band"), "members")
    stars = members.groupBy(F.col("node").alias("x")).agg(F.min("least").alias("y")).filter("y < x")
    links = stored(confirmed(stars, docs), "links")
    found = components(links, "x", "y")
    split = _split_buckets(members, found)
    more = stored(_block_links(split, classes, docs, side, slack), "more")
    found = components(links.union(more), "x", "y")
    of_class = classes.join(found, classes["node"] == found["node"], "left").select(
        "n_shingles", "set_high", "set_low", F.coalesce("component", classes["node"]).alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_high", "set_low").join(
        of_class, ["n_shingles", "set_high", "set_low"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _split_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components, with the component of each."""
    placed = members.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                       F.count("*").alias("size")).filter("low < high")
    return stored(placed.join(mixed.select("band", "size"), "band"), "split")


def _block_links(split: DataFrame, classes: DataFrame, docs: DataFrame, side: int, slack: float) -> DataFrame:
    """Links that join different components within a bucket; a pair is looked at in the first bucket that it shares.

    A bucket is cut into blocks of about ``side`` classes; a task holds two blocks, however large the bucket is. Components
    that a link has joined count as one from then on, so a task returns a forest: fewer links than it has classes.
    """
    members = (split.join(classes.select("node", "signature", "bands").distinct(), "node")
               .join(docs.select(F.col("doc_id").alias("node"), "text"), "node"))
    blocks = F.ceil(F.col("size") / side).cast("int")
    dealt = (members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "component",
                     "signature", "bands", "text"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        signs = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
        bands = np.stack(group["bands"].to_list())
        node, part, mine, band = (group[c].to_numpy() for c in ("node", "component", "mine", "band"))
        cross = group["i"].iloc[0] != group["j"].iloc[0]
        texts, sets = group["text"].to_list(), {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = next(shingle_sets(pa.array([texts[k]], pa.string())))
            return sets[k]

        _, part = np.unique(part, return_inverse=True)
        out = []
        for k in range(len(group)):
            rest = np.flatnonzero((part != part[k]) & (mine != mine[k] if cross else True) & (node < node[k]))
            if len(rest):
                rest = rest[estimate(signs[rest], signs[k]) >= 0.75 - slack]
            if len(rest):
                shared = bands[rest] == bands[k]
                rest = rest[bands[k][np.argmax(shared, 1)] == band[k]]
            for m in rest:
                if part[m] != part[k] and linked(shingles(k), shingles(m)):
                    out.append((node[k], node[m]))
                    part[part == part[m]] = part[k]
        return pd.DataFrame(out, columns=["x", "y"], dtype=np.int64)

    return dealt.groupBy("band", "i", "j").applyInPandas(work, "x long, y long")
