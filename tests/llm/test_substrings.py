"""Chunk cuts and repeated substrings against direct definitions."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodspark.llm import bwt, chunks, common
from floodspark.llm.common import runs


def cuts(data):
    hashes = []
    for i in range(len(data)):
        h = sum(int(chunks.GEAR[data[i - j]]) << j for j in range(min(32, i + 1))) & 0xFFFFFFFF
        hashes.append(0 if i + 1 < len(data) and (data[i + 1] & 0xC0) == 0x80 else h)
    out = [i + 1 for i in range(len(data)) if hashes[i] > max(hashes[max(0, i - 32):i], default=0) and hashes[i] >= max(hashes[i + 1:i + 33], default=0)]
    return out if not data or out and out[-1] == len(data) else [*out, len(data)]


def test_cuts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("the andé \n日zq,.0") for _ in range(rng.randint(0, 300))).encode() for _ in range(30)] + [b""]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for text, ends in zip(texts, chunks.chunk_ends(np.frombuffer(b"".join(texts), np.uint8), at)):
        assert ends.tolist() == cuts(text)


def test_cuts_fall_in_step_after_an_insertion():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(5000))
    ends = [next(chunks.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))) for t in (text, b"inserted " + text)]
    assert len(set((ends[1] - 9).tolist()) & set(ends[0].tolist())) >= len(ends[0]) - 2


def test_long_chunks_are_cut_between_characters():
    data = np.frombuffer(("é" * 3000 + "a" * 5000).encode(), np.uint8)
    ends = next(chunks.chunk_ends(data, np.array([0, len(data)])))
    assert np.diff(ends, prepend=0).max() <= chunks.LONGEST + 3
    assert all((data[e] & 0xC0) != 0x80 for e in ends[:-1])


def test_first_copy_stays(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(4, f"{word()} {passage} {word()}"), (9, f"{word()} {word()} {passage}"), (2, " ".join(word() for _ in range(60))), (None, passage)]
    found = {r.doc_id: r for r in chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[4].n_removed == found[2].n_removed == found[2].n_repeated == 0 and found[4].n_repeated > 2
    assert found[9].n_removed > 250 and found[9].n_spans == 1 and found[None].n_removed > 250
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in found.values())


def test_one_of_different_rows_with_one_key_or_none_keeps_a_passage(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for key in (7, None):
        passage = " ".join(word() for _ in range(60))
        rows = [(key, f"{word()} {passage} {word()}") for _ in range(3)]
        found = chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.n_removed > 250 for r in found) == [False, True, True]
        assert sorted(r.n_removed for r in found)[0] == 0 and all(r.n_repeated > 2 for r in found)


def test_chunk_edges(spark, edge_docs, no_docs):
    rows = chunks.deduplicated(edge_docs).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in rows) == Counter((r.doc_id, len((r.text or "").encode())) for r in edge_docs.collect())
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (1, 2, 3, None)) and next(r for r in rows if r.doc_id == 5).n_removed > 50_000
    assert chunks.deduplicated(no_docs).count() == 0


def repeated(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = True
        out.append(mark)
    return out


def test_expansion_finds_repeated_starts():
    rng = random.Random(4)
    for _ in range(60):
        length = rng.choice([26, 30, 40, 64])
        base = bytes(rng.choice(b"abc\x00") for _ in range(200))
        texts = []
        for _ in range(rng.randint(1, 8)):
            t = bytearray()
            for _ in range(rng.randint(1, 4)):
                a = rng.randint(0, 150)
                t += base[a:a + rng.randint(1, 90)] + (bytes([rng.choice(b"abcxyz")]) if rng.random() < 0.4 else b"")
            texts.append(bytes(t))
        seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
        for t, got in zip(texts, bwt.repeated_starts(texts, length)):
            assert got.tolist() == [seen[t[i:i + length]] > 1 for i in range(len(t) - length + 1)]


def test_common_prefixes_come_by_value():
    texts = [b"banana band banana bandana banana" * 3, b"ananas banana band"]
    order, _, codes = bwt.suffix_order(texts, 60)
    value = bwt.common_prefixes(order, codes, 50, from_=1)
    joined = codes.tolist()
    for k in range(1, len(order)):
        a, b, n = order[k - 1], order[k], 0
        while joined[a + n] == joined[b + n] and joined[a + n]:
            n += 1
        assert value[k] == (n if n < 50 else -1)


def same(rows, found):
    want = Counter()
    for (key, text), gone in zip(rows, repeated([(t or "").encode() for _, t in rows], 400)):
        kept = np.frombuffer((text or "").encode(), np.uint8)[~gone].tobytes()
        want[key, len(gone), int(gone.sum()), len(runs(gone)[0]), kept] += 1
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()) == want


@pytest.mark.parametrize("most", [5000, 2])
def test_removal(spark, copies, most):
    rows = [*copies, (None, "x " * 300), (98, "y" * 1000)]
    assert same(rows, bwt.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), most_contexts=most))


def test_removal_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.filter("doc_id <> 4 OR doc_id IS NULL").collect()]
    assert same(rows, bwt.without_repeats(edge_docs.filter("doc_id <> 4 OR doc_id IS NULL")))
    assert bwt.without_repeats(edge_docs).count() == edge_docs.count()
    assert bwt.without_repeats(no_docs).count() == 0


def test_many_equal_rows(spark):
    """Thousands of equal rows cost as much as one, and what they share with another document goes there too."""
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rng.choice("ijkl ") for _ in range(700)) + text[500:1000] + "m" * 300
    rows = [(1, other), (2, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(
        spark.range(20_000, numPartitions=4).selectExpr("7L doc_id", f"'{text}' text")).unionByName(
        spark.range(50).selectExpr("cast(null as long) doc_id", "'short too' text"))
    found = bwt.without_repeats(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", F.length("kept").alias("k")).count().collect()
    assert {tuple(r) for r in found} == {(1, 1500, 500, 1, 1000, 1), (2, 5, 0, 0, 5, 1), (7, 3000, 3000, 1, 0, 20_000), (None, 9, 0, 0, 9, 50)}


def test_crowded_anchors_are_split_without_reading_the_documents_again(spark):
    """Texts go over the network once for contexts and once for removal, however often anchors are split."""
    rng = random.Random(8)
    passage = [rng.choice("abcdefgh ") for _ in range(600)]
    near = []
    for i in range(12):
        p = list(passage)
        p[rng.randrange(600)] = "#"
        p[50 * i] = "%"
        near.append((i, "".join(p)))
    rows = near + [(100 + i, "".join(rng.choice("ijklmnop ") for _ in range(20_000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    sent, name = {}, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        for most in (5000, 2):
            start = written()
            assert same(rows, bwt.without_repeats(docs, most_contexts=most))
            sent[most] = written() - start
    finally:
        spark.conf.set(name, before)
    assert sum(len(t) for _, t in rows) < sent[5000] and sent[2] < 1.3 * sent[5000]


def test_shuffle_files_go_when_the_write_ends(spark):
    def files():
        folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in folder.split("\n") if "/shuffle_" in x and x.endswith(".data")}

    table, name = spark.range(1000).selectExpr("id % 7 a").groupBy("a").count(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = files(), spark.conf.get(name, None)
    with common.shuffles_freed(spark):
        assert common.stored(table, "sums").count() == 7
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(name, "false") == (setting or "false")
