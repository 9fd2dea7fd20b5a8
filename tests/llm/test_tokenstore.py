"""The hash is perfect and minimal; units encode like whole texts; stores give every document back by its key."""

import random
import zlib

import numpy as np
import pytest

from floodspark.llm import tokenstore
from floodspark.llm.queries import tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 20_000])
def test_slots_are_a_bijection(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False) - 5 * 10**11
    table, place = tokenstore.perfect_hash(keys)
    assert sorted(place.tolist()) == list(range(n))
    assert len(table) <= max(1, n // 2)


def test_units_encode_like_whole_texts():
    encoder = tokenstore.TextEncoder(FILE)
    rng = random.Random(3)
    texts = ["", " ", "  ", "a  b", "a\n b", "a \nb", " lead", "trail ", "trail  ", "x y  z  w", "<|endoftext|> a<|endoftext|>b", "it's we'll \n\n  ok\x1c x"]
    texts += ["".join(rng.choice("the an'sé\n\t \x1c 日9.!") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for text, got in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(got, "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def expected(rows):
    tokenizer, at, out = tokenstore.TextEncoder(FILE).tokenizer, 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [40, 1 << 22])
def test_round_trip(spark, copies, size):
    store = tokenstore.write_store(spark.createDataFrame(copies, "doc_id long, text string"), FILE, shard_ids=size)
    assert sorted(map(tuple, tokenstore.with_checksums(tokenstore.read_store(store)).collect()), key=str) == expected(copies)


def test_lookup(spark, copies):
    store = tokenstore.write_store(spark.createDataFrame(copies, "doc_id long, text string"), FILE, shard_ids=500)
    keys = spark.createDataFrame([(5,), (5,), (99,), (10**9,), (-4,), (None,)], "doc_id long")
    found = {r.doc_id: (r.start, r.n_tokens) for r in tokenstore.lookup(store, keys).collect()}
    assert found == {k: (s, n) for k, s, n, _ in expected(copies) if k in (5, 99)}


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    store = tokenstore.write_store(edge_docs, FILE)
    assert sorted(map(tuple, tokenstore.with_checksums(tokenstore.read_store(store)).collect()), key=str) == expected(rows)
    twice = tokenstore.lookup(store, spark.createDataFrame([(3,)], "doc_id long")).collect()
    assert len(twice) == 2
    nothing = tokenstore.write_store(no_docs, FILE)
    assert tokenstore.read_store(nothing).count() == 0
    assert tokenstore.lookup(nothing, edge_docs.select("doc_id")).count() == 0


def test_units_are_the_librarys_whatever_is_remembered():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    rng, plain = random.Random(3), Tokenizer.from_file(file)
    parts = [*"ab \n\t.,'1é日🎉", "  ", "<|endoftext|>", "\r\n", "'s", " don't", "\0", "\xa0", " words", " of", "\nlines"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = [np.array(e.ids, "<u2").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    for limit in (0, 3000, 1 << 30):
        encoder = tokenstore.TextEncoder(file, limit)
        got = [i for k in range(0, len(texts), 100) for i in encoder.encode(texts[k:k + 100])]
        assert got == want and encoder.held <= limit
