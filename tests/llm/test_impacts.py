import collections
import math
import random
import re

import numpy as np
import pytest

from floodspark.llm import impacts

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    counted = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in {(i, tuple(sorted(set(terms_of(t))))) for i, t in items}:
        scored = []
        for doc, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in text if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc, s))
        scored.sort(key=lambda x: x[:2] + (x[2] or 0,))
        out += [(item, r + 1, d, s) for r, (_, _, d, s) in enumerate(scored[:k])]
    return sorted(out, key=str)


def collected(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n, words=200):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ7") for _ in range(rng.randint(1, 6))) for _ in range(words)]
    topics = [rng.sample(vocabulary, 25) for _ in range(6)]
    pick = lambda topic: rng.choice(topic) if rng.random() < 0.5 else vocabulary[min(int(rng.expovariate(0.05)), words - 1)]
    text = lambda m, topic: "".join(pick(topic).title() + rng.choice([" ", ", ", ".\n", "-"]) for _ in range(m))
    docs = [(i, text(rng.randint(0, 90), rng.choice(topics))) for i in range(n)]
    docs += [(n + i, docs[i % 3 + 1][1]) for i in range(n // 3)]
    return docs, [(i, text(rng.randint(1, 30), rng.choice(topics))) for i in range(25)]


def test_against_all_scores(spark):
    docs, items = corpus(1, 500)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = collected(impacts.ranked(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and len(got) == 250


def test_items_in_blocks(spark):
    docs, items = corpus(2, 120)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = collected(impacts.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), k=3, most_terms=100))
    assert got == brute(docs, items, 3)


def shard_of(docs, items, block):
    vocabulary = sorted({t for _, text in items for t in terms_of(text)})
    place = {t: i for i, t in enumerate(vocabulary)}
    counted = [collections.Counter(terms_of(t)) for _, t in docs]
    inside = [sorted((place[t], n) for t, n in c.items() if t in place) for c in counted]
    sizes = np.array([sum(c.values()) for c in counted])
    flat = np.array([p for row in inside for p in row]).reshape(-1, 2)
    n = int((sizes > 0).sum())
    shard = impacts.Shard(sizes, np.cumsum([len(r) for r in inside]), flat[:, 0], flat[:, 1], n, int(sizes.sum()), len(vocabulary), block)
    holding = np.bincount(flat[:, 0], minlength=len(vocabulary))
    return shard, impacts.weights(n, holding), [np.array(sorted({place[t] for t in terms_of(text)})) for _, text in items]


def test_summaries_are_exact_and_blocks_are_skipped():
    docs, items = corpus(3, 1500)
    shard, weight, asked = shard_of(docs, items, 16)
    assert shard.blocks
    dense = np.zeros((len(docs), shard.n_terms), np.int64)
    dense[np.repeat(np.arange(len(docs)), shard.ends - shard.starts), shard.terms] = shard.impacts
    for term, blocks in shard.blocks.items():
        assert sorted(blocks.docs) == sorted(shard.list_of(term))
        for q in asked[:5]:
            w = np.zeros(shard.n_terms, np.int64)
            w[q] = weight[q]
            reach = blocks.reach(q, w)
            for b in range(len(blocks.starts)):
                assert reach[b] == (dense[blocks.docs[blocks.starts[b]:blocks.ends[b]]].max(0) * w).sum()
    for q in asked:
        w = np.zeros(shard.n_terms, np.int64)
        w[q] = weight[q]
        best = impacts.Best(10)
        for found, scores in shard.search(q, w, 1, 10):
            best.add(scores, np.zeros(len(found), bool), found)
        want = dense @ w
        order = np.lexsort((np.arange(len(want)), -want))[:10]
        assert best.ids.tolist() == [i for i in order if want[i] > 0] and (best.scores == want[best.ids]).all()
    assert shard.skipped > 0 and shard.scored < len(asked) * len(docs)


@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_summaries_in_steps(monkeypatch, cells):
    monkeypatch.setattr(impacts, "CELLS", cells)
    docs, items = corpus(4, 200)
    shard, weight, asked = shard_of(docs, items, 8)
    blocks = next(iter(shard.blocks.values()))
    assert (np.diff(blocks.terms) > 0).all() and (blocks.reach(asked[0], weight) > 0).any()


def test_edges(spark, edge_docs, no_docs):
    items = [(1, "the river 7"), (1, "words runs"), (1, "The RIVER, 7 the"), (2, None), (3, " -.-"), (None, "short text été"), (4, "日本語のテキスト"), (5, "nowhere")]
    bench = spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, rank int, place int")
    got = collected(impacts.ranked(edge_docs.withColumn("score", edge_docs["doc_id"]), bench))
    assert got == brute([(r.doc_id, r.text) for r in edge_docs.collect()], items) and got
    assert collected(impacts.ranked(no_docs, bench)) == [] and collected(impacts.ranked(edge_docs, bench.limit(0))) == []
