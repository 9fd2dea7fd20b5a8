"""Components against all pairs; estimates; blocks of a bucket; sets of short texts."""

import re

import numpy as np
import pyarrow as pa

from floodspark.llm import minhash
from floodspark.llm.components import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            same = docs[a][0] is not None and docs[a][0] == docs[b][0]
            n = len(sets[a] & sets[b])
            link = n and None not in (docs[a][0], docs[b][0]) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)
            if same or link:
                root[find(a)] = find(b)
    out = []
    for k, (key, _) in enumerate(docs):
        least = None if key is None else min(docs[m][0] for m in range(len(docs)) if find(m) == find(k) and docs[m][0] is not None)
        out.append((key, len(sets[k]), least, key is None or least == key))
    return sorted(out, key=str)


def result(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_components(spark, copies):
    assert result(minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"))) == brute(copies)


def test_blocks_of_a_bucket_change_nothing(spark, copies):
    assert result(minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), side=3)) == brute(copies)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert result(minhash.near_duplicates(edge_docs)) == brute(rows)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_sets_and_order_of_short_texts():
    one = [s.tolist() for s in minhash.shingle_sets(pa.array(["a b", "b a", "A  B", "a b c d e", "", None, "a\u00a0b"]))]
    assert one[0] != one[1] and one[0] == one[2] and len(one[3]) == 1 and one[4] == one[5] == [] and len(one[6]) == 1


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.8, 1.0):
        found = []
        for _ in range(40):
            both = rng.integers(0, 2**63, int(400 * share), dtype=np.uint64)
            n = (len(both) and round(len(both) / share) or 400) - len(both)
            own = rng.integers(0, 2**63, n, dtype=np.uint64)
            a, b = (np.frombuffer(minhash.pack(minhash.minima(np.union1d(both, x))), np.uint8) for x in (own[:n // 2], own[n // 2:]))
            found.append(minhash.estimate(a[None], b)[0])
        assert abs(np.mean(found) - share) < 0.03, share


def test_two_bits_estimate_too():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**32, 512, dtype=np.uint32)
    b = np.where(rng.random(512) < 0.6, a, rng.integers(0, 2**32, 512, dtype=np.uint32))
    signs = [np.frombuffer(minhash.pack(x, 2), np.uint8) for x in (a, b)]
    assert abs(minhash.estimate(signs[0][None], signs[1], 2)[0] - 0.6) < 0.1


def test_components_of_paths_rings_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(200, 200 + k) for k in range(1, 30)] + [(5, None), (7, 7), (300, 301), (300, 301)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {k: 0 for k in range(61)} | {100 + k: 100 for k in range(7)} | {200 + k: 200 for k in range(30)} | {300: 300, 301: 300}
    assert got == want


def test_near_copies_give_a_forest(spark, monkeypatch):
    """Many near copies, and one text with the least key that shares buckets with them but no link."""
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words[:46]))] + [(i, " ".join([*words, f"x{i}"])) for i in range(1, 300)]
    seen = []

    def counted(edges, a="a", b="b"):
        seen.append(edges.count())
        return components(edges, a, b)

    monkeypatch.setattr(minhash, "components", counted)
    got = result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), side=120))
    assert got == [(i, n, min(i, 1), i < 2) for i, n in sorted(((i, max(len(t.split()) - 4, 1)) for i, t in rows), key=str)]
    assert max(seen) <= 12 * len(rows)
