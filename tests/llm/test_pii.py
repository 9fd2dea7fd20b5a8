"""Base spans against plain patterns; the field against exact sums; added spans."""

import itertools
import random
import re

import numpy as np
import pytest

from floodspark.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 8 <= len(digits) <= 15
                    or kind == "card" and (not 16 <= len(digits) <= 19 or sum(doubled) % 10)):
                continue
            out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("letters", ["a@.1 9-+(é", "01 2.-+(4", "4 -"])
def test_base_spans_match_the_plain_patterns(letters):
    rng = random.Random(letters)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    for run in ("a" * 300_000, "1" * 300_000, "a." * 150_000, "+1 " * 100_000, "1." * 100_000, "@" * 200_000):
        pii.base_spans(run)


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    unary, edges = rng.normal(size=(5, 3)), np.array([[0, 1], [1, 2], [1, 3], [3, 4]])
    tables = rng.normal(size=(4, 3, 3))
    want = np.zeros((5, 3))
    for labels in itertools.product(range(3), repeat=5):
        p = np.exp(sum(unary[k, v] for k, v in enumerate(labels)) + sum(t[labels[a], labels[b]] for (a, b), t in zip(edges, tables)))
        for k, v in enumerate(labels):
            want[k, v] += p
    got = pii.propagate(unary, edges, tables, rounds=60)
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-6)


def test_a_loop_of_agreeing_tokens_spreads_a_label():
    unary = np.array([[0.0, 6.0], [1.0, 0.0], [1.0, 0.0]])
    agree = np.array([[3.0, 0.0], [0.0, 3.0]])
    edges = np.array([[0, 1], [1, 2], [0, 2]])
    assert (pii.propagate(unary, edges, np.stack([agree] * 3))[:, 1] > 0.9).all()
    assert (pii.propagate(unary, edges[:0], np.zeros((0, 2, 2)))[1:, 1] < 0.5).all()


def test_skip_edges_are_paths():
    text = "555-7713 " * 50
    chain, skip = pii.graph(text, pii.nodes(text))
    assert len(chain) == 49 and len(skip) <= 150


def test_repeated_number_without_its_prefix_is_added(spark):
    rng = random.Random(3)
    number = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(i, f"call +1 {(n := number())} or +1 {n} now, room {rng.randint(1, 99)}") for i in range(200)]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "call +1 (017) 555-7713 or (017) 555-7713 later, room 12"
    assert pii.added_spans(text, pii.base_spans(text), model) == [("phone", 26, 40)]
    assert pii.masked(text, model) == "call [PHONE] or [PHONE] later, room 12"
    assert pii.added_spans("room 12, hall 77", [], model) == []


def test_edges(spark, edge_docs, no_docs):
    model = pii.fit(edge_docs)
    found = pii.find_pii(edge_docs, model).collect()
    texts = {(r.doc_id, r.text) for r in edge_docs.collect()}
    assert len(found) == edge_docs.count()
    long_text = next(t for i, t in texts if i == 4)
    assert [tuple(s) for s in next(r.base for r in found if r.doc_id == 4)] == plain_spans(long_text)
    assert all(not r.base and not r.added for r in found if r.doc_id in (1, 2, None))
    masked = pii.mask_pii(edge_docs, model)
    assert masked.columns == edge_docs.columns and masked.count() == edge_docs.count()
    assert "@" not in masked.filter("doc_id = 4").first().text
    empty = pii.fit(no_docs)
    assert pii.find_pii(no_docs, empty).count() == 0 and len(pii.find_pii(edge_docs, empty).collect()) == len(found)
