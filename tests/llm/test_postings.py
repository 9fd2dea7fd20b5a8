"""Phrase hits against a window scan; proximity; blocks of phrases."""

import re

from floodspark.llm import postings
from floodspark.llm.common import stored

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def scan(docs, items, width=10):
    wanted = {}
    for key, text in items:
        w = words(text)
        for i in range(max(len(w) - width + 1, min(len(w), 1))):
            wanted.setdefault(tuple(w[i:i + width]), set()).add(key)
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(p) for p in wanted}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in wanted:
                    hit.update(range(i, i + k))
                    found |= wanted[tuple(w[i:i + k])]
        out.append((key, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


DOCS = [(1, "One two three four FIVE six seven eight nine ten eleven twelve"), (2, "x one-two three four five six seven eight nine ten y"),
        (3, "tiny item here and Tiny  Item"), (4, None), (5, ""), (None, "tiny item"), (6, "été déjà vu été déjà vu"), (1, "tiny item"), (7, "the the the the the")]
ITEMS = [(10, "one two three four five six seven eight nine ten eleven"), (11, "tiny item"), (12, None), (13, ""), (None, "the"), (14, "été déjà vu"),
         (15, "tiny ITEM!"), (16, "the the")]


def result(frame):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(set(r["items"])))) for r in frame.collect()), key=str)


def test_hits(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = scan(DOCS, [i for i in ITEMS if i[0] is not None])
    assert result(postings.decontaminate(docs, items)) == want
    index, phrases = stored(postings.build_index(docs), "index"), postings.phrase_windows(items)
    assert result(postings.search(index, phrases, block=2)) == want


def test_rows_alike_keep_their_own_results_over_several_blocks(spark):
    rows = [(1, "tiny item"), (None, "tiny item"), (None, "the the"), (1, "the the")] * 2
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = stored(postings.build_index(docs), "index")
    assert result(postings.search(index, postings.phrase_windows(items), block=2)) == scan(rows, [i for i in ITEMS if i[0] is not None])
    assert index.select("name").distinct().count() == len(rows)


def test_matches_name_place_and_length(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame([(11, "tiny item")], "item_id long, text string")
    row = postings.decontaminate(docs, items).filter("doc_id = 3").first()
    assert (row["items"], row.starts, row.lengths) == ([11, 11], [0, 4], [2, 2])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x beta"), (3, "beta alpha"), (4, "alpha"), (5, "beta")], "doc_id long, text string")
    phrases = postings.phrase_windows(spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    found = postings.search(postings.build_index(docs), phrases, span=3)
    assert sorted(r.doc_id for r in found.collect() if r["items"]) == [1, 3]


def test_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "runs the river")], "item_id long, text string")
    assert postings.decontaminate(no_docs, one).count() == 0
    assert all(r.n_hit == 0 for r in postings.decontaminate(edge_docs, none).collect())
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert result(postings.decontaminate(edge_docs, one)) == scan(rows, [(1, "runs the river")])
