"""Corpus queries against their SQL on the smallest tables; the pipeline against its operators' brute force."""

import pytest

import corpus_pipeline
from floodspark.llm.oracles import ORACLES
from floodspark.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(str(tuple(r)) for r in frame.select(*columns).collect()) == want


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline(spark, con):
    """Each stage keeps what it should of all that its predecessor kept."""
    from test_minhash import brute
    from test_pii import plain_spans
    from test_postings import scan

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        rows = {r.doc_id: r for r in before.collect()}
        texts = [(k, r.text) for k, r in rows.items()]
        if name == "language":
            assert {r.doc_id for r in after.collect()} == set(rows)
        elif name == "near_duplicates":
            assert {r.doc_id for r in after.collect()} == {k for k, _, _, kept in brute(texts) if kept}
        elif name == "decontamination":
            assert {r.doc_id for r in after.collect()} == {k for k, _, hit, _ in scan(texts, items) if not hit}
        elif name == "pii":
            for r in after.collect():
                assert not plain_spans(r.text) and r.n_chars == len(r.text) and (r.text == rows[r.doc_id].text or plain_spans(rows[r.doc_id].text))
        else:
            assert {r.doc_id: r.n_chars for r in after.collect()} == {k: len(t) for k, t in texts} and all(r.round_trip for r in after.collect())
        if name != "sentencepiece":
            assert after.columns == docs.columns
        before = after.cache()


def test_near_copies_are_told_by_row_not_by_key(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (None, text(2)), (None, text(2)), (3, text(3)), (4, text(3)), (4, text(4)), (None, text(5)), (9, text(5)), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [(1, text(1)), (None, text(2)), (3, text(3)), (4, text(4)), (9, text(5)), (6, None), (6, None)]))


def test_pipeline_edges(spark, edge_docs, no_docs):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge_docs.select(names), no_docs.select(names)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == names
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_benchmark_passages_are_told_by_text_not_by_key(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 100").first().text
    rows = [(None, f"before {item} after"), (5, item), (5, "a clean text that shares the key of another"), (None, "a clean text without a key"), (6, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, near_row long, held_text long")
    kept = corpus_pipeline.without_benchmark(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, rows[2:]))


def test_columns_with_the_names_of_the_stages_stay(spark):
    rows = [(1, "one text of some words", 7, 8, 9), (2, "another text of other words", 17, 18, 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_row long, Near_Row_ long, gone_row long")
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == rows
