"""Backoff order, bulk scores against single ones, held-out accuracy, edges."""

import numpy as np

from floodspark.llm import language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_bulk_scores(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    scorer = language.Scorer(model)
    for token in ("the", "Thonding!", "zzzq", "日本", "éque-la", "x", "7"):
        scorer.learn({token})
        want = sum((language.score_word(w, model) for w in language.LETTERS.findall(token.lower())), np.zeros(len(model["langs"])))
        assert np.allclose(scorer.scores[scorer.place[token]], want), token
    known = language.accepted(docs, model)
    assert known.columns == docs.columns and known.count() > 990


def test_labels_of_held_out_documents_are_never_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    false = docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    a, b = language.train(docs), language.train(false)
    assert a["langs"] == b["langs"] and all((a["weights"][k] == b["weights"][k]).all() for k in a["weights"])


def test_words_go_before_grams_and_long_grams_before_short():
    units = {0: {"cat": 0}, 5: {"^dogs": 0}, 2: {"do": 0}, 1: {"d": 0}}
    model = {"langs": ["a", "b"], "units": units, "weights": {k: np.array([[-1.0 - k, -2.0]]) for k in units}}
    assert language.score_word("cat", model).tolist() == [-1.0, -2.0]
    assert np.allclose(language.score_word("dogs", model), 0.4 * np.array([-6.0, -2.0]) * 4)
    assert np.allclose(language.score_word("dom", model), 0.4 ** 4 * np.array([-3.0, -2.0]) * 3)
    assert np.allclose(language.score_word("d", model), 0.4 ** 5 * np.array([-2.0, -2.0]))
    assert language.score_word("xyz", model).tolist() == [0.0, 0.0]


def test_sample_bound(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = language.train(docs, max_docs=100, max_words=50, max_grams=20)
    assert all(len(units) <= 50 * len(small["langs"]) for units in small["units"].values())


def test_edges(spark, edge_docs, no_docs):
    found = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(edge_docs, language.train(edge_docs)).collect()}
    by = {i: (lang, s) for i, lang, s in found}
    assert by[1] == by[2] == by[6] == by[8] == ("und", 0.0)
    assert by[4][0] == "en" and by[7][0] in ("de", "en", "es", "fr")
    none = language.train(no_docs)
    assert none["langs"] == [] and language.identify(no_docs, none).count() == 0
    assert {r.lang_pred for r in language.identify(edge_docs, none).collect()} == {"und"}
    assert language.accepted(edge_docs, none).count() == 0


def test_model_keeps_the_most_frequent_units_exactly(spark):
    """A language of many rare words: exactly the bound is kept, none more frequent is left out, also of a single language."""
    rows = [(k, "xx", " ".join([f"common{chr(97 + j)}" for j in range(9)] + [f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}"])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language.train(docs, max_words=40, max_grams=15)
    assert len(model["units"][0]) == 40 and all(len(model["units"][o]) == 15 for o in language.ORDERS[:-1])
    assert {f"common{chr(97 + j)}" for j in range(9)} <= set(model["units"][0])


def test_remembered_tokens_are_bounded_by_letters(spark):
    model = language.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    small, large = language.Scorer(model, letters=50), language.Scorer(model)
    for text in ["the cat and the dog " * 5, "unbroken" * 200, "le chat et le chien", "the cat", "unbroken" * 200 + " the"]:
        assert small.predict(text) == large.predict(text)
        assert small.held <= max(50, sum(map(len, set(text.split()))))

