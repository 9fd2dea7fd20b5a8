"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unknown word falls back to its
character n-grams of five letters, word ends included; where none of these is known, to those of four, and so on down
to single letters. Each shorter step counts less.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import kept, stored
from floodspark.operators.ordered import number_rows

ORDERS = (5, 4, 3, 2, 1)
BACKOFF = 0.4
LETTERS = re.compile(r"[^\W\d_]+")
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(key: str = "doc_id") -> Column:
    """True for the documents that are never learnt from."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2


def grams(word: str, order: int) -> list[str]:
    """The n-grams of a word between its end marks; single letters go without marks."""
    padded = f"^{word}$" if order > 1 else word
    return [padded[i:i + order] for i in range(len(padded) - order + 1)]


def train(docs: DataFrame, max_docs: int = 20_000, max_words: int = 20_000, max_grams: int = 10_000) -> dict:
    """Word and n-gram log frequencies of each language of the labelled documents that are not held out.

    ``max_docs`` bounds the sample: where more documents are labelled, those with the smallest hash of key and text
    are taken, whole texts each; equal rows go together. ``max_words`` and ``max_grams`` bound what is kept of a
    language and order, most frequent first, then by hash. So the model's size does not depend on the corpus, and no
    task orders all units of a language: they are numbered by buckets of their count and hash.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False)))
    n = labelled.count()
    if n > max_docs:
        share = int(max_docs / n * (1 << 32))
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) < share)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            yield _counted([(lang, 0, w, c) for lang, words in found.items() for w, c in words.items()])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, word, c in zip(*(batch.column(k).to_pylist() for k in ("lang", "unit", "n"))):
                for order in ORDERS:
                    for gram in grams(word, order):
                        found[lang, order, gram] += c
            yield _counted([(*k, c) for k, c in found.items()])

    schema = "lang string, kind int, unit string, n long"
    add = lambda df: df.groupBy("lang", "kind", "unit").agg(F.sum("n").alias("n"))
    words = stored(add(labelled.select("lang", "text").mapInArrow(count_words, schema)), "words")
    counted = words.union(add(words.mapInArrow(count_grams, schema)))
    counted = stored(counted.withColumn("down", -F.col("n")).withColumn("mark", F.xxhash64("unit")), "units")
    bucket = F.struct("down", F.shiftright("mark", 58).alias("part"))
    kept = number_rows(counted, ["lang", "kind"], bucket, [F.col("down"), F.col("mark"), F.col("unit")], "place").filter(
        F.col("place") <= F.when(F.col("kind") == 0, max_words).otherwise(max_grams))
    rows = kept.select("lang", "kind", "unit", "n").toPandas().sort_values(["kind", "unit", "lang"])
    langs = sorted(rows["lang"].unique())
    model: dict = {"langs": langs, "units": {}, "weights": {}}
    for kind, part in rows.groupby("kind"):
        units = {u: k for k, u in enumerate(dict.fromkeys(part["unit"]))}
        table = np.zeros((len(units), len(langs)))
        table[part["unit"].map(units).to_numpy(), part["lang"].map(langs.index).to_numpy()] = part["n"].to_numpy()
        total = table.sum(0)
        model["units"][int(kind)] = units
        model["weights"][int(kind)] = np.log((table + 0.5) / (total + 0.5 * len(units)))
    return model


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * 4
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "kind", "unit", "n"])


def score_word(word: str, model: dict) -> np.ndarray:
    """Log score of one lower-case word in each language; zeros where not even a letter is known."""
    known = model["units"].get(0, {}).get(word)
    if known is not None:
        return model["weights"][0][known]
    for step, order in enumerate(ORDERS, 1):
        units = model["units"].get(order, {})
        rows = [units[g] for g in grams(word, order) if g in units]
        if rows:
            return BACKOFF ** step * model["weights"][order][rows].mean(0) * min(len(word), 8)
    return np.zeros(len(model["langs"]))


class Scorer:
    """Scores texts as ``score_word`` does, many new tokens at once.

    Remembers the score of up to ``limit`` tokens of ``letters`` characters in all, as a token of a script without
    spaces may be a whole text; beyond, only the tokens of the text at hand.
    """

    def __init__(self, model: dict, limit: int = 800_000, letters: int = 16 << 20):
        self.langs, self.limit, self.letters = model["langs"], limit, letters
        self.words, self.grams, tables, at = {}, {}, [], 0
        for kind, units in model["units"].items():
            step = ORDERS.index(kind) + 1 if kind else 0
            (self.grams if kind else self.words).update({u: k + at for u, k in units.items()})
            tables.append(BACKOFF ** step * model["weights"][kind])
            at += len(units)
        self.weights = np.concatenate(tables) if tables else np.zeros((0, 0))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.scores = np.zeros((1024, len(self.langs)))

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.place]
        if self.place and (len(self.place) + len(new) > self.limit or self.held + sum(map(len, new)) > self.letters):
            self.forget()
            new = list(tokens)
        self.held += sum(map(len, new))
        need = len(self.place) + len(new)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((need, len(self.langs)))])
        rows, starts, scales, owners = [], [], [], []
        for token in new:
            k = self.place[token] = len(self.place)
            for word in LETTERS.findall(token.lower()):
                found = self.words.get(word)
                if found is not None:
                    starts.append(len(rows))
                    scales.append(1.0)
                    owners.append(k)
                    rows.append(found)
                    continue
                for order in ORDERS:
                    found = [self.grams[g] for g in grams(word, order) if g in self.grams]
                    if found:
                        starts.append(len(rows))
                        scales.append(min(len(word), 8) / len(found))
                        owners.append(k)
                        rows += found
                        break
        if rows:
            sums = np.add.reduceat(self.weights[rows], starts, axis=0) * np.array(scales)[:, None]
            np.add.at(self.scores, owners, sums)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTERS.search(text):
            return "und", 0.0
        tokens = text.split()
        if any(t not in self.place for t in tokens):
            self.learn(set(tokens))
        total = self.scores[np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))].sum(0)
        likely = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(likely[best] / likely.sum())


def scorer_of(shared) -> Scorer:
    """The scorer of a broadcast model; a Python worker keeps it, with what it remembers, between tasks."""
    model = shared.value
    return kept("language", model, lambda: Scorer(model))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior of that language, equal priors).

    Null text, text without a letter and a model without languages give ``und`` with score 0. A text of unknown
    letters only gets the first language by name with equal shares; so do ties. A null doc_id is not held out.
    Repeated rows each get a result, other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                       "text").mapInArrow(work, PREDICTED)


def accepted(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The documents whose language the model tells with a score of at least ``least``; ``und`` is never accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
