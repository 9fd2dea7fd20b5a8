"""From raw documents to training tokens: language, near copies, benchmark passages, personal data, encoding.

Every stage reads what the one before has written. Documents whose language is not told, near copies but one, and
documents with benchmark passages go; personal data is masked; the last stage returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm import language, minhash, pii, postings, sentencepiece
from floodspark.llm.common import stored, table
from floodspark.llm.queries import tokenizer_file
from floodspark.llm.spans import row_key


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that word-first backoff tells with a score of 0.3 or more."""
    return language.accepted(docs, language.train(docs))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes not to be a column of ``docs``."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least key of each near-duplicate group; of several, the least by the hash of its text. A null key
    comes last. Rows are told apart by a number of their own, so rows that share a key, or have none, are several."""
    row = free_name(docs, "near_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = stored(minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
                   .select(F.col("doc_id").alias("near_row"), F.col("component_id").alias("near_group")), "groups")
    ranked = rows.select(F.col(row).alias("near_row"),
                         F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", row_key().alias("twin"), F.col(row).alias("near_row")).alias("rank"))
    later = found.filter("near_row <> near_group").select("near_row", "near_group")
    several = later.union(later.select("near_group", "near_group").distinct())
    stays = several.join(ranked, "near_row").groupBy("near_group").agg(F.min("rank")["near_row"].alias("near_row")).select("near_row")
    gone = several.select("near_row").join(stays, "near_row", "left_anti").select(F.col("near_row").alias("gone_row"))
    return rows.join(gone, rows[row] == gone["gone_row"], "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. A text alone decides, whatever its key: rows of equal texts go
    together, and a text is named by a 64-bit hash."""
    found = postings.decontaminate(docs.select(F.xxhash64("text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    held = found.filter("n_hit > 0").select(F.col("doc_id").alias("held_text")).distinct()
    return docs.join(held, F.xxhash64(docs["text"]) == held["held_text"], "left_anti").select(docs.columns)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask_pii(docs, pii.fit(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return sentencepiece.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("language", told_language), ("near_duplicates", one_of_near_copies), ("decontamination", without_benchmark),
          ("pii", masked), ("sentencepiece", encoded)]

#: Learned languages, fitted potentials and the Viterbi search have no SQL form; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
