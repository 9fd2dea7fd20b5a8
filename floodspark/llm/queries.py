"""The registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodspark.llm.bwt import without_repeats
from floodspark.llm.chunks import deduplicated
from floodspark.llm.common import table
from floodspark.llm.covertree import near_vectors
from floodspark.llm.hnsw import nearest_vectors
from floodspark.llm.impacts import ranked
from floodspark.llm.language import identify, train
from floodspark.llm.minhash import near_duplicates
from floodspark.llm.pii import KINDS, find_pii, fit
from floodspark.llm.postings import decontaminate
from floodspark.llm.segments import hard_negatives
from floodspark.llm.sentencepiece import encode
from floodspark.llm.tokenstore import read_store, with_checksums, write_store
from floodspark.llm.urls import judge


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    together = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        F.array_position(kinds, s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return find_pii(docs, fit(docs)).select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"),
                                            listed(together).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op2_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op5_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_minimal_perfect_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_checksums(read_store(write_store(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))))


def op7_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op8_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_numpy_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")).drop("ids")


def op10_bwt_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op11_segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_small_world_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"))


def op13_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_skip_chain_pii, op2_positional_index, op3_cover_tree, op4_word_backoff_language, op5_bbit_minhash, op6_minimal_perfect_hash,
                                  op7_redirect_equivalence, op8_gear_chunks, op9_numpy_viterbi, op10_bwt_expansion, op11_segment_summaries,
                                  op12_small_world_shards, op13_geometric_blocks)}
