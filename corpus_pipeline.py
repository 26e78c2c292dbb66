"""Training-data pipeline over the documents table: each stage works on all that the one before kept.

The stages return the columns of documents; the last returns the packed pieces. Learned and drawn steps (toxicity, mixing)
have no SQL twin, so the whole has none; tests compare it with a brute-force version stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lutrin.llm import minhash, mixing, packing, substrings, toxicity
from lutrin.llm.common import table, written
from lutrin.llm.queries import public_tokenizer


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject; its labels come from the labels table."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates (shingles of five words, similarity 0.8)."""
    return minhash.without_near_duplicates(docs, words=5, share=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that occur earlier in the corpus."""
    return substrings.without_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: rows of documents, once per pass that takes words of them."""
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids placed in sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizer("word_bpe_49k.json")))


STAGES = [("toxicity", non_toxic), ("minhash_near_dedup", near_unique), ("substring_dedup", without_repeats),
          ("source_mixing", mixed), ("best_fit_packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
