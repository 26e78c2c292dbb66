"""The registered query of every operator of this folder, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm import (
    conversations,
    embeddings,
    extraction,
    fingerprints,
    minhash,
    mixing,
    neighbours,
    packing,
    spelling,
    substrings,
    toxicity,
    urls,
    warc,
)
from lutrin.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def public_tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    cut = packing.pieces(table(spark, folder, "documents"), public_tokenizer("word_bpe_49k.json"))
    return packing.pack(cut)


@query
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows, taken = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    sums = taken.groupBy("_row").agg(F.sum("words").alias("taken"))
    return rows.join(sums, "_row", "left").select(
        "row.doc_id", "size", "row.source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
         urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.verdict(table(spark, folder, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL["op3_url_filter"] = urls.verdict_sql(RULES)


@query
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").withColumn("_text", extraction.main_text(F.col("html"), extraction.fitted()))
    return pages.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


@query
def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = warc.with_originals(table(spark, folder, "pages").select("page_id", "url", "html"))
    index = warc.write(pages, warc.archive_folder(spark))
    return warc.resolved(warc.read(index))


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = docs.withColumn("score", toxicity.score(F.col("text"), lexicon))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    marked = substrings.duplicate_words(table(spark, folder, "documents").select("doc_id", "text"))
    return marked.select("doc_id", substrings.kept_digest("text", "_lutrin_spans").alias("d")).select("doc_id", "d.*")


@query
def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.prefix_trie(conversations.with_heads(conversations.sequences(table(spark, folder, "conversations"))))


SQL["op11_prefix_trie"] = conversations.TRIE_SQL


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, folder, "documents"), slip_every=97))


@query
def op13_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
