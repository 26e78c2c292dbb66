"""Facts about whole collections, read from their first passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions import nlp
from lutrin.functions.text import truncated
from lutrin.operators.skew import top_per
from lutrin.session import written

ORDER = ["doc_id", "chunk_index"]


def first_passages(passages: DataFrame, count: int, rank: str = "place") -> DataFrame:
    """The first passages per collection in book order.

    Places are ranked without the texts, each task keeps `count` of them before the shuffle; then only the texts at those
    places are fetched.
    """
    keys = ["collection_id", *ORDER]
    passages = written(passages.select(*keys, "text"))  # chunking would run twice
    places = top_per(passages.select(*keys), ["collection_id"], [F.col(c) for c in ORDER], count, rank)
    return passages.select(*keys, "text").join(places, keys)


def collection_facts(passages: DataFrame, count: int = L.META_CHUNKS) -> DataFrame:
    """Players, minutes and age from the first passage that names each; a range beats a single number."""
    facts = first_passages(passages, count).select(
        "collection_id", "place", nlp.player_range(F.col("text")).alias("players"),
        nlp.minute_range(F.col("text")).alias("minutes"), nlp.minimum_age(F.col("text")).alias("age"))

    def earliest(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("place")))

    return (facts.groupBy("collection_id")
            .agg(earliest("players").alias("p"), earliest("minutes").alias("m"), earliest("age").alias("age_min"))
            .select("collection_id", F.col("p.low").alias("players_min"), F.col("p.high").alias("players_max"),
                    F.col("m.low").alias("duration_min"), F.col("m.high").alias("duration_max"), "age_min"))


def bucket_texts(passages: DataFrame, per_bucket: int = L.BUCKET_TEXTS) -> DataFrame:
    """(collection_id, bucket, position, text): first texts about setup, turns, end and rounds."""
    kind = nlp.section_type(None, F.col("text"))
    typed = first_passages(passages, L.GAMEPLAY_CHUNKS).withColumn("kind", kind)
    buckets = F.array_compact(F.array(
        F.when(F.col("kind") == "setup", "setup"), F.when(F.col("kind") == "turn", "turns"),
        F.when(F.col("kind") == "end", "end_game"),
        F.when((F.col("kind") != "setup") & nlp.mentions_round(F.col("text")), "rounds")))
    return top_per(typed.select("collection_id", "place", "text", F.explode(buckets).alias("bucket")),
                   ["collection_id", "bucket"], [F.col("place")], per_bucket, "position")


def gameplay_sections(passages: DataFrame) -> DataFrame:
    """(collection_id, bucket, title, description, keywords) from the first texts of each bucket."""
    few = bucket_texts(passages).filter(F.col("position") <= L.SUMMARY_TEXTS)
    texts = (few.groupBy("collection_id", "bucket")
             .agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("texts"))
             .withColumn("texts", F.col("texts.text")))
    titles = F.create_map(*[F.lit(x) for kv in L.BUCKET_TITLES.items() for x in kv])
    parts = F.filter(F.transform("texts", lambda t: nlp.opening_sentences(t)), lambda p: p != "")
    return texts.select(
        "collection_id", "bucket", titles[F.col("bucket")].alias("title"),
        truncated(F.array_join(parts, "\n\n"), 700).alias("description"),
        F.slice(nlp.keywords(F.array_join("texts", " ")), 1, L.MAX_KEYWORDS).alias("keywords"))


def mechanic_evidence(passages: DataFrame, count: int = L.GAMEPLAY_CHUNKS) -> DataFrame:
    """(collection_id, tag, label, description): first sentence that mentions each topic."""
    found = first_passages(passages, count).select(
        "collection_id", "place", F.explode(nlp.mechanic_evidence(F.col("text"))).alias("e"))
    return (found.groupBy("collection_id", F.col("e.tag").alias("tag"))
            .agg(F.min_by("e.sentence", "place").alias("description"))
            .select("collection_id", "tag", nlp.mechanic_label(F.col("tag")).alias("label"), "description"))


def phases(passages: DataFrame, count: int = L.GAMEPLAY_CHUNKS) -> DataFrame:
    """(collection_id, phases): the numbered list with most items, the earliest on ties."""
    lists = (first_passages(passages, count)
             .filter(~nlp.section_type(None, F.col("text")).isin("end", "scoring", "component"))
             .filter(F.regexp_count("text", F.lit(L.NUMBERED_ITEM)) >= 2)
             .select("collection_id", "place", nlp.numbered_items(F.col("text")).alias("items"))
             .filter(F.size("items") > 0))
    best = top_per(lists, ["collection_id"], [F.size("items").desc(), F.col("place")], 1, "_best")
    return best.select("collection_id", F.slice("items", 1, L.MAX_PHASES).alias("phases"))


def gameplay(passages: DataFrame) -> DataFrame:
    """One row per collection with all gameplay fields; collections without any are left out."""
    passages = written(first_passages(passages, L.GAMEPLAY_CHUNKS))  # read once for all fields
    sections = gameplay_sections(passages).groupBy("collection_id").agg(*[
        F.first(F.when(F.col("bucket") == b, F.struct("title", "description", "keywords")), True).alias(b)
        for b in L.BUCKET_TITLES])
    mechanics = mechanic_evidence(passages).groupBy("collection_id").agg(
        F.sort_array(F.collect_list(F.struct("label", "tag", "description"))).alias("mechanics"))
    return (sections.join(mechanics, "collection_id", "full").join(phases(passages), "collection_id", "full"))


def is_empty_gameplay() -> Column:
    filled = [F.col(b).isNotNull() for b in L.BUCKET_TITLES] + [
        F.size(F.coalesce(F.col("mechanics"), F.array())) > 0, F.size(F.coalesce(F.col("phases"), F.array())) > 0]
    out = filled[0]
    for f in filled[1:]:
        out = out | f
    return ~out
