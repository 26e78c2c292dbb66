"""What a model is given: trimmed history, budgeted sections, context text and prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.functions import lexicon as L
from lutrin.functions.text import let, not_blank, strip, truncated


def valid_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trimmed and bounded questions, and the rows rejected for a blank name or question."""
    ok = not_blank(F.coalesce(F.col("collection"), F.lit(""))) & not_blank(F.coalesce(F.col("question"), F.lit("")))
    accepted = queries.filter(ok).withColumn("question", truncated(strip(F.col("question")), L.MAX_QUESTION))
    return accepted, queries.filter(~ok)


def trimmed_history(history: Column, keep: int = L.MAX_HISTORY_TURNS) -> Column:
    """Last complete turns of array<struct<question, answer>>, each side bounded."""
    stripped = F.transform(history, lambda t: F.struct(
        strip(F.coalesce(t["question"], F.lit(""))).alias("question"),
        strip(F.coalesce(t["answer"], F.lit(""))).alias("answer")))
    complete = F.filter(stripped, lambda t: (t["question"] != "") & (t["answer"] != ""))
    bounded = F.transform(complete, lambda t: F.struct(
        truncated(t["question"], L.MAX_QUESTION).alias("question"),
        truncated(t["answer"], L.MAX_HISTORY_ANSWER).alias("answer")))
    return let(bounded, lambda h: F.slice(h, F.greatest(F.size(h) - keep + 1, F.lit(1)), keep))


def exchanges(turns: DataFrame) -> DataFrame:
    """User turns paired with the assistant turn that follows, other roles left out.

    turns(conv_id, turn, role, text) -> (conv_id, exchange_no, question, answer).
    """
    spoken = turns.filter(F.col("role").isin("user", "assistant"))
    w = W.partitionBy("conv_id").orderBy("turn")
    return (spoken.select("conv_id", "turn", "role", "text",
                          F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
            .filter(F.col("role") == "user")
            .select("conv_id", F.row_number().over(w).cast("int").alias("exchange_no"),
                    F.col("text").alias("question"),
                    F.when(F.col("next_role") == "assistant", F.col("answer")).alias("answer")))


def last_exchanges(rows: DataFrame, keep: int = L.MAX_EXCHANGES) -> DataFrame:
    """A conversation keeps its newest exchanges; ranks are cut before the shuffle."""
    w = W.partitionBy("conv_id").orderBy(F.col("exchange_no").desc())
    return rows.withColumn("_age", F.row_number().over(w)).filter(F.col("_age") <= keep).drop("_age")


def last_files(rows: DataFrame) -> DataFrame:
    """Newest non-empty `files` per conversation."""
    return (rows.filter(F.size("files") > 0)
            .groupBy("conv_id").agg(F.max_by("files", "exchange_no").alias("files")))


def context_turns(rows: DataFrame, keep: int = L.MAX_HISTORY_TURNS) -> DataFrame:
    """Newest exchanges without error and with answer and model, as one history array per conversation."""
    good = rows.filter(F.col("error").isNull() & (F.col("answer") != "") & (F.col("model") != ""))
    return (last_exchanges(good, keep).groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("exchange_no", "question", "answer"))).alias("turns"))
            .select("conv_id", F.transform("turns", lambda t: F.struct(
                t["question"].alias("question"), t["answer"].alias("answer"))).alias("history")))


def fit_budget(sections: Column, budget: int = L.CONTEXT_BUDGET) -> Column:
    """Sections in order while they fit; one that is too long is skipped, the first stays."""
    def keep(arr: Column) -> Column:
        lengths = F.transform(arr, lambda s: F.length(s["text"]))
        flags = F.aggregate(
            lengths, F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("keep")),
            lambda acc, n: let((F.size(acc["keep"]) == 0) | (acc["used"] + n <= budget), lambda fits: F.struct(
                (acc["used"] + F.when(fits, n).otherwise(0)).alias("used"),
                F.array_append(acc["keep"], fits).alias("keep"))),
            lambda acc: acc["keep"])
        return let(flags, lambda f: F.filter(arr, lambda s, i: F.get(f, i)))
    return let(sections, keep)


def page_reference(start: Column, end: Column) -> Column:
    return (F.when(start.isNull() | (start <= 0), "")
            .when(end > start, F.concat(F.lit("p. "), start.cast("string"), F.lit("-"), end.cast("string")))
            .otherwise(F.concat(F.lit("p. "), start.cast("string"))))


def by_chapter(sections: Column) -> Column:
    """Chapters in order of first appearance, ranks kept inside a chapter."""
    return let(sections, lambda arr: F.flatten(F.transform(
        F.array_distinct(F.transform(arr, lambda s: s["hierarchy_path"])),
        lambda path: F.filter(arr, lambda s: s["hierarchy_path"] == path))))


def context_text(sections: Column) -> Column:
    """Numbered sections under their chapter line, separated by blank lines."""
    def entry(arr: Column, s: Column, i: Column) -> Column:
        opens = (s["hierarchy_path"] != "") & (
            (i == 0) | (F.get(arr, i - 1)["hierarchy_path"] != s["hierarchy_path"]))
        reference = page_reference(s["page_start"], s["page_end"])
        return F.concat(
            F.when(opens, F.concat(F.lit("Chapitre : "), s["hierarchy_path"], F.lit("\n\n"))).otherwise(""),
            F.lit("Section "), (i + 1).cast("string"), F.lit(": "), s["title"],
            F.when(reference != "", F.concat(F.lit(" ("), reference, F.lit(")"))).otherwise(""),
            F.lit("\n"), s["text"])
    return let(by_chapter(sections), lambda arr: F.array_join(
        F.transform(arr, lambda s, i: entry(arr, s, i)), "\n\n"))


def prompt(question: Column, context: Column, history: Column) -> Column:
    """The user message for a batch model: extracts, earlier questions, last answer, question."""
    earlier = F.concat(
        F.lit("Questions précédentes :\n"),
        F.array_join(F.transform(history, lambda t: F.concat(F.lit("- "), t["question"], F.lit("\n"))), ""),
        F.lit("Dernière réponse donnée : "), F.try_element_at(history, F.lit(-1))["answer"], F.lit("\n\n"))
    return F.concat(
        F.lit("Extraits du livret (seule source autorisée) :\n---\n"), context, F.lit("\n---\n\n"),
        F.when(F.size(history) > 0, earlier).otherwise(""),
        F.lit("Question : "), question)


def retrieved_context(found: DataFrame, budget: int = L.CONTEXT_BUDGET) -> DataFrame:
    """Adds the kept sections and the context text; no section gives a null context."""
    kept = found.withColumn("kept", fit_budget(F.col("sections"), budget))
    return kept.withColumn("context", F.when(F.size("kept") > 0, context_text(F.col("kept"))))


def response_sections(sections: Column) -> Column:
    """Sections as shown with an answer: missing pages become 0."""
    return F.transform(sections, lambda s: F.struct(
        s["title"].alias("title"), s["text"].alias("content"), s["score"].alias("score"),
        F.coalesce(s["page_start"], F.lit(0)).alias("page_num"),
        F.coalesce(s["page_end"], F.lit(0)).alias("page_end"), s["source_file"].alias("file")))
