"""Checks on answers: facts, citations, refusals, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions.text import comparable_answer, let, not_blank, words

# Polite openings taken off an answer. The guard replaces a word boundary
# and looks at the next sign only, so accented letters count as letters.
FILLER = (r"(?i)^\s*(?:ok|okay|d'accord|d’accord|bien sûr|très bien)(?![\p{L}\p{N}_])\s*[,.!:]?\s*")


def without_filler(answer: Column) -> Column:
    """The opening is taken off unless nothing else is left."""
    return let(F.regexp_replace(answer, FILLER, ""), lambda t: F.when(not_blank(t), t).otherwise(answer))


def content_text(raw: Column) -> Column:
    """JSON content given as a string or as typed chunks, of which only `text` ones count; null gives ''."""
    variant = F.try_parse_json(raw)
    chunks = F.from_json(raw, "array<struct<type:string,text:string>>")
    return (F.when(raw.isNull() | (F.trim(raw) == "null"), "")
            .when(F.schema_of_variant(variant) == "STRING", F.try_variant_get(variant, "$", "string"))
            .when(F.trim(raw).startswith("["), F.array_join(F.transform(
                F.filter(chunks, lambda c: c["type"] == "text"),
                lambda c: F.coalesce(c["text"], F.lit(""))), "")))


def cited_pages(answer: Column) -> Column:
    """Both ends of every cited page range, distinct, in order of citation."""
    first = F.regexp_extract_all(answer, F.lit(L.PAGE_CITATION), 1)
    last = F.regexp_extract_all(answer, F.lit(L.PAGE_CITATION), 2)
    both = F.flatten(F.zip_with(first, last, lambda a, b: F.array(a.try_cast("int"), b.try_cast("int"))))
    return F.array_distinct(F.array_compact(both))


def without_citations(answer: Column) -> Column:
    """A cited page number must not pass for a fact."""
    return comparable_answer(F.regexp_replace(answer, L.PAGE_CITATION, ""))


def holds_word(text: Column, word: Column) -> Column:
    """`word` occurs without a letter or digit touching it."""
    quoted = F.regexp_replace(word, r"([^\p{L}\p{N} ])", r"\\$1")
    guarded = F.concat(F.lit(r"(^|[^\p{L}\p{Nd}])"), quoted, F.lit(r"($|[^\p{L}\p{Nd}])"))
    return (word != "") & F.regexp_like(text, guarded)


def missing_facts(answer: Column, facts: Column) -> Column:
    """Facts of which no `|`-variant stands in the answer.

    The answer is cut into words once; a variant of one word is looked up among them, only others become a pattern.
    """
    def holds(a: Column, variant: Column) -> Column:
        return F.when(F.regexp_like(variant, F.lit(r"^[\p{L}\p{Nd}]+$")), F.array_contains(a["words"], variant)).otherwise(holds_word(a["text"], variant))

    words = let(without_citations(answer), lambda t: F.struct(t.alias("text"), F.split(t, r"[^\p{L}\p{Nd}]+").alias("words")))
    return let(words, lambda a: F.filter(facts, lambda fact: ~F.exists(
        F.split(fact, r"\|"), lambda v: holds(a, comparable_answer(v)))))


def in_page_range(page: Column, start: Column, end: Column) -> Column:
    return start.isNotNull() & page.between(start, F.greatest(start, F.coalesce(end, start)))


def any_page_in_range(pages: Column, start: Column, end: Column) -> Column:
    return F.exists(pages, lambda p: in_page_range(p, start, end))


def invented_pages(cited: Column, sections: Column) -> Column:
    """Cited pages outside every section that was sent."""
    return F.filter(cited, lambda p: ~F.exists(
        sections, lambda s: in_page_range(p, s["page_start"], s["page_end"])))


def is_refusal(answer: Column) -> Column:
    return comparable_answer(answer).contains(L.REFUSAL)


def word_count(answer: Column) -> Column:
    return F.size(words(comparable_answer(answer)))


def page_range_text(start: Column, end: Column) -> Column:
    return (F.when(start.isNull(), "?")
            .when(end > start, F.concat(start.cast("string"), F.lit("-"), end.cast("string")))
            .otherwise(start.cast("string")))
