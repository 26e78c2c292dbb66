"""French text analysis as column expressions: types, topics, keywords, stems, facts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions.text import fold, folded_literal, let, sentences, strip, terms, truncated


def section_type(title: Column | None, text: Column) -> Column:
    """First matching type in order of priority, else `general`."""
    opening = F.left(text, F.lit(200))
    heard = F.lower(opening if title is None else F.concat(F.coalesce(title, F.lit("")), F.lit(" "), opening))

    def choose(c: Column) -> Column:
        found = F.lit("general")
        for kind, pattern in reversed(L.SECTION_PATTERNS.items()):
            found = F.when(_matches(c, pattern), kind).otherwise(found)
        return found
    return let(heard, choose)


def _matches(c: Column, pattern: str) -> Column:
    """rlike; alternatives that are plain words are looked up one by one, which costs a tenth of the pattern."""
    if re.search(r"[\\^$*+?{}\[\]().]", pattern.replace(r"\.", "")):
        return c.rlike(pattern)
    return _contains(c, set(pattern.replace(r"\.", ".").split("|")))


def _contains(c: Column, forms: set[str]) -> Column:
    """Any of the forms occurs anywhere; a form that holds another one adds nothing."""
    needed = sorted(f for f in forms if not any(g != f and g in f for g in forms))
    return reduce(or_, [c.contains(f) for f in needed]) if needed else F.lit(False)


def _whole(words: list[str]) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}])({'|'.join(re.escape(w) for w in sorted(words))})($|[^\p{{L}}\p{{N}}])"


def _anywhere(folded: Column, keywords: Iterable[str]) -> Column:
    """Any folded keyword occurs anywhere."""
    return _contains(folded, {folded_literal(k) for k in keywords})


def _mentions(low: Column, folded: Column, keywords: list[str], match: str) -> Column:
    """Any keyword occurs: anywhere in the folded text, or as a whole word.

    Keywords below SHORT_KEYWORD letters would be found inside most words, and folding would make them
    function words, so they only count as whole words with their accents.
    """
    if match == "word":
        return folded.rlike(_whole([folded_literal(k) for k in keywords]))
    short = [k.lower() for k in keywords if len(k) < L.SHORT_KEYWORD]
    long = _anywhere(folded, [k for k in keywords if len(k) >= L.SHORT_KEYWORD])
    return long | low.rlike(_whole(short)) if short else long


def mechanics(text: Column, match: str = "substring") -> Column:
    """Sorted topic tags mentioned in the text."""
    def tags(low: Column, folded: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(_mentions(low, folded, keywords, match), F.lit(tag))
            for tag, (_, keywords) in sorted(L.MECHANICS.items())]))
    return let(F.lower(text), lambda low: let(fold(low), lambda folded: tags(low, folded)))


def mechanic_label(tag: Column) -> Column:
    pairs = [F.lit(x) for tag_, (label, _) in L.MECHANICS.items() for x in (tag_, label)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), tag), tag)


def mentions_round(text: Column) -> Column:
    return fold(text).rlike(L.ROUND_PATTERN)


@lru_cache(maxsize=16)
def _word_columns(application: str, words: tuple[str, ...]) -> tuple[Column, ...]:
    return tuple(F.lit(w) for w in words)


def is_one_of(word: Column, words: Iterable[str]) -> Column:
    """Set membership; the literals of a long list are made once per application."""
    application = SparkSession.active().sparkContext.applicationId
    return word.isin(*_word_columns(application, tuple(sorted(words))))


def _wanted(word: Column, folded: Column, stop: list[str] | None, nouns: list[str] | None) -> Column:
    """Domain nouns stay; other words stay from three letters on if they are no function word.

    The lists are folded, so testing the folded word covers the word itself.
    """
    nouns = set(L.DOMAIN_NOUNS if nouns is None else nouns)
    dropped = set(L.STOPWORDS if stop is None else stop) - nouns
    short = {n for n in nouns if len(n) < 3}
    kept = (F.length(word) >= 3) & ~is_one_of(folded, dropped)
    return kept | is_one_of(folded, short) if short else kept


def keywords(text: Column, stop: list[str] | None = None, nouns: list[str] | None = None) -> Column:
    """Distinct folded words in order; domain nouns stay, short and function words go."""
    return F.filter(F.array_distinct(terms(fold(text))), lambda w: _wanted(w, w, stop, nouns))


def search_terms(text: Column, stop: list[str] | None = None, nouns: list[str] | None = None) -> Column:
    """As `keywords`, accents kept: stems are taken from the words as written."""
    return F.filter(F.array_distinct(terms(F.lower(text))), lambda w: _wanted(w, fold(w), stop, nouns))


def query_terms(text: Column) -> Column:
    """struct<mode, terms>: any of the first terms, or all words when no term is left."""
    return let(F.array_distinct(terms(F.lower(text))), lambda words: let(
        F.filter(words, lambda w: _wanted(w, fold(w), None, None)), lambda found: F.when(
            F.size(found) > 0,
            F.struct(F.lit("any").alias("mode"), F.slice(found, 1, L.MAX_TERMS).alias("terms"))
        ).otherwise(F.struct(F.lit("all").alias("mode"), words.alias("terms")))))


def query_text(text: Column) -> Column:
    """The terms as an OR query, or the question itself when it holds none."""
    return let(search_terms(text), lambda found: F.when(
        F.size(found) > 0, F.array_join(F.slice(found, 1, L.MAX_TERMS), " or ")).otherwise(text))


def stem(word: Column) -> Column:
    """Light French stemming after Savoy's published minimal rules.

    Plural marks, then a final r, e or é, then a doubled last letter; at least three
    letters stay.
    """
    singular = F.when(F.length(word) >= 5, F.when(
        word.endswith("aux"), F.concat(F.left(word, F.length(word) - 2), F.lit("l")))).otherwise(word)
    bare = F.regexp_replace(F.coalesce(singular, word), "^(.{3,}?)é?e?r?[sx]?$", "$1")
    return let(bare, lambda w: F.when(
        (F.length(w) > 3) & (F.right(w, F.lit(1)) == F.substring(w, -2, 1)),
        F.left(w, F.length(w) - 1)).otherwise(w))


def text_stems(text: Column, stop: list[str] | None = None) -> Column:
    """Stems of every word that is no function word, repeats kept."""
    stop = L.STOPWORDS if stop is None else stop
    kept = F.filter(terms(F.lower(F.coalesce(text, F.lit("")))), lambda w: ~is_one_of(fold(w), stop))
    return F.transform(kept, stem)


# --- facts about a collection ----------------------------------------------------------

def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def player_range(text: Column) -> Column:
    """struct<low, high>, null when the text names no number of players."""
    return _range(text, L.PLAYERS_RANGE, L.PLAYERS_SINGLE)


def minute_range(text: Column) -> Column:
    return _range(text, L.MINUTES_RANGE, L.MINUTES_SINGLE)


def _range(text: Column, both: str, single: str) -> Column:
    return (F.when(text.rlike(both), F.struct(
                _number(text, both, 1).alias("low"), _number(text, both, 2).alias("high")))
            .when(text.rlike(single), F.struct(
                _number(text, single, 1).alias("low"), _number(text, single, 1).alias("high"))))


def minimum_age(text: Column) -> Column:
    return _number(text, L.AGE, 1)


# --- gameplay --------------------------------------------------------------------------

def opening_sentences(text: Column, budget: int = 350) -> Column:
    """Leading sentences while they fit the budget, each closed by a full stop."""
    state = F.aggregate(
        sentences(text),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda acc, s: F.when(
            acc["full"] | (F.length(acc["text"]) + F.length(s) + 2 > budget),
            F.struct(acc["text"].alias("text"), F.lit(True).alias("full")),
        ).otherwise(F.struct(
            F.concat(acc["text"], F.when(acc["text"] != "", " ").otherwise(""), s, F.lit(".")).alias("text"),
            F.lit(False).alias("full"))))
    return strip(state["text"])


def mechanic_evidence(text: Column) -> Column:
    """array<struct<tag, sentence>>: per topic the first sentence that mentions it."""
    def per_text(pairs: Column) -> Column:
        return F.filter(F.array(*[
            F.struct(F.lit(tag).alias("tag"), truncated(
                F.get(F.filter(pairs, lambda p: _anywhere(p["folded"], keywords_)),
                      F.lit(0))["sentence"], 200).alias("sentence"))
            for tag, (_, keywords_) in sorted(L.MECHANICS.items())]),
            lambda found: found["sentence"].isNotNull())
    return let(F.transform(sentences(text), lambda s: F.struct(
        s.alias("sentence"), fold(s).alias("folded"))), per_text)


def numbered_items(text: Column) -> Column:
    """array<struct<order, name, steps>>, one entry per number, sorted by number."""
    orders = F.regexp_extract_all(text, F.lit(L.NUMBERED_ITEM), 1)
    names = F.regexp_extract_all(text, F.lit(L.NUMBERED_ITEM), 2)
    items = F.filter(
        F.zip_with(orders, names, lambda o, n: F.struct(
            o.try_cast("int").alias("order"), truncated(strip(n), 90).alias("name"))),
        lambda i: i["order"] > 0)

    def build(found: Column) -> Column:
        distinct = F.filter(found, lambda x, i: ~F.exists(
            F.slice(found, 1, i), lambda y: y["order"] == x["order"]))
        return let(F.sort_array(distinct), lambda ordered: F.transform(ordered, lambda x: F.struct(
            x["order"].alias("order"), x["name"].alias("name"),
            sub_steps(text, x["order"], F.exists(
                ordered, lambda y: y["order"] == x["order"] + 1)).alias("steps"))))
    return let(items, build)


def sub_steps(text: Column, order: Column, has_next: Column) -> Column:
    """Bulleted lines between item `order` and the next item."""
    def marker(n: Column) -> Column:
        return F.concat(F.lit(r"(?m)^\s*"), n.cast("string"), F.lit(r"[.)]\s+"))

    def block(opened: Column) -> Column:
        return F.when(has_next, F.element_at(F.split(opened, marker(order + 1), 2), 1)).otherwise(opened)

    opened = F.element_at(F.split(text, marker(order), 2), -1)
    return F.transform(F.regexp_extract_all(block(opened), F.lit(L.SUB_STEP), 1), strip)
