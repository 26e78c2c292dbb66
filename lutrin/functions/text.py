"""Column expressions on text: normalisers, line tests, page and paragraph rules.

Everything here is evaluated inside the row, so none of it shuffles.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L

WORD_BREAK = r"[^\p{L}\p{Nd}]+"


# --- building blocks -------------------------------------------------------------------

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute `value` once per row and use it several times."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(L.SPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(L.SPACE))


def not_blank(c: Column) -> Column:
    return F.length(strip(c)) > 0


def squeeze(c: Column) -> Column:
    """White-space runs become one space."""
    return strip(F.regexp_replace(c, L.SPACE_RUN, " "))


def truncated(c: Column, size: int, mark: str = "…") -> Column:
    return F.when(F.length(c) > size, F.concat(F.left(c, F.lit(size)), F.lit(mark))).otherwise(c)


def words(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(c, L.SPACE_RUN), lambda w: w != "")


def terms(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(c, WORD_BREAK), lambda w: w != "")


def run_lengths(sorted_values: Column) -> Column:
    """array<struct<value, n>> of a sorted array, without leaving the row."""
    def runs(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)),
            lambda i: i.isNotNull())
        return let(starts, lambda st: F.transform(
            st, lambda p, k: F.struct(
                F.get(s, p).alias("value"),
                (F.coalesce(F.get(st, k + 1), F.size(s)) - p).alias("n"))))
    return let(sorted_values, runs)


def flat(parts: list[Column]) -> Column:
    """Texts that apply, in order: null ones are left out."""
    return F.array_compact(F.array(*parts))


# --- normalisers -----------------------------------------------------------------------

def valid_utf8(c: Column) -> Column:
    """Bytes that are no UTF-8 are dropped."""
    return F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit(""))


def fold(c: Column) -> Column:
    """Lower case without French accents."""
    return F.translate(F.lower(c), L.ACCENTED, L.UNACCENTED)


def folded_literal(text: str) -> str:
    return text.lower().translate(str.maketrans(L.ACCENTED, L.UNACCENTED))


def comparable(c: Column) -> Column:
    """The form in which excerpts and texts are compared."""
    return squeeze(F.lower(F.translate(c, L.TYPOGRAPHIC, L.PLAIN)))


def comparable_answer(c: Column) -> Column:
    """As `comparable`, without Markdown."""
    return comparable(F.translate(F.translate(c, "_", " "), "*`#", ""))


MARKS = "[\u0300-\u036f]"


def _plain_forms() -> dict[str, str]:
    """Every letter and digit that is an ASCII one once its canonical decomposition has lost its marks, with that one."""
    found = {}
    for sign in map(chr, range(0x80, 0x3000)):
        base = re.sub(MARKS, "", unicodedata.normalize("NFD", sign))
        if base.isascii() and base.isalnum() and len(base) == 1:
            found[sign] = base
    return found


PLAIN_FORMS = _plain_forms()


def name_key(c: Column) -> Column:
    """Names compared by letters and digits only: decomposed, without marks, in lower case, all else one space.

    "Š", "ő" and "ā" are s, o and a, composed or not; letters without a decomposition ("ø", "ł") are no letters here.
    """
    base = F.regexp_replace(F.translate(c, "".join(PLAIN_FORMS), "".join(PLAIN_FORMS.values())), MARKS, "")
    return F.trim(F.regexp_replace(F.lower(base), "[^a-z0-9]+", " "))


def short_name_key(c: Column) -> Column:
    """`name_key` without a leading article."""
    return F.regexp_replace(name_key(c), "^(le|la|les|l|the) ", "")


def slug(c: Column) -> Column:
    dashed = F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    return F.regexp_replace(dashed, "[^a-z0-9-]", "")


def safe_file_name(c: Column) -> Column:
    """Last path segment, accents folded, anything unusual replaced, extension kept."""
    upper = L.ACCENTED.upper()
    last = F.element_at(F.split(F.rtrim(F.translate(c, "\\", "/"), F.lit("/")), "/"), -1)

    def build(name: Column) -> Column:
        extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
        stem = F.left(name, F.length(name) - F.length(extension))
        plain = F.translate(stem, L.ACCENTED + upper, L.UNACCENTED + L.UNACCENTED.upper())
        # each foreign sign is one underscore, runs of foreign letters are one
        signs = F.regexp_replace(plain, r"[^\p{L}\p{Nd}._-]", "_")
        safe = F.regexp_replace(signs, "[^a-zA-Z0-9._-]+", "_")
        safe = F.when(F.btrim(safe, F.lit(".")) == "", "file").otherwise(safe)
        return F.concat(safe, F.regexp_replace(extension, "[^a-zA-Z0-9._-]+", "_"))
    return let(last, build)


# --- line tests ------------------------------------------------------------------------

def letter_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}+", ""))


def last_sign(c: Column) -> Column:
    """Last character that is no space or tab."""
    return F.right(F.rtrim(c, F.lit(" \t")), F.lit(1))


def first_sign(c: Column) -> Column:
    return F.left(F.ltrim(c, F.lit(" \t")), F.lit(1))


def ends_sentence(c: Column) -> Column:
    return last_sign(c).isin(".", "!", "?", ":", ";")


def starts_lower_ascii(c: Column) -> Column:
    return first_sign(c).between("a", "z")


def is_list_marker(c: Column) -> Column:
    return c.rlike(r"^([-•*–—]|[0-9][.)])")


def is_upper(c: Column) -> Column:
    """At least three letters, all upper case."""
    return (letter_count(c) >= 3) & (F.upper(c) == c)


def may_be_heading(line: Column, following: Column) -> Column:
    """The part of the heading test that looks at the line and the next one."""
    return (
        F.length(line).between(3, 60)
        & line.rlike(r"^[\p{Lu}\p{Nd}]")
        & (~is_list_marker(line) | is_upper(line))
        & ~line.contains(":")
        & ~last_sign(line).isin(".", ",", ";", "!", "?")
        & (letter_count(line) >= 3)
        & ~F.coalesce(first_sign(following).rlike(r"^\p{Ll}"), F.lit(False))
    )


def is_heading(line: Column, previous: Column, following: Column) -> Column:
    """Heading test of one line; `previous` is empty at a block start or after a heading."""
    opens = F.coalesce(previous, F.lit("")) == ""
    return may_be_heading(line, following) & (opens | (ends_sentence(previous) & is_upper(line)))


def is_contents_line(trimmed: Column) -> Column:
    """A line of a table of contents: short, leaders, ends in a digit."""
    return (F.length(trimmed).between(1, 120)
            & F.rtrim(trimmed).rlike(r"[0-9]$")
            & trimmed.rlike("[._·…]"))


def is_page_number(trimmed: Column) -> Column:
    """Only digits, or few digits inside dashes."""
    return ((trimmed.rlike(r"^[0-9 \t]*[0-9][0-9 \t]*$") & (F.length(trimmed) <= 5))
            | trimmed.rlike(r"^[-–— \t]*[0-9]{1,4}[-–— \t]*$"))


def is_low_quality(text: Column) -> Column:
    """Empty, few letters, mostly tiny words, or hardly any distinct word."""
    def judged(sample: Column) -> Column:
        # the words as one text: signs at both ends of a word are removed in one pass, a word of signs alone stays as an empty one
        signs = r"(?=[^\p{L}\p{Nd} ])(?:(?:(?<= )|^)[^\p{L}\p{Nd} ]+|[^\p{L}\p{Nd} ]+(?= |$))"
        clean = F.split(F.lower(F.regexp_replace(F.array_join(sample, " "), signs, "")), " ")
        return let(clean, lambda ws: (
            (F.size(F.filter(ws, lambda w: F.length(w) <= 2)) > F.size(ws) * F.lit(0.6))
            | ((F.size(ws) >= 10) & (F.size(F.array_distinct(ws)) < 5))))

    few_letters = let(strip(text), lambda t: (
        (F.length(t) == 0) | (letter_count(t) < F.length(t) * F.lit(0.45))))
    # the first 30 words: a blank first part and the rest of the text come on top
    first_words = F.slice(F.filter(F.split(text, L.SPACE_RUN, 32), lambda w: w != ""), 1, 30)
    return few_letters | let(first_words, lambda sample: (F.size(sample) > 0) & judged(sample))


# --- pages -----------------------------------------------------------------------------

def clean_page(text: Column) -> Column:
    """Hyphens at line ends undone, page numbers dropped, spaces and blank lines collapsed."""
    glued = F.regexp_replace(
        text, r"(\p{L})-[ \t]*\n[ \t]*(\p{Ll})", "$1$2")
    kept = F.filter(
        F.transform(F.split(glued, "\n"), strip), lambda l: (l == "") | ~is_page_number(l))
    spaced = F.transform(kept, lambda l: F.regexp_replace(l, "[ \t]+", " "))
    return strip(F.regexp_replace(F.array_join(spaced, "\n"), "\n{3,}", "\n\n"))


def split_pages(text: Column) -> Column:
    """array<struct<page_no, text>>: cut at form feeds, numbers kept when pages are empty."""
    pages = F.transform(F.split(text, "\f"), lambda p, i: F.struct(
        (i + 1).alias("page_no"), clean_page(strip(p)).alias("text")))
    whole = F.array(F.struct(F.lit(1).alias("page_no"), strip(text).alias("text")))
    return let(F.filter(pages, lambda p: p["text"] != ""),
               lambda kept: F.when(F.size(kept) > 0, kept).otherwise(whole))


def pages_of_lines(text: Column, lines_per_page: int = 20) -> Column:
    """Pages of a fixed number of lines, for texts that hold no form feed."""
    def cut(lines: Column) -> Column:
        last = F.floor((F.size(lines) - 1) / F.lit(lines_per_page)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda p: F.struct(
            (p + 1).alias("page_no"),
            F.array_join(F.slice(lines, p * lines_per_page + 1, F.lit(lines_per_page)), "\n").alias("text")))
    return let(F.split(text, "\n"), cut)


def repeated_lines(pages: Column, times: int = L.HEADER_REPEATS) -> Column:
    """Short lines seen `times` times or more in the document, found by sorting in the row."""
    lines = F.filter(
        F.flatten(F.transform(pages, lambda p: F.transform(F.split(p["text"], "\n"), strip))),
        lambda l: F.length(l).between(4, 80))
    return let(F.sort_array(lines), lambda s: F.array_distinct(
        F.filter(s, lambda l, i: l == F.get(s, i - (times - 1)))))


def without_layout_noise(text: Column, headers: Column) -> Column:
    """Repeated lines and table-of-contents lines removed, blank lines collapsed."""
    kept = F.filter(F.split(text, "\n"), lambda l: let(
        strip(l), lambda t: ~F.array_contains(headers, t) & ~is_contents_line(t)))
    return strip(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"))


# --- long paragraphs -------------------------------------------------------------------

def split_long(text: Column, size: int = L.CHUNK_SIZE) -> Column:
    """Pieces of at most `size` characters.

    One alternation states the priorities: the rest if it fits, else the last sentence
    end of the final third, else the last space of the second half, else a hard cut.
    """
    third, half = size * 2 // 3, size // 2
    piece = (
        rf"(?s)(.{{1,{size}}}+\z"
        rf"|.{{{third},{size}}}[.!?](?=[ \n]|\z)"
        rf"|.{{{half},{size}}}(?=[ \n])"
        rf"|.{{{size}}})[ \n]*"
    )
    pieces = F.transform(F.regexp_extract_all(text, F.lit(piece), 1), strip)
    return F.filter(pieces, lambda p: p != "")


# --- sentences, titles, summaries ------------------------------------------------------

def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, L.SENTENCE_BREAK), strip), lambda s: F.length(s) >= 8)


def title_candidate(text: Column) -> Column:
    """First of ten lines that looks like words; null when none does.

    The tenth part is the whole rest of the text, so it counts only when it is one line.
    """
    first_ten = F.transform(F.split(text, "\n", 10), strip)
    fits = F.filter(first_ten, lambda l: F.length(l).between(4, 80) & (
        F.length(F.regexp_replace(l, r"[^a-zA-Z\x{80}-\x{10FFFF}]", "")) >= 3))
    return F.get(fits, F.lit(0))


def title(candidate: Column, kind: Column, chunk_index: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in L.SECTION_LABELS.items() for x in kv])
    label = F.try_element_at(labels, kind)
    numbered = F.concat_ws(" ", F.coalesce(label, F.lit("Règles")), (chunk_index + 1).cast("string"))
    return F.when(candidate.isNull(), numbered).otherwise(
        F.concat(F.coalesce(F.concat(label, F.lit(" — ")), F.lit("")), truncated(candidate, 60)))


def summary(text: Column, size: int = 220) -> Column:
    """First sentence or first paragraph, else a cut at a space past the half."""
    def build(t: Column) -> Column:
        # one sign, then all up to a full stop or blank line; without one the empty end spares a search at later places
        sentence = F.regexp_extract(t, r"^(?:[\s\S][^.!?\n]*+(?:\n(?!\n)[^.!?\n]*+)*+(?:[.!?]|\n\n)|)", 0)
        opening = F.left(t, F.lit(1))
        first = F.when(opening.isin(".", "!", "?"), opening).otherwise(sentence)
        head = F.left(t, F.lit(size))
        # the last space counts when it lies past the half
        cut = F.when(head.rlike(rf"^[\s\S]{{{size // 2 + 1},}} "),
                     F.regexp_extract(head, r"^([\s\S]*) ", 1)).otherwise(head)
        return let(first, lambda f: F.when(f != "", F.left(strip(f), F.lit(size)))
                   .when(F.length(t) <= size, t)
                   .otherwise(F.concat(strip(cut), F.lit("…"))))
    return let(strip(text), build)
