"""From documents to passages.

A document is one row with `pages array<struct<page_no, text>>`. Cleaning, paragraphs,
chapters and packing are array expressions on that row: the whole stage is narrow, there
is no shuffle and no group to collect, whatever the number of documents per collection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions import nlp, text as T, topics
from lutrin.functions.text import let

PARAGRAPH = "array<struct<text:string,page_start:int,page_end:int,heading:boolean>>"
CHUNK = "array<struct<text:string,page_start:int,page_end:int,hierarchy_path:string>>"
LINES = "_lines"
PARAGRAPHS = "_paragraphs"


# --- lines and headings ----------------------------------------------------------------

def block_lines(pages: Column, headers: Column) -> Column:
    """array<struct<page, line, opens, next>>: the lines of every block of every page."""
    def of_block(page: Column, block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), T.strip), lambda l: l != "")
        return let(lines, lambda ls: F.transform(ls, lambda l, i: F.struct(
            page["page_no"].cast("int").alias("page"), l.alias("line"),
            (i == 0).alias("opens"), F.get(ls, i + 1).alias("next"))))

    def of_page(page: Column) -> Column:
        blocks = F.split(T.without_layout_noise(page["text"], headers), "\n\n")
        return F.flatten(F.transform(blocks, lambda b: of_block(page, b)))

    return F.flatten(F.transform(pages, of_page))


def with_headings(lines: Column) -> Column:
    """Adds `heading` and the previous line.

    A line is a heading by itself (H) or because it may be one and directly follows a
    heading (B). The chain H B B ... is found in one pass over one sign per line: a match
    starts at H, or at B where the match before it ended.
    """
    def marks(ls: Column) -> Column:
        signs = F.transform(ls, lambda x, i: let(F.struct(
            T.may_be_heading(x["line"], x["next"]).alias("may"),
            (x["opens"] | (T.ends_sentence(F.get(ls, i - 1)["line"]) & T.is_upper(x["line"]))).alias("strong"),
        ), lambda t: F.when(t["may"] & t["strong"], "H").when(t["may"] & ~x["opens"], "B").otherwise("-")))
        chained = F.regexp_replace(F.concat(F.lit("-"), F.array_join(signs, "")), r"H|\GB", "H")
        return let(chained, lambda m: F.transform(ls, lambda x, i: F.struct(
            x["page"].alias("page"), x["line"].alias("line"), x["opens"].alias("opens"),
            F.when(~x["opens"], F.get(ls, i - 1)["line"]).alias("before"),
            (F.substring(m, i + 2, F.lit(1)) == "H").alias("heading"))))
    return let(lines, marks)


def paragraphs(lines: Column) -> Column:
    """Lines joined to paragraphs; a heading stands alone.

    Inside a block a line is glued by a space when the sentence before it is open or it
    starts lower case, else by a line feed; list items stay on their own line.
    """
    def build(ls: Column) -> Column:
        parts = F.transform(ls, lambda x, i: F.struct(
            x["page"].alias("page"), x["line"].alias("line"), x["heading"].alias("heading"),
            (x["opens"] | x["heading"] | F.coalesce(F.get(ls, i - 1)["heading"], F.lit(False))).alias("first"),
            F.when(T.is_list_marker(x["line"]), "\n")
             .when(~T.ends_sentence(x["before"]) | T.starts_lower_ascii(x["line"]), " ")
             .otherwise("\n").alias("glue")))

        def cut(ps: Column) -> Column:
            starts = F.filter(F.transform(ps, lambda p, i: F.when(p["first"], i)), lambda i: i.isNotNull())
            return let(starts, lambda st: F.transform(st, lambda s, k: F.struct(
                F.array_join(F.transform(
                    F.slice(ps, s + 1, F.coalesce(F.get(st, k + 1), F.size(ps)) - s),
                    lambda p, j: F.when(j == 0, p["line"]).otherwise(F.concat(p["glue"], p["line"]))), "").alias("text"),
                F.get(ps, s)["page"].alias("page_start"), F.get(ps, s)["page"].alias("page_end"),
                F.get(ps, s)["heading"].alias("heading"))))
        return let(parts, cut)
    return let(lines, build)


# --- merging ---------------------------------------------------------------------------

def _joined(ps: Column, starts: Column) -> Column:
    """Paragraphs merged from the positions in `starts` on, joined by a space."""
    return let(starts, lambda st: F.transform(st, lambda s, k: let(
        F.slice(ps, s + 1, F.coalesce(F.get(st, k + 1), F.size(ps)) - s), lambda run: F.struct(
            F.array_join(F.transform(run, lambda p: p["text"]), " ").alias("text"),
            F.get(ps, s)["page_start"].alias("page_start"),
            F.element_at(run, -1)["page_end"].alias("page_end"),
            F.get(ps, s)["heading"].alias("heading")))))


def merge_short(ps: Column, minimum: int = L.MIN_PARAGRAPH) -> Column:
    """A paragraph shorter than `minimum` takes the next one in, headings excepted."""
    def starts(arr: Column) -> Column:
        state = F.aggregate(
            F.transform(arr, lambda p, i: F.struct(
                i.alias("i"), F.length(p["text"]).alias("n"), p["heading"].alias("heading"))),
            F.struct(F.array().cast("array<int>").alias("starts"),
                     F.lit(minimum).alias("n"), F.lit(True).alias("heading")),
            lambda acc, p: F.when(
                (acc["n"] < minimum) & ~acc["heading"] & ~p["heading"],
                F.struct(acc["starts"].alias("starts"), (acc["n"] + 1 + p["n"]).alias("n"),
                         acc["heading"].alias("heading")),
            ).otherwise(F.struct(F.array_append(acc["starts"], p["i"]).alias("starts"),
                                 p["n"].alias("n"), p["heading"].alias("heading"))))
        return state["starts"]
    return let(ps, lambda arr: _joined(arr, starts(arr)))


def merge_continuations(ps: Column) -> Column:
    """A paragraph that starts lower case joins an open one before it, across pages too."""
    def starts(arr: Column) -> Column:
        return F.filter(F.transform(arr, lambda p, i: F.when(
            (i == 0) | p["heading"] | F.get(arr, i - 1)["heading"]
            | ~T.starts_lower_ascii(p["text"])
            | T.ends_sentence(F.get(arr, i - 1)["text"]), i)), lambda i: i.isNotNull())
    return let(ps, lambda arr: _joined(arr, starts(arr)))


# --- packing ---------------------------------------------------------------------------

def pack(ps: Column, size: int = L.CHUNK_SIZE, minimum: int = L.MIN_CHUNK) -> Column:
    """Greedy packing to chunks that stay inside a chapter.

    The fold only decides which paragraphs go together (positions, lengths, chapter); the
    texts are put together afterwards. An upper-case heading opens a chapter, another one a part of it.
    A buffer shorter than `minimum` is carried over a heading and dropped at a flush.
    """
    none = F.lit(None).cast("int")

    def path(chapter: Column, part: Column) -> Column:
        return F.concat(chapter, F.when((chapter != "") & (part != ""), " > ").otherwise(""), part)

    def flushed(acc: Column) -> Column:
        entry = F.struct(acc["first"].alias("first"), acc["last"].alias("last"), F.lit(False).alias("long"),
                         path(acc["chapter"], acc["part"]).alias("path"))
        return F.when(acc["width"] >= minimum, F.array_append(acc["out"], entry)).otherwise(acc["out"])

    def state(out, first, last, length, width, chapter, part) -> Column:
        return F.struct(out.alias("out"), first.alias("first"), last.alias("last"), length.alias("length"),
                        width.alias("width"), chapter.alias("chapter"), part.alias("part"))

    empty = F.array().cast("array<struct<first:int,last:int,long:boolean,path:string>>")
    zero = F.lit(0)

    def step(acc: Column, p: Column) -> Column:
        # a heading closes a buffer that is long enough, then names what follows
        def at_heading(a: Column) -> Column:
            closes = p["heading"] & (a["length"] >= minimum)
            chapter = F.when(p["heading"] & p["upper"], p["title"]).otherwise(a["chapter"])
            part = F.when(~p["heading"], a["part"]).when(p["upper"], "").otherwise(p["title"])
            return state(F.when(closes, flushed(a)).otherwise(a["out"]),
                         F.when(closes, none).otherwise(a["first"]), a["last"],
                         F.when(closes, zero).otherwise(a["length"]),
                         F.when(closes, zero).otherwise(a["width"]), chapter, part)

        def add(a: Column) -> Column:
            alone = F.struct(p["i"].alias("first"), p["i"].alias("last"), F.lit(True).alias("long"),
                             path(a["chapter"], a["part"]).alias("path"))
            over = (a["length"] > 0) & (a["length"] + p["n"] > size)
            return (
                F.when(p["n"] > 2 * size, state(
                    F.array_append(flushed(a), alone), none, none, zero, zero, a["chapter"], a["part"]))
                .when(over, state(flushed(a), p["i"], p["i"], p["n"], p["n"], a["chapter"], a["part"]))
                .otherwise(state(a["out"], F.coalesce(a["first"], p["i"]), p["i"], a["length"] + p["n"],
                                 a["width"] + p["n"] + F.when(a["length"] > 0, 2).otherwise(0),
                                 a["chapter"], a["part"])))
        return let(F.when(p["heading"], at_heading(acc)).otherwise(acc), add)

    def groups(arr: Column) -> Column:
        entries = F.transform(arr, lambda p, i: F.struct(
            i.alias("i"), F.length(p["text"]).alias("n"), p["heading"].alias("heading"),
            (p["heading"] & T.is_upper(p["text"])).alias("upper"),
            F.when(p["heading"], p["text"]).alias("title")))
        start = state(empty, none, none, zero, zero, F.lit(""), F.lit(""))
        end = F.aggregate(entries, start, step)
        return let(end, lambda acc: flushed(acc))

    def texts(arr: Column, g: Column) -> Column:
        first, last = F.get(arr, g["first"]), F.get(arr, g["last"])
        return let(
            F.when(g["long"], T.split_long(first["text"], size)).otherwise(F.array(F.array_join(
                F.transform(F.slice(arr, g["first"] + 1, g["last"] - g["first"] + 1), lambda p: p["text"]),
                "\n\n"))),
            lambda ts: F.transform(ts, lambda t: F.struct(
                t.alias("text"), first["page_start"].alias("page_start"),
                last["page_end"].alias("page_end"), g["path"].alias("hierarchy_path"))))

    return let(ps, lambda arr: F.flatten(F.transform(groups(arr), lambda g: texts(arr, g))))


def chunks(ps: Column, size: int = L.CHUNK_SIZE, minimum: int = L.MIN_CHUNK) -> Column:
    """All paragraphs of a tiny document as one chunk, else merged and packed ones."""
    def whole(arr: Column) -> Column:
        return F.array(F.struct(
            F.array_join(F.transform(arr, lambda p: p["text"]), "\n\n").alias("text"),
            F.get(arr, F.lit(0))["page_start"].alias("page_start"),
            F.element_at(arr, -1)["page_end"].alias("page_end"), F.lit("").alias("hierarchy_path")))

    def choose(arr: Column) -> Column:
        total = F.aggregate(arr, F.lit(0), lambda acc, p: acc + F.length(p["text"]))
        return (F.when(F.size(arr) == 0, F.array().cast(CHUNK))
                .when(total < minimum, whole(arr).cast(CHUNK))
                .otherwise(pack(merge_continuations(merge_short(arr)), size, minimum).cast(CHUNK)))
    return let(ps, choose)


# --- DataFrame level -------------------------------------------------------------------

def document_paragraphs(documents: DataFrame) -> DataFrame:
    """Adds `paragraphs` to rows with `pages`."""
    lines = let(F.col("pages"), lambda ps: let(T.repeated_lines(ps), lambda h: block_lines(ps, h)))
    return documents.withColumn("paragraphs", paragraphs(with_headings(lines)).cast(PARAGRAPH))


def passages(documents: DataFrame, size: int = L.CHUNK_SIZE, minimum: int = L.MIN_CHUNK) -> DataFrame:
    """One row per passage: (collection_id, doc_id, chunk_index, total_chunks, text, pages, path).

    Chunks of low quality are left out but counted: the numbers of the others keep the gaps.
    """
    packed = document_paragraphs(documents).select(
        "collection_id", "doc_id", chunks(F.col("paragraphs"), size, minimum).alias("chunks"))
    rows = packed.select(
        "collection_id", "doc_id", F.size("chunks").alias("total_chunks"),
        # the outer form keeps the optimizer from computing the chunks once more for a size filter
        F.posexplode_outer("chunks").alias("chunk_index", "chunk"))
    return (rows.filter(F.col("chunk_index").isNotNull())
            .select("collection_id", "doc_id", "chunk_index", "total_chunks", "chunk.*")
            .withColumn("text", T.valid_utf8(F.col("text")))
            .filter(~T.is_low_quality(F.col("text"))))


def passage_id(collection: Column, document: Column, index: Column) -> Column:
    """Deterministic: a re-run gives the same ids."""
    return F.sha2(F.concat_ws("/", collection, document.cast("string"), index.cast("string")), 256)


def enriched(rows: DataFrame) -> DataFrame:
    """Adds id, type, topics, title and summary to passage rows."""
    return (
        rows.withColumn("_title", T.title_candidate(F.col("text")))
        .withColumn("section_type", nlp.section_type(F.col("_title"), F.col("text")))
        .select(
            passage_id(F.col("collection_id"), F.col("doc_id"), F.col("chunk_index")).alias("passage_id"),
            "collection_id", "doc_id", "chunk_index", "total_chunks",
            T.title(F.col("_title"), F.col("section_type"), F.col("chunk_index")).alias("title"),
            "section_type", "text", T.summary(F.col("text")).alias("summary"),
            topics.mechanics(F.col("text")).alias("mechanics"),
            "page_start", "page_end", "hierarchy_path"))


def embed_text(path: Column, text: Column, prefix: str = "") -> Column:
    """What is embedded: the chapter, a line feed and the text, behind the model's prefix."""
    body = F.when(path != "", F.concat_ws("\n", path, text)).otherwise(text)
    return F.concat(F.lit(prefix), body)


def chapter_paths(lines: Column) -> Column:
    """array<struct<pos, line, path>> of the headings: part under the last upper-case chapter."""
    def paths(ls: Column) -> Column:
        heads = F.filter(F.transform(ls, lambda x, i: F.struct(
            (i + 1).alias("pos"), x["line"].alias("line"), x["heading"].alias("heading"),
            T.is_upper(x["line"]).alias("upper"))), lambda x: x["heading"])
        empty = F.array().cast("array<struct<pos:int,line:string,path:string>>")
        return F.aggregate(
            heads, F.struct(F.lit("").alias("chapter"), empty.alias("out")),
            lambda acc, h: F.struct(
                F.when(h["upper"], h["line"]).otherwise(acc["chapter"]).alias("chapter"),
                F.array_append(acc["out"], F.struct(
                    h["pos"].alias("pos"), h["line"].alias("line"),
                    F.when(h["upper"] | (acc["chapter"] == ""), h["line"]).otherwise(
                        F.concat(acc["chapter"], F.lit(" > "), h["line"])).alias("path"))).alias("out")),
            lambda acc: acc["out"])
    return let(lines, paths)
