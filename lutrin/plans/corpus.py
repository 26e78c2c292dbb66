"""Queries that turn documents into passages and describe them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions import nlp
from lutrin.functions import text as T
from lutrin.functions.text import let
from lutrin.operators import enrich, index, passages as P
from lutrin.plans import sql as S
from lutrin.plans.registry import query
from lutrin.plans.retrieval import stored_index
from lutrin.session import shared_folder
from lutrin.sources import files, generations
from lutrin.sources import tables as D

# --- pages and lines -------------------------------------------------------------------


@query("header_lines", f"""
    WITH {S.LINES}
    SELECT doc_id, {S.strip('line')} AS line FROM lines WHERE length({S.strip('line')}) BETWEEN 4 AND 80
    GROUP BY ALL HAVING count(*) >= 5""")
def header_lines(spark, folder):
    docs = D.documents(spark, folder)
    return docs.select("doc_id", F.explode(T.repeated_lines(F.col("pages"))).alias("line"))


@query("clean_lines", f"""
    WITH {S.PAGES}, p AS (SELECT doc_id, source AS collection_id, page_no, text FROM doc_pages),
    {S.cleaned_lines('p')}
    SELECT doc_id, page_no, text FROM clean_pages""")
def clean_lines(spark, folder):
    docs = D.documents(spark, folder)
    cleaned = let(F.col("pages"), lambda ps: let(T.repeated_lines(ps), lambda h: F.transform(ps, lambda p: F.struct(
        p["page_no"].cast("long").alias("page_no"), T.without_layout_noise(p["text"], h).alias("text")))))
    return (docs.select("doc_id", F.explode(cleaned).alias("p")).select("doc_id", "p.*")
            .filter(F.col("text") != ""))


# Conversations glued with form feeds: every turn is a page, with a hyphenated line and a page number.
PAGE_TEXT = f"text || ' fin-' || {S.NL} || 'ale   de' || chr(9) || 'page' || {S.NL} || {S.NL} || {S.NL} || {S.NL} || '- ' || turn || ' -' || {S.NL}"
KEPT_PAGE_LINES = f"""list_filter(list_transform(string_split(regexp_replace({S.strip('raw')},
    '(\\p{{L}})-[ \\t]*\\n[ \\t]*(\\p{{Ll}})', '\\1\\2', 'g'), {S.NL}), lambda l: {S.strip('l')}),
    lambda l: l = '' OR NOT {S.page_number('l')})"""


@query("page_split", f"""
    WITH raw AS (
        SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '' ELSE {PAGE_TEXT} END, chr(12) ORDER BY turn) AS whole
        FROM conversations GROUP BY conv_id),
    cut AS (
        SELECT conv_id, unnest(string_split(whole, chr(12))) AS raw,
               generate_subscripts(string_split(whole, chr(12)), 1) AS page_no FROM raw),
    cleaned AS (
        SELECT conv_id, page_no, {S.strip(f"regexp_replace(array_to_string(list_transform({KEPT_PAGE_LINES}, lambda l: regexp_replace(l, '[ \\t]+', ' ', 'g')), {S.NL}), '\\n{{3,}}', {S.NL} || {S.NL}, 'g')")} AS text
        FROM cut)
    SELECT conv_id, page_no, text FROM cleaned WHERE text <> ''""")
def page_split(spark, folder):
    turns = D.table(spark, folder, "conversations")
    page = F.concat(F.col("text"), F.lit(" fin-\nale   de\tpage\n\n\n\n- "), F.col("turn").cast("string"), F.lit(" -\n"))
    glued = (turns.select("conv_id", "turn", F.when(F.col("role") == "system", "").otherwise(page).alias("page"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "page"))).alias("p"))
             .select("conv_id", F.array_join("p.page", "\f").alias("text")))
    return (glued.select("conv_id", F.explode(T.split_pages(F.col("text"))).alias("p"))
            .select("conv_id", F.col("p.page_no").cast("long").alias("page_no"), "p.text"))


@query("source_inventory", f"""
    WITH {S.PAGES}, sizes AS (
        SELECT source AS collection_id, doc_id, count(*) AS n_pages, sum(length(text)) AS n_chars FROM doc_pages GROUP BY ALL)
    SELECT collection_id, count(*) AS n_files, sum(n_pages)::BIGINT AS n_pages, sum(n_chars)::BIGINT AS n_chars,
           count(*) FILTER (n_chars = 0) AS n_empty FROM sizes GROUP BY ALL""")
def source_inventory(spark, folder):
    docs = D.documents(spark, folder)
    chars = F.aggregate("pages", F.lit(0), lambda acc, p: acc + F.length(p["text"]))
    return (docs.select("collection_id", F.size("pages").alias("n"), chars.alias("c"))
            .groupBy("collection_id").agg(
                F.count("*").alias("n_files"), F.sum("n").alias("n_pages"), F.sum("c").alias("n_chars"),
                F.count_if(F.col("c") == 0).alias("n_empty")))


# --- chapters and chunks ---------------------------------------------------------------

# Web pages without tags: every tag is a line break, so titles and list entries become short lines.
WEB_PAGES = f"""web AS (
    SELECT page_id AS doc_id, 'web' AS collection_id, 1 AS page_no,
           {S.strip(f"regexp_replace(html, '<[^>]*>', {S.NL}, 'g')")} AS text FROM pages)"""


@query("headings_chapters", f"""
    WITH {WEB_PAGES}, {S.headings('web')}, levels AS (
        SELECT doc_id, pos, line, {S.upper_text('line')} AS is_up FROM headed WHERE heading),
    filled AS (
        SELECT *, sum(is_up::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter_no,
               last_value(CASE WHEN is_up THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter
        FROM levels)
    SELECT doc_id, pos, line, CASE WHEN chapter IS NOT NULL AND NOT is_up THEN chapter || ' > ' || line ELSE line END AS path
    FROM filled""")
def headings_chapters(spark, folder):
    pages = D.table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), T.strip(F.regexp_replace("html", "<[^>]*>", "\n")).alias("text"))
    docs = pages.select("doc_id", F.array(F.struct(F.lit(1).alias("page_no"), F.col("text"))).alias("pages"))
    lines = let(F.col("pages"), lambda ps: let(T.repeated_lines(ps), lambda h: P.block_lines(ps, h)))
    marked = docs.select("doc_id", P.with_headings(lines).alias("lines"))
    return (marked.select("doc_id", F.explode(P.chapter_paths(F.col("lines"))).alias("h"))
            .select("doc_id", F.col("h.pos").cast("long").alias("pos"), "h.line", "h.path"))


CHUNK_COLUMNS = "collection_id, doc_id, chunk_index, total_chunks, text, page_start, page_end, hierarchy_path"
PLAIN_PAGES = "p AS (SELECT doc_id, source AS collection_id, page_no, text FROM doc_pages)"


def _long_numbers(df):
    wanted = {"chunk_index", "total_chunks", "page_start", "page_end"}
    return df.select(*[F.col(c).cast("long").alias(c) if c in wanted else F.col(c) for c in df.columns])


@query("chunks", f"""
    WITH RECURSIVE {S.PAGES}, {PLAIN_PAGES}, {S.chunks('p')}
    SELECT {CHUNK_COLUMNS} FROM chunks""")
def chunks(spark, folder):
    return _long_numbers(P.passages(D.documents(spark, folder)))


# The same documents with a chapter line on every page and a part line on every other page.
CHAPTER_PAGES = f"""p AS (
    SELECT doc_id, source AS collection_id, page_no,
           CASE WHEN page_no % 2 = 1 THEN 'PARTIE ' || page_no || {S.NL} ELSE '' END
           || 'Section ' || source || ' ' || page_no || {S.NL} || text AS text FROM doc_pages)"""


def _chapter_documents(spark, folder):
    docs = D.documents(spark, folder)
    return docs.withColumn("pages", F.transform("pages", lambda p: F.struct(
        p["page_no"].alias("page_no"), F.concat(
            F.when(p["page_no"] % 2 == 1, F.concat(F.lit("PARTIE "), p["page_no"].cast("string"), F.lit("\n"))).otherwise(""),
            F.lit("Section "), F.col("collection_id"), F.lit(" "), p["page_no"].cast("string"), F.lit("\n"),
            p["text"]).alias("text"))))


@query("chunks_in_chapters", f"""
    WITH RECURSIVE {S.PAGES}, {CHAPTER_PAGES}, {S.chunks('p')}
    SELECT {CHUNK_COLUMNS} FROM chunks""")
def chunks_in_chapters(spark, folder):
    return _long_numbers(P.passages(_chapter_documents(spark, folder)))


@query("passage_index", f"""
    WITH RECURSIVE {S.PAGES}, {CHAPTER_PAGES}, {S.chunks('p')}, described AS (
        SELECT *, {S.title_candidate('text')} AS candidate FROM chunks),
    typed AS (SELECT *, {S.section_type("lower(coalesce(candidate, '') || ' ' || left(text, 200))")} AS section_type FROM described)
    SELECT sha256(collection_id || '/' || doc_id || '/' || chunk_index) AS passage_id, collection_id, doc_id, chunk_index,
           {S.title('candidate', 'section_type', 'chunk_index')} AS title, section_type, {S.summary('text')} AS summary,
           array_to_string({S.mechanics('text')}, ' ') AS mechanics, page_start, page_end, hierarchy_path,
           CASE WHEN hierarchy_path <> '' THEN 'passage: ' || hierarchy_path || {S.NL} || text ELSE 'passage: ' || text END AS embed_text
    FROM typed""")
def passage_index(spark, folder):
    rows = P.enriched(P.passages(_chapter_documents(spark, folder)))
    return _long_numbers(rows.select(
        "passage_id", "collection_id", "doc_id", "chunk_index", "title", "section_type", "summary",
        F.array_join("mechanics", " ").alias("mechanics"), "page_start", "page_end", "hierarchy_path",
        P.embed_text(F.col("hierarchy_path"), F.col("text"), "passage: ").alias("embed_text")))


@query("postings", f"""
    WITH {S.PASSAGES}, fields AS (
        SELECT collection_id, passage_id, 'A' AS field, unnest({S.text_stems('title')}) AS stem FROM passages
        UNION ALL SELECT collection_id, passage_id, 'B', unnest({S.text_stems('hierarchy_path')}) FROM passages
        UNION ALL SELECT collection_id, passage_id, 'C', unnest({S.text_stems('text')}) FROM passages)
    SELECT collection_id, passage_id, field, stem, count(*) AS tf,
           round(CASE field WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.4 ELSE 0.2 END * count(*) / (count(*) + 1), 6) AS weight
    FROM fields GROUP BY collection_id, passage_id, field, stem""")
def postings(spark, folder):
    rows = index.postings(D.page_passages(spark, folder))
    return rows.select("collection_id", "passage_id", "field", "stem", F.col("tf").cast("long").alias("tf"),
                       F.round("weight", 6).alias("weight"))


# --- analysis of whole texts -----------------------------------------------------------

@query("low_quality", f"""
    SELECT d.doc_id, {S.low_quality('text')} AS low_quality, coalesce(l.quality, -1)::BIGINT AS quality
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def low_quality(spark, folder):
    docs, labels = D.texts(spark, folder), D.table(spark, folder, "labels")
    return (docs.select("doc_id", T.is_low_quality(F.col("text")).alias("low_quality"))
            .join(labels.select("doc_id", "quality"), "doc_id", "left")
            .withColumn("quality", F.coalesce("quality", F.lit(-1)).cast("long")))


@query("section_types", f"SELECT doc_id, {S.section_type('lower(left(text, 200))')} AS section_type FROM documents")
def section_types(spark, folder):
    return D.texts(spark, folder).select(
        "doc_id", nlp.section_type(None, F.col("text")).alias("section_type"))


def _label(tag: str) -> str:
    whens = " ".join(f"WHEN '{t}' THEN {S.text(label)}" for t, (label, _) in L.MECHANICS.items())
    return f"(CASE {tag} {whens} END)"


@query("mechanics", f"""
    WITH tagged AS (SELECT doc_id, unnest({S.mechanics('text')}) AS tag FROM documents)
    SELECT doc_id, tag, {_label('tag')} AS label FROM tagged""")
def mechanics(spark, folder):
    return (D.texts(spark, folder)
            .select("doc_id", F.explode(nlp.mechanics(F.col("text"))).alias("tag"))
            .withColumn("label", nlp.mechanic_label(F.col("tag"))))


@query("keywords", f"""
    WITH {S.first_terms('kw', 'documents', 'doc_id', S.fold('text'), S.KEYWORD)}
    SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS keywords
    FROM documents d LEFT JOIN kw USING (doc_id) GROUP BY d.doc_id""")
def keywords(spark, folder):
    return D.texts(spark, folder).select(
        "doc_id", F.array_join(nlp.keywords(F.col("text")), " ").alias("keywords"))


@query("search_terms", f"""
    WITH {S.first_terms('st', 'conversations', 'conv_id, turn', 'lower(text)', S.SEARCH_TERM)}
    SELECT c.conv_id, c.turn, coalesce(string_agg(w, ' ' ORDER BY i), '') AS terms,
           coalesce(string_agg(w, ' or ' ORDER BY i) FILTER (i <= 8), any_value(c.text)) AS query_text
    FROM conversations c LEFT JOIN st USING (conv_id, turn) GROUP BY c.conv_id, c.turn""")
def search_terms(spark, folder):
    return D.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.array_join(nlp.search_terms(F.col("text")), " ").alias("terms"),
        nlp.query_text(F.col("text")).alias("query_text"))


@query("titles_summaries", f"""
    WITH {S.PAGES}, described AS (SELECT *, {S.title_candidate('text')} AS candidate FROM doc_pages),
    typed AS (SELECT *, {S.section_type("lower(coalesce(candidate, '') || ' ' || left(text, 200))")} AS section_type FROM described)
    SELECT doc_id, page_no, section_type, {S.title('candidate', 'section_type', '(page_no - 1)')} AS title,
           {S.summary('text')} AS summary, len({S.sentences('text')})::BIGINT AS n_sentences FROM typed""")
def titles_summaries(spark, folder):
    rows = D.texts(spark, folder).select(
        "doc_id", F.explode(T.pages_of_lines(F.col("text"))).alias("p")).select("doc_id", "p.*")
    titled = rows.withColumn("candidate", T.title_candidate(F.col("text"))).withColumn(
        "section_type", nlp.section_type(F.col("candidate"), F.col("text")))
    return titled.select(
        "doc_id", F.col("page_no").cast("long").alias("page_no"), "section_type",
        T.title(F.col("candidate"), F.col("section_type"), F.col("page_no") - 1).alias("title"),
        T.summary(F.col("text")).alias("summary"), F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


# --- facts about collections -----------------------------------------------------------

# Pages that also name players, minutes and an age, in turns.
FACT_TEXT = """text || CASE WHEN doc_id % 3 = 0 THEN ' De ' || (doc_id % 4 + 1) || ' à ' || (doc_id % 4 + 3) || ' joueurs.'
    WHEN doc_id % 3 = 1 THEN ' Pour ' || (doc_id % 5 + 1) || ' joueurs, ' || (doc_id % 60 + 15) || ' minutes.'
    ELSE ' Durée 30-' || (doc_id % 60 + 31) || ' min, à partir de ' || (doc_id % 10 + 6) || ' ans.' END"""
FACT_PASSAGES = f"""{S.PAGES}, passages AS (
    SELECT source AS collection_id, doc_id, page_no - 1 AS chunk_index, {FACT_TEXT} AS text FROM doc_pages)"""


def _fact_passages(spark, folder):
    rows = D.texts(spark, folder).select(
        F.col("source").alias("collection_id"), "doc_id", F.explode(T.pages_of_lines(F.col("text"))).alias("p"))

    def plus(n: int, m: int) -> F.Column:
        return (F.col("doc_id") % n + m).cast("string")

    tail = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" De "), plus(4, 1), F.lit(" à "), plus(4, 3), F.lit(" joueurs.")))
            .when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" Pour "), plus(5, 1), F.lit(" joueurs, "), plus(60, 15), F.lit(" minutes.")))
            .otherwise(F.concat(F.lit(" Durée 30-"), plus(60, 31), F.lit(" min, à partir de "), plus(10, 6), F.lit(" ans."))))
    return rows.select("collection_id", "doc_id", (F.col("p.page_no") - 1).cast("int").alias("chunk_index"),
                       F.concat(F.col("p.text"), tail).alias("text"))


def _extract(pattern: str, group: int) -> str:
    return f"try_cast(nullif(regexp_extract(text, {S.text(pattern)}, {group}), '') AS BIGINT)"


def _either(both: str, single: str, group: int) -> str:
    return (f"CASE WHEN regexp_matches(text, {S.text(both)}) THEN {_extract(both, group)} "
            f"WHEN regexp_matches(text, {S.text(single)}) THEN {_extract(single, 1)} END")


@query("collection_meta", f"""
    WITH {FACT_PASSAGES}, first_five AS (
        SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY doc_id, chunk_index) AS place
        FROM passages QUALIFY place <= 5),
    facts AS (
        SELECT collection_id, place, {_either(L.PLAYERS_RANGE, L.PLAYERS_SINGLE, 1)} AS p1,
               {_either(L.PLAYERS_RANGE, L.PLAYERS_SINGLE, 2)} AS p2,
               {_either(L.MINUTES_RANGE, L.MINUTES_SINGLE, 1)} AS m1,
               {_either(L.MINUTES_RANGE, L.MINUTES_SINGLE, 2)} AS m2, {_extract(L.AGE, 1)} AS age FROM first_five)
    SELECT collection_id, coalesce(arg_min(p1, place) FILTER (p1 IS NOT NULL), -1) AS players_min,
           coalesce(arg_min(p2, place) FILTER (p1 IS NOT NULL), -1) AS players_max,
           coalesce(arg_min(m1, place) FILTER (m1 IS NOT NULL), -1) AS duration_min,
           coalesce(arg_min(m2, place) FILTER (m1 IS NOT NULL), -1) AS duration_max,
           coalesce(arg_min(age, place) FILTER (age IS NOT NULL), -1) AS age_min
    FROM facts GROUP BY collection_id""")
def collection_meta(spark, folder):
    facts = enrich.collection_facts(_fact_passages(spark, folder))
    return facts.select("collection_id", *[
        F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c)
        for c in ("players_min", "players_max", "duration_min", "duration_max", "age_min")])


# Pages that open with words of the four buckets, in turns.
OPENINGS = ["Mise en place. ", "Tour de jeu. ", "Fin de partie. ", "Chaque manche compte. ", ""]
BUCKET_TEXT = "CASE doc_id % 5 " + " ".join(
    f"WHEN {i} THEN {S.text(o)}" for i, o in enumerate(OPENINGS)) + " END || text"
BUCKET_PASSAGES = f"""{S.PAGES}, passages AS (
    SELECT source AS collection_id, doc_id, page_no - 1 AS chunk_index, {BUCKET_TEXT} AS text FROM doc_pages)"""
FIRST_150 = """first_passages AS (
    SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY doc_id, chunk_index) AS place
    FROM passages QUALIFY place <= 150)"""


def _bucket_passages(spark, folder):
    rows = D.texts(spark, folder).select(
        F.col("source").alias("collection_id"), "doc_id", F.explode(T.pages_of_lines(F.col("text"))).alias("p"))
    opening = F.element_at(F.array(*[F.lit(o) for o in OPENINGS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return rows.select("collection_id", "doc_id", (F.col("p.page_no") - 1).cast("int").alias("chunk_index"),
                       F.concat(opening, F.col("p.text")).alias("text"))


@query("gameplay_buckets", f"""
    WITH {BUCKET_PASSAGES}, {FIRST_150}, typed AS (
        SELECT *, {S.section_type('lower(left(text, 200))')} AS kind,
               regexp_matches({S.fold('text')}, '{L.ROUND_PATTERN}') AS round_named FROM first_passages),
    bucketed AS (
        SELECT collection_id, place, text, 'setup' AS bucket FROM typed WHERE kind = 'setup'
        UNION ALL SELECT collection_id, place, text, 'turns' FROM typed WHERE kind = 'turn'
        UNION ALL SELECT collection_id, place, text, 'end_game' FROM typed WHERE kind = 'end'
        UNION ALL SELECT collection_id, place, text, 'rounds' FROM typed WHERE kind <> 'setup' AND round_named),
    few AS (
        SELECT *, row_number() OVER (PARTITION BY collection_id, bucket ORDER BY place) AS position
        FROM bucketed QUALIFY position <= 3),
    parts AS (
        SELECT *, list_reduce({S.sentences('text')}, lambda acc, s: {{
            'text': CASE WHEN acc.shut OR length(acc.text) + length(s) + 2 > 350 THEN acc.text
                         ELSE acc.text || CASE WHEN acc.text <> '' THEN ' ' ELSE '' END || s || '.' END,
            'shut': acc.shut OR length(acc.text) + length(s) + 2 > 350}}, {{'text': '', 'shut': false}}).text AS part FROM few),
    joined AS (
        SELECT collection_id, bucket, string_agg(nullif(part, ''), {S.NL} || {S.NL} ORDER BY position) AS description,
               string_agg(text, ' ' ORDER BY position) AS texts FROM parts GROUP BY ALL),
    {S.first_terms('kw', 'joined', 'collection_id, bucket', S.fold('texts'), S.KEYWORD)},
    picked AS (SELECT collection_id, bucket, string_agg(w, ' ' ORDER BY i) AS keywords FROM kw WHERE i <= 12 GROUP BY ALL)
    SELECT collection_id, bucket, CASE bucket {' '.join(f"WHEN '{k}' THEN {S.text(v)}" for k, v in L.BUCKET_TITLES.items())} END AS title,
           {S.truncated("coalesce(description, '')", 700)} AS description,
           coalesce(keywords, '') AS keywords FROM joined LEFT JOIN picked USING (collection_id, bucket)""")
def gameplay_buckets(spark, folder):
    return enrich.gameplay_sections(_bucket_passages(spark, folder)).withColumn("keywords", F.array_join("keywords", " "))


def _evidence(tag: str, keywords_: list[str]) -> str:
    hit = " OR ".join(f"contains({S.fold('s')}, {S.text(T.folded_literal(k))})" for k in keywords_)
    return f"SELECT collection_id, place, '{tag}' AS tag, list_filter(sents, lambda s: {hit})[1] AS sentence FROM split_up"


@query("mechanic_evidence", f"""
    WITH {BUCKET_PASSAGES}, {FIRST_150}, split_up AS (
        SELECT collection_id, place, {S.sentences('text')} AS sents FROM first_passages),
    found AS ({' UNION ALL '.join(_evidence(t, k) for t, (_, k) in L.MECHANICS.items())})
    SELECT collection_id, tag, {_label('tag')} AS label,
           arg_min({S.truncated('sentence', 200)}, place) AS description
    FROM found WHERE sentence IS NOT NULL GROUP BY collection_id, tag""")
def mechanic_evidence(spark, folder):
    return enrich.mechanic_evidence(_bucket_passages(spark, folder))


# Numbered lists made of the lines of a page, every other line a bulleted step.
LIST_PASSAGES = f"""{S.LINES}, listed AS (
    SELECT source, doc_id, (i - 1) // 20 AS chunk_index, i,
           CASE WHEN i % 2 = 1 THEN ((i - 1) % 20) // 2 + 1 || '. ' || line ELSE '- ' || line END AS line FROM lines),
    passages AS (
        SELECT source AS collection_id, doc_id, chunk_index, string_agg(line, {S.NL} ORDER BY i) AS text
        FROM listed GROUP BY ALL)"""


@query("phases", f"""
    WITH {LIST_PASSAGES}, {FIRST_150}, wanted AS (
        SELECT * FROM first_passages WHERE {S.section_type('lower(left(text, 200))')} NOT IN ('end', 'scoring', 'component')),
    item_lines AS (
        SELECT collection_id, place, unnest(string_split(text, {S.NL})) AS line,
               generate_subscripts(string_split(text, {S.NL}), 1) AS k FROM wanted),
    items AS (
        SELECT collection_id, place, k, try_cast(regexp_extract(line, '^\\s*(\\d+)[.)]\\s+(.{{5,200}})', 1) AS INT) AS nr,
               {S.strip("regexp_extract(line, '^\\s*(\\d+)[.)]\\s+(.{5,200})', 2)")} AS name
        FROM item_lines WHERE regexp_matches(line, '^\\s*(\\d+)[.)]\\s+(.{{5,200}})')),
    -- the first line that carries the number, long enough or not, opens its steps
    openers AS (
        SELECT collection_id, place, try_cast(regexp_extract(line, '^\\s*(\\d+)[.)]\\s', 1) AS INT) AS nr, min(k) AS at
        FROM item_lines WHERE regexp_matches(line, '^\\s*(\\d+)[.)]\\s') GROUP BY ALL),
    first_items AS (SELECT collection_id, place, nr, arg_min(name, k) AS name FROM items WHERE nr > 0 GROUP BY ALL),
    counts AS (SELECT collection_id, place, count(*) AS n_lines FROM items GROUP BY ALL HAVING count(*) >= 2),
    sized AS (SELECT collection_id, place, count(*) AS n FROM first_items JOIN counts USING (collection_id, place) GROUP BY ALL),
    best AS (SELECT collection_id, place FROM sized QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY n DESC, place) = 1),
    bounds AS (
        SELECT f.*, o.at, (SELECT min(n.at) FROM openers n JOIN first_items g ON g.collection_id = n.collection_id
                           AND g.place = n.place AND g.nr = n.nr WHERE n.collection_id = f.collection_id
                           AND n.place = f.place AND n.nr = f.nr + 1 AND n.at > o.at) AS until
        FROM first_items f JOIN best USING (collection_id, place)
        JOIN openers o ON o.collection_id = f.collection_id AND o.place = f.place AND o.nr = f.nr),
    steps AS (
        SELECT b.collection_id, b.place, b.nr,
               string_agg({S.strip("regexp_extract(l.line, '^\\s*[-•*–]\\s+(.{3,100})', 1)")}, ' / ' ORDER BY l.k) AS steps
        FROM bounds b JOIN item_lines l ON l.collection_id = b.collection_id AND l.place = b.place
             AND l.k >= b.at AND l.k < coalesce(b.until, 1000000)
        WHERE regexp_matches(l.line, '^\\s*[-•*–]\\s+(.{{3,100}})') GROUP BY ALL)
    SELECT b.collection_id, b.nr::BIGINT AS phase, {S.truncated('b.name', 90)} AS name, coalesce(s.steps, '') AS steps
    FROM bounds b LEFT JOIN steps s USING (collection_id, place, nr)
    QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY nr) <= 15""")
def phases(spark, folder):
    docs = D.texts(spark, folder)
    marked = F.transform(F.split("text", "\n"), lambda l, i: F.when(
        i % 2 == 0, F.concat((F.floor((i % 20) / 2) + 1).cast("string"), F.lit(". "), l)).otherwise(F.concat(F.lit("- "), l)))
    rows = (docs.select(F.col("source").alias("collection_id"), "doc_id", F.array_join(marked, "\n").alias("t"))
            .select("collection_id", "doc_id", F.explode(T.pages_of_lines(F.col("t"))).alias("p"))
            .select("collection_id", "doc_id", (F.col("p.page_no") - 1).cast("int").alias("chunk_index"), "p.text"))
    return (enrich.phases(rows).select("collection_id", F.explode("phases").alias("p"))
            .select("collection_id", F.col("p.order").cast("long").alias("phase"), "p.name",
                    F.array_join("p.steps", " / ").alias("steps")))


@query("reference_pages", f"""
    WITH raw AS (SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS whole, min(role) AS first_role FROM conversations GROUP BY conv_id)
    SELECT conv_id AS doc_id, generate_subscripts(string_split(whole, chr(12)), 1) AS page_no,
           {S.comparable("unnest(string_split(whole, chr(12)))")} AS text FROM raw""")
def reference_pages(spark, folder):
    """Whole conversations cut at form feeds again, every page in comparable form."""
    glued = (D.table(spark, folder, "conversations").groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
             .select(F.lit("c").alias("collection_id"), F.col("conv_id").alias("doc_id"), F.array_join("p.text", "\f").alias("text")))
    return files.reference_pages(glued).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "text")


# --- derived columns, vectors and sinks ------------------------------------------------

@query("backfilled_lengths", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE -1 END AS n_chars FROM documents""")
def backfilled_lengths(spark, folder):
    """A derived column computed only where it is still null."""
    docs = D.texts(spark, folder).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 1, F.lit(-1).cast("long")).alias("n_chars"))
    return index.backfill(docs, "n_chars", F.length("text").cast("long")).select("doc_id", "n_chars")


@query("refreshed_postings", f"""
    WITH {S.PASSAGES}, changed AS (
        SELECT collection_id, passage_id, title, hierarchy_path,
               CASE WHEN page_start % 2 = 0 THEN 'nouvelle règle ' || text ELSE text END AS text FROM passages),
    fields AS (
        SELECT collection_id, passage_id, 'A' AS field, unnest({S.text_stems('title')}) AS stem FROM changed
        UNION ALL SELECT collection_id, passage_id, 'B', unnest({S.text_stems('hierarchy_path')}) FROM changed
        UNION ALL SELECT collection_id, passage_id, 'C', unnest({S.text_stems('text')}) FROM changed)
    SELECT collection_id, passage_id, field, stem, count(*) AS tf FROM fields GROUP BY collection_id, passage_id, field, stem""")
def refreshed_postings(spark, folder):
    """The stored index after some passages changed: a segment with their postings and a mark on the earlier ones."""
    passages, postings = stored_index(spark, folder)
    edited = F.col("page_start") % 2 == 0
    new = passages.withColumn("text", F.when(edited, F.concat(F.lit("nouvelle règle "), F.col("text"))).otherwise(F.col("text")))
    root = f"{shared_folder(spark)}/lutrin-{uuid.uuid4().hex}/postings"
    generations.commit(spark, root, postings)
    index.update_postings(new, passages.filter(edited).select("passage_id"), root)
    rows = generations.read(spark, root)
    return rows.select("collection_id", "passage_id", "field", "stem", F.col("tf").cast("long").alias("tf"))


@query("dimension_rejects", """
    SELECT vec_id, vec_id % 64 AS size, vec_id % 64 = 63 AS searchable FROM embeddings WHERE embedding IS NOT NULL""")
def dimension_rejects(spark, folder):
    """Vectors of many sizes: those that a search over 63 dimensions takes, and the table of the others."""
    rows = D.table(spark, folder, "embeddings").filter(F.col("embedding").isNotNull()).select(
        "vec_id", F.slice("embedding", F.lit(1), (F.col("vec_id") % 64).cast("int")).alias("embedding"))
    fits, others = index.split_by_dimension(rows, 63)
    size = F.size("embedding").cast("long").alias("size")
    return fits.select("vec_id", size, F.lit(True).alias("searchable")).unionByName(others.select("vec_id", size, F.lit(False).alias("searchable")))


@query("failed_embeddings", f"""
    WITH {S.PASSAGES} SELECT passage_id, length(text) % 3 <> 0 AS embedded,
        CASE WHEN length(text) % 3 = 0 THEN 'ValueError: no vector for ' || length(text) || ' letters' ELSE '' END AS error FROM passages""")
def failed_embeddings(spark, folder):
    """An embedder that raises on some texts: every passage stays, with an error of its own where it failed."""
    def embed(texts):
        for n in texts.str.len():
            if n % 3 == 0:
                raise ValueError(f"no vector for {n} letters")
        return [[float(n)] for n in texts.str.len()]
    rows = index.with_guarded_embedding(D.page_passages(spark, folder), F.col("text"), embed, dimensions=1)
    return rows.select("passage_id", F.col("embedding").isNotNull().alias("embedded"), F.coalesce("embedding_error", F.lit("")).alias("error"))


@query("empty_gameplay", f"""
    WITH {BUCKET_PASSAGES}, {FIRST_150} SELECT collection_id, count(*) > 0 AND
        bool_and(NOT ({S.section_type('lower(left(text, 200))')} IN ('setup', 'turn', 'end') OR regexp_matches({S.fold('text')}, '{L.ROUND_PATTERN}'))) AS no_bucket
    FROM first_passages GROUP BY collection_id""")
def empty_gameplay(spark, folder):
    """Which collections have no gameplay bucket at all, over the one row per collection."""
    passages = _bucket_passages(spark, folder)
    rows = enrich.gameplay(passages)
    missing = rows.select("collection_id", *L.BUCKET_TITLES).withColumn("mechanics", F.lit(None).cast("array<string>")).withColumn(
        "phases", F.lit(None).cast("array<string>")).select("collection_id", enrich.is_empty_gameplay().alias("e"))
    return (passages.select("collection_id").distinct().join(missing, "collection_id", "left")
            .select("collection_id", F.coalesce("e", F.lit(True)).alias("no_bucket")))


@query("result_sink", "SELECT item_id, text, length(text) AS n FROM benchmark")
def result_sink(spark, folder):
    """Evaluation rows written as JSON and read back."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    rows = D.table(spark, folder, "benchmark").select("item_id", "text", F.length("text").cast("long").alias("n"))
    files.write_results(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("file_documents", """
    WITH files AS (SELECT lang AS collection_id, count(*) AS n_files, sum(length(trim(text, chr(10) || ' '))) AS n_chars FROM documents GROUP BY lang)
    SELECT collection_id, n_files, n_chars::BIGINT AS n_chars FROM files""")
def file_documents(spark, folder):
    """Document texts written as one file each, listed and read back by extension."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = D.texts(spark, folder).select(F.col("lang").alias("collection_id"), "doc_id", "text")
    files.write_texts(docs, path)
    documents, _ = files.read_documents(spark, path)
    listed = files.list_files(spark, path).select("collection_id", F.col("name").alias("doc_id"))
    sizes = documents.select("collection_id", "doc_id", F.aggregate("pages", F.lit(0), lambda acc, p: acc + F.length(p["text"])).alias("n"))
    both = listed.join(sizes, ["collection_id", "doc_id"], "left").select(files.collection_of(F.col("collection_id")).alias("collection_id"), "n")
    return both.groupBy("collection_id").agg(F.count("*").alias("n_files"), F.sum("n").cast("long").alias("n_chars"))
