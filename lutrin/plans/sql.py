"""Building blocks of the comparison SQL (written for DuckDB), apart from the Spark code."""

from __future__ import annotations

from lutrin.functions import lexicon as L

NL = "chr(10)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {text(L.SPACE)})"


SPACES = r"'[\s\x0B\x{85}\p{Z}]+'"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, {SPACES}, ' ', 'g')")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {SPACES}), lambda w: w <> '')"


def terms(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


def fold(x: str) -> str:
    return f"translate(lower({x}), {text(L.ACCENTED)}, {text(L.UNACCENTED)})"


def comparable(x: str) -> str:
    return squeeze(f"lower(translate({x}, {text(L.TYPOGRAPHIC)}, {text(L.PLAIN)}))")


def comparable_answer(x: str) -> str:
    return comparable(f"regexp_replace(replace({x}, '_', ' '), '[*`#]', '', 'g')")


def truncated(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '…' ELSE {x} END"


def letters(x: str) -> str:
    return rf"length(regexp_replace({x}, '\P{{L}}', '', 'g'))"


def last_sign(x: str) -> str:
    return f"right(rtrim({x}, ' ' || chr(9)), 1)"


def first_sign(x: str) -> str:
    return f"left(ltrim({x}, ' ' || chr(9)), 1)"


def ends_sentence(x: str) -> str:
    return f"({last_sign(x)} IN ('.', '!', '?', ':', ';'))"


def starts_lower(x: str) -> str:
    return f"({first_sign(x)} BETWEEN 'a' AND 'z')"


def list_marker(x: str) -> str:
    return f"regexp_matches({x}, '^([-•*–—]|[0-9][.)])')"


def upper_text(x: str) -> str:
    return f"({letters(x)} >= 3 AND upper({x}) = {x})"


def may_be_heading(line: str, following: str) -> str:
    return rf"""(length({line}) BETWEEN 3 AND 60 AND regexp_matches({line}, '^[\p{{Lu}}\p{{Nd}}]')
        AND (NOT {list_marker(line)} OR {upper_text(line)}) AND NOT contains({line}, ':')
        AND {last_sign(line)} NOT IN ('.', ',', ';', '!', '?') AND {letters(line)} >= 3
        AND NOT coalesce(regexp_matches({first_sign(following)}, '^\p{{Ll}}'), false))"""


def contents_line(t: str) -> str:
    return (f"(length({t}) BETWEEN 1 AND 120 AND regexp_matches(rtrim({t}), '[0-9]$') "
            f"AND regexp_matches({t}, '[._·…]'))")


def page_number(t: str) -> str:
    return (f"((regexp_matches({t}, '^[0-9 \\t]*[0-9][0-9 \\t]*$') AND length({t}) <= 5) "
            f"OR regexp_matches({t}, '^[-–— \\t]*[0-9]{{1,4}}[-–— \\t]*$'))")


def low_quality(x: str) -> str:
    sample = f"list_slice({words(x)}, 1, 30)"
    clean = (rf"list_transform({sample}, lambda w: lower(regexp_replace(w, "
             rf"'^[^\p{{L}}\p{{Nd}}]+|[^\p{{L}}\p{{Nd}}]+$', '', 'g')))")
    return (f"(length({strip(x)}) = 0 OR {letters(strip(x))} < length({strip(x)}) * 0.45 "
            f"OR len(list_filter({clean}, lambda w: length(w) <= 2)) > len({sample}) * 0.6 "
            f"OR (len({sample}) >= 10 AND len(list_distinct({clean})) < 5))")


def stem(w: str) -> str:
    singular = f"CASE WHEN length({w}) >= 5 AND ends_with({w}, 'aux') THEN left({w}, length({w}) - 2) || 'l' ELSE {w} END"
    bare = f"regexp_replace({singular}, '^(.{{3,}}?)é?e?r?[sx]?$', '\\1')"
    doubled = f"(length({bare}) > 3 AND right({bare}, 1) = substring({bare}, length({bare}) - 1, 1))"
    return f"(CASE WHEN {doubled} THEN left({bare}, length({bare}) - 1) ELSE {bare} END)"


STOP = listed(L.STOPWORDS)
NOUNS = listed(L.DOMAIN_NOUNS)


def text_stems(x: str) -> str:
    kept = f"list_filter({terms(f'lower({x})')}, lambda w: NOT list_contains({STOP}, {fold('w')}))"
    return f"list_transform({kept}, lambda w: {stem('w')})"


KEYWORD = f"(list_contains({NOUNS}, w) OR (length(w) >= 3 AND NOT list_contains({STOP}, w)))"
SEARCH_TERM = (f"(list_contains({NOUNS}, w) OR list_contains({NOUNS}, {fold('w')}) OR (length(w) >= 3 "
               f"AND NOT list_contains({STOP}, w) AND NOT list_contains({STOP}, {fold('w')})))")


def first_terms(name: str, source: str, keys: str, x: str, keep: str) -> str:
    """CTE `name`(keys, w, i): distinct kept words with the place where each is first seen."""
    return f"""{name}_words AS (SELECT {keys}, unnest({terms(x)}) AS w, generate_subscripts({terms(x)}, 1) AS place FROM {source}),
    {name} AS (
        SELECT {keys}, w, row_number() OVER (PARTITION BY {keys} ORDER BY place) AS i
        FROM (SELECT {keys}, w, min(place) AS place FROM {name}_words WHERE {keep} GROUP BY {keys}, w))"""


def section_type(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {text(p)}) THEN '{k}'" for k, p in L.SECTION_PATTERNS.items())
    return f"(CASE {whens} ELSE 'general' END)"


def mechanics(x: str) -> str:
    def said(keyword: str) -> str:
        if len(keyword) < 4:
            return rf"regexp_matches(lower({x}), '(^|[^\p{{L}}\p{{N}}]){keyword.lower()}($|[^\p{{L}}\p{{N}}])')"
        return f"contains({fold(x)}, {fold(text(keyword))})"

    tags = ", ".join(f"CASE WHEN {' OR '.join(map(said, keywords_))} THEN '{tag}' END"
                     for tag, (_, keywords_) in sorted(L.MECHANICS.items()))
    return f"list_filter([{tags}], lambda t: t IS NOT NULL)"


def title_candidate(x: str) -> str:
    """First fitting of nine lines; the tenth part is all that is left of the text."""
    lines = f"string_split({x}, {NL})"
    parts = (f"list_concat(list_slice({lines}, 1, 9), CASE WHEN len({lines}) > 9 "
             f"THEN [array_to_string(list_slice({lines}, 10, len({lines})), {NL})] ELSE [] END)")
    fits = (f"list_filter(list_transform({parts}, lambda l: {strip('l')}), lambda l: length(l) BETWEEN 4 AND 80 "
            r"AND length(regexp_replace(l, '[^a-zA-Z\x{80}-\x{10FFFF}]', '', 'g')) >= 3)")
    return f"{fits}[1]"


def title(candidate: str, kind: str, index: str) -> str:
    labels = " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in L.SECTION_LABELS.items())
    label = f"(CASE {kind} {labels} END)"
    return (f"CASE WHEN {candidate} IS NULL THEN coalesce({label}, 'Règles') || ' ' || ({index} + 1) "
            f"ELSE coalesce({label} || ' — ', '') || ({truncated(candidate, 60)}) END")


def summary(x: str, n: int = 220) -> str:
    """First sentence or paragraph by position, else a cut at a space past the half."""
    t = strip(x)
    mark = f"(CASE WHEN regexp_matches({t}, '[.!?]') THEN length(regexp_extract({t}, '^[^.!?]*[.!?]')) END)"
    gap = f"nullif(instr({t}, {NL} || {NL}), 0)"
    first = (f"CASE WHEN {gap} IS NOT NULL AND {gap} < coalesce({mark}, length({t}) + 1) THEN left({t}, ({gap} - 1)::BIGINT) "
             f"WHEN {mark} IS NOT NULL THEN left({t}, {mark}) END")
    head = f"left({t}, {n})"
    at = f"(length({head}) - instr(reverse({head}), ' ') + 1)"
    cut = f"CASE WHEN contains({head}, ' ') AND {at} - 1 > {n // 2} THEN left({head}, {at} - 1) ELSE {head} END"
    return (f"CASE WHEN ({first}) IS NOT NULL THEN left({strip(f'({first})')}, {n}) "
            f"WHEN length({t}) <= {n} THEN {t} ELSE {strip(f'({cut})')} || '…' END")


def sentences(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '{L.SENTENCE_BREAK}')"
    return f"list_filter(list_transform({parts}, lambda s: {strip('s')}), lambda s: length(s) >= 8)"


# --- tables ----------------------------------------------------------------------------

LINES = f"""lines AS (
    SELECT doc_id, lang, source, unnest(string_split(text, {NL})) AS line,
           generate_subscripts(string_split(text, {NL}), 1) AS i
    FROM documents)"""
PAGES = f"""{LINES}, doc_pages AS (
    SELECT doc_id, lang, source, (i - 1) // 20 + 1 AS page_no, string_agg(line, {NL} ORDER BY i) AS text
    FROM lines GROUP BY ALL)"""

# Pages as passages: language is the collection, source the chapter.
PASSAGES = f"""{PAGES}, passages AS (
    SELECT doc_id || '-' || page_no AS passage_id, lang AS collection_id, doc_id::VARCHAR AS source_file,
           source AS hierarchy_path, page_no - 1 AS chunk_index,
           coalesce({title_candidate('text')}, '') AS title, text, page_no AS page_start, page_no AS page_end
    FROM doc_pages)"""

LANGUAGE = r"""CASE WHEN regexp_matches(text, '[ßäöüÄÖÜ]') THEN 'de' WHEN regexp_matches(text, '[ñíóÑÍÓ]') THEN 'es'
    WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 'fr' ELSE 'en' END"""
QUESTIONS = f"""questions AS (
    SELECT item_id::VARCHAR AS query_id, {LANGUAGE} AS collection_id, text AS question FROM benchmark)"""


def cleaned_lines(pages: str) -> str:
    """CTEs from `pages`(doc_id, collection_id, page_no, text) to `kept_lines` in blocks."""
    return f"""
    raw_lines AS (
        SELECT doc_id, collection_id, page_no, unnest(string_split(text, {NL})) AS line,
               generate_subscripts(string_split(text, {NL}), 1) AS i FROM {pages}),
    headers AS (
        SELECT doc_id, {strip('line')} AS t FROM raw_lines WHERE length({strip('line')}) BETWEEN 4 AND 80
        GROUP BY ALL HAVING count(*) >= 5),
    clean_pages AS (
        SELECT r.doc_id, r.collection_id, r.page_no,
               {strip(f"regexp_replace(string_agg(r.line, {NL} ORDER BY r.i), '\n{{3,}}', {NL} || {NL}, 'g')")} AS text
        FROM raw_lines r LEFT JOIN headers h ON r.doc_id = h.doc_id AND {strip('r.line')} = h.t
        WHERE h.t IS NULL AND NOT {contents_line(strip('r.line'))} GROUP BY ALL),
    blocks AS (
        SELECT doc_id, collection_id, page_no, unnest(string_split(text, {NL} || {NL})) AS block,
               generate_subscripts(string_split(text, {NL} || {NL}), 1) AS b FROM clean_pages),
    kept_lines AS (
        SELECT doc_id, collection_id, page_no, b, {strip('line')} AS line, k FROM (
            SELECT doc_id, collection_id, page_no, b, unnest(string_split(block, {NL})) AS line,
                   generate_subscripts(string_split(block, {NL}), 1) AS k FROM blocks)
        WHERE {strip('line')} <> '')"""


def headings(pages: str) -> str:
    return cleaned_lines(pages) + f""",
    around AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, b, k) AS pos,
               lag(line) OVER w AS before, lead(line) OVER w AS following
        FROM kept_lines WINDOW w AS (PARTITION BY doc_id, page_no, b ORDER BY k)),
    tested AS (SELECT *, {may_be_heading('line', 'following')} AS may FROM around),
    strong AS (SELECT *, may AND (before IS NULL OR ({ends_sentence('before')} AND {upper_text('line')})) AS is_strong
               FROM tested),
    headed AS (
        SELECT *, may AND coalesce(max(CASE WHEN is_strong THEN pos END) OVER w, -1)
                          > coalesce(max(CASE WHEN NOT may THEN pos END) OVER w, -1) AS heading
        FROM strong WINDOW w AS (PARTITION BY doc_id, page_no, b ORDER BY pos
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def paragraphs(pages: str) -> str:
    return headings(pages) + f""",
    marked AS (
        SELECT *, before IS NULL OR heading OR lag(heading) OVER (PARTITION BY doc_id ORDER BY pos) AS opens,
               CASE WHEN {list_marker('line')} THEN {NL}
                    WHEN NOT {ends_sentence('before')} OR {starts_lower('line')} THEN ' ' ELSE {NL} END AS glue
        FROM headed),
    numbered AS (
        SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS para FROM marked),
    paragraphs AS (
        SELECT doc_id, collection_id, para AS i, bool_or(heading) AS heading, min(page_no) AS page_start,
               min(page_no) AS page_end,
               string_agg(CASE WHEN opens THEN line ELSE glue || line END, '' ORDER BY pos) AS text
        FROM numbered GROUP BY doc_id, collection_id, para)"""


def chunks(pages: str) -> str:
    """CTEs down to `chunks`; needs WITH RECURSIVE."""
    return paragraphs(pages) + f""",
    totals AS (SELECT doc_id, sum(length(text)) AS total FROM paragraphs GROUP BY doc_id),
    tiny AS (
        SELECT doc_id, collection_id, string_agg(text, {NL} || {NL} ORDER BY i) AS text,
               min(page_start) AS page_start, max(page_end) AS page_end
        FROM paragraphs JOIN totals USING (doc_id) WHERE total < 150 GROUP BY doc_id, collection_id),
    short_run AS (
        SELECT doc_id, i, i AS grp, length(text) AS n, heading FROM paragraphs WHERE i = 1
        UNION ALL
        SELECT p.doc_id, p.i,
               CASE WHEN s.n < 40 AND NOT s.heading AND NOT p.heading THEN s.grp ELSE p.i END,
               CASE WHEN s.n < 40 AND NOT s.heading AND NOT p.heading THEN s.n + 1 + length(p.text) ELSE length(p.text) END,
               CASE WHEN s.n < 40 AND NOT s.heading AND NOT p.heading THEN s.heading ELSE p.heading END
        FROM short_run s JOIN paragraphs p ON p.doc_id = s.doc_id AND p.i = s.i + 1),
    merged AS (
        SELECT p.doc_id, p.collection_id, s.grp AS i, bool_or(p.heading) AS heading, min(p.page_start) AS page_start,
               max(p.page_end) AS page_end, string_agg(p.text, ' ' ORDER BY p.i) AS text
        FROM paragraphs p JOIN short_run s ON p.doc_id = s.doc_id AND p.i = s.i GROUP BY ALL),
    breaks AS (
        SELECT *, (lag(text) OVER w IS NULL OR heading OR lag(heading) OVER w
                   OR NOT {starts_lower('text')} OR {ends_sentence('lag(text) OVER w')})::INT AS brk
        FROM merged WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    continued AS (
        SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM breaks),
    paras AS (
        SELECT doc_id, collection_id, grp AS i, bool_or(heading) AS heading, min(page_start) AS page_start,
               max(page_end) AS page_end, string_agg(text, ' ' ORDER BY i) AS text,
               length(string_agg(text, ' ' ORDER BY i)) AS n,
               {upper_text("string_agg(text, ' ' ORDER BY i)")} AS is_up
        FROM continued JOIN totals USING (doc_id) WHERE total >= 150 GROUP BY doc_id, collection_id, grp),
    -- one row per paragraph: the buffer after it, and the range it closed, if any
    packing AS (
        SELECT doc_id, 0::BIGINT AS i, NULL::BIGINT AS first, 0::BIGINT AS len, 0::BIGINT AS width, '' AS chapter, '' AS part,
               NULL::BIGINT AS out_first, NULL::BIGINT AS out_last, '' AS out_path, 0::BIGINT AS out_width, false AS long
        FROM paras GROUP BY doc_id
        UNION ALL
        SELECT doc_id, i,
               CASE WHEN n > 1400 THEN NULL WHEN closes OR over THEN i ELSE coalesce(first, i) END,
               CASE WHEN n > 1400 THEN 0 WHEN closes OR over THEN n ELSE len + n END,
               CASE WHEN n > 1400 THEN 0 WHEN closes OR over THEN n ELSE width + n + CASE WHEN len > 0 THEN 2 ELSE 0 END END,
               new_chapter, new_part,
               CASE WHEN closes OR over OR n > 1400 THEN first END, CASE WHEN closes OR over OR n > 1400 THEN i - 1 END,
               CASE WHEN closes THEN chapter || CASE WHEN chapter <> '' AND part <> '' THEN ' > ' ELSE '' END || part
                    ELSE new_chapter || CASE WHEN new_chapter <> '' AND new_part <> '' THEN ' > ' ELSE '' END || new_part END,
               width, n > 1400
        FROM (SELECT q.doc_id, p.i, p.n, q.first, q.len, q.width, q.chapter, q.part,
                     p.heading AND q.len >= 150 AS closes,
                     NOT (p.heading AND q.len >= 150) AND q.len > 0 AND q.len + p.n > 700 AS over,
                     CASE WHEN p.heading AND p.is_up THEN p.text ELSE q.chapter END AS new_chapter,
                     CASE WHEN NOT p.heading THEN q.part WHEN p.is_up THEN '' ELSE p.text END AS new_part
              FROM packing q JOIN paras p ON p.doc_id = q.doc_id AND p.i = q.i + 1)),
    ends AS (SELECT doc_id, max(i) AS n_paras FROM paras GROUP BY doc_id),
    ranges AS (
        SELECT doc_id, out_first AS a, out_last AS z, out_path AS path, false AS long FROM packing
        WHERE out_first IS NOT NULL AND out_width >= 150
        UNION ALL
        SELECT doc_id, i, i, chapter || CASE WHEN chapter <> '' AND part <> '' THEN ' > ' ELSE '' END || part, true
        FROM packing WHERE long
        UNION ALL
        SELECT q.doc_id, q.first, q.i, chapter || CASE WHEN chapter <> '' AND part <> '' THEN ' > ' ELSE '' END || part, false
        FROM packing q JOIN ends e ON q.doc_id = e.doc_id AND q.i = e.n_paras WHERE q.first IS NOT NULL AND q.width >= 150),
    ranged AS (
        SELECT r.doc_id, p.collection_id, r.a, r.path, r.long, min(p.page_start) AS page_start, max(p.page_end) AS page_end,
               string_agg(p.text, {NL} || {NL} ORDER BY p.i) AS text
        FROM ranges r JOIN paras p ON p.doc_id = r.doc_id AND p.i BETWEEN r.a AND r.z GROUP BY ALL),
    -- long paragraphs, cut piece by piece
    cutting AS (
        SELECT doc_id, a, 0 AS piece_no, '' AS piece, text AS rest FROM ranged WHERE long
        UNION ALL
        SELECT doc_id, a, piece_no + 1, {strip('left(rest, cut)')},
               ltrim(substring(rest, cut + 1), ' ' || {NL})
        FROM (SELECT *, CASE WHEN length(rest) <= 700 THEN length(rest) ELSE coalesce(
                  list_max(list_filter(range(467, 702), lambda k: substring(head, k, 1) IN ('.', '!', '?')
                      AND substring(head, k + 1, 1) IN (' ', {NL}, ''))),
                  list_max(list_filter(range(350, 701), lambda k: substring(head, k + 1, 1) IN (' ', {NL}))), 700) END AS cut
              FROM (SELECT *, left(rest, 702) AS head FROM cutting WHERE rest <> ''))),
    pieces AS (
        SELECT doc_id, collection_id, a, 0 AS piece_no, path, page_start, page_end, text FROM ranged WHERE NOT long
        UNION ALL
        SELECT c.doc_id, r.collection_id, c.a, c.piece_no, r.path, r.page_start, r.page_end, c.piece
        FROM cutting c JOIN ranged r ON r.doc_id = c.doc_id AND r.a = c.a AND r.long WHERE c.piece <> ''
        UNION ALL
        SELECT doc_id, collection_id, 0, 0, '', page_start, page_end, text FROM tiny),
    placed AS (
        SELECT collection_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, piece_no) - 1 AS chunk_index,
               count(*) OVER (PARTITION BY doc_id) AS total_chunks, text, page_start, page_end, path AS hierarchy_path
        FROM pieces),
    chunks AS (SELECT * FROM placed WHERE NOT {low_quality('text')})"""
