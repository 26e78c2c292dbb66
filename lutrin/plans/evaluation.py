"""Queries that measure retrieval and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lutrin.functions import answers as A
from lutrin.functions import lexicon as L
from lutrin.functions.text import comparable, words
from lutrin.operators import context as C
from lutrin.operators import evaluate as E
from lutrin.functions.scores import candidate_depth
from lutrin.operators import retrieve as R
from lutrin.plans import sql as S
from lutrin.plans.registry import query
from lutrin.plans.retrieval import BENCH_SEARCH, CONTEXT, ID, _bench, stored_cells, stored_index
from lutrin.session import written
from lutrin.sources import tables as D

# --- excerpts in texts -----------------------------------------------------------------


@query("excerpt_hits", f"""
    WITH b AS (SELECT item_id, {S.comparable('text')} AS excerpt FROM benchmark),
    d AS (SELECT doc_id, {S.comparable('text')} AS normal FROM documents)
    SELECT item_id, doc_id FROM b JOIN d ON contains(normal, excerpt)""")
def excerpt_hits(spark, folder):
    """Every document that holds a benchmark text, case, quotes and spacing aside."""
    texts = D.texts(spark, folder).select(
        F.col("doc_id").alias("text_id"), comparable(F.col("text")).alias("normal"))
    excerpts = D.table(spark, folder, "benchmark").select("item_id", comparable(F.col("text")).alias("excerpt"))
    return E.containing(written(texts), excerpts, []).select("item_id", F.col("text_id").alias("doc_id"))


# A question is out of the book if its excerpt stands on no page of its collection.
JUDGED = f"""page_texts AS (SELECT collection_id, page_start AS page_no, {S.comparable('text')} AS normal FROM passages),
question_excerpts AS (SELECT query_id, collection_id, question, {S.comparable('question')} AS excerpt FROM questions),
expected AS (
    SELECT *, EXISTS (SELECT 1 FROM page_texts p WHERE p.collection_id = a.collection_id AND contains(p.normal, a.excerpt)) AS in_book
    FROM question_excerpts a),
expected_pages AS (
    SELECT e.query_id, list_sort(list_distinct(list(p.page_no))) AS pages
    FROM expected e JOIN page_texts p ON p.collection_id = e.collection_id AND contains(p.normal, e.excerpt)
    WHERE e.in_book GROUP BY e.query_id)"""


def _pages(passages):
    return passages.select("collection_id", F.col("source_file").alias("doc_id"),
                           F.col("page_start").alias("page_no"), "text")


@query("expected_pages", f"""
    WITH {S.PASSAGES}, {S.QUESTIONS}, {JUDGED}
    SELECT query_id, array_to_string(pages, ' ') AS pages FROM expected_pages""")
def expected_pages(spark, folder):
    passages, _ = stored_index(spark, folder)
    found = E.expected_pages(D.excerpt_questions(spark, folder), _pages(passages))
    return found.select(ID, F.array_join(F.transform("expected_pages", lambda p: p.cast("string")), " ").alias("pages"))


SHORT_EXCERPTS = f"""b AS (SELECT item_id, {S.words(S.comparable('text'))} AS ws FROM benchmark),
short AS (
    SELECT item_id, 1 AS n, ws[1] AS excerpt FROM b WHERE len(ws) >= 1
    UNION ALL SELECT item_id, 2, ws[1] || ' ' || ws[2] FROM b WHERE len(ws) >= 2)"""


@query("short_excerpt_hits", f"""
    WITH {SHORT_EXCERPTS}, d AS (SELECT doc_id, {S.comparable('text')} AS normal FROM documents)
    SELECT item_id, n, count(*) AS n_docs FROM short JOIN d ON contains(normal, excerpt) GROUP BY item_id, n""")
def short_excerpt_hits(spark, folder):
    """How many documents hold the first word, and the first two words, of each benchmark text."""
    texts = D.texts(spark, folder).select(F.col("doc_id").alias("text_id"), comparable(F.col("text")).alias("normal"))
    ws = words(comparable(F.col("text")))
    firsts = D.table(spark, folder, "benchmark").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), ws.alias("ws"))
    excerpts = firsts.filter(F.size("ws") >= F.col("n")).select(
        "item_id", F.col("n").cast("long").alias("n"), F.array_join(F.slice("ws", F.lit(1), F.col("n")), " ").alias("excerpt"))
    return E.containing(texts, excerpts, []).groupBy("item_id", "n").agg(F.count("*").alias("n_docs"))


# --- retrieval -------------------------------------------------------------------------

RESULTS = f"""{CONTEXT}, {JUDGED}, section_hits AS (
    SELECT s.*, contains({S.comparable('s.text')}, e.excerpt) AS hit
    FROM sections s JOIN expected e USING (query_id) WHERE e.in_book),
first_hits AS (SELECT query_id, min(place) AS rank FROM section_hits WHERE hit GROUP BY query_id),
kept_hits AS (SELECT DISTINCT h.query_id FROM section_hits h JOIN kept k USING (query_id, place) WHERE h.hit),
vector_hits AS (
    SELECT DISTINCT v.query_id FROM by_vector v JOIN passages p USING (passage_id) JOIN expected e USING (query_id)
    WHERE v.rank <= 6 AND e.in_book AND contains({S.comparable('p.text')}, e.excerpt)),
results AS (
    SELECT e.query_id, e.collection_id, e.question, e.in_book, coalesce(f.rank, 0) AS rank, k.query_id IS NOT NULL AS in_context,
           v.query_id IS NOT NULL AS vector_hit, x.pages, coalesce(length(c.context), 0) AS context_chars,
           CASE WHEN f.rank IS NOT NULL AND x.pages IS NOT NULL
                THEN len(list_filter(x.pages, lambda p: p BETWEEN h.page_start AND greatest(h.page_start, h.page_end))) > 0 END AS page_ok,
           h.page_start, h.page_end
    FROM expected e LEFT JOIN first_hits f USING (query_id) LEFT JOIN section_hits h ON h.query_id = e.query_id AND h.place = f.rank
    LEFT JOIN kept_hits k ON k.query_id = e.query_id LEFT JOIN vector_hits v ON v.query_id = e.query_id
    LEFT JOIN expected_pages x ON x.query_id = e.query_id LEFT JOIN contexts c ON c.query_id = e.query_id)"""


def _results(spark, folder):
    """One judged row per question, as one batch plan over all questions."""
    questions, passages, postings = _bench(spark, folder)
    pages = written(E.expected_pages(questions, _pages(passages)))
    judged = (questions.join(pages, ID, "left").withColumn("expected", F.when(
        F.col("expected_pages").isNotNull(), F.col("expected")).otherwise(F.array().cast("array<string>"))))
    # ranked once at the larger depth: the search and the vector-only list are cuts of it
    depth = candidate_depth(L.ASK_LIMIT)
    by_vector = written(R.vector_candidates(questions, stored_cells(spark, folder), depth))
    hits = R.fuse(by_vector, R.text_candidates(questions, postings, depth), L.ASK_LIMIT)
    found = C.retrieved_context(judged.drop("vector").join(R.expand_top(hits, passages), ID, "left"))
    first = by_vector.filter(F.col("rank") <= L.ASK_LIMIT)
    vector_texts = (first.join(passages.select("passage_id", "text"), "passage_id")
                    .groupBy(ID).agg(F.collect_list("text").alias("vector_texts")))
    return E.judged_retrieval(found.join(vector_texts, ID, "left"))


@query("judged_questions", f"""
    WITH RECURSIVE {RESULTS}
    SELECT query_id, rank, in_context, vector_hit, context_chars, coalesce(page_ok::VARCHAR, '') AS page_ok FROM results""")
def judged_questions(spark, folder):
    return _results(spark, folder).select(
        ID, F.col("rank").cast("long").alias("rank"), "in_context", "vector_hit",
        F.col("context_chars").cast("long").alias("context_chars"),
        F.coalesce(F.col("page_ok").cast("string"), F.lit("")).alias("page_ok"))


def _pct(part: str, whole: str) -> str:
    return f"round(100.0::DOUBLE * count(*) FILTER ({part}) / nullif(count(*) FILTER ({whole}), 0), 6)"


@query("retrieval_metrics", f"""
    WITH RECURSIVE {RESULTS}
    SELECT count(*) AS questions, count(*) FILTER (NOT in_book) AS out_of_book,
           {_pct('in_book AND rank = 1', 'in_book')} AS hit_1, {_pct('in_book AND rank BETWEEN 1 AND 3', 'in_book')} AS hit_3,
           {_pct('in_book AND rank > 0', 'in_book')} AS hit_k,
           round(sum(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END) / count(*) FILTER (in_book), 6) AS mrr,
           {_pct('in_context', 'in_book')} AS in_context, {_pct('vector_hit', 'in_book')} AS vector_hit,
           {_pct('page_ok', 'page_ok IS NOT NULL')} AS page_accuracy, floor(avg(context_chars))::BIGINT AS mean_context_chars
    FROM results""")
def retrieval_metrics(spark, folder):
    return E.retrieval_metrics(_results(spark, folder))


@query("failure_report", f"""
    WITH RECURSIVE {RESULTS}, previews AS (
        SELECT query_id, string_agg({S.NL} || '    ' || place || '. (' || printf('%.2f', score) || ') '
               || left({S.squeeze('text')}, 90) || '…', '' ORDER BY place) AS lines FROM sections GROUP BY query_id)
    SELECT r.query_id, concat_ws({S.NL},
        CASE WHEN NOT page_ok THEN '✗ page [' || collection_id || '] ' || question || ' : pages attendues '
             || array_to_string(pages, ' ') || ', section p.' || page_start
             || CASE WHEN page_end > page_start THEN '-' || page_end ELSE '' END END,
        CASE WHEN in_book AND rank = 0 THEN '✗ [' || collection_id || '] ' || question || ' : attendu ' || question || coalesce(lines, '') END,
        CASE WHEN rank > 0 AND NOT in_context THEN '✗ budget [' || collection_id || '] ' || question || ' : rang ' || rank || ', '
             || context_chars || ' caractères' END) AS report
    FROM results r LEFT JOIN previews USING (query_id)""")
def failure_report(spark, folder):
    return _results(spark, folder).select(ID, E.retrieval_failure(F.col("collection_id")).alias("report"))


@query("page_match", f"""
    WITH {BENCH_SEARCH}, named AS (
        SELECT query_id, place, page_start, page_end,
               source_file || CASE WHEN source_file::BIGINT % 2 = 0 THEN '.PDF' ELSE '.md' END AS file FROM sections),
    pdfs AS (SELECT * FROM named WHERE lower(file) LIKE '%.pdf'),
    cited AS (SELECT query_id, length(question) % 4 + 1 AS page FROM questions),
    holding AS (
        SELECT c.query_id, arg_min(p.file, p.place) AS file FROM cited c JOIN pdfs p USING (query_id)
        WHERE c.page BETWEEN p.page_start AND greatest(p.page_start, p.page_end) GROUP BY c.query_id),
    only_one AS (SELECT query_id, min(file) AS file FROM pdfs GROUP BY query_id HAVING count(DISTINCT file) = 1),
    inside AS (SELECT DISTINCT c.query_id FROM cited c JOIN named n USING (query_id) WHERE c.page BETWEEN n.page_start AND n.page_end)
    SELECT c.query_id, c.page, coalesce(h.file, o.file, '') AS file, i.query_id IS NOT NULL AS sent
    FROM cited c LEFT JOIN holding h USING (query_id) LEFT JOIN only_one o USING (query_id) LEFT JOIN inside i USING (query_id)""")
def page_match(spark, folder):
    """The file a cited page belongs to, and whether the page was among the sections sent."""
    questions, passages, postings = _bench(spark, folder)
    found = questions.select(ID, "question").join(R.search(questions, passages, postings, L.ASK_LIMIT, stored=stored_cells(spark, folder)), ID, "left")
    named = F.transform("sections", lambda s: F.struct(
        s["page_start"].alias("page_start"), s["page_end"].alias("page_end"),
        F.concat(s["source_file"], F.when(s["source_file"].cast("long") % 2 == 0, ".PDF").otherwise(".md")).alias("source_file")))
    rows = found.select(ID, (F.length("question") % 4 + 1).alias("page"), named.alias("sections"))
    return rows.select(
        ID, F.col("page").cast("long").alias("page"),
        F.coalesce(E.file_for_page(F.col("page"), F.col("sections")), F.lit("")).alias("file"),
        (F.size(A.invented_pages(F.array("page"), F.col("sections"))) == 0).alias("sent"))


# --- answers ---------------------------------------------------------------------------

# Assistant turns with citations put around the text.
CITING = "'Voir p.' || (turn + 1) || '-' || (turn + 3) || ' et page ' || (conv_id % 7 + 1) || '. ' || text || ' (pages ' || (turn + 2) || ' à ' || (turn + 4) || ')'"


def _citing():
    def number(c):
        return c.cast("string")
    turn, conv = F.col("turn"), F.col("conv_id")
    return F.concat(F.lit("Voir p."), number(turn + 1), F.lit("-"), number(turn + 3), F.lit(" et page "), number(conv % 7 + 1),
                    F.lit(". "), F.col("text"), F.lit(" (pages "), number(turn + 2), F.lit(" à "), number(turn + 4), F.lit(")"))


@query("answer_failures", """
    WITH a AS (
        SELECT conv_id, turn, conv_id % 4 = 0 AS out, CASE WHEN turn = 3 THEN 'délai' END AS error, contains(lower(text), 'the') AS refused,
               conv_id % 3 > 0 AS in_context, turn % 4 = 1 AS misses, length(text) % 5 = 0 AS invents, length(text) AS words
        FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, concat_ws(', ', CASE WHEN error IS NOT NULL THEN 'erreur : ' || error END,
        CASE WHEN error IS NULL AND out AND NOT refused THEN 'répond alors que la règle n''est pas dans le livret' END,
        CASE WHEN error IS NULL AND NOT out AND refused AND in_context THEN 'refuse alors que la réponse est dans le contexte' END,
        CASE WHEN error IS NULL AND NOT out AND misses THEN 'faits manquants deux, trois' END,
        CASE WHEN invents THEN 'pages absentes du contexte 7 9' END, CASE WHEN words > 120 THEN words || ' mots' END) AS problems FROM a""")
def answer_failures(spark, folder):
    """What is wrong with each answer, in one line: errors, refusals, missing facts, invented pages, length."""
    rows = D.table(spark, folder, "conversations").filter("role = 'assistant' and text is not null")
    none, conv, n = F.array().cast("array<string>"), F.col("conv_id"), F.length("text")
    judged = rows.select(
        "conv_id", "turn", F.when(conv % 4 == 0, none).otherwise(F.array(F.lit("x"))).alias("expected"), F.when(F.col("turn") == 3, "délai").alias("error"),
        F.lower("text").contains("the").alias("refused"), (conv % 3 > 0).alias("in_context"),
        F.when(F.col("turn") % 4 == 1, F.array(F.lit("deux"), F.lit("trois"))).otherwise(none).alias("missing"),
        F.when(n % 5 == 0, F.array(F.lit(7), F.lit(9))).otherwise(F.array().cast("array<int>")).alias("invented_pages"), n.alias("words"))
    return judged.select("conv_id", "turn", E.answer_failure(120).alias("problems"))


@query("cited_pages", f"""
    WITH a AS (SELECT conv_id, turn, {CITING} AS answer FROM conversations WHERE role = 'assistant'),
    ends AS (
        SELECT conv_id, turn, unnest(regexp_extract_all(answer, '(?i)(?:pages?|p\\.)\\s*(\\d+)(?:\\s*(?:-|–|à)\\s*(\\d+))?', 1)) AS first,
               unnest(regexp_extract_all(answer, '(?i)(?:pages?|p\\.)\\s*(\\d+)(?:\\s*(?:-|–|à)\\s*(\\d+))?', 2)) AS last,
               generate_subscripts(regexp_extract_all(answer, '(?i)(?:pages?|p\\.)\\s*(\\d+)', 1), 1) AS i FROM a),
    numbers AS (
        SELECT conv_id, turn, try_cast(first AS BIGINT) AS page, 2 * i AS pos FROM ends
        UNION ALL SELECT conv_id, turn, try_cast(last AS BIGINT), 2 * i + 1 FROM ends),
    once AS (SELECT conv_id, turn, page, min(pos) AS pos FROM numbers WHERE page IS NOT NULL GROUP BY ALL)
    SELECT conv_id, turn, string_agg(page::VARCHAR, ' ' ORDER BY pos) AS pages FROM once GROUP BY ALL""")
def cited_pages(spark, folder):
    rows = D.table(spark, folder, "conversations").filter(F.col("role") == "assistant")
    pages = A.cited_pages(_citing())
    return rows.select("conv_id", "turn", F.array_join(F.transform(pages, lambda p: p.cast("string")), " ").alias("pages"))


FACTS = f"""asked AS (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations
    WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
    SELECT conv_id, turn, 'Voir p. ' || (turn + 1) || '. **' || answer || '**' AS answer,
           {S.words(S.comparable_answer('text'))} AS picked
    FROM asked WHERE role = 'user' AND next_role = 'assistant'),
variants AS (
    SELECT conv_id, turn, unnest(list_concat(picked, [(turn + 1)::VARCHAR])) AS fact,
           generate_subscripts(list_concat(picked, ['']), 1) AS i,
           {S.comparable_answer(r"regexp_replace(answer, '(?i)(?:pages?|p\.)\s*(\d+)(?:\s*(?:-|–|à)\s*(\d+))?', '', 'g')")} AS answer
    FROM pairs),
checked AS (
    SELECT *, regexp_matches(answer, '(^|[^\\p{{L}}\\p{{Nd}}])' || regexp_escape({S.comparable_answer('fact')}) || '($|[^\\p{{L}}\\p{{Nd}}])')
           AND {S.comparable_answer('fact')} <> '' AS found FROM variants)"""


@query("facts", f"""
    WITH {FACTS}
    SELECT conv_id, turn, count(*) FILTER (found) AS found, count(*) AS total,
           coalesce(string_agg('zz|' || fact, ', ' ORDER BY i) FILTER (NOT found), '') AS missing
    FROM checked GROUP BY ALL""")
def facts(spark, folder):
    """All words of each question looked up in its answer; the page number only stands in a citation."""
    turns = D.table(spark, folder, "conversations").filter(F.col("role").isin("user", "assistant"))
    from pyspark.sql import Window as W
    w = W.partitionBy("conv_id").orderBy("turn")
    paired = (turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"),
                           F.lead("text").over(w).alias("reply"))
              .filter((F.col("role") == "user") & (F.col("next_role") == "assistant")))
    answer = F.concat(F.lit("Voir p. "), (F.col("turn") + 1).cast("string"), F.lit(". **"), F.col("reply"), F.lit("**"))
    picked = F.concat(words(A.comparable_answer(F.col("text"))), F.array((F.col("turn") + 1).cast("string")))
    wanted = F.transform(picked, lambda f: F.concat(F.lit("zz|"), f))
    rows = paired.select("conv_id", "turn", answer.alias("answer"), wanted.alias("facts"))
    missing = rows.withColumn("missing", A.missing_facts(F.col("answer"), F.col("facts")))
    return missing.select(
        "conv_id", "turn", (F.size("facts") - F.size("missing")).cast("long").alias("found"),
        F.size("facts").cast("long").alias("total"), F.array_join("missing", ", ").alias("missing"))


# Answers made of the question: what is cited and said depends on language and length.
ANSWERS = f"""{RESULTS}, first_sections AS (SELECT query_id, page_start AS first_page FROM sections WHERE place = 1),
said AS (
    SELECT r.*, CASE WHEN f.first_page IS NULL THEN 'no section' END AS error,
           CASE WHEN collection_id IN ('de', 'es') THEN 'Je ne trouve pas cette règle dans le livret.'
                ELSE 'D''accord. **' || question || '** (p. ' || f.first_page || '-' || (f.first_page + length(question) % 3) || ')' END AS answer,
           {S.words(S.comparable_answer('question'))} AS picked,
           length(question) % 100 AS tokens, coalesce(f.first_page, 0) AS first_page
    FROM results r LEFT JOIN first_sections f USING (query_id)),
fact_rows AS (
    SELECT query_id, unnest(list_concat(picked, ['introuvable'])) AS fact, answer FROM said WHERE length(question) % 2 = 0
    UNION ALL SELECT query_id, unnest(picked), answer FROM said WHERE length(question) % 2 = 1),
fact_counts AS (
    SELECT query_id, count(*) AS total, count(*) FILTER (regexp_matches(
        {S.comparable_answer(r"regexp_replace(answer, '(?i)(?:pages?|p\.)\s*(\d+)(?:\s*(?:-|–|à)\s*(\d+))?', '', 'g')")},
        '(^|[^\\p{{L}}\\p{{Nd}}])' || regexp_escape({S.comparable_answer('fact')}) || '($|[^\\p{{L}}\\p{{Nd}}])')) AS found
    FROM fact_rows GROUP BY query_id),
citations AS (
    SELECT query_id, first_page AS page FROM said WHERE contains(answer, '(p. ')
    UNION SELECT query_id, first_page + length(question) % 3 FROM said WHERE contains(answer, '(p. ')),
judged AS (
    SELECT s.*, c.total, c.found, c.total = c.found AND s.error IS NULL AS complete,
           contains({S.comparable_answer('s.answer')}, 'je ne trouve pas') AS refused,
           len({S.words(S.comparable_answer('s.answer'))}) AS n_words,
           EXISTS (SELECT 1 FROM citations z WHERE z.query_id = s.query_id AND NOT EXISTS (
               SELECT 1 FROM kept k WHERE k.query_id = z.query_id
               AND z.page BETWEEN k.page_start AND greatest(k.page_start, k.page_end))) AS invented,
           EXISTS (SELECT 1 FROM citations z WHERE z.query_id = s.query_id AND list_contains(s.pages, z.page)) AS cites_expected
    FROM said s LEFT JOIN fact_counts c USING (query_id))"""


def _answers(spark, folder):
    judged = _results(spark, folder)
    first_page = F.get(F.col("sections"), F.lit(0))["page_start"]
    last_page = first_page + F.length("question") % 3
    answer = F.when(F.col("collection_id").isin("de", "es"), "Je ne trouve pas cette règle dans le livret.").otherwise(F.concat(
        F.lit("D'accord. **"), F.col("question"), F.lit("** (p. "), first_page.cast("string"), F.lit("-"),
        last_page.cast("string"), F.lit(")")))
    picked = words(A.comparable_answer(F.col("question")))
    rows = (judged.withColumn("error", F.when(first_page.isNull(), "no section"))
            .withColumn("answer", answer)
            .withColumn("facts", F.when(F.length("question") % 2 == 0, F.concat(picked, F.array(F.lit("introuvable")))).otherwise(picked))
            .withColumn("tokens", F.length("question") % 100)
            .withColumn("model", F.concat(F.lit("m-"), F.col("collection_id")))
            .withColumn("expected_pages", F.coalesce("expected_pages", F.array().cast("array<int>"))))
    return E.judged_answers(rows)


@query("answer_metrics", f"""
    WITH RECURSIVE {ANSWERS}
    SELECT count(*) FILTER (error IS NULL) AS answered, count(*) FILTER (error IS NOT NULL) AS errors,
           {_pct('error IS NULL AND in_book AND total > 0 AND complete', 'error IS NULL AND in_book AND total > 0')} AS complete,
           round(100.0::DOUBLE * sum(found) FILTER (error IS NULL AND in_book) / nullif(sum(total) FILTER (error IS NULL AND in_book), 0), 6) AS facts,
           {_pct('error IS NULL AND in_book AND total > 0 AND complete AND in_context', 'error IS NULL AND in_book AND in_context')} AS complete_if_context,
           {_pct('error IS NULL AND in_book AND total > 0 AND complete AND in_context', 'error IS NULL AND in_book AND total > 0 AND in_context')} AS complete_if_context_facts,
           count(*) FILTER (error IS NULL AND in_book AND in_context AND refused) AS false_refusals,
           count(*) FILTER (error IS NULL AND NOT in_book) AS out_of_book,
           count(*) FILTER (error IS NULL AND NOT in_book AND refused) AS refused_out_of_book,
           {_pct('error IS NULL AND in_book AND pages IS NOT NULL AND in_context AND cites_expected', 'error IS NULL AND in_book AND pages IS NOT NULL AND in_context')} AS expected_page_cited,
           count(*) FILTER (error IS NULL AND invented) AS invented,
           floor(avg(n_words) FILTER (error IS NULL))::BIGINT AS mean_words,
           count(*) FILTER (error IS NULL AND n_words > 150) AS too_long,
           floor(avg(tokens) FILTER (error IS NULL))::BIGINT AS mean_tokens
    FROM judged""")
def answer_metrics(spark, folder):
    return E.answer_metrics(_answers(spark, folder))


@query("models_and_latency", f"""
    SELECT event_type AS model, count(*) AS answers,
           (round(floor(avg(cast(floor(value * 10) AS BIGINT))) / 100) * 100)::BIGINT AS mean_ms,
           (round(max(cast(floor(value * 10) AS BIGINT)) / 100.0) * 100)::BIGINT AS max_ms
    FROM events WHERE event_type <> 'error' GROUP BY event_type""")
def models_and_latency(spark, folder):
    """Answers, mean and maximum latency per model, errors left out."""
    events = D.table(spark, folder, "events").select(
        F.col("event_type").alias("model"), F.when(F.col("event_type") == "error", "e").alias("error"),
        F.floor(F.col("value") * 10).alias("ms"))
    ok = events.filter(F.col("error").isNull())
    counts = E.models_used(events)
    return counts.join(E.latency_by(ok, "model", "ms"), "model")


@query("answer_cleanup", """
    WITH a AS (
        SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'Ok, ' || text WHEN 1 THEN 'D''accord.' || chr(10) || text
               WHEN 2 THEN 'Okapi : ' || text WHEN 3 THEN 'Très bien ! ' ELSE text END AS answer
        FROM conversations WHERE role = 'assistant'),
    t AS (SELECT *, regexp_replace(answer, '(?i)^\\s*(ok|okay|d''accord|d’accord|bien sûr|très bien)\\b\\s*[,.!:]?\\s*', '') AS cut FROM a)
    SELECT conv_id, turn, CASE WHEN trim(cut) <> '' THEN cut ELSE answer END AS answer FROM t""")
def answer_cleanup(spark, folder):
    rows = D.table(spark, folder, "conversations").filter(F.col("role") == "assistant")
    n, text = (F.col("conv_id") + F.col("turn")) % 5, F.col("text")
    answer = (F.when(n == 0, F.concat(F.lit("Ok, "), text)).when(n == 1, F.concat(F.lit("D'accord.\n"), text))
              .when(n == 2, F.concat(F.lit("Okapi : "), text)).when(n == 3, F.lit("Très bien ! ")).otherwise(text))
    return rows.select("conv_id", "turn", A.without_filler(answer).alias("answer"))


@query("answer_content", """
    WITH c AS (
        SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN to_json(text)::VARCHAR
               WHEN 1 THEN to_json([{'type': 'thinking', 'text': role}, {'type': 'text', 'text': text}, {'type': 'text', 'text': ' fin'}])::VARCHAR
               ELSE 'null' END AS raw, text FROM conversations)
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ' fin' ELSE '' END AS content FROM c""")
def answer_content(spark, folder):
    """Content stored as a JSON string, as typed chunks or as null."""
    def chunk(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))
    turns = D.table(spark, folder, "conversations")
    as_string = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r"^\{\"t\":([\s\S]*)\}$", 1)
    chunks = F.to_json(F.array(chunk("thinking", F.col("role")), chunk("text", F.col("text")), chunk("text", F.lit(" fin"))))
    raw = F.when(F.col("turn") % 3 == 0, as_string).when(F.col("turn") % 3 == 1, chunks).otherwise("null")
    return turns.select("conv_id", "turn", A.content_text(raw).alias("content"))
