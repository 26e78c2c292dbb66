"""Queries that answer questions from passages: candidates, fusion, expansion, context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lutrin.functions import lexicon as L
from lutrin.functions import scores
from lutrin.operators import activity as V
from lutrin.operators import ask as A
from lutrin.operators import context as C
from lutrin.operators import cells, index, retrieve as R, textblocks
from lutrin.plans import sql as S
from lutrin.plans.registry import query
from lutrin.session import written
from lutrin.sources import tables as D

ID = "query_id"

# --- vectors ---------------------------------------------------------------------------

POOLED = """dims AS (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
means AS (SELECT label, dim, avg(x) AS x FROM dims GROUP BY ALL),
pooled AS (SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM means)"""
CENTROID_SCORES = f"""{POOLED}, queries AS (SELECT label, list(x ORDER BY dim) AS vector FROM pooled GROUP BY label),
scored AS (
    SELECT q.label AS query_id, e.vec_id AS passage_id,
           round(list_dot_product(e.embedding::DOUBLE[], q.vector) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 9) AS score
    FROM embeddings e JOIN queries q ON q.label = e.label WHERE e.embedding IS NOT NULL),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM scored)"""


def _centroid_search(spark, folder, depth, min_score):
    """Each collection's centre asks for the nearest vectors of its collection."""
    vectors = D.table(spark, folder, "embeddings").select(
        F.col("label").alias("collection_id"), F.col("vec_id").alias("passage_id"),
        F.lit(None).cast("int").alias("page_start"), "embedding")
    asked = (index.mean_pooled(vectors, ["collection_id"])
             .select(F.col("collection_id").alias(ID), "collection_id", F.col("embedding").alias("vector")))
    found = R.vector_candidates(asked, vectors, depth, min_score)
    return found.select(F.col(ID).cast("long").alias(ID), "passage_id", F.col("rank").cast("long").alias("rank"),
                        F.round("score", 6).alias("score"))


@query("mean_pool_l2", f"WITH {POOLED} SELECT label, dim, round(x, 6) AS x FROM pooled")
def mean_pool_l2(spark, folder):
    pooled = index.mean_pooled(D.table(spark, folder, "embeddings"), ["label"])
    return (pooled.select("label", F.posexplode("embedding").alias("d", "v"))
            .select("label", (F.col("d") + 1).cast("long").alias("dim"), F.round("v", 6).alias("x")))


@query("vector_topk", f"""
    WITH {CENTROID_SCORES}
    SELECT query_id::BIGINT AS query_id, passage_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10""")
def vector_topk(spark, folder):
    return _centroid_search(spark, folder, 10, -1)


@query("vector_min_score", f"""
    WITH {CENTROID_SCORES}
    SELECT query_id::BIGINT AS query_id, passage_id, rank, round(score, 6) AS score
    FROM ranked WHERE rank <= 40 AND score >= 0.1""")
def vector_min_score(spark, folder):
    return _centroid_search(spark, folder, scores.candidate_depth(L.ASK_LIMIT), 0.1)


# --- hybrid search in SQL --------------------------------------------------------------

def hashed(name: str, source: str, key: str, x: str) -> str:
    """Sparse unit vectors name(key, bucket, v) of stem counts."""
    return f"""{name}_counts AS (
        SELECT {key}, ('0x' || left(md5(stem), 8))::UBIGINT % 64 AS bucket, count(*) AS n
        FROM (SELECT {key}, unnest({S.text_stems(x)}) AS stem FROM {source}) GROUP BY {key}, bucket),
    {name} AS (
        SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS v FROM {name}_counts)"""


def retrieval_sql(questions: str, limit: int, min_score: float = L.MIN_COSINE) -> str:
    """CTEs from `passages` and `questions`(query_id, collection_id, question) to `sections`."""
    depth = max(4 * limit, 40)
    return f"""
    {hashed('pv', 'passages', 'passage_id', 'text')}, {hashed('qv', questions, 'query_id', 'question')},
    cosines AS (
        SELECT q.query_id, p.passage_id, round(sum(a.v * b.v), 9) AS score
        FROM {questions} q JOIN passages p USING (collection_id) JOIN qv a ON a.query_id = q.query_id
        JOIN pv b ON b.passage_id = p.passage_id AND b.bucket = a.bucket GROUP BY ALL),
    by_vector AS (
        SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank
        FROM cosines WHERE score >= {min_score} QUALIFY rank <= {depth}),
    {S.first_terms('qt', questions, 'query_id', 'lower(question)', S.SEARCH_TERM)},
    asked AS (
        SELECT DISTINCT query_id, {S.stem('w')} AS stem, 1 AS any_term FROM qt WHERE i <= 8
        UNION ALL
        SELECT DISTINCT query_id, unnest({S.text_stems('question')}), 0 FROM {questions}
        WHERE query_id NOT IN (SELECT query_id FROM qt)),
    fields AS (
        SELECT collection_id, passage_id, 'A' AS field, unnest({S.text_stems('title')}) AS stem FROM passages
        UNION ALL SELECT collection_id, passage_id, 'B', unnest({S.text_stems('hierarchy_path')}) FROM passages
        UNION ALL SELECT collection_id, passage_id, 'C', unnest({S.text_stems('text')}) FROM passages),
    weights AS (
        SELECT collection_id, passage_id, stem, field,
               any_value(CASE field WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.4::DOUBLE ELSE 0.2::DOUBLE END) * count(*) / (count(*) + 1) AS w
        FROM fields GROUP BY collection_id, passage_id, stem, field),
    text_scores AS (
        SELECT a.query_id, w.passage_id, round(sum(w.w), 9) AS score
        FROM asked a JOIN {questions} q ON q.query_id = a.query_id
        JOIN weights w ON w.stem = a.stem AND w.collection_id = q.collection_id
        GROUP BY a.query_id, w.passage_id
        HAVING max(a.any_term) = 1 OR count(DISTINCT a.stem) = (SELECT count(*) FROM asked z WHERE z.query_id = a.query_id)),
    by_text AS (
        SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank
        FROM text_scores QUALIFY rank <= {depth}),
    fused AS (
        SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.passage_id, t.passage_id) AS passage_id,
               coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + t.rank), 0) AS votes
        FROM by_vector v FULL JOIN by_text t ON v.query_id = t.query_id AND v.passage_id = t.passage_id),
    hits AS (
        SELECT query_id, passage_id, round(votes / (2.0::DOUBLE / 61)
               * CASE WHEN page_start > 1 THEN 1 / (1 + 0.005::DOUBLE * (page_start - 1)) ELSE 1 END, 9) AS score,
               row_number() OVER (PARTITION BY query_id ORDER BY round(votes / (2.0::DOUBLE / 61)
               * CASE WHEN page_start > 1 THEN 1 / (1 + 0.005::DOUBLE * (page_start - 1)) ELSE 1 END, 9) DESC, passage_id) AS rank
        FROM fused JOIN passages USING (passage_id) QUALIFY rank <= {limit}),
    placed AS (SELECT h.query_id, h.rank, h.score, p.* FROM hits h JOIN passages p USING (passage_id)),
    near AS (
        SELECT h.query_id, h.rank, n.passage_id, n.chunk_index, n.text, n.page_start, n.page_end
        FROM placed h JOIN passages n ON n.collection_id = h.collection_id AND n.source_file = h.source_file
             AND n.hierarchy_path = h.hierarchy_path AND h.hierarchy_path <> ''
             AND n.chunk_index BETWEEN h.chunk_index - 2 AND h.chunk_index + 2),
    used_1 AS (
        SELECT query_id, passage_id FROM near WHERE rank = 1 UNION SELECT query_id, passage_id FROM hits WHERE rank = 1),
    second AS (
        SELECT h.query_id, min(h.rank) AS rank FROM hits h ANTI JOIN used_1 u USING (query_id, passage_id) GROUP BY h.query_id),
    near_2 AS (
        SELECT n.* FROM near n JOIN second s USING (query_id, rank) ANTI JOIN used_1 u USING (query_id, passage_id)),
    used_2 AS (
        SELECT * FROM used_1 UNION SELECT query_id, passage_id FROM near_2
        UNION SELECT h.query_id, h.passage_id FROM hits h JOIN second s USING (query_id, rank)),
    grown AS (
        SELECT query_id, rank, string_agg(text, {S.NL} || {S.NL} ORDER BY chunk_index) AS text,
               arg_min(page_start, chunk_index) AS page_start, arg_max(page_end, chunk_index) AS page_end
        FROM (SELECT * FROM near WHERE rank = 1 UNION ALL SELECT * FROM near_2) GROUP BY query_id, rank),
    survivors AS (
        SELECT p.* FROM placed p WHERE p.rank = 1
        UNION ALL SELECT p.* FROM placed p JOIN second s USING (query_id, rank)
        UNION ALL SELECT p.* FROM placed p ANTI JOIN used_2 u USING (query_id, passage_id)),
    sections AS (
        SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank) AS place, s.passage_id, s.score,
               s.title, s.hierarchy_path, s.source_file, coalesce(g.text, s.text) AS text,
               coalesce(g.page_start, s.page_start) AS page_start, coalesce(g.page_end, s.page_end) AS page_end
        FROM survivors s LEFT JOIN grown g USING (query_id, rank))"""


BENCH_SEARCH = f"{S.PASSAGES}, {S.QUESTIONS}, {retrieval_sql('questions', L.ASK_LIMIT)}"


_STORED: dict[tuple, tuple] = {}


def stored_index(spark, folder):
    """Passages with vectors and their postings as stored tables, made once per application and input."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STORED:
        passages = written(D.page_embeddings(D.page_passages(spark, folder)))
        _STORED[key] = passages, written(index.postings(passages))
    return _STORED[key]


def stored_cells(spark, folder):
    """The stored passages' vectors by cell, made once like the index."""
    key = (spark.sparkContext.applicationId, folder, "cells")
    if key not in _STORED:
        _STORED[key] = cells.build(stored_index(spark, folder)[0])
    return _STORED[key]


def stored_blocks(spark, folder):
    """The stored postings by block, made once like the index."""
    key = (spark.sparkContext.applicationId, folder, "blocks")
    if key not in _STORED:
        _STORED[key] = textblocks.build(stored_index(spark, folder)[1])
    return _STORED[key]


def _bench(spark, folder):
    passages, postings = stored_index(spark, folder)
    questions = written(D.excerpt_questions(spark, folder)
                        .withColumn("vector", index.hashed_vector(F.col("question"))))
    return questions, passages, postings


def _ranked(df, *columns):
    return df.select(ID, "passage_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *columns)


@query("fulltext_topk", f"""
    WITH {BENCH_SEARCH} SELECT query_id, passage_id, rank, round(score, 6) AS score FROM by_text""")
def fulltext_topk(spark, folder):
    questions, _, postings = _bench(spark, folder)
    return _ranked(R.text_candidates(questions, postings, scores.candidate_depth(L.ASK_LIMIT)))


@query("fulltext_topk_blocks", f"""
    WITH {BENCH_SEARCH} SELECT query_id, passage_id, rank, round(score, 6) AS score FROM by_text""")
def fulltext_topk_blocks(spark, folder):
    """The same lists from postings stored by block, of which only those are read that can reach a list."""
    questions, _, _ = _bench(spark, folder)
    return _ranked(R.text_candidates(questions, stored_blocks(spark, folder), scores.candidate_depth(L.ASK_LIMIT)))


@query("hybrid_rrf", f"""
    WITH {BENCH_SEARCH} SELECT query_id, passage_id, rank, round(score, 6) AS score FROM hits""")
def hybrid_rrf(spark, folder):
    questions, passages, postings = _bench(spark, folder)
    depth = scores.candidate_depth(L.ASK_LIMIT)
    return _ranked(R.fuse(R.vector_candidates(questions, stored_cells(spark, folder), depth),
                          R.text_candidates(questions, postings, depth), L.ASK_LIMIT))


@query("neighbors", f"""
    WITH {BENCH_SEARCH}
    SELECT query_id, rank, passage_id, page_start, page_end FROM near""")
def neighbors(spark, folder):
    questions, passages, postings = _bench(spark, folder)
    depth = scores.candidate_depth(L.ASK_LIMIT)
    hits = R.fuse(R.vector_candidates(questions, stored_cells(spark, folder), depth),
                  R.text_candidates(questions, postings, depth), L.ASK_LIMIT)
    return R.neighbors(R.placed(hits, passages).drop("passage_id"), passages).select(
        ID, F.col("rank").cast("long").alias("rank"), "near.passage_id",
        F.col("near.page_start").cast("long").alias("page_start"), F.col("near.page_end").cast("long").alias("page_end"))


def _section_rows(found, column="sections"):
    return (found.select(ID, F.posexplode(column).alias("i", "s"))
            .select(ID, (F.col("i") + 1).cast("long").alias("place"), "s.passage_id",
                    F.col("s.page_start").cast("long").alias("page_start"),
                    F.col("s.page_end").cast("long").alias("page_end"), F.md5("s.text").alias("text_md5")))


SECTION_COLUMNS = "query_id, place, passage_id, page_start, page_end, md5(text) AS text_md5"


@query("expand_top2", f"WITH {BENCH_SEARCH} SELECT {SECTION_COLUMNS} FROM sections")
def expand_top2(spark, folder):
    questions, passages, postings = _bench(spark, folder)
    return _section_rows(R.search(questions, passages, postings, L.ASK_LIMIT, stored=stored_cells(spark, folder)))


# --- context ---------------------------------------------------------------------------

KEPT = f"""{BENCH_SEARCH}, budget AS (
    SELECT query_id, place, length(text) AS used, true AS kept FROM sections WHERE place = 1
    UNION ALL
    SELECT s.query_id, s.place, CASE WHEN b.used + length(s.text) <= 7000 THEN b.used + length(s.text) ELSE b.used END,
           b.used + length(s.text) <= 7000
    FROM budget b JOIN sections s ON s.query_id = b.query_id AND s.place = b.place + 1),
kept AS (SELECT s.* FROM sections s JOIN budget b USING (query_id, place) WHERE b.kept)"""
PAGE_REF = """CASE WHEN page_start IS NULL OR page_start <= 0 THEN ''
    WHEN page_end > page_start THEN ' (p. ' || page_start || '-' || page_end || ')' ELSE ' (p. ' || page_start || ')' END"""
CONTEXT = f"""{KEPT}, chaptered AS (
    SELECT *, min(place) OVER (PARTITION BY query_id, hierarchy_path) AS chapter_place FROM kept),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chapter_place, place) AS nr FROM chaptered),
contexts AS (
    SELECT query_id, string_agg(
        CASE WHEN hierarchy_path <> '' AND place = chapter_place THEN 'Chapitre : ' || hierarchy_path || {S.NL} || {S.NL} ELSE '' END
        || 'Section ' || nr || ': ' || title || {PAGE_REF} || {S.NL} || text, {S.NL} || {S.NL} ORDER BY nr) AS context
    FROM numbered GROUP BY query_id)"""


def _found(spark, folder):
    questions, passages, postings = _bench(spark, folder)
    found = R.search(questions, passages, postings, L.ASK_LIMIT, stored=stored_cells(spark, folder))
    return questions.select(ID, "collection_id", "question", "expected").join(found, ID, "left")


@query("context_budget", f"WITH RECURSIVE {KEPT} SELECT {SECTION_COLUMNS.replace('place,', '')} FROM kept")
def context_budget(spark, folder):
    kept = C.retrieved_context(_found(spark, folder))
    return _section_rows(kept, "kept").drop("place")


@query("context_text", f"""
    WITH RECURSIVE {CONTEXT} SELECT query_id, context, length(context) AS n_chars FROM contexts""")
def context_text(spark, folder):
    found = C.retrieved_context(_found(spark, folder)).filter(F.col("context").isNotNull())
    return found.select(ID, "context", F.length("context").cast("long").alias("n_chars"))


@query("ask_batch", f"""
    WITH RECURSIVE {CONTEXT}
    SELECT q.query_id, q.collection_id, coalesce(count(k.place), 0) AS n_sections,
           coalesce(any_value(c.context), '') AS answer,
           'Extraits du livret (seule source autorisée) :' || {S.NL} || '---' || {S.NL} || coalesce(any_value(c.context), '')
           || {S.NL} || '---' || {S.NL} || {S.NL} || 'Question : ' || any_value({S.truncated('q.question', 500)}) AS prompt
    FROM questions q LEFT JOIN kept k USING (query_id) LEFT JOIN contexts c USING (query_id)
    GROUP BY q.query_id, q.collection_id""")
def ask_batch(spark, folder):
    """The whole job of `operators.ask`: validation, name lookup, hybrid search, expansion, budget, context, prompt, answer.

    Without a model the answer is the context itself.
    """
    answers = _asked(spark, folder, D.excerpt_questions(spark, folder)).answers
    return answers.select(ID, "collection_id", F.size("sections").cast("long").alias("n_sections"),
                          F.coalesce("answer", F.lit("")).alias("answer"), "prompt")


def _asked(spark, folder, questions, cache=None):
    """`questions` (query_id, collection_id, question) put to the languages as collections, named in capitals."""
    passages, postings = stored_index(spark, folder)
    moment = F.timestamp_seconds(F.lit(1_000_000_000))
    collections = D.table(spark, folder, "documents").select(F.col("lang").alias("collection_id")).distinct().select(
        "collection_id", F.upper("collection_id").alias("name"), moment.alias("updated_at"))
    queries = questions.select(ID, F.concat(F.lit(" "), F.col("collection_id")).alias("collection"), "question",
                               F.from_json(F.lit("[]"), A.HISTORY).alias("history"))
    return A.ask(queries, collections, passages, postings, index.hashed_vector, moment, cache=cache, stored=stored_cells(spark, folder))


@query("ask_outcomes", f"""
    WITH {S.QUESTIONS}
    SELECT query_id, CASE query_id::BIGINT % 4 WHEN 0 THEN 'unknown collection' WHEN 1 THEN 'blank' WHEN 2 THEN 'from cache' ELSE 'asked' END AS outcome,
           CASE WHEN query_id::BIGINT % 4 = 2 THEN 'kept ' || query_id ELSE '' END AS kept FROM questions""")
def ask_outcomes(spark, folder):
    """Benchmark questions of which some name no collection, some are blank and some were answered before."""
    turn = F.col(ID).cast("long") % 4
    questions = D.excerpt_questions(spark, folder).select(
        ID, F.when(turn == 0, "nowhere").otherwise(F.col("collection_id")).alias("collection_id"),
        F.when(turn == 1, " \t").otherwise(F.col("question")).alias("question"))
    moment = F.timestamp_seconds(F.lit(1_000_000_000))
    cache = questions.filter(turn == 2).select(
        V.cache_key(F.col("collection_id"), moment, F.col("question")).alias("cache_key"),
        F.concat(F.lit("kept "), F.col(ID)).alias("answer"), (moment + F.expr("INTERVAL 1 HOUR")).alias("expires_at"))
    found = _asked(spark, folder, questions, cache)
    served = found.answers.select(ID, F.when(F.col("cached"), "from cache").otherwise("asked").alias("outcome"),
                                  F.when(F.col("cached"), F.col("answer")).otherwise("").alias("kept"))
    return served.unionByName(found.rejected.select(ID, F.col("reason").alias("outcome"), F.lit("").alias("kept")))


# --- conversations ---------------------------------------------------------------------

EXCHANGES = """spoken AS (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
    WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
exchanges AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS exchange_no, text AS question,
           CASE WHEN next_role = 'assistant' THEN next_text END AS answer
    FROM spoken WHERE role = 'user')"""
TRIMMED = f"""{EXCHANGES}, complete AS (
    SELECT conv_id, exchange_no, {S.truncated(S.strip('question'), 500)} AS question,
           {S.truncated(S.strip('answer'), 2000)} AS answer FROM exchanges
    WHERE {S.strip("coalesce(question, '')")} <> '' AND {S.strip("coalesce(answer, '')")} <> ''),
history AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY exchange_no DESC) AS age FROM complete QUALIFY age <= 3)"""


def _histories(spark, folder):
    """(conv_id, history): all exchanges of a conversation, oldest first."""
    rows = C.last_exchanges(D.exchanges_history(spark, folder))
    return (rows.groupBy("conv_id")
            .agg(F.sort_array(F.collect_list(F.struct("exchange_no", "question", "answer"))).alias("h"))
            .select("conv_id", F.transform("h", lambda t: F.struct(
                t["question"].alias("question"), t["answer"].alias("answer"))).alias("history"),
                F.try_element_at("h", F.lit(-1))["question"].alias("question")))


@query("history_trim", f"""
    WITH {TRIMMED} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY exchange_no) AS place, question, answer
    FROM history""")
def history_trim(spark, folder):
    trimmed = _histories(spark, folder).select("conv_id", C.trimmed_history(F.col("history")).alias("h"))
    return (trimmed.select("conv_id", F.posexplode("h").alias("i", "t"))
            .select("conv_id", (F.col("i") + 1).cast("long").alias("place"), "t.question", "t.answer"))


@query("history_turns", f"""
    WITH {EXCHANGES}, good AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY exchange_no DESC) AS age FROM exchanges
        WHERE answer <> '' AND NOT contains(answer, '  ') QUALIFY age <= 3),
    capped AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY exchange_no DESC) AS age FROM exchanges QUALIFY age <= 30)
    SELECT c.conv_id, (SELECT string_agg(g.question, ' / ' ORDER BY g.exchange_no) FROM good g WHERE g.conv_id = c.conv_id) AS questions,
           (SELECT arg_max(f.exchange_no, f.exchange_no) FROM capped f WHERE f.conv_id = c.conv_id AND f.answer IS NOT NULL) AS files
    FROM capped c GROUP BY c.conv_id HAVING questions IS NOT NULL""")
def history_turns(spark, folder):
    """Last three good exchanges, and the newest exchange that came with files, per conversation."""
    rows = D.exchanges_history(spark, folder)
    judged = (rows.withColumn("error", F.when(F.col("answer").contains("  "), "broken"))
              .withColumn("model", F.lit("m")))
    turns = C.context_turns(judged).select(
        "conv_id", F.array_join(F.transform("history", lambda t: t["question"]), " / ").alias("questions"))
    files = C.last_files(C.last_exchanges(rows).withColumn(
        "files", F.when(F.col("answer").isNotNull(), F.array("exchange_no")).otherwise(F.array().cast("array<int>"))))
    return turns.join(files, "conv_id", "left").select(
        "conv_id", "questions", F.get(F.col("files"), F.lit(0)).cast("long").alias("files"))


@query("query_validation", f"""
    WITH asked AS (
        SELECT conv_id, turn, CASE WHEN role = 'system' THEN '  ' ELSE role END AS collection, text || ' ' || text AS question
        FROM conversations)
    SELECT conv_id, turn, {S.strip('collection')} <> '' AND {S.strip('question')} <> '' AS accepted,
           CASE WHEN {S.strip('collection')} <> '' THEN {S.truncated(S.strip('question'), 500)} ELSE question END AS question
    FROM asked""")
def query_validation(spark, folder):
    asked = D.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", "  ").otherwise(F.col("role")).alias("collection"),
        F.concat_ws(" ", "text", "text").alias("question"))
    accepted, rejected = C.valid_queries(asked)
    return (accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))
            .select("conv_id", "turn", "accepted", "question"))


@query("prompt_rows", f"""
    WITH {TRIMMED}, last_question AS (
        SELECT conv_id, arg_max(question, exchange_no) AS question, max(exchange_no) AS n FROM exchanges GROUP BY conv_id),
    earlier AS (
        SELECT h.conv_id, string_agg('- ' || h.question || {S.NL}, '' ORDER BY h.exchange_no) AS questions,
               arg_max(h.answer, h.exchange_no) AS answer
        FROM (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.exchange_no DESC) AS back
              FROM complete c JOIN last_question l ON l.conv_id = c.conv_id AND c.exchange_no < l.n QUALIFY back <= 3) h
        GROUP BY h.conv_id)
    SELECT l.conv_id, 'Extraits du livret (seule source autorisée) :' || {S.NL} || '---' || {S.NL} || 'Extrait ' || l.conv_id
           || {S.NL} || '---' || {S.NL} || {S.NL} || coalesce('Questions précédentes :' || {S.NL} || e.questions
           || 'Dernière réponse donnée : ' || e.answer || {S.NL} || {S.NL}, '') || 'Question : ' || l.question AS prompt
    FROM last_question l LEFT JOIN earlier e USING (conv_id)""")
def prompt_rows(spark, folder):
    asked = _histories(spark, folder).withColumn(
        "history", C.trimmed_history(F.slice("history", F.lit(1), F.size("history") - 1)))
    extract = F.concat(F.lit("Extrait "), F.col("conv_id").cast("string"))
    return asked.select("conv_id", C.prompt(F.col("question"), extract, F.col("history")).alias("prompt"))


FOLLOW_UP = f"""{S.PASSAGES}, {TRIMMED}, last_question AS (
    SELECT conv_id, arg_max(question, exchange_no) AS question, max(exchange_no) AS n FROM exchanges GROUP BY conv_id),
earlier AS (
    SELECT h.conv_id, string_agg(h.question, ' ' ORDER BY h.exchange_no DESC) AS questions
    FROM (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.exchange_no DESC) AS back
          FROM complete c JOIN last_question l ON l.conv_id = c.conv_id AND c.exchange_no < l.n QUALIFY back <= 3) h
    GROUP BY h.conv_id),
spoken_in AS (SELECT conv_id, {S.LANGUAGE.replace('text', 'question')} AS collection_id, question FROM last_question),
questions AS (
    SELECT conv_id || '#0' AS query_id, collection_id, question FROM spoken_in
    UNION ALL SELECT s.conv_id || '#1', s.collection_id, s.question || ' ' || e.questions FROM spoken_in s JOIN earlier e USING (conv_id)),
{retrieval_sql('questions', L.ASK_LIMIT)},
mixed AS (
    SELECT string_split(query_id, '#')[1] AS query_id, passage_id, text, page_start, page_end,
           2 * place + (string_split(query_id, '#')[2] = '1')::INT AS pos FROM sections),
once AS (
    SELECT query_id, passage_id, min(pos) AS pos, arg_min(text, pos) AS text, arg_min(page_start, pos) AS page_start,
           arg_min(page_end, pos) AS page_end FROM mixed GROUP BY ALL)"""


@query("interleave_followup", f"""
    WITH {FOLLOW_UP}
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place, passage_id, page_start, page_end,
           md5(text) AS text_md5 FROM once QUALIFY place <= 6""")
def interleave_followup(spark, folder):
    """The last question of every conversation, searched alone and completed by its history."""
    passages, postings = stored_index(spark, folder)
    asked = _histories(spark, folder).select(
        F.col("conv_id").cast("string").alias(ID), D.language_of(F.col("question")).alias("collection_id"), "question",
        C.trimmed_history(F.slice("history", F.lit(1), F.size("history") - 1)).alias("history"))
    found = R.search_with_history(asked, passages, postings, index.hashed_vector, stored=stored_cells(spark, folder))
    return _section_rows(found.filter(F.col("sections").isNotNull()))


# --- another embedding model -----------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(ArrayType(DoubleType()))
def letter_profile(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stand-in for a user's model: how often each letter occurs, at length one."""
    for texts in batches:
        lower = texts.fillna("").str.lower()
        counts = np.stack([lower.str.count(c).to_numpy(dtype="float64") for c in LETTERS], axis=1)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        yield pd.Series(list(np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)))


LETTER_COUNTS = ", ".join(f"length(lower({{x}})) - length(replace(lower({{x}}), '{c}', ''))" for c in LETTERS)


def _letters(x: str) -> str:
    return "[" + LETTER_COUNTS.format(x=x) + "]::DOUBLE[]"


@query("vector_topk_alt_model", f"""
    WITH {S.PASSAGES}, {S.QUESTIONS}, p AS (SELECT passage_id, collection_id, {_letters('text')} AS v FROM passages),
    q AS (SELECT query_id, collection_id, {_letters('question')} AS v FROM questions),
    scored AS (
        SELECT query_id, passage_id, round(list_dot_product(p.v, q.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(q.v, q.v)), 9) AS score
        FROM q JOIN p USING (collection_id))
    SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank,
           round(score, 6) AS score FROM scored WHERE score >= 0.72 QUALIFY rank <= 40""")
def vector_topk_alt_model(spark, folder):
    """The same vector search with another model's vectors; nothing is indexed again."""
    passages = index.with_embedding(D.page_passages(spark, folder), F.col("text"), letter_profile, dimensions=len(LETTERS))
    questions = index.with_embedding(D.excerpt_questions(spark, folder), F.col("question"), letter_profile, "vector")
    return _ranked(R.vector_candidates(questions, written(passages), scores.candidate_depth(L.ASK_LIMIT)))


@query("response_sections", f"""
    WITH RECURSIVE {KEPT}
    SELECT query_id, title, round(score, 6) AS score, coalesce(page_start, 0) AS page_num, coalesce(page_end, 0) AS page_end, source_file AS file
    FROM kept""")
def response_sections(spark, folder):
    """Sections as they are shown beside an answer."""
    kept = C.retrieved_context(_found(spark, folder))
    return (kept.select(ID, F.explode(C.response_sections(F.col("kept"))).alias("s"))
            .select(ID, "s.title", F.round("s.score", 6).alias("score"), F.col("s.page_num").cast("long").alias("page_num"),
                    F.col("s.page_end").cast("long").alias("page_end"), "s.file"))
