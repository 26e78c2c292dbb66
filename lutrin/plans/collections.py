"""Queries that look up, change and describe stored collections and files."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lutrin.functions import text as T
from lutrin.operators import maintain as M
from lutrin.operators import names as N
from lutrin.operators import passages as P
from lutrin.plans import sql as S
from lutrin.plans.registry import query
from lutrin.session import shared_folder
from lutrin.sources import catalog, files, generations
from lutrin.sources import tables as D

# --- counts, lookups -------------------------------------------------------------------


@query("collection_counts", """
    SELECT c_custkey AS collection_id, c_name AS name, coalesce(n, 0) AS n_passages
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def collection_counts(spark, folder):
    """Every customer (collection) with its orders (passages), zero included, by name."""
    collections = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("collection_id"), F.col("c_name").alias("name"))
    passages = D.table(spark, folder, "orders").select(F.col("o_custkey").alias("collection_id"))
    return M.collection_counts(collections, passages).orderBy("name")


@query("lookup_by_name", """
    WITH wanted AS (SELECT upper(c_name) AS wanted FROM customer UNION ALL SELECT n_name FROM nation)
    SELECT w.wanted, coalesce(c.c_custkey, -1) AS id, c.c_custkey IS NOT NULL AS found
    FROM wanted w LEFT JOIN customer c ON lower(c.c_name) = lower(w.wanted)""")
def lookup_by_name(spark, folder):
    """Case-insensitive lookup of many names at once; names without a row come back as not found."""
    rows = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    wanted = rows.select(F.upper("name").alias("wanted")).unionByName(
        D.table(spark, folder, "nation").select(F.col("n_name").alias("wanted")))
    found, missing = N.by_name(wanted, rows)
    return (found.select("wanted", "id", F.lit(True).alias("found"))
            .unionByName(missing.select("wanted", F.lit(-1).cast("long").alias("id"), F.lit(False).alias("found"))))


@query("selected_orders", """
    SELECT o_orderkey AS passage_id, o_custkey AS collection_id FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE lower(c_mktsegment) LIKE '%build%')""")
def selected_orders(spark, folder):
    """Passage ids of the collections whose name holds a text, whatever its case."""
    chosen = N.name_search(D.table(spark, folder, "customer"), "BUILD", "c_mktsegment")
    rows = D.table(spark, folder, "orders").select(F.col("o_orderkey").alias("passage_id"), F.col("o_custkey").alias("collection_id"))
    return N.by_id(rows, chosen.select(F.col("c_custkey").alias("collection_id")), "collection_id")


@query("shared_names", """
    SELECT lower(p_name) AS name_key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1""")
def shared_names(spark, folder):
    return N.ambiguous_names(D.table(spark, folder, "part"), "p_name")


NAME_KEY = "trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g'))"


def _short_key(x: str) -> str:
    return f"regexp_replace({NAME_KEY.format(x=x)}, '^(le|la|les|l|the) ', '')"


@query("collection_name_match", f"""
    WITH names AS (
        SELECT DISTINCT name, {_short_key('name')} AS key FROM (
            SELECT n_name AS name FROM nation UNION ALL SELECT 'Les ' || n_name || ' Junior' FROM nation
            UNION ALL SELECT p_name FROM part)),
    asked AS (
        SELECT doc_id AS query_id, ' ' || {NAME_KEY.format(x='question')} || ' ' AS text FROM (
            SELECT doc_id, text || ' à ' || n_name || CASE WHEN doc_id % 3 = 0 THEN ' junior ?' WHEN doc_id % 3 = 1 THEN ' ou Canada ?' ELSE ' ?' END AS question
            FROM documents JOIN nation ON n_nationkey = doc_id % 25)),
    cited AS (SELECT query_id, name, key FROM asked JOIN names ON key <> '' AND contains(text, ' ' || key || ' ')),
    best AS (
        SELECT *, first_value(name) OVER w AS best_name, first_value(key) OVER w AS best_key
        FROM cited WINDOW w AS (PARTITION BY query_id ORDER BY length(name) DESC, name)),
    settled AS (
        SELECT query_id, any_value(best_name) AS best_name, bool_and(contains(best_key, key)) AS clear FROM best GROUP BY query_id)
    SELECT a.query_id, coalesce(CASE WHEN clear THEN best_name END, '') AS name FROM asked a LEFT JOIN settled USING (query_id)""")
def collection_name_match(spark, folder):
    """The longest name a text cites; none when it cites several different ones."""
    nations, parts = D.table(spark, folder, "nation"), D.table(spark, folder, "part")
    names = (nations.select(F.col("n_name").alias("name"))
             .unionByName(nations.select(F.concat(F.lit("Les "), "n_name", F.lit(" Junior")).alias("name")))
             .unionByName(parts.select(F.col("p_name").alias("name"))))
    docs = D.texts(spark, folder).join(
        nations, F.col("n_nationkey") == (F.col("doc_id") % 25).cast("int"))
    tail = F.when(F.col("doc_id") % 3 == 0, " junior ?").when(F.col("doc_id") % 3 == 1, " ou Canada ?").otherwise(" ?")
    questions = docs.select(F.col("doc_id").alias("query_id"),
                            F.concat("text", F.lit(" à "), "n_name", tail).alias("question"))
    return N.detected_names(questions, names).withColumn("name", F.coalesce("name", F.lit("")))


# --- changes ---------------------------------------------------------------------------

# Changes: urgent orders get a new price and no status; new orders come from suppliers.
CHANGES = """changes AS (
    SELECT o_orderkey, NULL::VARCHAR AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate + INTERVAL 1 DAY AS o_orderdate
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT -1 - s_suppkey, 'N', s_acctbal, TIMESTAMP '1999-01-01' FROM supplier)"""


@query("upsert", f"""
    WITH {CHANGES}
    SELECT coalesce(o.o_orderkey, c.o_orderkey) AS o_orderkey, coalesce(c.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
           coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice,
           strftime(coalesce(o.o_orderdate, c.o_orderdate), '%Y-%m-%d') AS created,
           CASE WHEN c.o_orderkey IS NOT NULL THEN 'now' ELSE o.o_orderpriority END AS touched
    FROM orders o FULL JOIN changes c ON o.o_orderkey = c.o_orderkey""")
def upsert(spark, folder):
    orders = D.table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", F.col("o_orderpriority").alias("touched"))
    urgent = orders.filter(F.col("touched") == "1-URGENT").select(
        "o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("o_orderdate"))
    new = D.table(spark, folder, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"),
        F.col("s_acctbal").alias("o_totalprice"), F.lit("1999-01-01").cast("timestamp_ntz").alias("o_orderdate"))
    out = M.upsert(orders, urgent.unionByName(new), "o_orderkey", fixed=["o_orderdate"], touched="touched", now=F.lit("now"))
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice",
                      F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"), "touched")


@query("cascade_delete", """
    SELECT 'customer' AS kind, c_custkey AS id FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT 'order', o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
              OR o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def cascade_delete(spark, folder):
    customers, orders = D.table(spark, folder, "customer"), D.table(spark, folder, "orders")
    parents, children = M.cascade_delete(customers, orders, customers.filter(F.col("c_acctbal") < 0), "c_custkey", "o_custkey")
    return (parents.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
            .unionByName(children.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))))


@query("failed_reindex_cleanup", """
    SELECT o_orderkey AS passage_id, o_orderdate >= TIMESTAMP '1998-01-01' AS is_new FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_orderdate) >= TIMESTAMP '1998-01-01') AND
          o_orderdate < TIMESTAMP '1998-01-01'""")
def failed_reindex_cleanup(spark, folder):
    """A re-index of stored collections that fails while it writes its rows: the version that was is what readers find."""
    root = _stored_orders(spark, folder)
    recent = _order_passages(spark, folder).filter("is_new").withColumn("passage_id", F.when(
        F.col("passage_id") % 7 == 3, F.raise_error(F.lit("no vector for this passage")).cast("long")).otherwise(F.col("passage_id")))
    try:
        M.reindex(recent, root)
    except PySparkException as e:
        if "no vector for this passage" not in str(e):
            raise
    return generations.read(spark, root).select("passage_id", "is_new")


def _order_passages(spark, folder):
    """Orders as passages of their customers; those from 1998 on are the new ones."""
    recent = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return D.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("passage_id"), F.col("o_custkey").alias("collection_id"), recent.alias("is_new"))


def _stored_orders(spark, folder):
    """A stored table with the earlier orders of the customers that have new ones."""
    rows = _order_passages(spark, folder)
    touched = rows.filter("is_new").select("collection_id").distinct()
    root = f"{shared_folder(spark)}/lutrin-{uuid.uuid4().hex}/passages"
    generations.commit(spark, root, rows.filter("not is_new").join(touched, "collection_id", "left_semi"))
    return root


@query("rollback", """
    WITH touched AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'),
    early AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (FROM touched) AND o_orderdate < TIMESTAMP '1998-01-01'),
    late AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
    SELECT 'before' AS version, o_orderkey AS passage_id FROM early
    UNION ALL SELECT 'imported', o_orderkey FROM late
    UNION ALL SELECT 'rolled back', o_orderkey FROM early
    UNION ALL SELECT 'partly', o_orderkey FROM early WHERE o_custkey % 2 = 0
    UNION ALL SELECT 'partly', o_orderkey FROM late WHERE o_custkey % 2 = 1""")
def rollback(spark, folder):
    """A whole import taken back by the pointer, and one of which only the even collections are taken back, row by row."""
    root = _stored_orders(spark, folder)
    late = _order_passages(spark, folder).filter("is_new")
    before = generations.version(spark, root)
    M.reindex(late, root)
    imported = generations.version(spark, root)
    back = generations.restore(spark, root, before.number)
    M.reindex(late, root)
    failed = late.filter(F.col("collection_id") % 2 == 0).select("collection_id").distinct()
    earlier = generations.read(spark, root, before).join(failed, "collection_id", "left_semi")
    partly = generations.commit(spark, root, earlier, failed)
    found = [generations.read(spark, root, at).select(F.lit(name).alias("version"), "passage_id")
             for name, at in (("before", before), ("imported", imported), ("rolled back", back), ("partly", partly))]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("replace_vs_merge", """
    WITH listed AS (
        SELECT o_custkey, list_sort(list_distinct(list('f' || (o_orderkey % 7)) FILTER (o_orderstatus = 'F'))) AS prev,
               list_sort(list_distinct(list('f' || (o_orderkey % 5)) FILTER (o_orderstatus <> 'F'))) AS new
        FROM orders GROUP BY o_custkey),
    filled AS (SELECT o_custkey, coalesce(prev, []) AS prev, coalesce(new, []) AS new, CASE WHEN o_custkey % 2 = 0 THEN 'merge' ELSE 'replace' END AS mode FROM listed)
    SELECT o_custkey AS collection_id, mode,
           array_to_string(CASE WHEN mode = 'merge' THEN list_concat(prev, list_filter(new, lambda f: NOT list_contains(prev, f))) ELSE new END, ' ') AS files,
           array_to_string(CASE WHEN mode = 'merge' THEN [] ELSE list_filter(prev, lambda f: NOT list_contains(new, f)) END, ' ') AS replaced,
           array_to_string(list_filter(new, lambda f: NOT list_contains(prev, f)), ' ') AS added
    FROM filled""")
def replace_vs_merge(spark, folder):
    def names(n, kept):
        return F.sort_array(F.collect_set(F.when(kept, F.concat(F.lit("f"), (F.col("o_orderkey") % n).cast("string")))))
    done = F.col("o_orderstatus") == "F"
    rows = (D.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("collection_id"))
            .agg(names(7, done).alias("previous"), names(5, ~done).alias("new"))
            .withColumn("mode", F.when(F.col("collection_id") % 2 == 0, "merge").otherwise("replace")))
    plan = M.import_plan(rows)
    return plan.select("collection_id", "mode", *[F.array_join(c, " ").alias(c) for c in ("files", "replaced", "added")])


@query("field_updates", """
    SELECT c_custkey, coalesce(g.gameplay, c_mktsegment) AS gameplay, g.gameplay IS NOT NULL AS updated
    FROM customer LEFT JOIN (SELECT o_custkey, 'orders ' || count(*) AS gameplay FROM orders GROUP BY o_custkey) g ON o_custkey = c_custkey""")
def field_updates(spark, folder):
    """Only the derived field and its update mark change, and only where there is a new value."""
    rows = D.table(spark, folder, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("gameplay"), F.lit(False).alias("updated"))
    values = (D.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey"))
              .agg(F.concat(F.lit("orders "), F.count("*").cast("string")).alias("gameplay"))
              .withColumn("updated", F.lit(True)))
    return M.set_fields(rows, "c_custkey", values, ["gameplay", "updated"])


@query("metadata_overlay", """
    SELECT c_custkey, c_mktsegment AS segment, c_nationkey::VARCHAR AS players, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'old' END AS age FROM customer""")
def metadata_overlay(spark, folder):
    old = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("age"), F.lit("old"))
    new = F.when(F.col("c_acctbal") < 0, F.create_map(
        F.lit("players"), F.col("c_nationkey").cast("string"), F.lit("age"), F.lit("low"))).otherwise(
        F.create_map(F.lit("players"), F.col("c_nationkey").cast("string")))
    merged = D.table(spark, folder, "customer").select("c_custkey", M.overlay(old, new).alias("m"))
    return merged.select("c_custkey", *[F.col("m")[k].alias(k) for k in ("segment", "players", "age")])


@query("bulk_status", f"""
    WITH RECURSIVE {S.PAGES}, p AS (
        SELECT d.doc_id, source AS collection_id, page_no, CASE WHEN l.toxic = 1 THEN '' ELSE text END AS text
        FROM doc_pages d LEFT JOIN labels l USING (doc_id)),
    {S.chunks('p')}, per_doc AS (
        SELECT p.collection_id, p.doc_id, sum(length(p.text)) AS n_chars, coalesce(any_value(c.n), 0) AS n
        FROM p LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id) GROUP BY ALL)
    SELECT collection_id, count(*) AS files, count(*) FILTER (n > 0) AS indexed, count(*) FILTER (n = 0) AS failed,
           count(*) FILTER (n_chars = 0) AS no_text, sum(n)::BIGINT AS n_passages, sum(n) > 0 AS success
    FROM per_doc GROUP BY collection_id""")
def bulk_status(spark, folder):
    """One bulk run over all collections: documents without text are error rows and stop nothing."""
    labels = D.table(spark, folder, "labels").filter("toxic = 1").select("doc_id").withColumn("blank", F.lit(True))
    docs = D.documents(spark, folder).join(labels, "doc_id", "left").withColumn("pages", F.when(
        F.col("blank"), F.transform("pages", lambda p: F.struct(p["page_no"].alias("page_no"), F.lit("").alias("text")))
    ).otherwise(F.col("pages")))
    outcomes = M.outcome(docs, P.passages(docs))
    empty = outcomes.groupBy("collection_id").agg(F.count_if(F.col("status") == "no text").alias("no_text"))
    return M.run_summary(outcomes).join(empty, "collection_id")


@query("file_lists", """
    SELECT p_partkey AS id, array_to_string(CASE WHEN p_size % 2 = 0 THEN [p_name] ELSE
           list_filter(list_transform(string_split(p_brand || ' + ' || p_name || ' + ', '+'), lambda f: trim(f)), lambda f: f <> '') END, '|') AS files
    FROM part WHERE p_size % 3 > 0""")
def file_lists(spark, folder):
    """Stored list, else the legacy text cut at plus signs; rows with neither are left out."""
    parts = D.table(spark, folder, "part")
    stored = F.when(F.col("p_size") % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    legacy = F.concat("p_brand", F.lit(" + "), "p_name", F.lit(" + "))
    rows = parts.select(F.col("p_partkey").alias("id"),
                        F.when(F.col("p_size") % 3 > 0, stored).alias("files"),
                        F.when(F.col("p_size") % 3 > 0, legacy).otherwise(" + ").alias("legacy"))
    resolved = rows.select("id", M.source_files(F.col("files"), F.col("legacy")).alias("f")).filter(F.col("f").isNotNull())
    return resolved.select("id", F.array_join("f", "|").alias("files"))


# --- files -----------------------------------------------------------------------------

URL_BASE = "regexp_extract(rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1)"


@query("file_manifest", f"""
    WITH named AS (
        SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN regexp_replace(html, '<[^>]*>', '', 'g')
                    WHEN page_id % 4 = 1 THEN '%PDF-1.7 ' || html ELSE html END AS content,
               CASE WHEN {URL_BASE} IN ('', '.') THEN 'downloaded-file' ELSE {URL_BASE} END AS name FROM pages)
    SELECT page_id, name, CASE WHEN page_id % 4 = 0 THEN CASE WHEN lower(name) LIKE '%.md' THEN '.md' ELSE '.txt' END
                WHEN page_id % 4 = 1 THEN '.pdf' ELSE '' END AS format,
           regexp_replace(name, '[^a-zA-Z0-9._-]', '_', 'g') AS file_name,
           page_id % 4 < 2 AS accepted, strlen(content) AS size
    FROM named""")
def file_manifest(spark, folder):
    """Fetched pages as files: name from the URL, format by content, web pages rejected."""
    pages = D.table(spark, folder, "pages")
    kind = F.col("page_id") % 4
    content = (F.when(kind == 0, F.regexp_replace("html", "<[^>]*>", ""))
               .when(kind == 1, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html")))
    fetched = pages.select("page_id", "url", F.encode(content, "UTF-8").alias("body"))
    arrived = fetched.select("page_id", "url", F.substring("body", 1, 512).alias("head"),
                             F.octet_length("body").cast("long").alias("size"))
    return files.manifest(arrived).select(
        "page_id", "name", F.coalesce("format", F.lit("")).alias("format"), "file_name", "accepted", "size")


@query("slugs", """
    SELECT p_partkey AS id, regexp_replace(replace(lower(p_name || ' L''' || p_brand || ' É ' || p_type), ' ', '-'), '[^a-z0-9-]', '', 'g') AS slug,
           regexp_replace(regexp_replace(replace(p_name, ' ', '_') || '_à_' || p_brand, 'à', 'a', 'g'), '[^a-zA-Z0-9._-]', '_', 'g') || '.pdf' AS file_name
    FROM part""")
def slugs(spark, folder):
    parts = D.table(spark, folder, "part")
    return parts.select(
        F.col("p_partkey").alias("id"),
        T.slug(F.concat("p_name", F.lit(" L'"), "p_brand", F.lit(" É "), "p_type")).alias("slug"),
        T.safe_file_name(F.concat(F.lit("../up\\"), "p_name", F.lit(" à "), "p_brand", F.lit(".pdf"))).alias("file_name"))


@query("catalog_profile", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, row_number() OVER () AS position, "
    f"(SELECT count(*) FROM {t}) AS row_count FROM (DESCRIBE {t})" for t in D.TABLES))
def catalog_profile(spark, folder):
    described = catalog.profile(spark, {t: D.table(spark, folder, t) for t in D.TABLES})
    return described.select("table_name", "column_name", F.col("position").cast("long").alias("position"), "row_count")


BOUNDED = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber"


@query("bounded_query", f"SELECT *, (SELECT count(*) > 100 FROM lineitem) AS truncated FROM ({BOUNDED}) LIMIT 100")
def bounded_query(spark, folder):
    """A report of the first hundred rows, and whether there are more."""
    D.table(spark, folder, "lineitem").createOrReplaceTempView("lineitem")
    return catalog.bounded_result(spark, BOUNDED, 100, seconds=300)
