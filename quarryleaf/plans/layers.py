"""Queries of operators/layers.py, operators/contracts.py and operators/readers.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.functions import names
from quarryleaf.functions.categories import classify
from quarryleaf.operators import contracts, layers, readers
from quarryleaf.plans.adapters import ARTICLES, articles, table
from quarryleaf.registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("layer_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in TABLES))
def _(spark, d):
    return readers.row_counts({t: table(spark, d, t) for t in TABLES})


@query("newest_runs", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    return readers.newest(table(spark, d, "events").select("event_id", "ts", "event_type"), "ts", 50, "event_id")


@query("light_chunks", "SELECT vec_id, label, embedding IS NOT NULL AS has_embedding FROM embeddings")
def _(spark, d):
    return readers.light_chunks(table(spark, d, "embeddings"), "text", "embedding")


_SEM = "s AS (SELECT o_orderkey AS doi, (o_orderkey % 100) / 100.0 AS r, (o_orderkey % 37) / 37.0 AS o FROM orders WHERE o_orderkey % 4 <> 0), m AS (SELECT a.*, r - o AS margin FROM articles a LEFT JOIN s USING (doi))"


@query("article_filter", f"WITH {ARTICLES}, {_SEM} SELECT doi, round(margin, 9) AS margin FROM m WHERE (margin IS NULL OR margin >= 0.1) AND year BETWEEN 1996 AND 1999 AND source IN ('F', 'O') AND venue IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    k = F.col("o_orderkey")
    sem = table(spark, d, "orders").where(k % 4 != 0).select(k.alias("doi"), ((k % 100) / 100.0).alias("relevance_score"), ((k % 37) / 37.0).alias("offtopic_score"))
    rows = readers.filtered(readers.with_margin(articles(spark, d), sem), (1996, 1999), ("F", "O"), ("BUILDING", "MACHINERY"), least_margin=0.1)
    return rows.select("doi", F.round("relevance_margin", 9).alias("margin"))


@query("chunks_of_articles", f"WITH {ARTICLES} SELECT l_orderkey AS doi, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT doi FROM articles WHERE year = 1997) GROUP BY 1")
def _(spark, d):
    chunks = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doi")
    return readers.of_articles(chunks, articles(spark, d).where("year = 1997")).groupBy("doi").agg(F.count("*").alias("n"))


@query("population_check", "SELECT '' AS missing, count(*) AS rows, CAST(count(*) - count(l_shipdate) AS BIGINT) AS blank, CAST(count(*) - count(DISTINCT l_orderkey || ':' || l_linenumber) AS BIGINT) AS repeated FROM lineitem")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("doi"))
    return readers.population(rows, ["doi"]).withColumn("missing", F.array_join("missing", ","))


@query("normalised_identifiers", r"SELECT page_id, nullif(lower(trim(regexp_replace(trim(url), '(?i)^https?://(www\.)?', ''))), '') AS id, split_part(regexp_replace(url, '/+$', ''), '/', -1) AS last FROM pages")
def _(spark, d):
    bare = F.regexp_replace(F.trim("url"), r"(?i)^https?://(www\.)?", F.lit("https://doi.org/"))
    return table(spark, d, "pages").select("page_id", names.normal_doi(bare).alias("id"), names.short_id(F.col("url")).alias("last"))


@query("normalised_titles", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", names.normal_title(F.col("text")).alias("title"))


_KIND = "CASE WHEN regexp_matches(t, '\\b(review|survey|overview)\\b') THEN 'review' WHEN k IN ('conference', 'inproceedings') THEN 'conference' WHEN regexp_matches(v, '\\b(conference|symposium|workshop)\\b') THEN 'conference' WHEN k = 'article' THEN 'journal' ELSE 'other' END"


@query("publication_categories", f"WITH r AS (SELECT p_partkey, lower(CASE p_size % 4 WHEN 0 THEN 'A Survey of ' ELSE '' END || p_name) AS t, CASE p_size % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'inproceedings' ELSE 'misc' END AS k, CASE p_size % 5 WHEN 0 THEN 'some workshop' ELSE 'letters' END AS v FROM part) SELECT {_KIND} AS category, count(*) AS n FROM r GROUP BY 1")
def _(spark, d):
    s = F.col("p_size")
    kind = classify(
        F.when(s % 3 == 0, "article").when(s % 3 == 1, "inproceedings").otherwise("misc"), F.concat(F.when(s % 4 == 0, "A Survey of ").otherwise(""), "p_name"),
        F.when(s % 5 == 0, "some workshop").otherwise("letters"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return table(spark, d, "part").groupBy(kind["category"].alias("category")).agg(F.count("*").alias("n"))


@query("data_contract", """SELECT 'lines.non_empty' AS check_id, 'error' AS severity, count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS observed, '1' AS expected FROM lineitem
UNION ALL SELECT 'lines.unique', 'error', count(*) = count(DISTINCT (l_orderkey, l_linenumber)), CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS VARCHAR), '0' FROM lineitem
UNION ALL SELECT 'lines.parent', 'error', count(*) = 0, CAST(count(*) AS VARCHAR), '0' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders.domain', 'warning', count(*) = 0, CAST(count(*) AS VARCHAR), '0' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'orders.partition', 'error', count(*) = 0, CAST(count(*) AS VARCHAR), '0' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'orders.same', 'error', count(*) = 0, CAST(count(*) AS VARCHAR), '0' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    ids = orders.select(F.col("o_orderkey").alias("id"))
    return contracts.union([
        contracts.non_empty("lines.non_empty", lines), contracts.unique("lines.unique", lines, ["l_orderkey", "l_linenumber"]), contracts.references("lines.parent", lines, "l_orderkey", orders, "o_orderkey"),
        contracts.in_domain("orders.domain", orders, "o_orderstatus", ["F", "O"], "warning"),
        contracts.partition("orders.partition", ids, [orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id")), orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))], "id"),
        contracts.same_set("orders.same", ids, lines.select(F.col("l_orderkey").alias("id")).distinct(), "id")])


_RESULTS = "r AS (SELECT 'v' || user_id % 2 AS dataset_version_id, event_type AS stage, 'c' || user_id % 5 AS check_id, event_id AS stage_run_id, CASE WHEN user_id % 3 = 0 THEN 'warning' ELSE 'error' END AS severity, value > 20 AS passed FROM events)"


def results(spark, d):
    u = F.col("user_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("v"), (u % 2).cast("string")).alias("dataset_version_id"), F.col("event_type").alias("stage"), F.concat(F.lit("c"), (u % 5).cast("string")).alias("check_id"), F.col("event_id").alias("stage_run_id"),
        F.when(u % 3 == 0, "warning").otherwise("error").alias("severity"), (F.col("value") > 20).alias("passed"))


@query("blocking_failures", f"WITH {_RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY stage_run_id DESC) AS i FROM r) SELECT dataset_version_id, stage, check_id, stage_run_id FROM k WHERE i = 1 AND NOT passed AND severity = 'error'")
def _(spark, d):
    return contracts.failures(results(spark, d)).select("dataset_version_id", "stage", "check_id", "stage_run_id")


@query("contract_status", f"WITH {_RESULTS}, k AS (SELECT *, row_number() OVER (PARTITION BY dataset_version_id, stage, check_id ORDER BY stage_run_id DESC) AS i FROM r) SELECT dataset_version_id, stage, count(*) AS checks, count(*) FILTER (NOT passed AND severity = 'error') AS errors, count(*) FILTER (NOT passed AND severity <> 'error') AS warnings FROM k WHERE i = 1 GROUP BY 1, 2")
def _(spark, d):
    return contracts.status(results(spark, d))


@query("pending_observations", "SELECT DISTINCT user_id AS doi FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 90)")
def _(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "doi")
    seen = e.where("event_type = 'purchase' and value > 90").withColumn("status", F.lit("success"))
    return layers.pending(e, seen)


@query("stale_executions", "SELECT event_id FROM events WHERE event_type = 'click' AND coalesce(CASE WHEN user_id % 2 = 0 THEN ts + INTERVAL 5 DAY END, ts) < TIMESTAMP '2024-01-10'")
def _(spark, d):
    beat = F.when(F.col("user_id") % 2 == 0, F.col("ts") + F.expr("interval 5 days"))
    runs = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), beat.alias("heartbeat_at"), F.col("ts").alias("started_at"))
    return layers.stale(runs, F.lit("2024-01-10").cast("timestamp_ntz")).select("event_id")


@query("reused_vectors", "WITH p AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 10 = 0 THEN text || '.' ELSE text END) AS h FROM documents) SELECT count(*) AS chunks, count(p.doc_id) FILTER (p.h = n.h) AS reused FROM n LEFT JOIN p USING (doc_id)")
def _(spark, d):
    i = F.col("doc_id")
    base = table(spark, d, "documents").select(i.alias("doi"), F.lit("abstract").alias("chunk_type"), F.lit(0).alias("seq"), "text")
    hashed = lambda df: df.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    old = hashed(base.where("doi % 3 <> 0")).withColumn("embedding", F.array(F.lit(1.0)))
    new = hashed(base.withColumn("text", F.when(F.col("doi") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    return layers.reused_vectors(new, old).agg(F.count("*").alias("chunks"), F.count("embedding").alias("reused"))
