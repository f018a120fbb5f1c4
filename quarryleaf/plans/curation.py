"""Queries of operators/curation.py: orders and lines as pairs and decisions, labels as adjudications, parts as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import curation as op
from quarryleaf.plans.adapters import table
from quarryleaf.registry import query

_KEY = "'10.1/' || {}"


def _doi(c):
    return F.concat(F.lit("10.1/"), F.col(c).cast("string"))


@query("upserted_rows", """WITH t AS (SELECT p_brand AS source, p_size AS source_id, min(p_name) AS title, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2),
i AS (SELECT p_brand AS source, p_size AS source_id, arg_max(p_name, p_partkey) AS title FROM part WHERE p_partkey % 3 = 1 GROUP BY 1, 2)
SELECT source, source_id, coalesce(i.title, t.title) AS title, t.n FROM t FULL JOIN i USING (source, source_id)""")
def _(spark, d):
    part = table(spark, d, "part")
    old = part.where("p_partkey % 3 = 0").groupBy(F.col("p_brand").alias("source"), F.col("p_size").alias("source_id")).agg(F.min("p_name").alias("title"), F.count("*").alias("n"))
    new = part.where("p_partkey % 3 = 1").select(F.col("p_brand").alias("source"), F.col("p_size").alias("source_id"), F.col("p_name").alias("title"), "p_partkey")
    return op.upsert(old, new, ["source", "source_id"], ["p_partkey"])


# Pairs: a line's part and supplier; every decision has a reason but those of quantity 1
_PAIRS = """pr AS (SELECT least(a, b) AS a, greatest(a, b) AS b, q, k FROM (SELECT '10.1/' || l_partkey AS a, '10.1/' || (l_partkey + 1 + l_suppkey % 5) AS b, max(l_quantity) AS q, min(l_orderkey) AS k FROM lineitem WHERE l_partkey % 10 = 0 GROUP BY 1, 2)),
st AS (SELECT a, b, CASE WHEN k % 2 = 0 THEN 'merge' ELSE 'keep' END AS decision, CASE WHEN k % 2 = 0 THEN a END AS canonical, 'seen' AS reason FROM pr WHERE q > 48),
inc AS (SELECT a, b, CASE WHEN k % 3 = 0 THEN 'merge' WHEN k % 3 = 1 THEN 'keep' ELSE 'drop' END AS decision, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN a ELSE b END END AS canonical, CASE WHEN k % 11 = 0 THEN ' ' ELSE 'read' END AS reason FROM pr WHERE q <= 49)"""
_DECIDED = f"{_PAIRS}, dec AS (SELECT a, b, decision, canonical, trim(reason) AS reason FROM inc UNION ALL SELECT * FROM st WHERE (a, b) NOT IN (SELECT (a, b) FROM inc))"


def _pairs(spark, d):
    lines = table(spark, d, "lineitem").where("l_partkey % 10 = 0").select(_doi("l_partkey").alias("x"), F.concat(F.lit("10.1/"), (F.col("l_partkey") + 1 + F.col("l_suppkey") % 5).cast("string")).alias("y"), "l_quantity", "l_orderkey")
    rows = lines.groupBy("x", "y").agg(F.max("l_quantity").alias("q"), F.min("l_orderkey").alias("k"))
    rows = rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "q", "k")
    k = F.col("k")
    standing = rows.where("q > 48").select("a", "b", F.when(k % 2 == 0, "merge").otherwise("keep").alias("decision"), F.when(k % 2 == 0, F.col("a")).alias("canonical"), F.lit("seen").alias("reason"))
    side = F.when(k % 2 == 0, F.col("a")).otherwise(F.col("b"))
    kind = F.when(k % 3 == 0, "merge").when(k % 3 == 1, "keep").otherwise("drop")
    incoming = rows.where("q <= 49").select("a", "b", kind.alias("decision"), F.when(k % 3 == 0, side).alias("canonical"), F.when(k % 11 == 0, " ").otherwise("read").alias("reason"))
    return rows, standing, incoming


@query("decided_pairs", f"WITH {_DECIDED} SELECT * FROM dec")
def _(spark, d):
    _, standing, incoming = _pairs(spark, d)
    return op.decided(standing, incoming)


@query("decision_problems", f"""WITH {_DECIDED}, mr AS (SELECT canonical, CASE WHEN canonical = a THEN b ELSE a END AS gone FROM dec WHERE decision = 'merge' AND canonical IS NOT NULL),
wk AS (SELECT '10.1/' || p_partkey AS k FROM part WHERE p_partkey % 13 > 0), qu AS (SELECT a, b FROM pr WHERE k % 17 > 0 UNION SELECT a, b FROM st),
j AS (SELECT a, b, CASE WHEN decision NOT IN ('merge', 'keep') THEN 'unknown decision' WHEN trim(reason) = '' THEN 'no reason' WHEN a NOT IN (SELECT k FROM wk) OR b NOT IN (SELECT k FROM wk) THEN 'unknown work'
 WHEN (a, b) NOT IN (SELECT (a, b) FROM qu) THEN 'not in the queue' WHEN decision = 'merge' AND (CASE WHEN canonical = a THEN b ELSE a END) IN (SELECT gone FROM mr GROUP BY 1 HAVING count(DISTINCT canonical) > 1) THEN 'two canonical works'
 WHEN decision = 'merge' AND (canonical IN (SELECT gone FROM mr) OR (CASE WHEN canonical = a THEN b ELSE a END) IN (SELECT canonical FROM mr)) THEN 'chain' END AS problem FROM inc) SELECT DISTINCT * FROM j WHERE problem IS NOT NULL""")
def _(spark, d):
    rows, standing, incoming = _pairs(spark, d)
    works = table(spark, d, "part").where("p_partkey % 13 > 0").select(_doi("p_partkey").alias("doi"))
    return op.decision_problems(standing, incoming, rows.where("k % 17 > 0").select("a", "b"), works)


@query("undone_decisions", f"WITH {_PAIRS} SELECT * FROM st WHERE (a, b) NOT IN (SELECT (a, b) FROM pr WHERE k % 5 = 0)")
def _(spark, d):
    rows, standing, _ = _pairs(spark, d)
    return op.without_decisions(standing, rows.where("k % 5 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


_LABELS = "CASE doc_id % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'exclude' WHEN 2 THEN 'same' ELSE 'uncertain' END"


def _adjudications(spark, d, where):
    i = F.col("doc_id")
    label = F.when(i % 4 == 0, "include").when(i % 4 == 1, "exclude").when(i % 4 == 2, "same").otherwise("uncertain")
    return table(spark, d, "labels").where(where).select(F.when(i % 2 == 0, "screening").otherwise("author").alias("workflow"), F.lit("v1").alias("dataset_version_id"), i.cast("string").alias("subject_id"), label.alias("final_label"), (i % 7).alias("n"))


@query("adjudicated_labels", f"""WITH o AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'screening' ELSE 'author' END AS workflow, 'v1' AS dataset_version_id, CAST(doc_id AS VARCHAR) AS subject_id, 'old' AS final_label, doc_id % 7 AS n FROM labels WHERE quality = 1),
i AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'screening' ELSE 'author' END AS workflow, 'v1' AS dataset_version_id, CAST(doc_id AS VARCHAR) AS subject_id, {_LABELS} AS final_label, doc_id % 7 AS n FROM labels WHERE doc_id % 3 = 0),
g AS (SELECT * FROM i WHERE (workflow = 'screening' AND final_label IN ('include', 'exclude', 'uncertain')) OR (workflow = 'author' AND final_label IN ('same', 'different', 'uncertain')))
SELECT workflow, dataset_version_id, subject_id, coalesce(g.final_label, o.final_label) AS final_label, coalesce(g.n, o.n) AS n FROM o FULL JOIN g USING (workflow, dataset_version_id, subject_id)""")
def _(spark, d):
    old = _adjudications(spark, d, "quality = 1").withColumn("final_label", F.lit("old"))
    return op.adjudicated(old, _adjudications(spark, d, "doc_id % 3 = 0"), "n")[0]


@query("refused_labels", f"WITH i AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'screening' ELSE 'author' END AS workflow, {_LABELS} AS final_label FROM labels) SELECT workflow, final_label, count(*) AS n FROM i WHERE NOT ((workflow = 'screening' AND final_label IN ('include', 'exclude', 'uncertain')) OR (workflow = 'author' AND final_label IN ('same', 'different', 'uncertain'))) GROUP BY 1, 2")
def _(spark, d):
    rows = _adjudications(spark, d, "true")
    return op.adjudicated(rows.limit(0), rows, "n")[1].groupBy("workflow", "final_label").agg(F.count("*").alias("n"))


@query("model_approvals", "WITH i AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN md5(lang) ELSE sha256(lang) END AS model_sha256, upper(sha256(source)) AS label_set_sha256 FROM documents) SELECT * FROM i WHERE length(model_sha256) = 64")
def _(spark, d):
    docs = table(spark, d, "documents")
    model = F.when(F.col("doc_id") % 5 == 0, F.md5(F.col("lang").cast("binary"))).otherwise(F.sha2(F.col("lang").cast("binary"), 256))
    rows = docs.select(F.col("doc_id").alias("id"), model.alias("model_sha256"), F.upper(F.sha2(F.col("source").cast("binary"), 256)).alias("label_set_sha256"))
    return op.approvals(rows.limit(0), rows)[0]


@query("review_protocols", """WITH o AS (SELECT 'taxonomy' AS workflow, p_brand AS protocol_version, min(p_name) AS instructions, sha256(min(p_name)) AS instructions_sha256 FROM part WHERE p_size < 10 GROUP BY 2),
i AS (SELECT DISTINCT CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE 'taxonomy' END AS workflow, p_brand AS protocol_version, p_name AS instructions, sha256(p_name) AS instructions_sha256 FROM part WHERE p_size > 45),
n AS (SELECT workflow, protocol_version FROM i GROUP BY 1, 2 HAVING count(DISTINCT instructions_sha256) = 1)
SELECT * FROM o UNION ALL SELECT i.* FROM i JOIN n USING (workflow, protocol_version) WHERE workflow = 'taxonomy' AND (workflow, protocol_version) NOT IN (SELECT (workflow, protocol_version) FROM o)""")
def _(spark, d):
    part = table(spark, d, "part")
    sha = F.sha2(F.col("instructions").cast("binary"), 256)
    old = part.where("p_size < 10").groupBy(F.col("p_brand").alias("protocol_version")).agg(F.min("p_name").alias("instructions")).select(F.lit("taxonomy").alias("workflow"), "protocol_version", "instructions", sha.alias("instructions_sha256"))
    new = part.where("p_size > 45").select(F.when(F.col("p_partkey") % 9 == 0, "other").otherwise("taxonomy").alias("workflow"), F.col("p_brand").alias("protocol_version"), F.col("p_name").alias("instructions"))
    return op.protocols(old, new)[0]


_FILES = "f AS (SELECT p_partkey AS k, 'raw/' || p_partkey || '.csv' AS path, p_brand AS source, 'csv' AS kind, sha256(p_name) AS sha256, CAST(p_size AS BIGINT) AS size_bytes FROM part)"


def _files(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("raw/"), k.cast("string"), F.lit(".csv")).alias("path"), F.col("p_brand").alias("source"), F.lit("csv").alias("kind"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"), F.col("p_size").cast("long").alias("size_bytes"))


@query("recorded_files", f"""WITH {_FILES}, m AS (SELECT path, source, kind, sha256, size_bytes FROM f WHERE k % 4 <> 0), s AS (SELECT path, source, kind, CASE WHEN k % 6 = 0 THEN sha256(path) ELSE sha256 END AS sha256, size_bytes + 1 AS size_bytes FROM f WHERE k % 3 = 0)
SELECT path, coalesce(s.source, m.source) AS source, coalesce(s.kind, m.kind) AS kind, coalesce(s.sha256, m.sha256) AS sha256, coalesce(s.size_bytes, m.size_bytes) AS size_bytes, s.path IS NOT NULL AND (m.path IS NULL OR s.sha256 <> m.sha256) AS changed FROM m FULL JOIN s USING (path)""")
def _(spark, d):
    f, k = _files(spark, d), F.col("k")
    scanned = f.where("k % 3 = 0").select("path", "source", "kind", F.when(k % 6 == 0, F.sha2(F.col("path").cast("binary"), 256)).otherwise(F.col("sha256")).alias("sha256"), (F.col("size_bytes") + 1).alias("size_bytes"))
    return op.recorded_files(f.where("k % 4 <> 0").drop("k"), scanned)


@query("versioned_pairs", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, max(l_discount) AS similarity, 'v7' AS dataset_version_id FROM lineitem WHERE l_quantity > 49 GROUP BY l_partkey, l_suppkey")
def _(spark, d):
    pairs = table(spark, d, "lineitem").where("l_quantity > 49").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.max("l_discount").alias("similarity"))
    return op.versioned({"duplicate_pairs": pairs}, "v7")["duplicate_pairs"]


@query("incoming_edges", "SELECT DISTINCT 'openalex' AS provider, 'W' || l_suppkey AS citing_work_id, 'W' || l_partkey AS cited_work_id, TIMESTAMP '2026-01-02 03:04:05' AS observed_at, 'cites_query' AS discovered_via FROM lineitem WHERE l_suppkey <> l_partkey AND l_linenumber <> 2")
def _(spark, d):
    name = lambda c: F.concat(F.lit("W"), F.col(c).cast("string"))
    found = table(spark, d, "lineitem").select(name("l_partkey").alias("cited"), F.when(F.col("l_linenumber") != 2, name("l_suppkey")).alias("citing"))
    return op.incoming_edges(found, F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"))


@query("result_rows", """SELECT 'x1' AS execution_id, CAST(3 AS BIGINT) AS stage_run_id, 'v1' AS dataset_version_id, 'gold' AS stage, o_orderstatus AS check_id, 'error' AS severity, count(*) < 1000 AS passed, '{"value":' || count(*) || '}' AS observed, '{"value":"few"}' AS expected FROM orders GROUP BY o_orderstatus""")
def _(spark, d):
    checks = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("check_id")).agg(F.count("*").alias("observed")).select("check_id", F.lit("error").alias("severity"), (F.col("observed") < 1000).alias("passed"), "observed", F.lit("few").alias("expected"))
    return op.result_rows(checks, "x1", 3, "v1", "gold")
