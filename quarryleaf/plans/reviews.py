"""Queries of operators/reviews.py: labels of quality and toxicity as two reviewers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import reviews as op
from quarryleaf.plans.adapters import table
from quarryleaf.registry import query


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|' || 7), doc_id) AS r FROM documents) WHERE r <= 15")
def _(spark, d):
    return op.stratified(table(spark, d, "documents"), "lang", "doc_id", 15, 7).select("doc_id", "lang")


@query("score_bands", "SELECT CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 2000 THEN 1 WHEN n_chars < 5000 THEN 2 END AS band, count(*) AS n FROM documents WHERE n_chars >= 0 GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(op.band(F.col("n_chars"), [0, 500, 2000, 5000]).alias("band")).agg(F.count("*").alias("n"))


@query("margin_sample", """WITH m AS (SELECT doc_id, (doc_id * 7919 % 1000) / 1000.0 - 0.5 AS margin FROM documents), s AS (SELECT doc_id, margin, CASE WHEN margin < -0.1 THEN 0 WHEN margin < 0 THEN 1 WHEN margin < 0.1 THEN 2 ELSE 3 END AS stratum FROM m)
SELECT doc_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id || '|' || 42), doc_id) AS r FROM s) WHERE r <= 10""")
def _(spark, d):
    i = F.col("doc_id")
    return op.margin_sample(table(spark, d, "documents").select(i, ((i * 7919 % 1000) / 1000.0 - 0.5).alias("margin")), "doc_id", "margin", 40).select("doc_id", "stratum")


@query("proportional_interleave", "SELECT doc_id, round((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 0.5) / count(*) OVER (PARTITION BY source), 9) AS position FROM documents")
def _(spark, d):
    return op.interleaved(table(spark, d, "documents"), "source", "doc_id").select("doc_id", F.round("position", 9).alias("position"))


@query("ambiguous_names")
def _(spark, d):
    """Names of made-up people from the customers' names; checked in tests on spelled-out cases."""
    i = F.col("c_custkey")
    first = F.array(*(F.lit(x) for x in ("Ana", "A.", "Bo", "B. C.", "Carl", "Ana B.")))
    last = F.array(*(F.lit(x) for x in ("Silva", "Muller", "Chen", "Smith", "Lee")))
    names = table(spark, d, "customer").select(F.concat_ws(" ", F.get(first, (i % 6).cast("int")), F.get(last, (F.col("c_nationkey") % 5).cast("int"))).alias("name"))
    return op.ambiguous_names(names, "name")


@query("pooled_subjects", "WITH r AS (SELECT label AS query_id, vec_id % 40 AS doc_id, min(vec_id) AS rank FROM embeddings GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS i FROM r) SELECT DISTINCT doc_id FROM w WHERE i <= 10")
def _(spark, d):
    return op.pooled(table(spark, d, "embeddings").select(F.col("label").alias("query_id"), (F.col("vec_id") % 40).alias("doc_id"), F.col("vec_id").alias("rank")))


_ASSIGNED = "a AS (SELECT doc_id * 2 + k AS assignment_id, doc_id AS subject_id, CASE k WHEN 0 THEN 'ann' ELSE 'bob' END AS reviewer_id FROM labels, (VALUES (0), (1)) t(k))"


def assigned(spark, d):
    both = table(spark, d, "labels").select(F.col("doc_id").alias("subject_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return both.select((F.col("subject_id") * 2 + F.col("k")).alias("assignment_id"), "subject_id", F.when(F.col("k") == 0, "ann").otherwise("bob").alias("reviewer_id"))


def label_rows(spark, d):
    pair = F.array(F.struct(F.lit(0).alias("k"), F.col("quality").alias("v")), F.struct(F.lit(1).alias("k"), F.col("toxic").alias("v")))
    rows = table(spark, d, "labels").where("doc_id % 5 <> 0").select("doc_id", F.explode(pair).alias("p"))
    return rows.select((F.col("doc_id") * 2 + F.col("p.k")).alias("assignment_id"), F.lit(1).alias("label_revision"), F.col("p.v").cast("string").alias("label"))


@query("review_progress", f"WITH {_ASSIGNED}, l AS (SELECT doc_id * 2 + k AS assignment_id FROM labels, (VALUES (0), (1)) t(k) WHERE doc_id % 5 <> 0) SELECT reviewer_id, count(*) AS total, count(l.assignment_id) AS labelled, count(*) - count(l.assignment_id) AS outstanding FROM a LEFT JOIN l USING (assignment_id) GROUP BY 1")
def _(spark, d):
    return op.progress(assigned(spark, d), label_rows(spark, d))


@query("open_assignments", f"WITH {_ASSIGNED} SELECT doc_id AS subject_id, r AS reviewer_id FROM (SELECT doc_id FROM documents WHERE doc_id < 500), (VALUES ('ann'), ('bob'), ('cyd')) t(r) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.subject_id = doc_id AND a.reviewer_id = r)")
def _(spark, d):
    return op.assignments(table(spark, d, "documents").where("doc_id < 500").select(F.col("doc_id").alias("subject_id")), ["ann", "bob", "cyd"], assigned(spark, d))


@query("collected_labels", f"WITH {_ASSIGNED}, l AS (SELECT doc_id * 2 + k AS assignment_id, CASE k WHEN 0 THEN quality ELSE toxic END AS label FROM labels, (VALUES (0), (1)) t(k) WHERE doc_id % 5 <> 0) SELECT subject_id, reviewer_id, CAST(label AS VARCHAR) AS label FROM a JOIN l USING (assignment_id) UNION ALL SELECT doc_id, 'adjudicated', 'include' FROM labels WHERE doc_id % 50 = 0")
def _(spark, d):
    final = table(spark, d, "labels").where("doc_id % 50 = 0").select(F.col("doc_id").alias("subject_id"), F.lit("include").alias("final_label"))
    return op.collected(label_rows(spark, d), assigned(spark, d), final)


def raw_labels(spark, d):
    i = F.col("doc_id")
    pair = F.array(F.struct(F.lit("ann").alias("r"), F.col("quality").alias("v")), F.struct(F.lit("bob").alias("r"), F.col("toxic").alias("v")))
    rows = table(spark, d, "labels").select(i, F.explode(pair).alias("p"))
    odd = F.when(i % 17 == 0, "Maybe").when(i % 23 == 0, "???").when(F.col("p.v") == 1, " Yes").otherwise("exclude")
    return rows.select(F.concat(F.lit("https://doi.org/10.1/"), i.cast("string")).alias("doi"), F.col("p.r").alias("reviewer"), odd.alias("label"))


_RAW = "r AS (SELECT doc_id, '10.1/' || doc_id AS doi, k AS reviewer, CASE WHEN doc_id % 17 = 0 THEN 'uncertain' WHEN doc_id % 23 = 0 THEN NULL WHEN (k = 'ann' AND quality = 1) OR (k = 'bob' AND toxic = 1) THEN 'include' ELSE 'exclude' END AS label FROM labels, (VALUES ('ann'), ('bob')) t(k))"


@query("label_issues", f"WITH {_RAW} SELECT CASE WHEN label IS NULL THEN 'invalid_label' ELSE 'unknown_doi' END AS issue, count(*) AS n FROM r WHERE label IS NULL OR doc_id % 2 = 1 GROUP BY 1")
def _(spark, d):
    known = table(spark, d, "labels").where("doc_id % 2 = 0").select(F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"))
    return op.validated(raw_labels(spark, d), known)[1].groupBy("issue").agg(F.count("*").alias("n"))


@query("review_consensus", f"WITH {_RAW}, s AS (SELECT doi, count(DISTINCT label) AS k, min(label) AS label, count(*) FILTER (label = 'uncertain') AS u FROM r WHERE label IS NOT NULL GROUP BY 1) SELECT doi, CASE WHEN u = 0 AND k = 1 THEN CAST(label = 'include' AS INT) END AS y_true, u = 0 AND k = 1 AS resolved, CASE WHEN u > 0 THEN 'uncertain' WHEN k > 1 THEN 'disagreement' ELSE 'unanimous' END AS status FROM s")
def _(spark, d):
    return op.consensus(op.validated(raw_labels(spark, d))[0]).withColumn("y_true", F.col("y_true").cast("int"))


@query("label_set_digest", f"WITH {_RAW} SELECT sha256(string_agg(doi || chr(9) || reviewer || chr(9) || label, chr(10) ORDER BY doi || chr(9) || reviewer || chr(9) || label)) AS digest FROM r WHERE label IS NOT NULL")
def _(spark, d):
    return op.label_digest(op.validated(raw_labels(spark, d))[0])
