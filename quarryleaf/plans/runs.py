"""Queries of operators/runs.py: events as runs and checks of versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import runs as op
from quarryleaf.operators import text
from quarryleaf.plans.adapters import table
from quarryleaf.plans.text import rounded
from quarryleaf.plans.vectors import _A, _COS, _E, ANCHOR
from quarryleaf.registry import query

_RUNS = """ru AS (SELECT event_id AS id, 'v' || (user_id % 40) AS dataset_version_id, ['raw', 'bronze', 'silver', 'gold', 'embed'][1 + CAST(event_id % 5 AS INT)] AS stage, CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'success' END AS status FROM events),
rs AS (SELECT event_id AS stage_run_id, CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'warning' END AS severity, value > 5 AS passed FROM events)"""


@query("ready_versions", f"""WITH {_RUNS}, l AS (SELECT dataset_version_id, stage, max(id) AS id FROM ru WHERE status = 'success' GROUP BY 1, 2), g AS (SELECT dataset_version_id, count(*) AS n FROM l WHERE id NOT IN (SELECT stage_run_id FROM rs WHERE severity = 'error' AND NOT passed) GROUP BY 1)
SELECT dataset_version_id, coalesce(n, 0) = 5 AS ready FROM (SELECT DISTINCT dataset_version_id FROM ru) LEFT JOIN g USING (dataset_version_id)""")
def _(spark, d):
    e = table(spark, d, "events")
    stage = F.get(F.array(*(F.lit(s) for s in op.STAGES[:-1])), (F.col("event_id") % 5).cast("int"))
    runs = e.select(F.col("event_id").alias("id"), F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("dataset_version_id"), stage.alias("stage"), F.when(F.col("event_type").isin("error", "view"), "failed").otherwise("success").alias("status"))
    results = e.select(F.col("event_id").alias("stage_run_id"), F.when(F.col("user_id") % 3 == 0, "error").otherwise("warning").alias("severity"), (F.col("value") > 5).alias("passed"))
    return op.ready_versions(runs, results)


@query("unchanged_versions", "SELECT o_orderkey AS version_id FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("superseded").alias("status"))
    return op.unchanged_versions(v, "all").unionByName(op.unchanged_versions(v, "gold"))


_OFF = [-x for x in ANCHOR[::-1]]
_B = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _OFF) + "]"
_SEM = f"{_E}, sm AS (SELECT vec_id AS doi, {_COS.format(a='v', b=_A)} AS r, {_COS.format(a='v', b=_B)} AS o FROM e)"


def _semantics(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doi")
    return op.dataset_semantics(e, e, ANCHOR, _OFF, "v1")


@query("dataset_semantics", f"WITH {_SEM} SELECT 'v1' AS dataset_version_id, doi, round(r, 6) AS relevance_score, round(o, 6) AS offtopic_score, round(r - o, 6) AS relevance_margin FROM sm")
def _(spark, d):
    return rounded(_semantics(spark, d)[0], 6, "relevance_score", "offtopic_score", "relevance_margin")


@query("semantic_figures", f"WITH {_SEM} SELECT count(*) AS works, round(median(r), 4) AS median_relevance, round(median(r - o), 4) AS median_margin, count(*) FILTER (r - o < 0) AS offtopic FROM sm")
def _(spark, d):
    return _semantics(spark, d)[1]


@query("retrieval_candidates", "WITH q(query_id, t) AS (VALUES ('licence', 'license'), ('english', 'the'), ('german', 'ung')), h AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS doi, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM documents JOIN q ON contains(lower(text), t)) SELECT query_id, doi, CAST(rank AS INT) AS rank FROM h WHERE rank <= 10")
def _(spark, d):
    from quarryleaf.operators.curation import retrieval_pool

    docs = table(spark, d, "documents")

    def retrieve(asked, depth):
        return [r.doc_id for r in text.literal_search(docs, "text", asked, depth, "doc_id").select("doc_id").collect()]  # depth rows

    return retrieval_pool(spark, retrieve, (("licence", "license"), ("english", "the"), ("german", "ung")))[0]
