"""Queries of operators/provider.py: answers are made from lines as JSON, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryleaf.operators import provider as op
from quarryleaf.plans.adapters import table
from quarryleaf.registry import query


def _work(c):
    return F.concat(F.lit("https://openalex.org/w"), F.col(c).cast("string"))


def _answers(spark, d):
    """A batch for each of ten, of suppliers that cite the parts in their lines."""
    lines = table(spark, d, "lineitem").where("l_quantity > 30")
    items = lines.groupBy((F.col("l_suppkey") % 10).alias("batch"), "l_suppkey").agg(F.collect_list(_work("l_partkey")).alias("referenced_works"))
    one = F.struct(F.when(F.col("l_suppkey") % 8 > 0, _work("l_suppkey")).alias("id"), "referenced_works")
    bodies = items.groupBy("batch").agg(F.collect_list(one).alias("results"))
    return bodies.select("batch", F.to_json(F.struct((F.size("results") + F.col("batch") % 2).alias("count"), "results")).alias("body"))


def _members(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").where("p_partkey % 4 > 0").select((k % 10).alias("batch"), F.concat(F.lit("https://openalex.org/W"), k.cast("string")).alias("work"))


@query("citing_pairs", "SELECT DISTINCT 'https://openalex.org/W' || l_partkey AS cited, 'https://openalex.org/w' || l_suppkey AS citing FROM lineitem WHERE l_quantity > 30 AND l_suppkey % 8 > 0 AND l_partkey % 4 > 0 AND l_partkey % 10 = l_suppkey % 10 AND l_partkey <> l_suppkey AND l_partkey IN (SELECT p_partkey FROM part)")
def _(spark, d):
    return op.citing_pairs(_answers(spark, d), _members(spark, d))


@query("truncated_batches", "SELECT DISTINCT l_suppkey % 10 AS batch, l_suppkey % 2 = 1 AS truncated FROM lineitem WHERE l_quantity > 30")
def _(spark, d):
    return op.truncated_batches(_answers(spark, d))


def _items(spark, d):
    """Registry items: a work's references are its lines; every fifth work is unknown."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y")), "l_orderkey")
    n = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = lines.groupBy("l_orderkey", "y").agg(F.array_sort(F.collect_list(n)).alias("ls"))
    ref = F.transform("ls", lambda x: F.struct(
        F.when(x["l_suppkey"] % 3 > 0, F.concat(F.lit("10.9/P"), x["l_partkey"].cast("string"))).alias("DOI"),
        F.when(x["l_suppkey"] % 2 > 0, F.concat((1980 + x["l_partkey"] % 30).cast("string"), F.lit("a"))).alias("year")))
    issued = F.struct(F.array(F.array(F.when(F.col("l_orderkey") % 7 > 0, F.col("y")), F.lit(3))).alias("date-parts"))
    body = F.to_json(F.struct(ref.alias("reference"), issued.alias("issued")))
    return rows.select(F.concat(F.lit("10.9/o"), F.col("l_orderkey").cast("string")).alias("doi"), F.when(F.col("l_orderkey") % 5 > 0, body).alias("body"))


_REFS = """rf AS (SELECT '10.9/o' || l_orderkey AS doi, l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INT) AS position,
CASE WHEN l_suppkey % 3 > 0 THEN '10.9/p' || l_partkey END AS reference_doi, CASE WHEN l_suppkey % 2 > 0 THEN CAST(1980 + l_partkey % 30 AS INT) END AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 5 > 0)"""


@query("reference_rows", f"WITH {_REFS} SELECT doi, position, reference_doi, year FROM rf")
def _(spark, d):
    return op.reference_rows(_items(spark, d))


@query("reference_list_status", "SELECT '10.9/o' || l_orderkey AS doi, CASE WHEN l_orderkey % 5 = 0 THEN 'not_found' ELSE 'success' END AS status, CAST(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) END AS INT) AS deposited FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def _(spark, d):
    return op.list_status(_items(spark, d))


@query("issued_years", "SELECT DISTINCT '10.9/o' || l_orderkey AS doi, CASE WHEN l_orderkey % 5 > 0 AND l_orderkey % 7 > 0 THEN CAST(year(o_orderdate) AS INT) END AS year, CASE WHEN l_orderkey % 5 = 0 THEN 'not_found' ELSE 'success' END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(spark, d):
    return op.issued_years(_items(spark, d))


@query("pending_lists", """WITH k AS (SELECT '10.' || (o_custkey % 4) || '/x' || o_orderkey AS doi, '10.' || (o_custkey % 4) AS reg, o_orderkey AS o FROM orders WHERE o_orderkey % 3 > 0),
p AS (SELECT doi, (row_number() OVER (PARTITION BY reg ORDER BY doi) - 0.5) / count(*) OVER (PARTITION BY reg) AS position FROM k) SELECT doi, round(position, 9) AS position FROM p ORDER BY p.position, doi LIMIT 5000""")
def _(spark, d):
    name = F.concat(F.lit("10."), (F.col("o_custkey") % 4).cast("string"), F.lit("/X"), F.col("o_orderkey").cast("string"))
    works = table(spark, d, "orders").select(name.alias("doi"), "o_orderkey")
    return op.pending_lists(works.select("doi"), works.where("o_orderkey % 3 = 0").select(F.lower("doi").alias("doi"))).select("doi", F.round("position", 9).alias("position"))


@query("pending_years", f"WITH {_REFS}, u AS (SELECT DISTINCT reference_doi AS doi FROM rf WHERE year IS NULL AND reference_doi IS NOT NULL AND reference_doi NOT IN (SELECT '10.9/p' || p_partkey FROM part WHERE p_partkey % 3 = 0)) SELECT doi FROM u ORDER BY md5(doi), doi LIMIT 5000")
def _(spark, d):
    have = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("10.9/p"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_partkey").alias("k"))
    return op.pending_years(op.reference_rows(_items(spark, d)), have.where("k % 2 = 0").select("doi"), have.where("k % 2 = 1").select("doi"))
