"""The test tables seen as a corpus: orders are articles, lines their authors, documents texts, events observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Article sources of the adapter; a third status is "other".
SOURCES = ("F", "O")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("citation_count"), F.count("*").alias("reference_count"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("doi"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("source"),
        F.col("c_mktsegment").alias("venue"), F.col("o_orderpriority").alias("category"), "citation_count", "reference_count")


def author_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doi, author, position, year, source, citation_count): one row per line of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doi"), F.col("l_suppkey").alias("author"), (F.row_number().over(order) - 1).alias("position"))
    return lines.join(articles(spark, sf_dir).select("doi", "year", "source", "venue", "citation_count"), "doi")


def keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, doi, year): an article's keywords are the names of the parts in its lines, a mention each."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("value")), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select("value", F.col("l_orderkey").alias("doi")).join(articles(spark, sf_dir).select("doi", "year"), "doi").select("value", "doi", "year")


ARTICLES = """articles AS (SELECT o_orderkey AS doi, CAST(year(o_orderdate) AS INT) AS year, o_orderstatus AS source, c_mktsegment AS venue,
  o_orderpriority AS category, q AS citation_count, n AS reference_count FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
AUTHORS = ARTICLES + """, author_rows AS (SELECT l.doi, author, position, a.year, a.source, a.venue, a.citation_count FROM (SELECT l_orderkey AS doi, l_suppkey AS author,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS position FROM lineitem) l JOIN articles a ON a.doi = l.doi)"""
KEYWORDS = ARTICLES + """, keywords AS (SELECT p_name AS value, a.doi, a.year FROM lineitem JOIN part ON l_partkey = p_partkey JOIN articles a ON a.doi = l_orderkey)"""
