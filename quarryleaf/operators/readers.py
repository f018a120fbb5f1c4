"""Table scans of the serving layer: light projections, newest rows, filters; all pruned to the columns asked for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def newest(df: DataFrame, at: str, limit: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(at), tie).limit(limit)


def light_chunks(chunks: DataFrame, text: str, vector: str) -> DataFrame:
    """Chunks without their texts and vectors, and whether a vector is there."""
    keep = [c for c in chunks.columns if c not in (text, vector)]
    return chunks.select(*keep, F.col(vector).isNotNull().alias("has_embedding"))


def filtered(df: DataFrame, years: tuple[int, int] | None = None, sources: Sequence[str] = (), venues: Sequence[str] = (), categories: Sequence[str] = (), least_margin: float | None = None) -> DataFrame:
    """All conditions at once; an empty list asks for everything; rows without a margin are always kept."""
    out = df
    if years:
        out = out.where(F.col("year").between(*years))
    for column, values in (("source", sources), ("venue", venues), ("category", categories)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if least_margin is not None:
        out = out.where(F.col("relevance_margin").isNull() | (F.col("relevance_margin") >= least_margin))
    return out


def with_margin(df: DataFrame, semantics: DataFrame, key: str = "doi") -> DataFrame:
    """df with its semantic scores, where there are any, and relevance less off-topic score."""
    return df.join(semantics, key, "left").withColumn("relevance_margin", F.col("relevance_score") - F.col("offtopic_score"))


def of_articles(chunks: DataFrame, articles: DataFrame, key: str = "doi") -> DataFrame:
    return chunks.join(articles.select(key).distinct(), key, "left_semi")


def exists(spark: SparkSession, name: str) -> bool:
    """Whether a table is there and its catalog can be reached."""
    try:
        return spark.catalog.tableExists(name)
    except Exception:
        return False


def population(df: DataFrame, required: Sequence[str], key: str = "doi") -> DataFrame:
    """One row: missing columns, rows, blank keys and repeated keys (trimmed, lower-cased)."""
    missing = F.array(*(F.lit(c) for c in required if c not in df.columns)).cast("array<string>")
    if key not in df.columns:
        return df.agg(F.count("*").alias("rows")).select(missing.alias("missing"), "rows", F.col("rows").alias("blank"), F.lit(0).cast("long").alias("repeated"))
    k = F.lower(F.trim(F.col(key).cast("string")))
    filled = F.when(F.coalesce(k, F.lit("")) != "", k)
    s = df.agg(F.count("*").alias("rows"), F.count(filled).alias("filled"), F.count_distinct(filled).alias("kinds"))
    return s.select(missing.alias("missing"), "rows", (F.col("rows") - F.col("filled")).alias("blank"), (F.col("filled") - F.col("kinds")).alias("repeated"))


def first_usable(layers: Sequence[tuple[str, DataFrame]], required: Sequence[str]) -> tuple[str | None, list[str]]:
    """The first layer whose population is sound, and why the others were passed over."""
    reasons = []
    for name, df in layers:
        p = population(df, required).first()
        why = ["missing " + ", ".join(p.missing)] * bool(p.missing) + ["empty"] * (p.rows == 0) + [f"{p.blank} blank keys"] * (p.blank > 0) + [f"{p.repeated} repeated keys"] * (p.repeated > 0)
        if not why:
            return name, reasons
        reasons.append(f"{name}: {'; '.join(why)}")
    return None, reasons
