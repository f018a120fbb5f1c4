"""Data contracts: every check is a row (check_id, severity, passed, observed, expected) computed by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def check(name: str, counted: DataFrame, expected: int = 0, severity: str = "error", passed: Column | None = None) -> DataFrame:
    """A check of the single number in `counted`."""
    n = F.col(counted.columns[0])
    return counted.select(
        F.lit(name).alias("check_id"), F.lit(severity).alias("severity"), (passed if passed is not None else n == expected).alias("passed"), n.cast("string").alias("observed"), F.lit(str(expected)).alias("expected"))


def union(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def non_empty(name: str, df: DataFrame) -> DataFrame:
    return check(name, df.agg(F.count("*").alias("n")), 1, passed=F.col("n") > 0)


def unique(name: str, df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key; combined before the shuffle."""
    return check(name, df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")))


def references(name: str, child: DataFrame, column: str, parent: DataFrame, key: str, severity: str = "error") -> DataFrame:
    """Child rows whose reference isn't in the parent; null references don't count."""
    have = parent.select(F.col(key).alias(column)).distinct()
    return check(name, child.where(F.col(column).isNotNull()).join(have, column, "left_anti").agg(F.count("*").alias("n")), severity=severity)


def one_value(name: str, df: DataFrame, column: str, value: str) -> DataFrame:
    return check(name, df.agg(F.count_if(~F.col(column).eqNullSafe(F.lit(value))).alias("n")))


def in_domain(name: str, df: DataFrame, column: str, domain: Sequence[str], severity: str = "error") -> DataFrame:
    return check(name, df.agg(F.count_if(~F.coalesce(F.col(column).isin(*domain), F.lit(False))).alias("n")), severity=severity)


def holds(name: str, df: DataFrame, condition: Column, severity: str = "error") -> DataFrame:
    """Rows for which a condition isn't true."""
    return check(name, df.agg(F.count_if(~F.coalesce(condition, F.lit(False))).alias("n")), severity=severity)


def partition(name: str, whole: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys that are in no part or in more than one, or in a part only: the parts must split the whole."""
    tagged = whole.select(key, F.lit(1).alias("w"), F.lit(0).alias("p"))
    for part in parts:
        tagged = tagged.unionByName(part.select(key, F.lit(0).alias("w"), F.lit(1).alias("p")))
    sums = tagged.groupBy(key).agg(F.max("w").alias("w"), F.sum("p").alias("p"))
    return check(name, sums.agg(F.count_if((F.col("w") != 1) | (F.col("p") != 1)).alias("n")))


def same_set(name: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    both = a.select(key, F.lit(1).alias("s")).unionByName(b.select(key, F.lit(2).alias("s"))).groupBy(key).agg(F.count_distinct("s").alias("k"))
    return check(name, both.agg(F.count_if(F.col("k") < 2).alias("n")))


def raw_contract(manifest: DataFrame, children: DataFrame, version: str) -> DataFrame:
    return union([
        non_empty("raw.non_empty", manifest), unique("raw.paths_unique", manifest, ["path"]), one_value("raw.version", manifest, "dataset_version_id", version),
        references("raw.children", children, "path", manifest, "path"),
        check("raw.sources", manifest.agg(F.count_if(F.col("source").isNull()).alias("n")), severity="warning")])


def bronze_contract(bronze: DataFrame, manifest: DataFrame, version: str, categories: Sequence[str]) -> DataFrame:
    return union([
        non_empty("bronze.non_empty", bronze), unique("bronze.natural_key", bronze, ["source", "source_id"]), references("bronze.raw_refs", bronze, "path", manifest, "path"),
        one_value("bronze.version", bronze, "dataset_version_id", version), in_domain("bronze.categories", bronze, "publication_category", categories)])


def silver_contract(bronze: DataFrame, silver: DataFrame, rejected: DataFrame, version: str, categories: Sequence[str]) -> DataFrame:
    kept = silver.select(F.explode("ids").alias("id"))
    return union([
        non_empty("silver.non_empty", silver), unique("silver.doi_unique", silver, ["doi"]), holds("silver.doi_present", silver, F.trim("doi") != ""),
        partition("silver.partition", bronze.select("id"), [kept, rejected.select("id")], "id"), one_value("silver.version", silver, "dataset_version_id", version),
        in_domain("silver.categories", silver, "publication_category", categories)])


def gold_contract(gold: DataFrame, chunks: DataFrame, categories: Sequence[str]) -> DataFrame:
    return union([
        non_empty("gold.non_empty", gold), unique("gold.doi_unique", gold, ["doi"]), unique("gold.chunk_key", chunks, ["doi", "chunk_type", "seq"]),
        references("gold.chunk_parent", chunks, "doi", gold, "doi"), holds("gold.char_len", chunks, F.col("char_len") == F.length("text")), in_domain("gold.categories", gold, "publication_category", categories)])


def embed_contract(chunks: DataFrame, size: int, model: str) -> DataFrame:
    v = F.col("embedding")
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    unit = F.abs(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) - 1) < 1e-3
    return union([
        holds("embed.complete", chunks, v.isNotNull()), holds("embed.compatible", chunks, (F.size(v) == size) & (F.col("embed_model") == model) & unit),
        holds("embed.finite", chunks, finite), holds("embed.text_hash", chunks, F.col("text_sha256") == F.sha2(F.col("text").cast("binary"), 256))])


def semantic_contract(semantics: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    scores = F.array("relevance_score", "offtopic_score")
    return union([
        same_set("semantic.coverage", semantics, gold, "doi"), unique("semantic.unique", semantics, ["doi"]), holds("semantic.finite", semantics, F.forall(scores, lambda x: x.isNotNull() & ~F.isnan(x))),
        holds("semantic.ranges", semantics, F.forall(scores, lambda x: x.between(-1, 1))),
        union([holds("semantic.pairs_ordered", pairs, F.col("doi_a") < F.col("doi_b")), unique("semantic.pairs_unique", pairs, ["doi_a", "doi_b"]), references("semantic.pairs_known", pairs, "doi_a", gold, "doi"), references("semantic.pairs_known_b", pairs, "doi_b", gold, "doi")])])


def failures(results: DataFrame) -> DataFrame:
    """Checks of error severity that failed in the latest stage run of each."""
    w = Window.partitionBy("check_id").orderBy(F.desc("stage_run_id"))
    latest = results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return latest.where("not passed and severity = 'error'")


def required(results: DataFrame) -> None:
    """Raise where a check of error severity fails."""
    bad = results.where("not passed and severity = 'error'").select("check_id", "observed").take(20)
    if bad:
        raise ValueError("contract failed: " + ", ".join(f"{r.check_id} ({r.observed})" for r in bad))


def status(results: DataFrame) -> DataFrame:
    """(dataset_version_id, stage, checks, errors, warnings) of the latest result of each check."""
    w = Window.partitionBy("dataset_version_id", "stage", "check_id").orderBy(F.desc("stage_run_id"))
    latest = results.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return latest.groupBy("dataset_version_id", "stage").agg(F.count("*").alias("checks"), F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("errors"), F.count_if(~F.col("passed") & (F.col("severity") != "error")).alias("warnings"))
