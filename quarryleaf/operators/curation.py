"""Writes of curators as tables: decisions on pairs, adjudications, approvals, protocols, manifests, versions, edges.

Each takes the standing table and what comes in, and returns the new table; a caller writes it as the next version. Rules
that a write must keep are returned as rows of problems, or raised where one row is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryleaf.functions.names import normal_doi
from quarryleaf.operators import joins

DECISIONS = ("merge", "keep")
# Labels of each review workflow.
WORKFLOW_LABELS = {
    "screening": ("include", "exclude", "uncertain"),
    "author": ("same", "different", "uncertain"),
    "taxonomy": ("present", "absent", "ambiguous"),
    "retrieval": ("relevant", "not_relevant", "uncertain"),
    "pdf": ("match", "mismatch", "uncertain"),
}
DECISION = "a string, b string, decision string, canonical string, reason string"


def upsert(table: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The table with the rows of the incoming keys replaced and new ones added; of several incoming rows of a key the
    last in order counts. Columns that the incoming rows lack keep their old values; rows with a null in the key are left
    out on the way in."""
    rows = incoming.dropna(subset=list(key))
    last = joins.latest(rows, key, order) if order else rows.dropDuplicates(list(key))
    mine = [c for c in table.columns if c not in key]
    new = last.select(*key, F.lit(True).alias("_in"), *(F.col(c).alias(f"_{c}") for c in mine if c in last.columns))
    both = table.withColumn("_old", F.lit(True)).join(new, list(key), "full_outer")
    value = lambda c: F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)) if c in last.columns else F.col(c)
    return both.select(*key, *(value(c).alias(c) for c in mine)).select(*table.columns)


def paired(df: DataFrame, *more: str) -> DataFrame:
    """Pairs in order with their identifiers normalised."""
    a, b = normal_doi(F.col("a")), normal_doi(F.col("b"))
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *more)


def decision_problems(standing: DataFrame, incoming: DataFrame, candidates: DataFrame, works: DataFrame, key: str = "doi") -> DataFrame:
    """(a, b, problem) of incoming decisions that may not be written: an unknown decision, no reason, an unknown work, a
    pair that is neither decided nor in the queue, a canonical work outside the pair, a work with two canonical ones, a
    canonical work that is itself merged away. The last two are judged with all standing and incoming decisions."""
    asked = paired(incoming, "decision", normal_doi(F.col("canonical")).alias("canonical"), F.trim(F.coalesce("reason", F.lit(""))).alias("reason"))
    known = works.select(normal_doi(F.col(key)).alias("_k")).distinct()
    queue = paired(candidates).unionByName(paired(standing)).distinct().withColumn("queued", F.lit(True))
    rows = (
        asked.join(queue, ["a", "b"], "left")
        .join(known.select(F.col("_k").alias("a"), F.lit(True).alias("has_a")), "a", "left")
        .join(known.select(F.col("_k").alias("b"), F.lit(True).alias("has_b")), "b", "left"))
    merges = merge_rows(decided(standing, incoming))
    twice = merges.groupBy("duplicate").agg(F.count_distinct("canonical").alias("n")).where("n > 1").select(F.col("duplicate").alias("gone"), F.lit(True).alias("twice"))
    chain = merges.select(F.col("duplicate").alias("canonical")).distinct().withColumn("chain", F.lit(True))
    heads = merges.select(F.col("canonical").alias("gone")).distinct().withColumn("head", F.lit(True))
    gone = F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    rows = rows.withColumn("gone", F.when(F.col("decision") == "merge", gone)).join(twice, "gone", "left").join(heads, "gone", "left").join(chain, "canonical", "left")
    outside = (F.col("decision") == "merge") & ~F.coalesce(F.col("canonical").isin(F.col("a"), F.col("b")), F.lit(False))
    problem = (
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision").when(F.col("reason") == "", "no reason")
        .when(F.col("has_a").isNull() | F.col("has_b").isNull(), "unknown work").when(F.col("queued").isNull(), "not in the queue").when(outside, "canonical work outside the pair")
        .when(F.col("twice"), "two canonical works").when((F.col("decision") == "merge") & (F.col("chain") | F.col("head")), "chain"))
    return rows.select("a", "b", problem.alias("problem")).where("problem is not null").distinct()


def decided(standing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Standing decisions with the incoming ones in their pairs' place; only a merge has a canonical work."""
    named = lambda df: paired(df, "decision", F.when(F.col("decision") == "merge", normal_doi(F.col("canonical"))).alias("canonical"), F.trim("reason").alias("reason"))
    new = named(incoming).dropDuplicates(["a", "b"])
    return named(standing).join(new.select("a", "b"), ["a", "b"], "left_anti").unionByName(new)


def merge_rows(decisions: DataFrame) -> DataFrame:
    """(canonical, duplicate) of the merges."""
    merges = decisions.where("decision = 'merge' and canonical is not null")
    return merges.select("canonical", F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("duplicate"))


def record_decision(spark: SparkSession, standing: DataFrame, candidates: DataFrame, works: DataFrame, decision: str, a: str, b: str, reason: str, canonical: str | None = None) -> DataFrame:
    """Standing decisions with one more; a ValueError names what is wrong with it."""
    incoming = spark.createDataFrame([(a, b, decision, canonical, reason)], DECISION)
    found = decision_problems(standing, incoming, candidates, works).first()
    if found:
        raise ValueError(f"{found.a}, {found.b}: {found.problem}")
    return decided(standing, incoming)


def without_decisions(standing: DataFrame, pairs: DataFrame) -> DataFrame:
    """Standing decisions without those of these pairs, in either order."""
    return standing.join(paired(pairs).distinct().select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.least(normal_doi(F.col("a")), normal_doi(F.col("b"))) == F.col("_a")) & (F.greatest(normal_doi(F.col("a")), normal_doi(F.col("b"))) == F.col("_b")), "left_anti")


def allowed_label(workflow: Column, label: Column) -> Column:
    """Whether a workflow knows a label; false for nulls and unknown workflows."""
    out = F.lit(False)
    for name, labels in WORKFLOW_LABELS.items():
        out = F.when(workflow == name, label.isin(*labels)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def adjudicated(table: DataFrame, incoming: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(the table with final labels put in by workflow, version and subject, the incoming rows whose label their workflow
    does not have)."""
    good = allowed_label(F.col("workflow"), F.col("final_label"))
    return upsert(table, incoming.where(good), ["workflow", "dataset_version_id", "subject_id"], [order]), incoming.where(~good)


def approvals(table: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with the approvals appended, those whose model or label set is not named by a SHA-256)."""
    hexed = lambda c: F.coalesce(F.lower(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    good = hexed("model_sha256") & hexed("label_set_sha256")
    return table.unionByName(incoming.where(good).select(*table.columns)), incoming.where(~good)


def protocols(table: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with new protocol versions, the incoming rows that would change a version or name no known workflow).
    Columns: workflow, protocol_version, instructions, instructions_sha256 (made here for incoming rows)."""
    key = ["workflow", "protocol_version"]
    digest = F.sha2(F.col("instructions").cast("binary"), 256)
    rows = incoming.select(*key, "instructions", digest.alias("instructions_sha256"))
    own = rows.groupBy(*key).agg(F.min("instructions_sha256").alias("_first"), F.count_distinct("instructions_sha256").alias("_n"))
    old = table.select(*key, F.col("instructions_sha256").alias("_old"))
    judged = rows.join(own, key).join(old, key, "left")
    fine = F.col("workflow").isin(*WORKFLOW_LABELS) & (F.col("_n") == 1) & F.coalesce(F.col("_old") == F.col("instructions_sha256"), F.lit(True))
    fine = F.coalesce(fine, F.lit(False))
    new = judged.where(fine & F.col("_old").isNull()).select(*rows.columns).distinct()
    return table.select(*rows.columns).unionByName(new), judged.where(~fine).select(*rows.columns)


def recorded_files(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """(path, source, kind, sha256, size_bytes, changed): the manifest with what was scanned; changed for a new path or
    another digest. Files that were not scanned stay as they are. Manifests: path, source, kind, sha256, size_bytes."""
    old = manifest.select("path", *(F.col(c).alias(f"_{c}") for c in ("source", "kind", "sha256", "size_bytes")))
    both = scanned.withColumn("_in", F.lit(True)).join(old, "path", "full_outer")
    changed = F.col("_in").isNotNull() & (F.col("_sha256").isNull() | (F.col("sha256") != F.col("_sha256")))
    keep = lambda c: F.when(F.col("_in"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return both.select("path", keep("source"), keep("kind"), keep("sha256"), keep("size_bytes"), F.coalesce(changed, F.lit(False)).alias("changed"))


def content_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row, `digest`: SHA-256 over all rows, whatever their order and partitions. Rows are digested one by one, their
    digests in 65536 groups by their first four characters, the groups' in order: no task or row holds all."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    rows = df.select(row.alias("h"))
    groups = rows.groupBy(F.substring("h", 1, 4).alias("g")).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))).cast("binary"), 256).alias("d"))
    return groups.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"])).cast("binary"), 256).alias("digest"))


def adopted(articles: DataFrame, chunks: DataFrame) -> str | None:
    """The version that an unversioned publication gets: a digest of its articles' keys and its chunks; None without any
    article. Equal contents have equal versions."""
    if articles.limit(1).count() == 0:
        return None
    parts = [content_digest(articles, ["doi"]), content_digest(chunks, ["doi", "chunk_type", "seq", "text"])]
    return hashlib.sha256("\n".join(p.first().digest for p in parts).encode()).hexdigest()


def versioned(tables: Mapping[str, DataFrame], version: str, pairs: str = "duplicate_pairs") -> dict[str, DataFrame]:
    """Live tables as those of a version; pairs are put in order."""
    tag = lambda df: df.withColumn("dataset_version_id", F.lit(version))
    return {name: tag(joins.ordered_pairs(df) if name == pairs else df) for name, df in tables.items()}


def incoming_edges(found: DataFrame, at: Column) -> DataFrame:
    """(provider, citing_work_id, cited_work_id, observed_at, discovered_via): each citing work of a cited one once,
    itself left out. found: cited, citing."""
    rows = found.where("citing is not null and citing <> '' and citing <> cited").select("citing", "cited").distinct()
    return rows.select(F.lit("openalex").alias("provider"), F.col("citing").alias("citing_work_id"), F.col("cited").alias("cited_work_id"), at.alias("observed_at"), F.lit("cites_query").alias("discovered_via"))


def result_rows(results: DataFrame, execution: str, run: int, version: str, stage: str) -> DataFrame:
    """Contract outcomes as rows to append: observed and expected as JSON. results: check_id, severity, passed, observed, expected."""
    as_json = lambda c: F.to_json(F.struct(F.col(c).alias("value"))).alias(c)
    return results.select(
        F.lit(execution).alias("execution_id"), F.lit(run).cast("long").alias("stage_run_id"), F.lit(version).alias("dataset_version_id"), F.lit(stage).alias("stage"),
        "check_id", "severity", "passed", as_json("observed"), as_json("expected"))


def retrieval_pool(spark: SparkSession, retrieve: Callable[[str, int], Sequence[str]], queries: Sequence[tuple[str, str]], depth: int = 10) -> tuple[DataFrame, dict[str, str]]:
    """(query_id, doi, rank) of each query's results, and the queries that failed with their errors. An error is raised
    only where every query failed. The query set is stated and small; the retrieval itself is distributed."""
    rows: list[tuple[str, str, int]] = []
    failed: dict[str, str] = {}
    for name, text in queries:
        try:
            rows += [(name, str(doi), k) for k, doi in enumerate(list(retrieve(text, depth))[:depth], 1)]
        except Exception as e:  # noqa: BLE001 - a backend may fail in any way; the failure is reported by query
            failed[name] = f"{type(e).__name__}: {e}"
    if failed and not rows:
        raise RuntimeError(f"every retrieval query failed ({len(failed)} of {len(queries)}); first: {next(iter(failed.values()))}")
    return spark.createDataFrame(rows, "query_id string, doi string, rank int"), failed
