"""Runs of stages: readiness, order, one writer at a time, and what a run's results rest on."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryleaf.operators import reviews, statistics, vectors

STAGES = ("raw", "bronze", "silver", "gold", "embed", "semantic")


def ready_versions(runs: DataFrame, results: DataFrame, stages: Sequence[str] = STAGES[:-1]) -> DataFrame:
    """(dataset_version_id, ready) of every version with a run: each stage has a successful run, and the last one of each
    no failed check of severity error. runs: id, dataset_version_id, stage, status; results: stage_run_id, severity, passed."""
    last = runs.where((F.col("status") == "success") & F.col("stage").isin(*stages)).groupBy("dataset_version_id", "stage").agg(F.max("id").alias("stage_run_id"))
    bad = results.where((F.col("severity") == "error") & ~F.col("passed")).select("stage_run_id").distinct().withColumn("_bad", F.lit(True))
    good = last.join(bad, "stage_run_id", "left").where("_bad is null").groupBy("dataset_version_id").agg(F.count_distinct("stage").alias("n"))
    every = runs.select("dataset_version_id").where("dataset_version_id is not null").distinct()
    return every.join(good, "dataset_version_id", "left").select("dataset_version_id", (F.coalesce("n", F.lit(0)) == len(stages)).alias("ready"))


def unchanged_versions(versions: DataFrame, workflow: str) -> DataFrame:
    """Versions whose stages a full run may skip: active already. None for a partial workflow."""
    return versions.where((F.col("status") == "active") & (F.lit(workflow) == "all")).select("version_id")


class Busy(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def single_writer(spark: SparkSession, path: str, owner: str) -> Iterator[str]:
    """Hold a lock file in a folder that all machines share while the body runs; Busy where another run holds it. The file
    is made in one step that fails if it is there, and taken away at the end."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(at, False)
    except Exception as e:  # noqa: BLE001 - the gateway raises its own type; only an existing file means busy
        if fs.exists(at):
            raise Busy(f"{path} is held; {owner} was not started") from e
        raise
    try:
        out.write(bytearray(owner.encode()))
        out.close()
        yield path
    finally:
        fs.delete(at, False)


def run_all(stages: Sequence[tuple[str, Callable[[], dict]]], record: Callable[[str, str, object], None], done: Sequence[str] = ()) -> dict[str, dict]:
    """Stages in order, each recorded as running and then success, skipped (one of `done`) or failed; a failure ends the
    run and is raised."""
    out = {}
    for name, stage in stages:
        if name in done:
            record(name, "skipped", None)
            out[name] = {"skipped": True}
            continue
        record(name, "running", None)
        try:
            out[name] = stage()
        except Exception as e:
            record(name, "failed", f"{type(e).__name__}: {e}")
            raise
        record(name, "success", out[name])
    return out


def code_fingerprint(root: Path, leave_out: Sequence[str] = (), extra: Sequence[str] = ("pyproject.toml",)) -> tuple[str | None, str]:
    """(git revision or None, SHA-256 over the paths and digests of all Python files but those under `leave_out`)."""
    files = [p for p in root.rglob("*.py") if not p.relative_to(root).as_posix().startswith(tuple(leave_out) or ("\0",))]
    whole = hashlib.sha256()
    for p in sorted([*files, *(root / e for e in extra if (root / e).exists())]):
        whole.update(p.relative_to(root).as_posix().encode() + b"\0" + hashlib.sha256(p.read_bytes()).digest())
    try:
        revision = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, check=True, capture_output=True, text=True, timeout=5).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        revision = None
    return revision or None, whole.hexdigest()


def screening_digest(model: str, anchor: str, off_anchor: str, threshold: float, least_recall: float) -> str:
    """What an approval of a screening rule applies to: model, both anchors, threshold and recall, six digits each."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sha("\n".join((model, sha(anchor), sha(off_anchor), f"{threshold:.6f}", f"{least_recall:.6f}")))


def expected_revision(found: str | None, expected: str) -> str:
    if found != expected:
        raise RuntimeError(f"model revision {found or 'unknown'} was loaded, {expected} expected")
    return expected


def embedded(texts: Sequence[str], embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]) -> list[list[float]]:
    """Vectors of a few texts (anchors) from a model given as a function; refused unless finite and of one length."""
    out = [[float(x) for x in v] for v in embed(texts)]
    if len(out) != len(texts) or len({len(v) for v in out}) > 1 or not all(np.isfinite(v).all() for v in map(np.asarray, out)):
        raise ValueError("the model must give a finite vector of the same length for each text")
    return out


def dataset_semantics(works: DataFrame, vectors_: DataFrame, anchor: Sequence[float], off_anchor: Sequence[float], version: str, key: str = "doi", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, stats): relevance, off-topic cosine and margin of every work of a version, and one row of figures. Raised
    where a work has no vector: signals of a part would pass for those of the whole."""
    missing = works.select(key).join(vectors_.where(F.col(vector).isNotNull()).select(key), key, "left_anti")
    if missing.limit(1).count():
        raise ValueError(f"{missing.count()} works have no vector")
    rows = works.select(key).distinct().join(vectors_.select(key, vector), key)
    scored = vectors.relevance(vectors.relevance(rows, vector, anchor, "relevance_score"), vector, off_anchor, "offtopic_score")
    out = scored.select(F.lit(version).alias("dataset_version_id"), key, "relevance_score", "offtopic_score", (F.col("relevance_score") - F.col("offtopic_score")).alias("relevance_margin"))
    return out, out.agg(
        F.count("*").alias("works"), F.round(F.median("relevance_score"), 4).alias("median_relevance"), F.round(F.median("relevance_margin"), 4).alias("median_margin"),
        F.count_if(F.col("relevance_margin") < 0).alias("offtopic"))


def screening_calibration(labels: DataFrame, margins: DataFrame, rule: Mapping[str, str], least_recall: float = 0.98) -> dict[str, DataFrame | str | None]:
    """From reviewers' labels to an approvable threshold: usable labels, issues, consensus, calibrated metrics, and the
    digests of labels and rule. labels: doi, reviewer, label; margins: doi, margin; rule: model, anchor, off_anchor."""
    usable, issues = reviews.validated(labels, margins)
    agreed = reviews.consensus(usable)
    judged = agreed.where("resolved").join(margins, "doi")
    metrics = statistics.calibrated_threshold(judged, "doi", "y_true", "margin", least_recall)
    cut = metrics.where("metric = 'threshold'").first()
    return {
        "usable": usable, "issues": issues, "consensus": agreed, "metrics": metrics, "label_set_sha256": reviews.label_digest(usable).first().digest,
        "model_sha256": screening_digest(rule["model"], rule["anchor"], rule["off_anchor"], cut.value, least_recall) if cut else None}
