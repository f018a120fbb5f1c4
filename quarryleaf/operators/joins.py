"""Joins, as-of selection, overlays, survivorship, merge plans, change sets and fuzzy matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by the order columns, combined before the shuffle (no window, no sort)."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *(F.col("_r")[c].alias(c) for c in rest))


def as_of(observations: DataFrame, key: str, at: str, tie: str, cutoff: Column, status: str | None = None, good: str = "success") -> DataFrame:
    """The latest observation of each key at or before the cutoff (ties: the higher id), successful ones only."""
    kept = observations.where(F.col(at) <= cutoff)
    return latest(kept if status is None else kept.where(F.col(status) == good), [key], [at, tie])


def fill_missing(own: DataFrame, cache: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """own with its null fields filled from the cache; a known value is never replaced."""
    other = cache.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = own.join(other, key, "left")
    return joined.select(*(F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in own.columns))


def overlay(cache: DataFrame, observed: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer merge field by field: an observed value replaces the cached one, but a 0 never lowers a positive."""
    c, o = cache.alias("c"), observed.alias("o")
    joined = c.join(o, F.col(f"c.{key}") == F.col(f"o.{key}"), "full_outer")

    def field(f: str) -> Column:
        old, new = F.col(f"c.{f}"), F.col(f"o.{f}")
        return F.when(new.isNull() | ((new == 0) & (F.coalesce(old, F.lit(0)) > 0)), old).otherwise(new).alias(f)

    return joined.select(F.coalesce(f"c.{key}", f"o.{key}").alias(key), *(field(f) for f in fields))


def source_records(main: DataFrame, side: DataFrame, key: str, fields: Sequence[str], order: str) -> DataFrame:
    """main left-joined with the last side row of each key, fields of main first, and the side rows whose key main
    lacks; side rows without a key are kept."""
    last = latest(side.where(F.col(key).isNotNull()), [key], [order])
    filled = fill_missing(main, last, key, fields).select(key, *fields)
    alone = side.join(main.select(key).distinct(), key, "left_anti").select(key, *fields)
    return filled.unionByName(alone)


def ordered_pairs(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *(c for c in df.columns if c not in (a, b)))


def unreviewed(pairs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pairs that no review names in either order."""
    return ordered_pairs(pairs).join(ordered_pairs(reviewed).select("a", "b").distinct(), ["a", "b"], "left_anti")


def latest_labels(labels: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each assignment's label of the highest revision."""
    return latest(labels, ["assignment_id"], ["label_revision"]).join(assignments, "assignment_id")


def survivors(df: DataFrame, key: str, text: str, order: str, firsts: Sequence[str], sets: Sequence[str]) -> DataFrame:
    """One row per key: the longest text (ties: first in order), the first known value of other fields in order, sorted
    distinct values, the ids in order, and whether rows were merged. Rows without a key are left out."""
    kept = df.where(F.col(key).isNotNull())
    primary = F.min(F.struct((-F.length(F.coalesce(text, F.lit("")))).alias("n"), F.col(order).alias("o"), F.col(text).alias("t")))
    first = [F.min(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in firsts]
    return kept.groupBy(key).agg(
        primary["t"].alias(text), *first, *(F.array_sort(F.collect_set(s)).alias(s) for s in sets),
        F.array_sort(F.collect_list(order)).alias("ids"), (F.count("*") > 1).alias("is_merged"))


def merged(df: DataFrame, canonical: str, key: str, counts: Sequence[str], firsts: Sequence[str], flags: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """Approved merges: the canonical row's values first, then those of the others by key; counts as maxima."""
    order = F.struct((F.col(key) != F.col(canonical)).alias("later"), F.col(key).alias("k"))
    first = [F.min(F.when(F.col(f).isNotNull(), F.struct(order.alias("o"), F.col(f).alias("v"))))["v"].alias(f) for f in firsts]
    joined = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(x).alias("v")))), lambda r: F.coalesce(r["v"], F.array())))).alias(x) for x in lists]
    return df.groupBy(canonical).agg(*first, *(F.max(c).alias(c) for c in counts), *(F.bool_or(f).alias(f) for f in flags), *joined)


def merge_plan(overrides: DataFrame, available: DataFrame, key: str = "doi") -> DataFrame:
    """(canonical, duplicates, status) of merge decisions (canonical, duplicate): `conflict` where a duplicate has two
    canonical ones, `chain` where a canonical one is itself a duplicate, `absent` where one isn't there, else `ok`."""
    conflict = overrides.groupBy("duplicate").agg(F.count_distinct("canonical").alias("n")).where("n > 1").select("duplicate", F.lit(True).alias("conflict"))
    chains = overrides.select(F.col("duplicate").alias("canonical"), F.lit(True).alias("chain")).distinct()
    have = available.select(F.col(key).alias("_k")).distinct()
    flagged = (
        overrides.distinct().join(conflict, "duplicate", "left").join(chains, "canonical", "left")
        .join(have.select(F.col("_k").alias("duplicate"), F.lit(True).alias("d")), "duplicate", "left")
        .join(have.select(F.col("_k").alias("canonical"), F.lit(True).alias("c")), "canonical", "left"))
    status = F.when(F.col("conflict"), "conflict").when(F.col("chain"), "chain").when(F.col("c").isNull() | F.col("d").isNull(), "absent").otherwise("ok")
    return flagged.withColumn("status", status).groupBy("canonical", "status").agg(F.array_sort(F.collect_set("duplicate")).alias("duplicates"))


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change, was): added, removed, modified, unchanged, or renamed: an added path with the digest of a removed
    one, matched once each in order of paths. Manifests: path, sha256."""
    p, c = previous.select("path", F.col("sha256").alias("old")), current.select("path", F.col("sha256").alias("new"))
    all_ = p.join(c, "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    rows = all_.withColumn("change", kind)

    def numbered(which: str, digest: str, path: str) -> DataFrame:
        w = Window.partitionBy(digest).orderBy("path")
        return rows.where(F.col("change") == which).select(F.col(digest).alias("digest"), F.col("path").alias(path), F.row_number().over(w).alias("k"))

    renamed = numbered("added", "new", "path").join(numbered("removed", "old", "was"), ["digest", "k"]).select("path", F.lit("renamed").alias("change"), "was")
    rest = rows.join(renamed, "path", "left_anti").join(renamed.select(F.col("was").alias("path")), "path", "left_anti")
    return rest.select("path", "change", F.lit(None).cast("string").alias("was")).unionByName(renamed)


def reconcile(stored: DataFrame, desired: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, status): new, unchanged, invalidated (text changed) or removed."""
    s, n = stored.select(*key, F.col(text).alias("_s"), F.lit(True).alias("_in")), desired.select(*key, F.col(text).alias("_n"), F.lit(True).alias("_want"))
    both = s.join(n, list(key), "full_outer")
    status = F.when(F.col("_in").isNull(), "new").when(F.col("_want").isNull(), "removed").when(F.col("_s").eqNullSafe(F.col("_n")), "unchanged").otherwise("invalidated")
    return both.select(*key, status.alias("status"))


def chosen_references(deposits: DataFrame, edges: DataFrame, years: DataFrame, corpus_years: DataFrame) -> DataFrame:
    """(doi, reference_source, reference_year): each work's deposited list if the latest one succeeded and has entries,
    else its edges. deposits: doi, observed_at, status, reference_doi, year; edges: doi, reference_doi; years and
    corpus_years: doi, year. A reference's year is its own, else a looked-up one, else that of the work in the corpus."""
    last = deposits.groupBy("doi").agg(F.max("observed_at").alias("observed_at"))
    current = deposits.join(last, ["doi", "observed_at"]).where((F.col("status") == "success") & F.col("reference_doi").isNotNull())
    rest = edges.join(current.select("doi").distinct(), "doi", "left_anti").select("doi", "reference_doi", F.lit(None).cast("int").alias("year"), F.lit("edges").alias("reference_source"))
    rows = current.select("doi", "reference_doi", "year", F.lit("deposit").alias("reference_source")).unionByName(rest)
    looked = years.select(F.col("doi").alias("reference_doi"), F.col("year").alias("_looked"))
    own = corpus_years.select(F.col("doi").alias("reference_doi"), F.col("year").alias("_own"))
    return rows.join(looked, "reference_doi", "left").join(own, "reference_doi", "left").select("doi", "reference_source", "reference_doi", F.coalesce("year", "_looked", "_own").alias("reference_year"))


def edge_agreement(forward: DataFrame, backward: DataFrame, known: DataFrame) -> DataFrame:
    """One row: pairs of either direction among known works, pairs in both, self-loops and edges to unknown works."""
    k = known.select(F.col("work").alias("citing")).distinct()
    inside = lambda e: e.where("citing <> cited").select("citing", "cited").distinct().join(k, "citing", "left_semi").join(k.withColumnRenamed("citing", "cited"), "cited", "left_semi").select("citing", "cited")
    f, b = inside(forward), inside(backward)
    both = f.intersect(b)
    loops = forward.unionByName(backward).where("citing = cited")
    dangling = forward.select("citing", "cited").distinct().join(k.withColumnRenamed("citing", "cited"), "cited", "left_anti")
    parts = [x.agg(F.count("*").alias(n)) for x, n in ((f, "forward"), (b, "backward"), (both, "both"), (loops, "self_loops"), (dangling, "dangling"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths): longest common subsequence by bits."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


def sorted_words(text: Column) -> Column:
    """Lower-cased words in order, for token-sort comparison."""
    return F.array_join(F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != "")), " ")


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)), dtype=float, count=len(a)))


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has the letters of each of 64 buckets."""
    out = np.zeros((64, len(texts)), dtype=np.int32)
    for i, text in enumerate(texts):
        for ch in text:
            out[ord(ch) & 63, i] += 1
    return out


def best_matches(queries: DataFrame, names: DataFrame, query: str, name: str, least: float = 85.0, block: int = 1024) -> DataFrame:
    """(query, name, score): the most similar name of each query by token-sort ratio if it reaches `least`, else nulls;
    ties: the smaller name. Every query meets every name, in blocks of about `block` rows of either side: the letters
    that two texts have in common bound their ratio from above, and pairs are compared from the largest bound on until
    it is below `least` or the best ratio found."""
    q = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    # one row: the numbers of blocks
    size = q.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).alias("ni")).join(n.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).alias("nj")))

    def cells(df: DataFrame, c: str, mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(c), F.col(f"n{mine}")).alias(mine)
        return df.join(F.broadcast(size)).select(c, sorted_words(F.col(c)).alias("s"), own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{other}") - 1)).alias(other))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str, float]] = []
        if len(a) and len(b):
            mine, texts, found = list(a["s"]), list(b["s"]), list(b["name"])
            common = np.zeros((len(mine), len(texts)), dtype=np.int32)
            for x, y in zip(_letters(mine), _letters(texts), strict=True):
                if x.any() and y.any():
                    common += np.minimum(x[:, None], y[None, :])
            both = np.array([len(x) for x in mine])[:, None] + np.array([len(y) for y in texts])[None, :]
            bound = np.where(both > 0, 200.0 * common / np.maximum(both, 1), 100.0)
            for i, asked in enumerate(a["query"]):
                best: tuple[float, str] | None = None
                for j in (near := np.flatnonzero(bound[i] >= least - 1e-9))[np.argsort(-bound[i, near], kind="stable")]:
                    if best and bound[i, j] < -best[0] - 1e-9:
                        break
                    score = indel_ratio(mine[i], texts[j])
                    if score >= least:
                        best = min(best, (-score, found[j])) if best else (-score, found[j])
                if best:
                    out.append((asked, best[1], -best[0]))
        return pd.DataFrame(out, columns=["query", "name", "score"])

    met = cells(q, "query", "i", "j").groupBy("i", "j").cogroup(cells(n, "name", "j", "i").groupBy("i", "j"))
    scored = met.applyInPandas(meet, "query string, name string, score double")
    best = scored.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return q.join(best, "query", "left").select("query", F.col("b.name").alias("name"), (-F.col("b.s")).alias("score"))
