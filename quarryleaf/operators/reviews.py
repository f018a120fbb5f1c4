"""Review evidence: sampling, assignment, labels, consensus, progress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryleaf.functions.names import author_key, normal_doi, without_accents


def hash_order(*columns: str | Column) -> Column:
    """A seeded order that any engine can repeat: the digest of the values joined by a bar."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)).cast("binary"))


def stratified(df: DataFrame, stratum: str, key: str, per: int, seed: int = 0) -> DataFrame:
    """At most `per` rows of each stratum, in the order of a seeded hash of the key."""
    w = Window.partitionBy(stratum).orderBy(hash_order(key, F.lit(seed)), key)
    return df.where(F.col(stratum).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r")


def band(value: Column, cuts: Sequence[float]) -> Column:
    """Index of the half-open interval of ascending cuts that holds the value; null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        out = F.when((value >= a) & (value < b), F.lit(i)).otherwise(out)
    return out


def quotas(sizes: Mapping[int, int], total: int) -> dict[int, int]:
    """Equal shares of a sample; what a small stratum can't fill goes round the others, one at a time."""
    names = sorted(sizes)
    out = {k: min(sizes[k], total // max(len(names), 1)) for k in names}
    left = min(total, sum(sizes.values())) - sum(out.values())
    while left > 0:
        for k in names:
            if left and out[k] < sizes[k]:
                out[k] += 1
                left -= 1
    return out


def margin_sample(df: DataFrame, key: str, margin: str, total: int = 100, cuts: Sequence[float] = (-0.10, 0.0, 0.10), seed: int = 42) -> DataFrame:
    """A sample over the four strata that the cuts make, with equal quotas. Four counts come to the driver."""
    rows = df.where(F.col(margin).isNotNull()).withColumn("stratum", band(F.col(margin), [float("-inf"), *cuts, float("inf")]))
    wanted = quotas({r["stratum"]: r["n"] for r in rows.groupBy("stratum").agg(F.count("*").alias("n")).collect()}, total)
    limit = F.lit(0)
    for k, n in wanted.items():
        limit = F.when(F.col("stratum") == k, n).otherwise(limit)
    w = Window.partitionBy("stratum").orderBy(hash_order(key, F.lit(seed)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def interleaved(df: DataFrame, group: str, key: str) -> DataFrame:
    """position: (rank within group - 0.5) / size of group; ordering by it, then group and key, keeps every prefix
    proportional."""
    w = Window.partitionBy(group)
    return df.withColumn("position", (F.row_number().over(w.orderBy(key)) - 0.5) / F.count("*").over(w))


def ambiguous_names(names: DataFrame, name: str, limit: int = 40) -> DataFrame:
    """(risk, a, b): spellings that share an identity key (merge), and keys of one surname whose initials could be the
    same person (split), taken in turn. Pairs stay within one key or surname."""
    base = names.select(F.trim(name).alias("name")).where("name <> ''").distinct().withColumn("key", author_key(F.col("name")))
    same = base.join(base.select("key", F.col("name").alias("b")), "key").where("name < b").select(F.lit("merge").alias("risk"), F.col("name").alias("a"), "b")
    plain = F.lower(without_accents(F.col("name")))
    last = F.when(plain.contains(","), F.trim(F.split_part(plain, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(plain, r"\s+"), -1))
    given = F.when(plain.contains(","), F.split_part(plain, F.lit(","), F.lit(2))).otherwise(F.array_join(F.slice(F.split(plain, r"\s+"), 1, F.greatest(F.size(F.split(plain, r"\s+")) - 1, F.lit(0))), " "))
    people = base.select("name", "key", last.alias("last"), F.array_distinct(F.transform(F.filter(F.split(given, r"[\s.]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1))).alias("initials"))
    other = people.select("last", F.col("name").alias("b"), F.col("key").alias("kb"), F.col("initials").alias("ib"))
    within = (F.size(F.array_except("initials", "ib")) == 0) | (F.size(F.array_except("ib", "initials")) == 0)
    split = people.join(other, "last").where((F.col("name") < F.col("b")) & (F.col("key") != F.col("kb")) & within).select(F.lit("split").alias("risk"), F.col("name").alias("a"), "b")
    both = same.unionByName(split)
    turn = F.row_number().over(Window.partitionBy("risk").orderBy("a", "b"))
    return both.withColumn("turn", turn).orderBy("turn", "risk").limit(limit)


def pooled(results: DataFrame, depth: int = 10) -> DataFrame:
    """Distinct subjects among the first `depth` different ones of each query. results: query_id, rank, doc_id."""
    first = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= depth).select("doc_id").distinct()


def assignments(subjects: DataFrame, reviewers: Sequence[str], existing: DataFrame) -> DataFrame:
    """(subject_id, reviewer_id) still to assign: each subject to each of the (two or more) reviewers."""
    if len(set(reviewers)) < 2:
        raise ValueError("two reviewers at least")
    wanted = subjects.select("subject_id", F.explode(F.array(*(F.lit(r) for r in sorted(set(reviewers))))).alias("reviewer_id")).distinct()
    return wanted.join(existing.select("subject_id", "reviewer_id"), ["subject_id", "reviewer_id"], "left_anti")


def next_revisions(incoming: DataFrame, labels: DataFrame) -> DataFrame:
    """Incoming labels with the revision after their assignment's last one."""
    last = labels.groupBy("assignment_id").agg(F.max("label_revision").alias("_last"))
    return incoming.join(last, "assignment_id", "left").withColumn("label_revision", F.coalesce("_last", F.lit(0)) + 1).drop("_last")


def collected(labels: DataFrame, assigned: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(subject_id, reviewer_id, label): the last revision of each assignment, and final labels as "adjudicated"."""
    best = labels.groupBy("assignment_id").agg(F.max_by("label", "label_revision").alias("label"))
    rows = best.join(assigned, "assignment_id").select("subject_id", "reviewer_id", "label")
    return rows.unionByName(adjudications.select("subject_id", F.lit("adjudicated").alias("reviewer_id"), F.col("final_label").alias("label")))


def progress(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """(reviewer_id, total, labelled, outstanding)."""
    done = labels.select("assignment_id").distinct().withColumn("_done", F.lit(True))
    s = assigned.join(done, "assignment_id", "left").groupBy("reviewer_id").agg(F.count("*").alias("total"), F.count("_done").alias("labelled"))
    return s.withColumn("outstanding", F.col("total") - F.col("labelled"))


# What reviewers write, and what it means.
ALIASES = {"include": "include", "relevant": "include", "yes": "include", "1": "include", "true": "include", "exclude": "exclude", "irrelevant": "exclude", "no": "exclude", "0": "exclude", "false": "exclude", "uncertain": "uncertain", "maybe": "uncertain", "unsure": "uncertain"}


def validated(labels: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Usable rows (doi, reviewer, label), once each, and the issues (doi, reviewer, issue) of the others: unknown labels,
    missing or unknown identifiers, reviewers who contradict themselves."""
    means = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    rows = labels.select(normal_doi(F.col("doi")).alias("doi"), F.trim("reviewer").alias("reviewer"), F.try_element_at(means, F.lower(F.trim("label"))).alias("label"))
    if known is not None:
        have = known.select(normal_doi(F.col("doi")).alias("doi")).distinct().withColumn("_known", F.lit(True))
        rows = rows.join(have, "doi", "left")
    else:
        rows = rows.withColumn("_known", F.lit(True))
    clash = F.size(F.collect_set("label").over(Window.partitionBy("doi", "reviewer"))) > 1
    issue = F.when(F.col("doi").isNull(), "missing_doi").when(F.col("label").isNull(), "invalid_label").when(F.col("_known").isNull(), "unknown_doi").when(clash, "reviewer_conflict")
    flagged = rows.withColumn("issue", issue)
    return flagged.where("issue is null").select("doi", "reviewer", "label").distinct(), flagged.where("issue is not null").select("doi", "reviewer", "issue")


def consensus(labels: DataFrame, adjudicator: str = "adjudicated") -> DataFrame:
    """(doi, y_true, resolved, status): the adjudicated label, else what all reviewers (two or more) agree on."""
    final = F.col("reviewer") == adjudicator
    binary = F.col("label").isin("include", "exclude")
    s = labels.groupBy("doi").agg(
        F.collect_set(F.when(final & binary, F.col("label"))).alias("a"), F.collect_set(F.when(~final & binary, F.col("label"))).alias("b"),
        F.count_distinct(F.when(~final, F.col("reviewer"))).alias("reviewers"), F.count_if(~final & (F.col("label") == "uncertain")).alias("unsure"))
    status = F.when(F.size("a") == 1, "adjudicated").when(F.col("unsure") > 0, "uncertain").when(F.size("b") > 1, "disagreement").when((F.size("b") == 1) & (F.col("reviewers") >= 2), "unanimous").otherwise("incomplete")
    chosen = F.when(F.size("a") == 1, F.col("a")[0]).when(status == "unanimous", F.col("b")[0])
    return s.select("doi", (chosen == "include").alias("y_true"), chosen.isNotNull().alias("resolved"), status.alias("status"))


def label_digest(labels: DataFrame) -> DataFrame:
    """One row: the digest of all (doi, reviewer, label) rows, in order. For a set of human labels, not a corpus."""
    rows = F.array_sort(F.collect_list(F.concat_ws("\t", "doi", "reviewer", "label")))
    return labels.agg(F.sha2(F.array_join(rows, "\n").cast("binary"), 256).alias("digest"))


def assisted(labels: DataFrame) -> DataFrame:
    """is_assisted: whether a reviewer's id ends in -assisted, in any case."""
    return labels.withColumn("is_assisted", F.coalesce(F.endswith(F.lower("reviewer_id"), F.lit("-assisted")), F.lit(False)))
