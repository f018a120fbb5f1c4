"""Medallion layers: raw records to bronze articles, silver works, gold works and chunks, and immutable versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryleaf.functions.categories import classify, preferred
from quarryleaf.functions.names import abstract_text, countries, normal_doi
from quarryleaf.operators import joins
from quarryleaf.operators.curation import content_digest
from quarryleaf.operators.text import chunked
from quarryleaf.sources.files import bib_record, export_record

ARTICLE = "source string, source_id string, record_type string, doi string, title string, authors array<string>, year int, venue string, abstract string, keywords array<string>, citation_count int, reference_count int, countries array<string>, online_date date, document_type string, license string, note string, path string"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, absent ones as typed nulls; additive evolution without inference."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def bronze(exports: DataFrame, entries: DataFrame, other: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Articles of two publishers. exports: CSV rows (file, row_index, doi, fields) of the first, entries: its BibTeX
    rows (path, key, entry_type, fields, doi), the last entry of an identifier filling the export's gaps; entries that
    no export has are kept, those without identifier too. other: BibTeX rows of the second. A cache (doi and counts)
    fills unknown counts only."""
    spark = exports.sparkSession
    rows = exports.select("doi", F.col("file").alias("path"), F.concat_ws(":", "file", "row_index").alias("source_id"), *(c.alias(n) for n, c in export_record(F.col("fields")).items()))
    rows = rows.withColumn("countries", countries(F.coalesce("affiliations", F.lit("")))).drop("affiliations")
    bib = entries.select("doi", "path", F.col("key").alias("source_id"), F.col("entry_type").alias("record_type"), *(c.alias(n) for n, c in bib_record(F.col("fields"), ";").items()))
    last = joins.latest(bib.where("doi is not null"), ["doi"], ["path", "source_id"])
    names = [c for c in bib.columns if c not in ("doi", "path", "source_id")]
    side = last.select("doi", *(F.col(c).alias(f"_{c}") for c in names))
    filled = rows.join(side, "doi", "left")
    pick = [(F.coalesce(_blank(c, rows), F.col(f"_{c}")) if c in rows.columns else F.col(f"_{c}")).alias(c) for c in names]
    first = filled.select("doi", "path", "source_id", *pick, *(c for c in rows.columns if c not in ("doi", "path", "source_id", *names)))
    alone = bib.join(rows.where("doi is not null").select("doi").distinct(), "doi", "left_anti")
    one = conform(first, ARTICLE).unionByName(conform(alone, ARTICLE)).withColumn("source", F.lit("first"))
    two = conform(other.select("doi", "path", F.col("key").alias("source_id"), F.col("entry_type").alias("record_type"), *(c.alias(n) for n, c in bib_record(F.col("fields"), ",").items())), ARTICLE).withColumn("source", F.lit("second"))
    out = one.unionByName(two)
    if cache is not None:
        out = joins.fill_missing(out, cache, "doi", ["citation_count", "reference_count"])
    kind = classify(F.col("record_type"), F.col("title"), F.col("venue"), F.col("document_type"), F.col("note"))
    return out.withColumn("_k", kind).select("*", F.col("_k.category").alias("publication_category"), F.col("_k.basis").alias("publication_category_basis"), F.sha2(F.concat_ws("|", "source", "source_id").cast("binary"), 256).alias("id")).drop("_k")


def _blank(column: str, df: DataFrame) -> Column:
    kind = dict(df.dtypes)[column]
    if kind.startswith("array"):
        return F.when(F.size(column) > 0, F.col(column))
    return F.nullif(F.col(column), F.lit("")) if kind == "string" else F.col(column)


def silver(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works by identifier, and rejected rows (id, reason). A work takes the fields of the row with the longest abstract
    (ties: the smaller id), the first known counts, dates and license by id, all sources and ids, the best category."""
    rejected = articles.where(normal_doi(F.col("doi")).isNull()).select("id", "source", "source_id", F.lit("no_doi").alias("reason"))
    rows = articles.withColumn("doi", normal_doi(F.col("doi"))).where("doi is not null")
    lead = ("title", "authors", "year", "venue", "abstract", "keywords", "record_type")
    primary = F.min_by(F.struct(*lead), F.struct((-F.length(F.coalesce("abstract", F.lit("")))).alias("n"), F.col("id")))
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in ("citation_count", "reference_count", "countries", "online_date", "license")]
    works = rows.groupBy("doi").agg(
        primary.alias("_p"), *first, F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_list("id")).alias("ids"),
        (F.count("*") > 1).alias("is_duplicate_merge"), preferred(F.col("publication_category"), F.col("publication_category_basis")).alias("_c"))
    return works.select("doi", *(F.col("_p")[c].alias(c) for c in lead), *(c for c in works.columns if c not in ("doi", "_p", "_c")), F.col("_c.category").alias("publication_category"), F.col("_c.basis").alias("publication_category_basis")), rejected


def gold(works: DataFrame, plan: DataFrame) -> DataFrame:
    """Works with approved merges applied. plan: (canonical, duplicates, status); only `ok` rows are applied."""
    pairs = plan.where("status = 'ok'").select(F.explode("duplicates").alias("doi"), "canonical")
    rows = works.join(pairs, "doi", "left").withColumn("canonical", F.coalesce("canonical", "doi"))
    firsts = ["title", "year", "venue", "abstract", "record_type", "online_date", "license", "publication_category", "publication_category_basis"]
    got = joins.merged(rows, "canonical", "doi", ["citation_count", "reference_count"], firsts, [], ["authors", "keywords", "sources", "ids", "countries"])
    return got.withColumnRenamed("canonical", "doi")


def chunks(works: DataFrame, fulltexts: DataFrame | None = None) -> DataFrame:
    """(doi, chunk_type, seq, text, char_len, text_sha256): an abstract chunk 0, full-text chunks from 1."""
    about = works.select("doi", F.lit("abstract").alias("chunk_type"), F.lit(0).alias("seq"), abstract_text(F.col("title"), F.col("keywords"), F.col("abstract")).alias("text")).where("text <> ''")
    out = about.withColumn("char_len", F.length("text"))
    if fulltexts is not None:
        out = out.unionByName(chunked(fulltexts, "doi", "text").select("doi", F.lit("fulltext").alias("chunk_type"), "seq", "text", "char_len"))
    return out.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))


def reused_vectors(desired: DataFrame, previous: DataFrame) -> DataFrame:
    """Desired chunks with the stored vector where the text is the same, else null: what is left is pending."""
    key = ["doi", "chunk_type", "seq"]
    old = previous.select(*key, F.col("text_sha256").alias("_s"), F.col("embedding").alias("_e"))
    return desired.join(old, key, "left").withColumn("embedding", F.when(F.col("_s") == F.col("text_sha256"), F.col("_e"))).drop("_s", "_e")


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A digest of all rows, whatever their order and partitions, by groups of rows: no task or row holds all."""
    return content_digest(df, columns).first().digest


def write_version(df: DataFrame, root: str, table: str, version: str) -> None:
    """Write an immutable version of a table; a published one is never overwritten."""
    if active_version(df.sparkSession, root) == version:
        raise ValueError(f"version {version} is active")
    df.drop("dataset_version_id").write.mode("overwrite").parquet(f"{root}/{table}/dataset_version_id={version}")


def active_version(spark: SparkSession, root: str) -> str | None:
    """The version that the pointer names, read through Spark from whatever store root is in."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_pointer")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    row = spark.read.schema("dataset_version_id string").json(f"{root}/_pointer").first()
    return row["dataset_version_id"] if row else None


def publish(spark: SparkSession, root: str, version: str, checks: DataFrame) -> None:
    """Point readers at a version once its contract holds; the pointer is written last."""
    from quarryleaf.operators.contracts import required

    required(checks)
    spark.createDataFrame([(version,)], "dataset_version_id string").coalesce(1).write.mode("overwrite").json(f"{root}/_pointer")


def read_active(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the active version: one directory is listed and read."""
    version = active_version(spark, root)
    if version is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{table}/dataset_version_id={version}").withColumn("dataset_version_id", F.lit(version))


def pending(wanted: DataFrame, observations: DataFrame, key: str = "doi", refresh: bool = False, most: int | None = None) -> DataFrame:
    """What a resumable collection still has to fetch: keys without a successful observation, in the order of their
    hash; `most` of them where a limit is asked for."""
    todo = wanted.select(key).distinct()
    if not refresh:
        todo = todo.join(observations.where("status = 'success'").select(key).distinct(), key, "left_anti")
    ordered = todo.orderBy(F.sha2(F.col(key).cast("string").cast("binary"), 256))
    return ordered if most is None else ordered.limit(most)


def stale(executions: DataFrame, cutoff: Column) -> DataFrame:
    """Running executions whose last sign of life is before the cutoff."""
    return executions.where((F.col("status") == "running") & (F.coalesce("heartbeat_at", "started_at") < cutoff))


def effective_sources(scanned: DataFrame, active: DataFrame) -> DataFrame:
    """Append policy: what was scanned, and active paths that are absent now."""
    return scanned.unionByName(active.join(scanned, "path", "left_anti"), allowMissingColumns=True)


def registrant_coverage(works: DataFrame, have: DataFrame, most: int = 6) -> DataFrame:
    """(prefix, n, covered) of the largest registrants."""
    known = have.select("doi").distinct().withColumn("_have", F.lit(True))
    rows = works.join(known, "doi", "left").withColumn("prefix", F.split_part("doi", F.lit("/"), F.lit(1)))
    return rows.groupBy("prefix").agg(F.count("*").alias("n"), F.count("_have").alias("covered")).orderBy(F.desc("n"), "prefix").limit(most)
