"""Providers' answers as tables, and resumable collection: what has an observation is not asked for again.

A call asks for a stated number of keys at most, as quotas demand; the next call goes on where it ended.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryleaf.functions.names import normal_doi, plausible_year, registrant
from quarryleaf.operators.curation import incoming_edges
from quarryleaf.operators.reviews import interleaved
from quarryleaf.sources import provider as web

RESULTS = "struct<count:bigint,results:array<struct<id:string,referenced_works:array<string>>>>"
ITEM = "struct<reference:array<struct<DOI:string,year:string>>,issued:struct<`date-parts`:array<array<int>>>>"
#: Keys that one call asks for, at most.
MOST_KEYS = 5000


def short_work(work: Column) -> Column:
    """The last part of a work's address, in upper case."""
    return F.upper(F.element_at(F.split(F.regexp_replace(work, "/+$", ""), "/"), -1))


def citing_pairs(answers: DataFrame, members: DataFrame) -> DataFrame:
    """(cited, citing) of batches' answers, each pair once: a citing work belongs to the members among its references.
    answers: batch, body (JSON); members: batch, work. A work's reference to itself is left out."""
    items = answers.select("batch", F.explode(F.from_json("body", RESULTS)["results"]).alias("r")).where("r.id is not null")
    refs = items.select("batch", F.col("r.id").alias("citing"), F.explode("r.referenced_works").alias("to"))
    mine = members.select("batch", F.col("work").alias("cited"), short_work(F.col("work")).alias("short")).distinct()
    met = refs.withColumn("short", short_work(F.col("to"))).join(mine, ["batch", "short"])
    return met.where(short_work(F.col("citing")) != F.col("short")).select("cited", "citing").distinct()


def truncated_batches(answers: DataFrame) -> DataFrame:
    """(batch, truncated): whether fewer results came than the provider counts; unknown counts are truncated."""
    body = F.from_json("body", RESULTS)
    n = answers.select("batch", body["count"].alias("count"), F.coalesce(F.size(body["results"]), F.lit(0)).alias("got"))
    return n.groupBy("batch").agg(F.coalesce(F.sum("got") < F.max("count"), F.lit(True)).alias("truncated"))


def reference_rows(items: DataFrame) -> DataFrame:
    """(doi, position, reference_doi, year) of registry items (doi, body; a null body is a work that the registry lacks)."""
    refs = items.select("doi", F.posexplode(F.from_json("body", ITEM)["reference"]).alias("position", "r"))
    return refs.select("doi", "position", normal_doi(F.col("r.DOI")).alias("reference_doi"), plausible_year(F.col("r.year")).alias("year"))


def list_status(items: DataFrame) -> DataFrame:
    """(doi, status, deposited): success with the number of references, or not_found."""
    n = F.coalesce(F.size(F.from_json("body", ITEM)["reference"]), F.lit(0))
    return items.select("doi", F.when(F.col("body").isNull(), "not_found").otherwise("success").alias("status"), F.greatest(n, F.lit(0)).alias("deposited"))


def issued_year(body: Column) -> Column:
    """The first part of the first issue date; null where there is none or it is 0."""
    parts = F.from_json(body, ITEM)["issued"]["date-parts"]
    return F.nullif(F.get(F.get(parts, F.lit(0)), F.lit(0)), F.lit(0))


def issued_years(items: DataFrame) -> DataFrame:
    """(doi, year, status): not_found where the registry lacks the work; a found one may have no year."""
    return items.select("doi", issued_year(F.col("body")).alias("year"), F.when(F.col("body").isNull(), "not_found").otherwise("success").alias("status"))


def pending_lists(corpus: DataFrame, lists: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """(doi, position): works without a list observation, publishers interleaved in proportion, at most `most`."""
    keys = corpus.select(normal_doi(F.col("doi")).alias("doi")).where("doi is not null and doi <> ''").distinct().join(lists.select("doi").distinct(), "doi", "left_anti")
    return interleaved(keys.withColumn("registrant", registrant(F.col("doi"))), "registrant", "doi").orderBy("position", "doi").limit(most).select("doi", "position")


def pending_years(references: DataFrame, corpus: DataFrame, years: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """Works to date: referred to without a year, neither in the corpus nor looked up, in the order of their digest."""
    undated = references.where("year is null and reference_doi is not null").select(F.col("reference_doi").alias("doi")).distinct()
    open_ = undated.join(corpus.select(normal_doi(F.col("doi")).alias("doi")), "doi", "left_anti").join(years.select("doi"), "doi", "left_anti")
    return open_.where(~F.contains("doi", F.lit(","))).orderBy(F.md5(F.col("doi").cast("binary")), "doi").limit(most)


def _collected(spark: SparkSession, keys: DataFrame, get: web.Get, url: str, select: str, batch: int, sleep: web.Sleep) -> tuple[DataFrame, dict]:
    rows: list[tuple[str, str | None]] = []
    dois = [r.doi for r in keys.collect()]  # at most MOST_KEYS
    stats = web.crawl(
        web.in_batches(dois, batch), lambda b: web.registry_items(b, get, url, select, sleep),
        lambda _, answer: rows.extend(answer["items"].items()), lambda answer: None if answer["status"] == "ok" else answer["status"])
    return spark.createDataFrame(rows, "doi string, body string"), stats


def collect_references(corpus: DataFrame, lists: DataFrame, references: DataFrame, years: DataFrame, get: web.Get, url: str, at: datetime, sleep: web.Sleep, most: int = MOST_KEYS) -> tuple[dict[str, DataFrame], dict]:
    """({lists, references, years}: rows to append, figures of both passes). First reference lists of works without one,
    then, unless the first was stopped, years of references that have none. lists: doi, observed_at, status, deposited;
    references: doi, position, reference_doi, year, observed_at; years: doi, year, status, observed_at."""
    spark, stamp = corpus.sparkSession, F.lit(at).cast("timestamp_ntz").alias("observed_at")
    items, first = _collected(spark, pending_lists(corpus, lists, most), get, url, "DOI,reference,issued", web.LIST_BATCH, sleep)
    new_lists, new_refs = list_status(items).select("*", stamp), reference_rows(items).select("*", stamp)
    if first["stopped"]:
        return {"lists": new_lists, "references": new_refs, "years": years.limit(0)}, {"lists": first, "years": None}
    known = references.select("reference_doi", "year").unionByName(new_refs.select("reference_doi", "year"))
    dated, second = _collected(spark, pending_years(known, corpus, years, most), get, url, "DOI,issued", web.YEAR_BATCH, sleep)
    return {"lists": new_lists, "references": new_refs, "years": issued_years(dated).select("*", stamp)}, {"lists": first, "years": second}


def refresh_edges(works: DataFrame, get: web.Get, url: str, at: datetime, sleep: web.Sleep, most: int = MOST_KEYS, refresh: bool = False, pages: int = web.MAX_PAGES) -> tuple[DataFrame, DataFrame, dict]:
    """(edges to append, (work_id, citing_crawled_at, citing_truncated) of works now crawled, figures). A work is done when
    it has a crawl time, not when it has an edge; refused batches stay pending. works: work_id, doi, citing_crawled_at."""
    spark = works.sparkSession
    open_ = works.where("work_id is not null") if refresh else works.where("work_id is not null and citing_crawled_at is null")
    order = interleaved(open_.withColumn("registrant", F.coalesce(registrant(F.col("doi")), F.lit("~"))), "registrant", "work_id")
    ids = [r.work_id for r in order.orderBy(F.col("doi").isNull(), "position", "work_id").limit(most).collect()]  # at most MOST_KEYS
    found: list[tuple[str, str]] = []
    done: list[tuple[str, bool]] = []

    def keep(_, answer: dict) -> None:
        for work, r in answer.items():
            found.extend((work, c) for c in r["citing"])
            done.append((work, r["truncated"]))

    def refused(answer: dict) -> str | None:
        one = next(iter(answer.values()), {"throttled": False, "error": None})
        return "error" if one["error"] is not None else "throttled" if one["throttled"] else None

    stats = web.crawl(web.in_batches(ids, web.CITING_BATCH), lambda b: web.citing(b, get, url, pages, sleep), keep, refused)
    stamp = F.lit(at).cast("timestamp_ntz")
    edges = incoming_edges(spark.createDataFrame(found, "cited string, citing string"), stamp)
    crawled = spark.createDataFrame(done, "work_id string, citing_truncated boolean")
    return edges, crawled.select("work_id", stamp.alias("citing_crawled_at"), "citing_truncated"), stats | {"truncated": sum(t for _, t in done)}
