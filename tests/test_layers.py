"""Sources, layers, versions, reviews and streams end to end on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quarryleaf.operators import contracts, joins, layers, reviews
from quarryleaf.sources import files
from quarryleaf.streaming import events

BIB = """
@ARTICLE{a1, title = {A {Survey} of X}, author="Ana Silva and Bo Chen", year=2020, journal={J}, doi={10.1/A}, keywords={p;q}, abstract={long abstract text that goes on}}@INPROCEEDINGS{a2,
 title={Second}, author={Chen, Bo}, year = {2021}, booktitle = "Proc. of Y", doi={https://doi.org/10.1/B}}
@comment{ignored {nested} } @ARTICLE{a3, title="No " # "doi", year={n.d.}}
@ARTICLE{broken, title={never closed
"""


def test_bib_entries():
    got = files.bib_entries(BIB)
    assert [(k, t) for k, t, _ in got] == [("a1", "article"), ("a2", "inproceedings"), ("a3", "article"), ("broken", "article")]
    assert got[0][2]["title"] == "A {Survey} of X" and got[0][2]["author"] == "Ana Silva and Bo Chen" and got[0][2]["year"] == "2020"
    assert got[1][2]["booktitle"] == "Proc. of Y" and got[2][2]["title"] == "No doi"
    assert files.bib_entries("") == [] and files.bib_entries("no entry") == []


@pytest.fixture
def corpus(spark, tmp_path):
    root = tmp_path / "in"
    (root / "first").mkdir(parents=True)
    (root / "second").mkdir()
    (root / "first/export1.csv").write_text('DOI,Document Title,Authors,Publication Year,Abstract,Author Keywords,Article Citation Count,Author Affiliations\n10.1/A,"A ""quoted"" survey","Silva, A.; Chen, B.",2020,,x;y,12.0,"U, Brazil; V, Chile"\n10.1/C,Third,Lee,2019,"multi\nline",,,\n')
    (root / "first/one.bib").write_text(BIB)
    (root / "second/two.bib").write_text('@article{b1, title={A survey}, doi={10.1/a}, year=2021, abstract={the longest abstract of them all, by far}, keywords={k1, k2}, journal={Z}}')
    (root / "report.txt").write_text('Search\n"smart grid" OR "power flow"\nYear: 2000-2020\nhttps://x.org/s?q=1\nLanguage: English\n')
    return root


def build(spark, root):
    exports = files.csv_rows(spark, f"{root}/first/*.csv")
    bibs = lambda d: files.bib_rows(spark.read.text(f"{root}/{d}/*.bib", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content")))
    cache = spark.createDataFrame([("10.1/c", 7, 3), ("10.1/a", 99, 5)], "doi string, citation_count int, reference_count int")
    return layers.bronze(exports, bibs("first"), bibs("second"), cache)


def test_layers_end_to_end(spark, corpus, tmp_path):
    bronze = build(spark, corpus).withColumn("dataset_version_id", F.lit("v1")).persist()
    rows = {(r.source, r.doi, r.title): r for r in bronze.collect()}
    a = rows["first", "10.1/a", 'A "quoted" survey']
    assert (a.citation_count, a.reference_count, a.abstract, a.countries, a.keywords) == (12, 5, "long abstract text that goes on", ["Brazil", "Chile"], ["x", "y"])
    assert rows["first", "10.1/c", "Third"].citation_count == 7 and rows["first", None, "No doi"].year is None
    assert len(rows) == bronze.count() == 6
    silver, rejected = layers.silver(bronze)
    silver = silver.withColumn("dataset_version_id", F.lit("v1"))
    best = {r.doi: r for r in silver.collect()}
    assert best["10.1/a"].title == "A survey" and best["10.1/a"].sources == ["first", "second"] and best["10.1/a"].is_duplicate_merge and best["10.1/a"].citation_count == 12
    assert best["10.1/a"].publication_category == "review" and best["10.1/b"].publication_category == "conference" and rejected.count() == 2
    domain = ["journal", "conference", "review", "other"]
    contracts.required(contracts.silver_contract(bronze, silver, rejected, "v1", domain))
    overrides = spark.createDataFrame([("10.1/a", "10.1/c"), ("10.1/a", "10.1/zz")], "canonical string, duplicate string")
    plan = joins.merge_plan(overrides, silver)
    assert {(r.status, tuple(r.duplicates)) for r in plan.collect()} == {("ok", ("10.1/c",)), ("absent", ("10.1/zz",))}
    gold = layers.gold(silver, plan)
    merged = {r.doi: r for r in gold.collect()}
    assert set(merged) == {"10.1/a", "10.1/b"} and merged["10.1/a"].citation_count == 12 and "Lee" in merged["10.1/a"].authors
    chunks = layers.chunks(gold, spark.createDataFrame([("10.1/a", "word " * 900)], "doi string, text string"))
    assert {(r.chunk_type, r.seq) for r in chunks.where("doi = '10.1/a'").collect()} == {("abstract", 0), *(("fulltext", i) for i in range(1, 5))}
    checks = contracts.gold_contract(gold, chunks, domain)
    out = f"{tmp_path}/out"
    assert layers.active_version(spark, out) is None
    layers.write_version(gold, out, "articles", "v1")
    layers.publish(spark, out, "v1", checks)
    assert layers.read_active(spark, out, "articles").count() == 2
    with pytest.raises(ValueError, match="active"):
        layers.write_version(gold, out, "articles", "v1")
    broken = gold.unionByName(gold)
    layers.write_version(broken, out, "articles", "v2")
    with pytest.raises(ValueError, match="gold.doi_unique"):
        layers.publish(spark, out, "v2", contracts.gold_contract(broken, chunks, domain))
    assert layers.active_version(spark, out) == "v1"
    same = layers.reused_vectors(chunks, chunks.withColumn("embedding", F.array(F.lit(1.0))))
    assert same.where("embedding is null").count() == 0


def test_manifest_changes(spark, corpus):
    kinds = {"csv": r"export.*\.csv$", "bib": r"\.bib$", "report": r"report\.txt$"}
    scan = files.manifest(spark, str(corpus), kinds)
    one = spark.createDataFrame(scan.collect(), scan.schema)
    assert {(r.path, r.kind) for r in one.collect()} == {("first/export1.csv", "csv"), ("first/one.bib", "bib"), ("second/two.bib", "bib"), ("report.txt", "report")}
    mark = layers.fingerprint(one, ["path", "sha256"])
    assert mark == layers.fingerprint(one.repartition(3), ["path", "sha256"])
    (corpus / "second/two.bib").rename(corpus / "second/moved.bib")
    (corpus / "report.txt").write_text("changed")
    (corpus / "first/new.bib").write_text("@misc{x}")
    two = files.manifest(spark, str(corpus), kinds)
    got = {(r.path, r.change, r.was) for r in joins.changes(one, two).collect()}
    assert got == {("first/export1.csv", "unchanged", None), ("first/one.bib", "unchanged", None), ("report.txt", "modified", None), ("first/new.bib", "added", None), ("second/moved.bib", "renamed", "second/two.bib")}
    assert layers.fingerprint(two, ["path", "sha256"]) != mark


def test_reports_caches_and_works(spark, corpus, tmp_path):
    text = spark.read.text(f"{corpus}/report.txt", wholetext=True).select(F.lit("r").alias("path"), F.col("value").alias("content"))
    r = files.search_report(text).first()
    assert (r.query, r.year_from, r.year_to, r.url, r.filters) == ('"smart grid" OR "power flow"', 2000, 2020, "https://x.org/s?q=1", ["Search", "Language: English"])
    (tmp_path / "cache.json").write_text(json.dumps({"https://doi.org/10.1/X": {"citation_count": 3, "reference_count": None}}))
    assert [tuple(x) for x in files.enrichment_cache(spark, f"{tmp_path}/cache.json").collect()] == [("10.1/x", 3, None)]
    (tmp_path / "bad.json").write_text("{nope")
    assert files.enrichment_cache(spark, f"{tmp_path}/bad.json").count() == 0
    doc = json.dumps({"id": "W1", "doi": "https://doi.org/10.1/X", "publication_year": 2020, "cited_by_count": 2, "counts_by_year": [{"year": 2021, "cited_by_count": 2}], "referenced_works": ["W2", "W1", "W2"]})
    one, years, edges = files.works(spark.createDataFrame([(doc,), (None,), ("junk",)], "j string"), "j")
    assert one.count() == 1 and [tuple(x) for x in years.collect()] == [("W1", 2021, 2)] and [tuple(x) for x in edges.collect()] == [("W1", "W2")]


def test_reviews(spark):
    names = spark.createDataFrame([("Ana Silva",), ("A. Silva",), ("Silva, Ana",), ("B. Silva",), ("Ana B. Silva",), (" ",)], "n string")
    got = {(r.risk, r.a, r.b) for r in reviews.ambiguous_names(names, "n").collect()}
    assert ("merge", "A. Silva", "Ana Silva") in got and not any("B. Silva" in (a, b) and "A. Silva" in (a, b) and risk == "merge" for risk, a, b in got)
    assert reviews.quotas({0: 3, 1: 100, 2: 100}, 60) == {0: 3, 1: 29, 2: 28}
    with pytest.raises(ValueError):
        reviews.assignments(names.select(F.col("n").alias("subject_id")), ["a"], names)
    labels = spark.createDataFrame([("10.1/a", "r1", "yes"), ("10.1/a", "r2", "no"), ("10.1/a", "adjudicated", "include"), ("10.1/b", "r1", "yes"), ("10.1/b", "r1", "no"), ("10.1/c", "r1", "maybe"), ("10.1/c", "r2", "yes"), (None, "r", "yes")], "doi string, reviewer string, label string")
    good, issues = reviews.validated(labels)
    assert {(r.doi, r.status, r.y_true) for r in reviews.consensus(good).collect()} == {("10.1/a", "adjudicated", True), ("10.1/c", "uncertain", None)}
    assert {(r.doi, r.issue) for r in issues.collect()} == {("10.1/b", "reviewer_conflict"), (None, "missing_doi")}


def stream(spark, tmp_path, rows, name):
    source = f"{tmp_path}/{name}"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k long, ts string, value double").select("k", F.to_timestamp("ts").alias("ts"), "value").coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema("k long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(source)


def test_streams(spark, tmp_path):
    parts = [[(1, "2024-01-01 00:01:00", 1.0), (1, "2024-01-01 00:04:00", 2.0), (2, "2024-01-01 00:02:00", 5.0)], [(1, "2024-01-01 00:03:00", 9.0), (1, "2024-01-01 02:00:00", 3.0)]]
    src = stream(spark, tmp_path, parts, "a")
    q = events.tumbling(src, "ts", "5 minutes", "k", "value", "10 minutes").writeStream.outputMode("complete").format("memory").queryName("tumble").start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r.start), r.k, r.n, r.total) for r in spark.table("tumble").collect()} == {("2024-01-01 00:00:00", 1, 3, 12.0), ("2024-01-01 00:00:00", 2, 1, 5.0), ("2024-01-01 02:00:00", 1, 1, 3.0)}
    q = events.latest_state(stream(spark, tmp_path, parts, "b"), "k", "ts", "value").writeStream.outputMode("update").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    last = {r.k: r.value for r in spark.sql("select k, max_by(value, at) as value from latest group by k").collect()}
    assert last == {1: 3.0, 2: 5.0}
    for _ in range(2):  # a second run over the same source adds nothing
        q = stream(spark, tmp_path, [], "a").writeStream.foreachBatch(events.append_new(f"{tmp_path}/sink", "k")).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/sink").collect()) == [1, 2]
