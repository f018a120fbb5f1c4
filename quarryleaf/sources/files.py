"""File sources: manifests of binary files, CSV exports, BibTeX, search reports, JSON caches, binary vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryleaf.functions.names import listed, normal_doi, online_date, whole_number


def manifest(spark: SparkSession, root: str, kinds: dict[str, str]) -> DataFrame:
    """(path, kind, sha256, bytes, modified, revision_id) of files below root whose relative path matches a pattern of
    `kinds` (kind: regular expression, first match). Files are read and hashed by executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/") + "/")
    path = F.when(F.instr(F.col("path"), base) > 0, F.substr(F.col("path"), F.instr(F.col("path"), base) + F.length(base))).otherwise(F.substring_index("path", "/", -1))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(kinds.items()):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    rows = files.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    found = rows.withColumn("kind", kind).where("kind is not null")
    return found.withColumn("revision_id", F.sha2(F.to_json(F.struct("path", "sha256")).cast("binary"), 256))


def csv_rows(spark: SparkSession, path: str, doi_column: str = "DOI") -> DataFrame:
    """(file, row_index, doi, fields): all columns of CSV exports as a map, blank cells as null, in file order."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        for pdf in it:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                reader = csv.DictReader(io.StringIO(bytes(content).decode("utf-8-sig")))
                rows = [{k: (v if v and v.strip() else None) for k, v in r.items() if k is not None and not isinstance(v, list)} for r in reader]
                yield pd.DataFrame({"file": [file] * len(rows), "row_index": range(len(rows)), "fields": rows})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row_index long, fields map<string,string>")
    return raw.select("file", "row_index", normal_doi(F.try_element_at("fields", F.lit(doi_column))).alias("doi"), "fields")


_START = re.compile(r"@\s*(\w+)\s*[{(]\s*", re.S)
_NAME = re.compile(r"\s*,?\s*([\w:+.\-]+)\s*=\s*", re.S)


def bib_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(key, entry type, fields) of BibTeX by balanced braces; entries need nothing between them, comments and broken
    ends are passed over. Values lose one pair of outer braces or quotes; # joins parts; names are lower-cased."""
    out, at = [], 0
    while m := _START.search(text, at):
        kind, at = m.group(1).lower(), m.end()
        if kind in ("comment", "preamble", "string"):
            at = _value(text, at - 1)[1] if text[at - 1 : at] in "{(" else at
            continue
        comma = re.compile(r"[,})]").search(text, at)
        if not comma:
            break
        key, fields = text[at : comma.start()].strip(), {}
        at = comma.start()
        while n := _NAME.match(text, at):
            value, at = _value(text, n.end())
            while j := re.compile(r"\s*#\s*").match(text, at):
                more, at = _value(text, j.end())
                value += more
            fields[n.group(1).lower()] = value
        close = re.compile(r"\s*,?\s*[})]").match(text, at)
        at = close.end() if close else at
        out.append((key, kind, fields))
    return out


def _value(text: str, at: int) -> tuple[str, int]:
    """A braced, quoted or bare value and where it ends."""
    if text[at : at + 1] == "{":
        depth = 0
        for k in range(at, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if depth == 0:
                return text[at + 1 : k], k + 1
        return text[at + 1 :], len(text)
    if text[at : at + 1] == '"':
        depth = 0
        for k in range(at + 1, len(text)):
            depth += (text[k] == "{") - (text[k] == "}")
            if text[k] == '"' and depth == 0:
                return text[at + 1 : k], k + 1
        return text[at + 1 :], len(text)
    m = re.compile(r"[^\s,#})]*").match(text, at)
    return m.group(0), m.end()


def bib_rows(files: DataFrame) -> DataFrame:
    """(path, key, entry_type, fields, doi) of rows (path, content as text)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, *e) for p, c in zip(pdf["path"], pdf["content"], strict=True) for e in bib_entries(c or "")]
            yield pd.DataFrame(rows, columns=["path", "key", "entry_type", "fields"])

    raw = files.select("path", "content").mapInPandas(run, "path string, key string, entry_type string, fields map<string,string>")
    return raw.select("*", normal_doi(F.try_element_at("fields", F.lit("doi"))).alias("doi"))


def search_report(files: DataFrame) -> DataFrame:
    """(path, query, year_from, year_to, url, filters) of search reports (path, content): the quoted disjunction, the
    year range, the address; the other non-blank lines are filters."""
    text = F.col("content")
    query = r'("[^"]+"(?:\s+OR\s+"[^"]+")+)'
    years = r"(?i)year\D{0,20}(\d{4})\s*[-–]\s*(\d{4})"
    url = r"(https?://\S+)"
    none = lambda c: F.nullif(c, F.lit(""))
    rest = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(query) & ~x.rlike(years) & ~x.rlike(url))
    return files.select(
        "path", none(F.regexp_extract(text, query, 1)).alias("query"), F.regexp_extract(text, years, 1).try_cast("int").alias("year_from"),
        F.regexp_extract(text, years, 2).try_cast("int").alias("year_to"), none(F.regexp_extract(text, url, 1)).alias("url"), rest.alias("filters"))


def enrichment_cache(spark: SparkSession, path: str) -> DataFrame:
    """(doi, citation_count, reference_count) of a JSON object by identifier; an unreadable file gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<citation_count:int,reference_count:int>>")
    return raw.select(F.explode(entries).alias("doi", "c")).select(normal_doi(F.col("doi")).alias("doi"), "c.citation_count", "c.reference_count")


def works(df: DataFrame, json: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A provider's work documents as works, yearly citation counts and reference edges without self-loops."""
    schema = "struct<id:string,doi:string,publication_year:int,cited_by_count:int,counts_by_year:array<struct<year:int,cited_by_count:int>>,referenced_works:array<string>>"
    w = df.select(F.from_json(json, schema).alias("w")).where("w.id is not null")
    one = w.select("w.id", normal_doi(F.col("w.doi")).alias("doi"), "w.publication_year", "w.cited_by_count")
    years = w.select("w.id", F.explode("w.counts_by_year").alias("y")).select("id", "y.year", F.col("y.cited_by_count").alias("citations"))
    edges = w.select(F.col("w.id").alias("citing"), F.explode("w.referenced_works").alias("cited")).where("citing <> cited").distinct()
    return one, years, edges


def export_record(fields: Column) -> dict[str, Column]:
    """Columns of an article from the map of a CSV export's row."""
    get = lambda n: F.try_element_at(fields, F.lit(n))
    return {
        "title": get("Document Title"), "authors": listed(get("Authors"), ";"), "year": whole_number(get("Publication Year")), "venue": get("Publication Title"), "abstract": get("Abstract"),
        "keywords": listed(get("Author Keywords"), ";"), "citation_count": whole_number(get("Article Citation Count")), "reference_count": whole_number(get("Reference Count")),
        "online_date": online_date(get("Online Date")), "document_type": get("Document Identifier"), "license": get("License"), "affiliations": get("Author Affiliations"),
    }


def bib_record(fields: Column, separator: str) -> dict[str, Column]:
    """Columns of an article from the map of a BibTeX entry."""
    get = lambda n: F.translate(F.try_element_at(fields, F.lit(n)), "{}", "")
    return {
        "title": get("title"), "authors": listed(F.regexp_replace(get("author"), r"\s+", " "), " and "), "year": whole_number(get("year")), "venue": F.coalesce(get("journal"), get("booktitle")),
        "abstract": get("abstract"), "keywords": listed(get("keywords"), separator), "note": get("note"),
    }
