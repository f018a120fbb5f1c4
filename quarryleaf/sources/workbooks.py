"""Tables of classified venues from spreadsheet files, read by executors from the file's own parts (zipped XML)."""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def header_key(value: object) -> str:
    """A header for comparison: without accents, folded, letters and digits only."""
    text = "".join(c for c in unicodedata.normalize("NFKD", str(value)) if not unicodedata.combining(c))
    return "".join(c for c in text.casefold() if c.isalnum())


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(content: bytes, wanted: Sequence[str] = ()) -> Iterator[list[str | None]]:
    """Rows of a workbook's sheet as text, cells by their column: the first sheet whose name (as a header) is wanted, else
    the first of all. Empty for what is no workbook."""
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
        sheets = [(s.get("name") or "", s.get(f"{_REL}id")) for s in listed]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        keys = {header_key(w) for w in wanted}
        chosen = next((i for n, i in sheets if header_key(n) in keys), sheets[0][1])
        path = targets[chosen].lstrip("/")
        part = book.open(path if path.startswith("xl/") else f"xl/{path}")
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError):
        return
    for _, row in ElementTree.iterparse(part):
        if row.tag != f"{_MAIN}row":
            continue
        cells: list[str | None] = []
        for cell in row.iter(f"{_MAIN}c"):
            at = _column(cell.get("r") or "") if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
            if kind == "inlineStr":
                cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif v is not None:
                cells[at] = shared[int(v.text)] if kind == "s" else v.text
        yield cells
        row.clear()


def venue_reference(spark: SparkSession, path: str, area: str, sheets: Sequence[str] = ("RelatorioQualis",), headers: Sequence[str] = ("issn", "titulo", "estrato"), area_header: str = "areadeavaliacao") -> DataFrame:
    """The three columns of classified venues in the workbooks at a path, of one area where a column names it; headers are
    compared without case, accents and spaces. A workbook without one of them gives no rows."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for content in pdf["content"]:
                rows = sheet_rows(bytes(content), sheets)
                places = {header_key(h): i for i, h in reversed(list(enumerate(next(rows, [])))) if h}
                if any(h not in places for h in headers):
                    continue
                in_area = places.get(area_header)
                get = lambda row, i: row[i] if i is not None and i < len(row) else None
                found = [[get(r, places[h]) for h in headers] for r in rows if in_area is None or (get(r, in_area) or "").strip() == area]
                yield pd.DataFrame(found, columns=list(headers))

    raw = spark.read.format("binaryFile").load(path).select("content")
    return raw.mapInPandas(run, ", ".join(f"{h} string" for h in headers))


def cached_reference(spark: SparkSession, path: str, area: str, folder: str) -> DataFrame:
    """The same through a Parquet table in a shared folder, named by the workbook's time and size and the area: a new
    workbook has another name, so that an old table is never read for it; a table that can't be read is made anew."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").orderBy("path").collect()  # a few workbooks
    key = hashlib.sha256(repr([(f.path, str(f.modificationTime), f.length) for f in files] + [area]).encode()).hexdigest()[:16]
    table = f"{folder.rstrip('/')}/reference-{key}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        venue_reference(spark, path, area).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)
