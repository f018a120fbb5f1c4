"""Text of portable documents, read by executors from the file's own objects: pages in order, text in the order it is
shown. Simple fonts are read as Latin-1, or by the font's own table to Unicode; what can't be read gives an empty text."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOWN = re.compile(rb"/(\S+)\s+[\d.+-]+\s+Tf|\[((?:[^\[\]()<>]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)*)\]\s*TJ|(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|Td|TD|BT|Tm)", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    data = found.group(1)
    return zlib.decompressobj().decompress(data) if b"FlateDecode" in body[: found.start()] else data


def _raw(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    out = re.sub(rb"\\(?:([0-7]{1,3})|\r?\n|(.))", lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPE.get(m[2], m[2]) if m[2] else b"", token[1:-1], flags=re.S)
    return out


def _to_unicode(table: bytes) -> dict[int, str]:
    """Codes of a font's table: single ones and ranges."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                out[int(a, 16) + k] = text(f"{int(c, 16) + k:0{len(c)}x}".encode())
    return out


def _read(raw: bytes, table: dict[int, str] | None) -> str:
    if not table:
        return raw.decode("latin-1")
    wide = max(table) > 255
    codes = [int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2)] if wide else list(raw)
    return "".join(table.get(c, "" if wide else chr(c)) for c in codes)


def page_texts(content: bytes) -> list[str]:
    """The text of each page, in the order of the page tree; raises where the file is no such document."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(content)}
    for body in list(objects.values()):  # objects packed in streams
        if b"/ObjStm" in body:
            packed = _inflated(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = [int(x) for x in packed[:first].split()]
            for k in range(0, len(heads) - 1, 2):
                stop = heads[k + 3] if k + 3 < len(heads) else len(packed) - first
                objects.setdefault(heads[k], packed[first + heads[k + 1] : first + stop])
    kind = lambda body, name: re.search(rb"/Type\s*/" + name + rb"\b(?!s)", body)
    root = next(n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b)
    pages: list[bytes] = []
    todo, seen = [root], set()
    while todo:
        n = todo.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        if kind(body, b"Page"):
            pages.append(body)
        else:
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            todo += [int(k) for k in reversed(_REF.findall(kids[1]))] if kids else []
    out = []
    for page in pages:
        where = page
        resources = re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page)
        if resources:
            where = objects.get(int(resources[1]), b"")
        fonts_at = re.search(rb"/Font\s+(\d+)\s+\d+\s+R", where)
        listed = objects.get(int(fonts_at[1]), b"") if fonts_at else (re.search(rb"/Font\s*<<(.*?)>>", where, re.S) or [b"", b""])[1]
        tables: dict[bytes, dict[int, str]] = {}
        for name, n in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", listed):
            to = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", objects.get(int(n), b""))
            tables[name] = _to_unicode(_inflated(objects.get(int(to[1]), b""))) if to else {}
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        stream = b"\n".join(_inflated(objects.get(int(n), b"")) for n in _REF.findall(contents[1])) if contents else b""
        table, said = None, []
        for font, array, one, move in _SHOWN.findall(stream):
            if font:
                table = tables.get(font)
            elif move:
                said.append("\n" if said and not said[-1].endswith("\n") else "")
            elif one:
                said.append(_read(_raw(one), table))
            else:
                for token in _STRING.findall(array):
                    said.append(_read(_raw(token), table) if token[:1] in b"(<" else " " if float(token) < -200 else "")
        out.append("".join(said).strip())
    return out


def portable_text(content: bytes | None) -> str:
    """Pages joined by an empty line, runs of blanks and tabs as one space; empty for anything that can't be read."""
    try:
        text = "\n\n".join(page_texts(bytes(content)))
    except Exception:  # noqa: BLE001 - a damaged or locked file may fail in any way, and counts as one without text
        return ""
    return re.sub(r"[ \t]+", " ", text).strip()


@F.pandas_udf(StringType())
def text_of(content: pd.Series) -> pd.Series:
    return content.map(portable_text)


def portable_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the documents at a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", text_of("content").alias("text"))
