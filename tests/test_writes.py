"""Curation, provider crawl, run control, readers of workbooks and portable documents."""

import hashlib
import io
import json
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarryleaf.operators import curation, provider, reviews, runs
from quarryleaf.sources import portable, workbooks
from quarryleaf.sources import provider as web

AT = datetime(2026, 1, 2)


def decisions(spark, rows):
    return spark.createDataFrame(rows, curation.DECISION)


def test_decisions_are_validated(spark):
    works = spark.createDataFrame([(f"10.1/{c}",) for c in "abcd"], "doi string")
    queue = spark.createDataFrame([("10.1/a", "10.1/b"), ("10.1/c", "10.1/b")], "a string, b string")
    none = decisions(spark, [])
    one = curation.record_decision(spark, none, queue, works, "merge", "10.1/B", "https://doi.org/10.1/a", " same work ", "10.1/a")
    assert [tuple(r) for r in one.collect()] == [("10.1/a", "10.1/b", "merge", "10.1/a", "same work")]
    for call, problem in (
        (("drop", "10.1/a", "10.1/b", "x", None), "unknown decision"), (("keep", "10.1/a", "10.1/b", " ", None), "no reason"), (("keep", "10.1/a", "10.1/z", "x", None), "unknown work"),
        (("keep", "10.1/a", "10.1/d", "x", None), "not in the queue"), (("merge", "10.1/a", "10.1/b", "x", "10.1/c"), "outside the pair"),
        (("merge", "10.1/b", "10.1/c", "x", "10.1/c"), "two canonical"), (("merge", "10.1/b", "10.1/c", "x", "10.1/b"), "chain"),
    ):
        with pytest.raises(ValueError, match=problem):
            curation.record_decision(spark, one, queue, works, *call[:4], call[4])
    kept = curation.record_decision(spark, one, queue, works, "keep", "10.1/a", "10.1/b", "no", "10.1/a")
    assert [tuple(r) for r in kept.collect()] == [("10.1/a", "10.1/b", "keep", None, "no")]
    assert curation.without_decisions(kept, spark.createDataFrame([("10.1/B", "10.1/A")], "a string, b string")).count() == 0


def test_upsert_and_protocols(spark):
    table = spark.createDataFrame([("s", 1, "old", 5), ("s", 2, "stays", 6)], "source string, id int, title string, n int")
    new = spark.createDataFrame([("s", 1, "first", 1), ("s", 1, "last", 2), ("t", 1, "new", 1), (None, 9, "lost", 1)], "source string, id int, title string, at int")
    assert sorted(tuple(r) for r in curation.upsert(table, new, ["source", "id"], ["at"]).collect()) == [("s", 1, "last", 5), ("s", 2, "stays", 6), ("t", 1, "new", None)]
    empty = spark.createDataFrame([], "workflow string, protocol_version string, instructions string, instructions_sha256 string")
    asked = spark.createDataFrame([("pdf", "1", "read"), ("pdf", "1", "read"), ("pdf", "2", "a"), ("pdf", "2", "b"), ("no", "1", "x")], "workflow string, protocol_version string, instructions string")
    good, bad = curation.protocols(empty, asked)
    assert [r.protocol_version for r in good.collect()] == ["1"] and bad.count() == 3
    changed = spark.createDataFrame([("pdf", "1", "other")], "workflow string, protocol_version string, instructions string")
    assert curation.protocols(good, changed)[1].count() == 1


def test_content_digest_is_of_rows_alone(spark):
    rows = [(i % 40, f"t{i}", i) for i in range(500)]
    frame = spark.createDataFrame(rows, "a int, b string, c int")
    one = curation.content_digest(frame.repartition(7), ["a", "b"]).first().digest
    assert one == curation.content_digest(frame.orderBy(F.desc("c")).coalesce(1), ["a", "b"]).first().digest
    assert one != curation.content_digest(frame.limit(499), ["a", "b"]).first().digest and len(one) == 64
    chunks = spark.createDataFrame([("x", "abstract", 0, "t")], "doi string, chunk_type string, seq int, text string")
    articles = spark.createDataFrame([("x",)], "doi string")
    version = curation.adopted(articles, chunks)
    assert version == curation.adopted(articles, chunks) != curation.adopted(articles, chunks.withColumn("text", F.lit("u")))
    assert curation.adopted(articles.limit(0), chunks) is None


def test_retrieval_fails_only_as_a_whole(spark):
    def retrieve(text, depth):
        if text == "bad":
            raise OSError("down")
        return ["x", "y", "z"]

    found, failed = curation.retrieval_pool(spark, retrieve, [("q1", "good"), ("q2", "bad")], 2)
    assert [tuple(r) for r in found.collect()] == [("q1", "x", 1), ("q1", "y", 2)] and failed == {"q2": "OSError: down"}
    with pytest.raises(RuntimeError, match="every retrieval query"):
        curation.retrieval_pool(spark, retrieve, [("q2", "bad")])


def test_waits():
    r = lambda v: web.Response(429, headers={"Retry-After": v} if v is not None else {})
    assert web.backoff_seconds(r("7"), 5) == 7 and web.backoff_seconds(r("900"), 0) == 60 and web.backoff_seconds(r(None), 1) == 2 and web.backoff_seconds(r(None), 9) == 8
    assert web.backoff_seconds(r("Wed, 21 Oct 2026 07:28:00 GMT"), 2) == 4
    assert web.retrying_is_futile(r("61")) and not web.retrying_is_futile(r("60")) and not web.retrying_is_futile(r(None))


def scripted(*answers):
    """A web that gives these answers in turn, and what it was asked."""
    asked, left = [], list(answers)

    def get(url, params):
        asked.append((url, params))
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return get, asked


def test_observations():
    slept = []
    R = web.Response
    get, _ = scripted(R(429), OSError("reset"), R(200, {"id": "W1", "cited_by_count": 3, "referenced_works": ["a", "b"]}))
    got = web.observation(" HTTPS://doi.org/10.1/X ", get, "u", slept.append)
    assert (got["doi"], got["status"], got["retry_count"], got["citation_count"], got["reference_count"]) == ("10.1/x", "success", 2, 3, 2) and slept == [1, 2]
    assert got["response_sha256"] == hashlib.sha256(got["payload"].encode()).hexdigest()
    cases = [((R(404),), "not_found"), ((R(403),), "error"), ((R(429, headers={"retry-after": "9999"}),), "rate_limited"), ((R(500),) * 4, "error"), ((OSError("x"),) * 4, "error")]
    for answers, status in cases:
        assert web.observation("10.1/x", scripted(*answers)[0], "u", lambda s: None)["status"] == status
    assert web.observation("  ", scripted()[0], "u")["status"] == "invalid_doi"


def test_pages_and_citing_works():
    R = web.Response
    page = lambda items, cursor, n=3: R(200, {"meta": {"count": n, "next_cursor": cursor}, "results": items})
    item = lambda i, *refs: {"id": f"https://o/{i}", "referenced_works": [f"https://o/{r}" for r in refs]}
    get, asked = scripted(page([item("W9", "W1", "W2"), item("W8", "W2")], "c2"), page([item("W1", "W1", "W2")], None))
    got = web.citing(["https://o/w1", "https://o/W2"], get, "u")
    assert got["https://o/w1"]["citing"] == ["https://o/W9"] and got["https://o/W2"]["citing"] == ["https://o/W9", "https://o/W8", "https://o/W1"]
    assert not got["https://o/W2"]["truncated"] and asked[0][1]["filter"] == "cites:W1|W2" and asked[1][1]["cursor"] == "c2"
    cut = web.citing(["W1"], scripted(page([item("W9", "W1")], "more", 5))[0], "u", most=1)
    assert cut["W1"]["truncated"] and not cut["W1"]["throttled"]
    refused = web.citing(["W1"], scripted(R(429, headers={"retry-after": "999"}))[0], "u", sleep=lambda s: None)
    assert refused["W1"]["throttled"] and refused["W1"]["truncated"] and refused["W1"]["error"] is None
    assert web.citing(["W1"], scripted(R(400))[0], "u")["W1"]["error"] == "HTTP 400" and web.citing([], None, "u") == {}


def registry(items):
    """A registry that holds these items by identifier."""
    def get(url, params):
        asked = [x.removeprefix("doi:") for x in params["filter"].split(",")]
        return web.Response(200, {"message": {"items": [items[d] for d in asked if d in items]}})

    return get


def test_collection_is_resumable(spark):
    items = {
        "10.1/a": {"DOI": "10.1/A", "reference": [{"DOI": "10.9/X", "year": "2001a"}, {"DOI": "10.9/Y"}, {"year": "in press"}, {"DOI": "10.1/B"}], "issued": {"date-parts": [[2010, 3]]}},
        "10.1/c": {"DOI": "10.1/c", "issued": {"date-parts": [[None]]}}, "10.9/y": {"DOI": "10.9/y", "issued": {"date-parts": [[1999]]}},
    }
    corpus = spark.createDataFrame([("10.1/A",), ("10.1/b",), ("10.1/c",), ("10.1/d",), (None,), ("10.1/e,f",)], "doi string")
    lists = spark.createDataFrame([("10.1/d",)], "doi string")
    refs = spark.createDataFrame([], "doi string, position int, reference_doi string, year int, observed_at timestamp_ntz")
    years = spark.createDataFrame([("10.9/z",)], "doi string")
    new, stats = provider.collect_references(corpus, lists, refs, years, registry(items), "u", AT, lambda s: None)
    assert {(r.doi, r.status, r.deposited) for r in new["lists"].collect()} == {("10.1/a", "success", 4), ("10.1/b", "not_found", 0), ("10.1/c", "success", 0)}
    assert {(r.position, r.reference_doi, r.year) for r in new["references"].collect()} == {(0, "10.9/x", 2001), (1, "10.9/y", None), (2, None, None), (3, "10.1/b", None)}
    assert [(r.doi, r.year, r.status) for r in new["years"].collect()] == [("10.9/y", 1999, "success")] and stats["lists"]["stopped"] is None
    again, _ = provider.collect_references(corpus, lists.unionByName(new["lists"].select("doi")), new["references"], years.unionByName(new["years"].select("doi")), registry(items), "u", AT, lambda s: None)
    assert all(df.count() == 0 for df in again.values())
    down = lambda url, params: web.Response(429, headers={"retry-after": "999"})
    none, stats = provider.collect_references(corpus, lists, refs, years, down, "u", AT, lambda s: None)
    assert all(df.count() == 0 for df in none.values()) and stats["lists"]["refused"] == 4


def test_edges_are_refreshed(spark):
    works = spark.createDataFrame([("W1", "10.1/a", None), ("W2", None, None), ("W3", "10.1/c", AT)], "work_id string, doi string, citing_crawled_at timestamp_ntz")
    body = {"meta": {"count": 2}, "results": [{"id": "W7", "referenced_works": ["W1", "W2", "W3"]}, {"id": "W2", "referenced_works": ["W2", "W1"]}]}
    edges, crawled, stats = provider.refresh_edges(works, lambda url, params: web.Response(200, body), "u", AT, lambda s: None)
    assert {(r.citing_work_id, r.cited_work_id) for r in edges.collect()} == {("W7", "W1"), ("W7", "W2"), ("W2", "W1")}
    assert {r.work_id: r.citing_truncated for r in crawled.collect()} == {"W1": False, "W2": False} and stats["kept"] == 2 and stats["truncated"] == 0
    _, crawled, stats = provider.refresh_edges(works, lambda url, params: web.Response(503, headers={"retry-after": "999"}), "u", AT, lambda s: None)
    assert crawled.count() == 0 and stats["refused"] == 2


def test_runs(spark, tmp_path):
    log = []
    out = runs.run_all([("raw", lambda: {"n": 1}), ("bronze", lambda: {"n": 2})], lambda *x: log.append(x[:2]), done=["raw"])
    assert out == {"raw": {"skipped": True}, "bronze": {"n": 2}} and log == [("raw", "skipped"), ("bronze", "running"), ("bronze", "success")]

    def fails():
        raise KeyError("x")

    with pytest.raises(KeyError):
        runs.run_all([("raw", fails), ("bronze", dict)], lambda *x: log.append(x[:2]))
    assert log[-1] == ("raw", "failed")
    lock = f"file://{tmp_path}/lock"
    with runs.single_writer(spark, lock, "one"):
        with pytest.raises(runs.Busy), runs.single_writer(spark, lock, "two"):
            pass
    with runs.single_writer(spark, lock, "three"):
        pass
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1")
    first = runs.code_fingerprint(tmp_path)[1]
    (tmp_path / "src/view.py").write_text("y")
    assert runs.code_fingerprint(tmp_path, ("src/view",))[1] == first != runs.code_fingerprint(tmp_path)[1]
    assert runs.screening_digest("m", "a", "b", 0.1, 0.98) == runs.screening_digest("m", "a", "b", 0.1 + 1e-9, 0.98) != runs.screening_digest("m", "a", "b", 0.1, 0.97)
    with pytest.raises(RuntimeError, match="unknown"):
        runs.expected_revision(None, "r1")
    assert runs.embedded(["a"], lambda t: [[1, 2]]) == [[1.0, 2.0]]
    with pytest.raises(ValueError):
        runs.embedded(["a", "b"], lambda t: [[1.0], [float("nan")]])


def test_semantics_need_every_vector(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "doi string, embedding array<double>")
    rows, stats = runs.dataset_semantics(v.select("doi"), v, [1.0, 0.0], [0.0, 1.0], "v1")
    assert {(r.doi, round(r.relevance_margin, 6)) for r in rows.collect()} == {("a", 1.0), ("b", -0.2)} and stats.first().offtopic == 1
    with pytest.raises(ValueError, match="1 works"):
        runs.dataset_semantics(v.select("doi").unionByName(spark.createDataFrame([("c",)], "doi string")), v, [1.0, 0.0], [0.0, 1.0], "v1")


def test_screening_calibration(spark):
    margins = spark.createDataFrame([(f"10.1/{i}", (i % 50 - 20) / 50 + (0.4 if i % 2 else 0.0)) for i in range(300)], "doi string, margin double")
    labels = spark.createDataFrame([(f"10.1/{i}", r, "yes" if i % 2 else "no") for i in range(300) for r in ("ann", "bob")] + [("10.1/999", "ann", "yes"), ("10.1/1", "cy", "perhaps")], "doi string, reviewer string, label string")
    out = runs.screening_calibration(labels, margins, {"model": "m", "anchor": "a", "off_anchor": "b"}, 0.5)
    assert {r.issue for r in out["issues"].collect()} == {"unknown_doi", "invalid_label"} and out["consensus"].where("resolved").count() == 300
    assert out["metrics"].count() == 6 and len(out["label_set_sha256"]) == len(out["model_sha256"]) == 64
    assert out["label_set_sha256"] == reviews.label_digest(out["usable"]).first().digest


def workbook(rows, sheet="Relatorio Qualis"):
    """A small workbook with shared and inline strings and a number."""
    cells, shared = [], []
    for i, row in enumerate(rows, 1):
        line = ""
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, int):
                line += f'<c r="{at}"><v>{v}</v></c>'
            elif j % 2:
                line += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            else:
                shared.append(v)
                line += f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>'
        cells.append(f'<row r="{i}">{line}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" sheetId="1" r:id="r2"/><sheet name="{sheet}" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/s.xml"/><Relationship Id="r2" Target="/xl/worksheets/t.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/t.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    rows = [["ISSN", "Título", "Área de Avaliação", "Estrato"], ["1-1", "Grid", "ENG", "A1"], ["2-2", "Law", "LAW", "A2"], [None, "Cells", "ENG ", "B1"], [33, "Num", "ENG", None]]
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.xlsx").write_bytes(workbook(rows))
    got = workbooks.venue_reference(spark, f"{tmp_path}/q", "ENG")
    want = {("1-1", "Grid", "A1"), (None, "Cells", "B1"), ("33", "Num", None)}
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["issn", "titulo", "estrato"]
    first = workbooks.cached_reference(spark, f"{tmp_path}/q", "ENG", f"file://{tmp_path}/cache")
    assert {tuple(r) for r in first.collect()} == want and {tuple(r) for r in workbooks.cached_reference(spark, f"{tmp_path}/q", "ENG", f"file://{tmp_path}/cache").collect()} == want
    (tmp_path / "q/a.xlsx").write_bytes(workbook([r[:2] + r[3:] for r in rows[:3]]))  # no column of areas: all rows
    assert workbooks.venue_reference(spark, f"{tmp_path}/q", "ENG").count() == 2
    (tmp_path / "q/a.xlsx").write_bytes(workbook([["ISSN", "x"], ["1", "y"]]))
    assert workbooks.venue_reference(spark, f"{tmp_path}/q", "ENG").count() == 0
    (tmp_path / "q/a.xlsx").write_bytes(b"no workbook")
    assert workbooks.venue_reference(spark, f"{tmp_path}/q", "ENG").count() == 0
    assert workbooks.header_key(" Área de AVALIAÇÃO ") == "areadeavaliacao"


def portable_file(pages, packed=True):
    """A document of these content streams, two fonts, one with a table to Unicode."""
    body = lambda d: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(zlib.compress(d)), zlib.compress(d)) if packed else b"<< /Length %d >>\nstream\n%s\nendstream" % (len(d), d)
    table = b"1 beginbfchar <0001> <00E9> endbfchar 1 beginbfrange <0041> <0043> <0061> endbfrange <0141> <0141>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))), len(pages)),
               3: b"<< /Font << /F1 4 0 R /F2 5 0 R >> >>", 4: b"<< /Type /Font /Subtype /Type1 >>", 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", 6: body(table + b" 1 beginbfchar <0200> <0078> endbfchar")}
    for i, page in enumerate(pages):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources 3 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = body(page)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in sorted(objects.items(), reverse=True))


def test_portable_documents(spark, tmp_path):
    one = b"BT /F1 12 Tf 1 0 0 1 0 0 Tm (Two  \\(words\\)\\t and \\101) Tj 0 -14 Td [(sp) -50 (lit) -300 (gap)] TJ T* /F2 9 Tf <000100410043> Tj ET"
    for packed in (True, False):
        assert portable.portable_text(portable_file([one, b"BT /F1 9 Tf (second) Tj ET"], packed)) == "Two (words) and A\nsplit gap\néac\n\nsecond"
    for bad in (b"", b"%PDF-1.4 nothing", None, portable_file([one])[:200]):
        assert portable.portable_text(bad) == ""
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.pdf").write_bytes(portable_file([one]))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in portable.portable_texts(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].startswith("Two (words)") and got["b.pdf"] == ""


def test_answers_as_tables(spark):
    """A crawl's answers, read as tables, give the same edges as the crawl itself."""
    items = [{"id": "https://o/W9", "referenced_works": ["https://o/W1", "https://o/w2"]}, {"id": "W1", "referenced_works": ["W1", "W2"]}, {"id": None, "referenced_works": ["W1"]}]
    body = {"count": 3, "results": items}
    want = web.citing(["W1", "W2"], lambda url, params: web.Response(200, {"meta": {"count": 3}, "results": items}), "u")
    answers = spark.createDataFrame([(0, json.dumps(body))], "batch int, body string")
    members = spark.createDataFrame([(0, "W1"), (0, "W2")], "batch int, work string")
    assert {(r.cited, r.citing) for r in provider.citing_pairs(answers, members).collect()} == {(w, c) for w, r in want.items() for c in r["citing"]}
    assert not provider.truncated_batches(answers).first().truncated
