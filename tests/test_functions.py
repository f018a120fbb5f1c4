import datetime

from pyspark.sql import functions as F

from quarryleaf.functions import names
from quarryleaf.functions.categories import classify, preferred


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("v")).first()["v"]


def test_identifiers(spark):
    for raw, want in (("https://doi.org/10.1/ABC", "10.1/abc"), (" http://dx.doi.org/10.1/x ", "10.1/x"), ("10.1/Y", "10.1/y"), ("  ", None), (None, None)):
        assert one(spark, names.normal_doi(F.col("x")), x=raw) == want
    assert one(spark, names.ordered_pair(F.col("a"), F.col("b")), a="10.1/B", b="https://doi.org/10.1/a") == ("10.1/a", "10.1/b")
    assert one(spark, names.ordered_pair(F.col("a"), F.col("b")), a="10.1/B", b="10.1/b") is None


def test_author_keys(spark):
    for raw, want in (("Silva, João P.", "j silva"), ("João Silva", "j silva"), ("da Silva, J.", "j da silva"), ("J. da Silva", "j silva"), ("Müller", "muller"), (".A. Chen.", "a chen")):
        assert one(spark, names.author_key(F.col("x")), x=raw) == want


def test_lists_numbers_dates(spark):
    assert one(spark, names.listed(F.col("x"), " and "), x="{A} B and  and C, D") == ["A B", "C, D"]
    assert one(spark, names.listed(F.col("x"), ";"), x=None) == []
    assert one(spark, names.countries(F.col("x")), x="Dep, Uni, Brazil; X, Chile; Y, n/a; Z, Brazil; ") == ["Brazil", "Chile"]
    for raw, want in (("12.0", 12), ("x", None), (None, None), ("7", 7)):
        assert one(spark, names.whole_number(F.col("x")), x=raw) == want
    assert one(spark, names.online_date(F.col("x")), x=" 5 Mar 2021 ") == datetime.date(2021, 3, 5)
    assert one(spark, names.online_date(F.col("x")), x="2021") is None
    for raw, want in (("1949", None), ("2020", 2020), ("2021", 2021), ("2022", None), ("9999", None), ("not a year", None), (None, None)):
        assert one(spark, names.valid_year(F.col("x"), 1950, 2021), x=raw) == want
    assert one(spark, names.plausible_year(F.col("x")), x="in press (2019), 3000") == 2019


def test_texts(spark):
    assert one(spark, names.normal_title(F.col("x")), x="  A  Título: B-2!") == "a t tulo b 2"
    assert one(spark, names.abstract_text(F.col("t"), F.col("k"), F.col("a")), t="T", k=["x", "y"], a="") == "T\n\nKeywords: x, y"
    assert one(spark, names.preview(F.col("x"), 5), x="ab  cd ef") == "ab cd…"
    assert one(spark, names.short_id(F.col("x")), x="https://x.org/W12/") == "W12"
    assert one(spark, names.non_article(F.col("r"), F.col("a")), r="inbook", a="short") is True


def test_categories(spark):
    rules = [
        (("article", "A survey of grids", "J", None, None), ("review", "title_review")), (("article", "X", "J", "Review article", None), ("review", "review_metadata")),
        (("inproceedings", "X", "J", None, None), ("conference", "conference_record_type")), (("article", "X", "2020 Symposium on Y", None, None), ("conference", "conference_venue_metadata")),
        (("article", "X", "Letters", None, None), ("journal", "journal_record_type")), (("misc", "X", "Letters", None, "early access"), ("journal", "journal_metadata")), (("misc", None, None, None, None), ("other", "other_record_type")),
    ]
    rows = spark.createDataFrame([r for r, _ in rules], "k string, t string, v string, d string, n string")
    got = rows.select(classify(*(F.col(c) for c in "ktvdn")).alias("c")).collect()
    assert [tuple(r.c) for r in got] == [w for _, w in rules]
    frame = spark.createDataFrame([(1, "journal", "journal_metadata"), (1, "conference", "conference_venue_metadata"), (1, "conference", "conference_record_type"), (2, None, None)], "g int, c string, b string")
    best = {r.g: tuple(r.p) for r in frame.groupBy("g").agg(preferred(F.col("c"), F.col("b")).alias("p")).collect()}
    assert best == {1: ("conference", "conference_record_type"), 2: ("other", "other_record_type")}
