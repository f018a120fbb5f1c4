from pyspark.sql import functions as F

from quarryleaf.operators import citations, counts, readers, windows


def test_price_interval_holds_the_index(spark):
    rows = [(d, 2010, y) for d in range(40) for y in [2009, 2007, 2000, 1990 + d % 10]] + [(99, 2010, None)] * 3 + [(98, 2010, 2015)]
    refs = spark.createDataFrame(rows, "doi long, year int, reference_year int")
    point = windows.price_index(refs).first()
    ci = citations.price_interval(refs, draws=200).first()
    assert point.works == 40 and ci.low <= point.price <= ci.high and citations.price_interval(refs.limit(8)).count() == 0


def test_sleeping_beauty_and_half_life(spark):
    late = [0] * 10 + [1, 2, 30]
    early = [20] + [1] * 12
    rows = [(d, 2000, 2000 + t, c) for d, s in ((1, late), (2, early)) for t, c in enumerate(s) if c]
    rows += [(2, 2000, 1999, 5), (3, 2000, 2005, 2)]
    series = windows.citation_series(spark.createDataFrame(rows, "doi long, publication_year int, year int, citations long"), 2012)
    b = {r.doi: r for r in windows.sleeping_beauties(series).collect()}
    assert b[1].peak == 12 and b[1].awakening == 11 and b[1].beauty > 50 and (b[2].peak, b[2].beauty, b[2].awakening) == (0, 0.0, None) and 3 not in b
    h = {r.doi: r.half_life for r in windows.half_lives(series).collect()}
    assert h == {1: 12, 2: 0}
    assert series.where("doi = 2 and t = 0").first().c == 25


def test_bradford_advances_one_zone_a_venue(spark):
    counts_ = spark.createDataFrame([("a", 60), ("b", 20), ("c", 10), ("d", 10)], "v string, n long")
    assert [(r.zone, r.venues, r.articles) for r in windows.bradford_zones(counts_, "v", "n").orderBy("zone").collect()] == [(1, 1, 60), (2, 1, 20), (3, 2, 20)]


def test_empty_frames(spark):
    none = spark.createDataFrame([], "doi long, year int, source string, citation_count double, venue string")
    assert counts.source_counts_by(none, "year", ["a"]).count() == 0 and counts.domain_totals(none, "source", ["a"]).where("n = 0").count() == 2
    assert windows.gini(none, "citation_count").first().gini == 0 and windows.cumulative_by_source(none, "year", ["a"]).count() == 0
    assert readers.population(none, ["doi", "title"]).first().missing == ["title"]


def test_filters_keep_unknown_margins(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, -0.5)], "doi long, relevance_margin double")
    assert {r.doi for r in readers.filtered(df, least_margin=0.0).collect()} == {1, 2}
    good = df.withColumn("doi", F.col("doi").cast("string"))
    assert readers.first_usable([("gold", good.limit(0)), ("silver", good.unionByName(good)), ("bronze", good)], ["doi"]) == ("bronze", ["gold: empty", "silver: 3 repeated keys"])
