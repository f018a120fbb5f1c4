"""Registered queries take whole tables."""

import random

import pytest

import __spark_entry__
from quarryleaf.operators import evaluation, graphs, joins, statistics, text, vectors
from quarryleaf.plans import graphs as graph_plans

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


@pytest.fixture
def light_edges(spark, monkeypatch):
    """Four authors with one article of all and one of two: no pair reaches twelve articles."""
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)], "doi long, author long")
    monkeypatch.setattr(graph_plans, "author_rows", lambda s, d: rows)


def test_graphs_of_light_edges(spark, light_edges):
    ranks = {r.node: r.rank for r in QUERIES["graph_pagerank"](spark, "").collect()}
    assert set(ranks) == {1, 2, 3, 4} and abs(sum(ranks.values()) - 1) < 1e-6 and ranks[1] > ranks[3]
    assert {(r.node, r.degree, r.strength) for r in QUERIES["graph_degrees"](spark, "").collect()} == {(1, 3, 4), (2, 3, 4), (3, 3, 3), (4, 3, 3)}
    assert QUERIES["graph_density"](spark, "").first().edges == 6
    assert {tuple(r) for r in QUERIES["graph_triangles"](spark, "").collect()} == {(1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)}
    assert {r.clustering for r in QUERIES["graph_clustering"](spark, "").collect()} == {1.0}


def test_best_matches_against_every_name(spark):
    """First letters differ in the first pairs; others are edited at random."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    names = ["catherine", "christopher", "ab", ""] + [" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(80)]
    asked = ["katherine", "kristopher", "", "xb"]
    for text in names[4:44]:
        edited = list(text)
        for _ in range(rng.randint(0, 3)):
            edited[rng.randrange(len(edited))] = rng.choice("abcde")
        asked.append("".join(edited))
    q, n = (spark.createDataFrame([(x,) for x in rows], "x string") for rows in (asked, names))
    for least in (85.0, 60.0):
        got = {r.query: (r.name, r.score) for r in joins.best_matches(q, n, "x", "x", least, block=16).collect()}
        plain = lambda t: " ".join(sorted(t.split()))
        for x in asked:
            score, name = min((-joins.indel_ratio(plain(x), plain(y)), y) for y in names)
            assert got[x] == ((name, -score) if -score >= least else (None, None)), x
    assert got["katherine"][0] == "catherine" and got["kristopher"][0] == "christopher"


def test_all_queries_of_searches(spark):
    """Every vector whose id divides by 50, and every benchmark item, is answered."""
    v, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("embeddings", "benchmark"))
    ids, items = ({r[0] for r in df.select(c).where(f"{c} is not null").collect()} for df, c in ((v, "vec_id"), (b, "item_id")))
    due = {i for i in ids if i % 50 == 0}
    assert {r.query_id for r in QUERIES["dense_topk"](spark, SF).collect()} == due
    got = QUERIES["hybrid_topk"](spark, SF).collect()
    assert {r.query_id for r in got} == due | items and {r.query_id for r in got if r.rank_a} == due | items & ids


def test_dense_blocks(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    got = {(r.query_id, r.rank): r.doc_id for r in text.dense_top_k(df.where("id % 3 = 0"), df, "id", "v", 5, block=16).collect()}
    want = {}
    for i, x in rows[::3]:
        best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for j, y in rows)[:5]
        want.update({(i, k + 1): j for k, (_, j) in enumerate(best)})
    assert got == want


def test_adjusted_p_values_of_all_rows(spark, tmp_path):
    """250 rows, 50 of them beyond the id that the query of the SQL stops at."""
    spark.range(1, 251).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    p = sorted((i * 7919 % 1000 / 1000 * ((i % 50 + 1) / 50), i) for i in range(1, 251))
    want, least = {}, 1.0
    for rank, (x, i) in reversed(list(enumerate(p, 1))):
        least = min(least, x * len(p) / rank)
        want[i] = least
    assert {r.k: r.p_adjusted for r in QUERIES["adjusted_p_values"](spark, str(tmp_path)).collect()} == pytest.approx(want, abs=1e-8)


def test_repetitions_are_the_defaults(spark, light_edges, monkeypatch):
    """The queries give the operators no numbers of repetitions of their own."""
    for module, name, plan in ((statistics, "heavy_tails", "heavy_tails"), (graphs, "graph_report", "graph_report"), (evaluation, "theme_stability", "theme_stability")):
        monkeypatch.setattr(module, name, lambda *args, **named: named)
        assert not {"draws", "simulations"} & set(QUERIES[plan](spark, SF)), plan


def test_trustworthiness_of_many_rows(spark):
    """More than 5000 rows, in several blocks; their projection is themselves, and the ranks of pairs are those of all."""
    df = spark.range(5100).selectExpr("id", "array(cast(cos(id) as float), cast(sin(id) as float), cast(id % 7 as float)) AS v")
    assert evaluation.trustworthiness(df, "id", "v", "v", 3).first()[0] == 1
    few = df.where("id < 60")
    full = vectors.neighbours(few, "id", "v", 60).select("id", "other", "rank")
    got = {(r.id, r.other): r.r for r in evaluation.ranks(few, "id", "v", full.select("id", "other")).collect()}
    assert got == {(r.id, r.other): r.rank for r in full.collect()}
