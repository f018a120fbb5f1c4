"""Queries of operators/text.py: documents as corpus, benchmark passages as queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarryleaf.functions import taxonomies as tx
from quarryleaf.operators import text as op
from quarryleaf.plans.adapters import table
from quarryleaf.registry import SQL, query


def rounded(df, digits, *columns):
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def queries_of(spark, d):
    """All benchmark texts, whole."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def documents(spark, d):
    """Documents with a year, a theme and a citation count."""
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", (2000 + F.col("doc_id") % 25).cast("int").alias("year"), (F.col("n_chars") % 50).alias("citation_count"))


_DOCS = "d AS (SELECT doc_id, text, lang, source, CAST(2000 + doc_id % 25 AS INT) AS year, n_chars % 50 AS citation_count FROM documents)"
_T = r"'[\p{L}\p{N}_]+'"
_BM25 = rf"""q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), {_T})) AS term FROM q) WHERE length(term) > 1 GROUP BY 1, 2),
w AS (SELECT doc_id, regexp_extract_all(lower(text), {_T}) AS ts FROM documents), l AS (SELECT doc_id, greatest(len(ts), 1) AS dl FROM w), s AS (SELECT count(*) AS n, avg(dl) AS adl FROM l),
tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM w) WHERE term IN (SELECT term FROM a) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / adl))), 9) AS score FROM a JOIN df USING (term) JOIN tf USING (term) JOIN l USING (doc_id), s GROUP BY 1, 2),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)"""


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, round(score, 5) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def _(spark, d):
    return rounded(op.bm25(table(spark, d, "documents"), queries_of(spark, d), 20), 5, "score")


_DENSE = "v AS (SELECT vec_id, embedding FROM embeddings), qv AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), dense AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(e, embedding), 6) DESC, vec_id) AS rank FROM qv, v)"


def dense(spark, d, k=50, items=False):
    """The best k vectors of every vector whose id divides by 50, in blocks of both; with items, also of those that share
    their id with a benchmark item."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("id % 50 = 0")
    if items:
        more = table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
        asked = asked.unionByName(rows.where("id % 50 <> 0").join(more, "id", "left_semi").select("id", "embedding"))
    return op.dense_top_k(asked, rows, "id", "embedding", k)


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM dense WHERE rank <= 50")
def _(spark, d):
    return dense(spark, d).select("query_id", "doc_id", "rank")


@query("rrf_fusion", f"""WITH {_BM25}, {_DENSE}, f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.doc_id, y.doc_id) AS doc_id, x.rank AS rank_a, y.rank AS rank_b FROM (SELECT * FROM dense WHERE rank <= 50) x FULL JOIN (SELECT * FROM r WHERE rank <= 50) y ON x.query_id = y.query_id AND x.doc_id = y.doc_id),
g AS (SELECT *, round(coalesce(1.0 / (60 + rank_a), 0) + coalesce(1.0 / (60 + rank_b), 0), 5) AS score FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g)
SELECT query_id, doc_id, CAST(rank_a AS INT) AS rank_a, CAST(rank_b AS INT) AS rank_b, score, CAST(rank AS INT) AS rank FROM h WHERE rank <= 10""")
def _(spark, d):
    return op.fused(dense(spark, d), op.bm25(table(spark, d, "documents"), queries_of(spark, d), 50))


@query("retrieval_quality", f"""WITH {_BM25}, k AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), n AS (SELECT query_id, count(*) AS n FROM k GROUP BY 1),
h AS (SELECT query_id, count(*) FILTER (rank <= 10) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM (SELECT * FROM r WHERE rank <= 20) JOIN k USING (query_id, doc_id) GROUP BY 1),
i AS (SELECT query_id, sum(1 / log2(x + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, least(n, 10) + 1)) AS x FROM n) GROUP BY 1)
SELECT query_id, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / ideal, 0), 6) AS ndcg FROM n JOIN i USING (query_id) LEFT JOIN h USING (query_id)""")
def _(spark, d):
    docs, asked = table(spark, d, "documents"), queries_of(spark, d)
    return rounded(op.ranking_quality(op.bm25(docs, asked, 20), op.containing(docs, asked), 10), 6, "recall", "mrr", "ndcg")


_STOP = ", ".join(f"'{w}'" for w in op.STOP_WORDS)


@query("zipf_law", rf"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), {_T})) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN ({_STOP}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500),
r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM c) SELECT word, n, CAST(rank AS INT) AS rank, round((SELECT -regr_slope(log10(n), log10(rank)) FROM r), 6) AS gamma, round((SELECT regr_r2(log10(n), log10(rank)) FROM r), 6) AS r2, round((SELECT regr_intercept(log10(n), log10(rank)) FROM r), 6) AS intercept, round((SELECT max(n) FROM r) / rank, 6) AS ideal, (SELECT count(DISTINCT word) FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN ({_STOP})) AS vocabulary, (SELECT count(*) FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}')) AS all_words FROM r""")
def _(spark, d):
    return rounded(op.zipf(table(spark, d, "documents")), 6, "gamma", "r2", "intercept", "ideal")


@query("class_tfidf", rf"""WITH {_DOCS}, e AS (SELECT *, CASE WHEN year < 2010 THEN 1 WHEN year < 2018 THEN 2 ELSE 3 END AS epoch FROM d), big AS (SELECT epoch FROM e GROUP BY 1 HAVING count(*) >= 10 AND count(DISTINCT lang) >= 2),
w AS (SELECT epoch, lang, unnest(regexp_extract_all(lower(text), {_T})) AS term FROM e WHERE epoch IN (SELECT epoch FROM big)), tf AS (SELECT epoch, lang, term, count(*) AS tf FROM w WHERE length(term) > 1 AND term NOT IN ({_STOP}) GROUP BY 1, 2, 3),
vo AS (SELECT term FROM tf GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 1500), k AS (SELECT * FROM tf WHERE term IN (SELECT term FROM vo)), a AS (SELECT epoch, sum(tf) / count(DISTINCT lang) AS a FROM k GROUP BY 1),
s AS (SELECT epoch, lang, term, tf * ln(1 + a / sum(tf) OVER (PARTITION BY epoch, term)) AS score FROM k JOIN a USING (epoch)), r AS (SELECT *, row_number() OVER (PARTITION BY epoch, lang ORDER BY round(score, 9) DESC, term) AS rank FROM s)
SELECT epoch, lang, term, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM r WHERE rank <= 5""")
def _(spark, d):
    docs = documents(spark, d).withColumn("epoch", F.when(F.col("year") < 2010, 1).when(F.col("year") < 2018, 2).otherwise(3))
    return rounded(op.class_tfidf(docs, "epoch", "lang"), 4, "score")


@query("theme_labels")
def _(spark, d):
    """Greedy picks over ranked terms; checked in tests against a plain version."""
    return op.theme_labels(table(spark, d, "documents"), "lang", "doc_id", "text")


_KW = "k AS (SELECT DISTINCT doc_id AS id, lower(trim(u)) AS kw FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS u FROM documents) WHERE trim(u) <> ''), top AS (SELECT kw FROM k GROUP BY 1 ORDER BY count(*) DESC, kw LIMIT 50), v AS (SELECT * FROM k WHERE kw IN (SELECT kw FROM top)), c AS (SELECT kw, count(*) AS n FROM v GROUP BY 1), p AS (SELECT a.id, a.kw AS k1, b.kw AS k2 FROM v a JOIN v b ON a.id = b.id AND a.kw < b.kw), n AS (SELECT count(*) AS n FROM documents), z AS (SELECT k1, k2, count(*) AS observed, any_value(x.n * y.n / n.n) AS expected, (count(*) - any_value(x.n * y.n / n.n)) / sqrt(greatest(0.1, any_value(x.n * y.n / n.n * (1 - x.n / n.n) * (1 - y.n / n.n)))) AS z FROM p JOIN c x ON x.kw = k1 JOIN c y ON y.kw = k2, n GROUP BY 1, 2)"


def keyword_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.split("text", "[ \n]", -1).alias("keywords"))


@query("keyword_pair_atypicality", f"WITH {_KW} SELECT k1, k2, observed, round(expected, 6) AS expected, round(z, 6) AS z FROM z")
def _(spark, d):
    return rounded(op.atypical_pairs(keyword_docs(spark, d), "keywords", "doc_id"), 6, "expected", "z")


@query("article_atypicality", f"WITH {_KW} SELECT id, round(min(z), 6) AS low, round(quantile_cont(z, 0.5), 6) AS middle FROM p JOIN z USING (k1, k2) GROUP BY 1")
def _(spark, d):
    return rounded(op.article_atypicality(keyword_docs(spark, d), "keywords", "doc_id"), 6, "low", "middle")


_HITS = f"""{_KW}, m AS (SELECT id, min(z) AS low, quantile_cont(z, 0.5) AS middle FROM p JOIN z USING (k1, k2) GROUP BY 1), q AS (SELECT quantile_cont(CAST(n_chars % 50 AS DOUBLE), 0.95) AS cut FROM documents),
hh AS (SELECT doc_id AS id, coalesce(low, 0) AS low, coalesce(middle, 0) AS middle, coalesce(low, 0) < -0.5 AS atypical, coalesce(middle, 0) > 0 AS conventional, CAST(n_chars % 50 AS DOUBLE) AS citations, n_chars % 50 >= cut AS hit FROM documents LEFT JOIN m ON m.id = doc_id, q)"""


def _hits(spark, d):
    docs = keyword_docs(spark, d).join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 50).alias("cites")), "doc_id")
    return op.atypical_hits(docs, "keywords", "doc_id", "cites")


@query("atypical_hits", f"WITH {_HITS} SELECT id, round(low, 6) AS low, round(middle, 6) AS middle, atypical, conventional, citations, hit FROM hh")
def _(spark, d):
    return rounded(_hits(spark, d), 6, "low", "middle")


@query("atypical_hit_rates", f"WITH {_HITS} SELECT round(100 * coalesce(avg(CASE WHEN atypical AND conventional THEN CAST(hit AS INT) END), 0), 1) AS high_atypical, round(100 * avg(CAST(hit AS INT)), 1) AS baseline FROM hh")
def _(spark, d):
    return op.hit_rates(_hits(spark, d))


#: The test texts hold none of the fixed patterns; these stand for a table of classes on them.
CLASSES = {"A": r"the|ing", "B": r"ung|lich", "C": r"ent", "D": r"license|\bof\b"}
_FLAGS = ", ".join(f"regexp_matches(lower(text), '{p}') AS c{i}" for i, p in enumerate(CLASSES.values()))
_TAX = f"{_DOCS}, f AS (SELECT *, {_FLAGS} FROM d)"


def classes(spark, d):
    return documents(spark, d).withColumn("text", F.lower("text"))


def _each(template: str) -> str:
    return " UNION ALL ".join(template.format(i=i, n=n) for i, n in enumerate(CLASSES))


@query("taxonomy_summary", f"WITH {_TAX} " + _each("SELECT '{n}' AS class, count(*) FILTER (c{i}) AS articles, round(avg(CASE WHEN year >= 2021 THEN 1.0 ELSE 0.0 END) FILTER (c{i}), 6) AS recent_share, round(avg(citation_count) FILTER (c{i}), 6) AS mean_citations FROM f"))
def _(spark, d):
    return rounded(op.taxonomy(classes(spark, d), "text", CLASSES), 6, "recent_share", "mean_citations")


@query("taxonomy_by_year", f"WITH {_TAX} " + _each("SELECT year, '{n}' AS class, count(*) FILTER (c{i}) AS articles FROM f WHERE year >= 2005 GROUP BY 1"))
def _(spark, d):
    return op.taxonomy_by_year(classes(spark, d), "text", CLASSES)


@query("taxonomy_co_occurrence", f"WITH {_TAX} " + " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", count(*) FILTER (c{i} AND c{j}) AS articles FROM f" for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)))
def _(spark, d):
    return op.co_occurrence(classes(spark, d), "text", CLASSES, CLASSES)


@query("taxonomy_coverage", f"WITH {_TAX}, n AS (SELECT CAST(c0 AS INT) + CAST(c1 AS INT) + CAST(c2 AS INT) + CAST(c3 AS INT) AS n FROM f) SELECT count(*) AS population, count(*) FILTER (n > 0) AS classified, count(*) FILTER (n = 0) AS unclassified, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) FILTER (n > 1) AS multi_label FROM n")
def _(spark, d):
    return rounded(op.taxonomy_coverage(classes(spark, d), "text", CLASSES), 6, "coverage")


@query("taxonomy_precision", f"WITH {_TAX}, j AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS class, doc_id, quality = 1 AS truth FROM labels), b AS (SELECT class, truth, CASE WHEN class = 'A' THEN c0 ELSE c1 END AS hit FROM j JOIN f USING (doc_id)), s AS (SELECT class, count(*) FILTER (hit AND truth) AS tp, count(*) FILTER (hit AND NOT truth) AS fp, count(*) FILTER (NOT hit AND truth) AS fn FROM b GROUP BY 1) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s")
def _(spark, d):
    i = F.col("doc_id")
    labels = table(spark, d, "labels").select(F.concat_ws("::", F.when(i % 2 == 0, "A").otherwise("B"), i.cast("string")).alias("subject_id"), F.when(F.col("quality") == 1, "present").otherwise("absent").alias("label"))
    return rounded(op.taxonomy_precision(classes(spark, d), "doc_id", "text", CLASSES, labels), 6, "precision", "recall", "f1")


def _re(pattern: str) -> str:
    """The pattern for DuckDB, whose word boundary knows ASCII letters only."""
    return re.sub(r"\\b(\w+|\(\?:.*\))\\b", r"(?:^|[^\\p{L}\\p{N}_])\1(?:$|[^\\p{L}\\p{N}_])", pattern)


#: The invented texts hold hardly any class's words: each is given two of these phrases by a rule, which between them stand
#: for every class of every table.
PHRASES = (
    "a pareto front", "genetic algorithm", "particle swarm", "a milp", "deep learning", "ant colony", "stochastic programming", "robust optimization", "socp model", "33-bus feeder", "69-bus feeder",
    "real-world grid", "brazilian grid", "123-bus feeder", "photovoltaic", "battery storage", "v2g", "reconfiguration", "investment", "saidi", "power loss", "voltage profile", "carbon emission", "resilience",
    "monte carlo", "worst-case", "fuzzy sets", "wasserstein", "chance constraint", "deterministic", "demand uncertainty", "multistage", "representative days", "snapshot", "gams", "matlab", "cplex", "digsilent",
    "gurobi", "opendss", "pyomo", "pscad", "linear programming", "second-order cone", "minlp", "simulated annealing", "reinforcement learning",
)
#: Concepts whose phrase is given to every twelfth text, and to more of some years for the first three.
CONCEPTS = ("electric vehicles", "neural networks", "bess", "hosting capacity", "extreme weather", "convex relaxation", "islanding", "adn", "blockchain", "digital twin", "box uncertainty", "soft open points")
_N = len(PHRASES)
_LISTED = "[" + ", ".join(f"'{x}'" for x in PHRASES) + "]"
_PLANTED = f"pl AS (SELECT doc_id, lower(text) || ' ' || ({_LISTED})[1 + CAST(doc_id % {_N} AS INT)] || ' ' || ({_LISTED})[1 + CAST((doc_id * 7 + 3) % {_N} AS INT)] AS text, CAST(2000 + doc_id % 25 AS INT) AS year, n_chars % 50 AS citation_count FROM documents)"


def planted(spark, d):
    docs, i, words = documents(spark, d), F.col("doc_id"), F.array(*(F.lit(x) for x in PHRASES))
    phrase = lambda n: F.get(words, (n % _N).cast("int"))
    return docs.withColumn("text", F.concat_ws(" ", F.lower("text"), phrase(i), phrase(i * 7 + 3)))


def _fixed(name: str, patterns: dict):
    """A query of one fixed pattern table, and its SQL."""
    sql = " UNION ALL ".join(f"SELECT '{n}' AS class, count(*) FILTER (regexp_matches(text, '{_re(p)}')) AS articles FROM pl" for n, p in patterns.items())
    sql = f"WITH {_PLANTED} {sql}"

    @query(name, sql)
    def _(spark, d):
        return op.taxonomy(planted(spark, d), "text", patterns).select("class", "articles")


for _name, _patterns in (
    ("optimization_methods", tx.OPTIMIZATION_METHODS), ("benchmark_feeders", tx.BENCHMARK_FEEDERS), ("objective_functions", tx.OBJECTIVES), ("uncertainty_paradigms", tx.UNCERTAINTY_PARADIGMS),
    ("planning_horizons", tx.PLANNING_HORIZONS), ("computational_solvers", tx.SOLVERS), ("complexity_spectrum", tx.COMPLEXITY_CLASSES),
):
    _fixed(_name, _patterns)


_OBJ = f"{_PLANTED}, ob AS (SELECT doc_id, year, " + " + ".join(f"CAST(regexp_matches(text, '{_re(p)}') AS INT)" for p in tx.OBJECTIVES.values()) + " AS n FROM pl)"


@query("objectives_together", f"WITH {_OBJ}, c AS (SELECT count(*) FILTER (n >= 1) AS classified, count(*) FILTER (n >= 2) AS several FROM ob) SELECT classified, several, round(coalesce(100.0 * several / nullif(classified, 0), 0), 6) AS percent FROM c")
def _(spark, d):
    return rounded(op.multi_label(planted(spark, d), "text", tx.OBJECTIVES), 6, "percent")


@query("objectives_together_by_year", f"WITH {_OBJ}, c AS (SELECT year, count(*) FILTER (n = 1) AS one, count(*) FILTER (n >= 2) AS several FROM ob WHERE n >= 1 AND year BETWEEN 2005 AND 2026 GROUP BY 1) SELECT *, round(100.0 * several / (one + several), 1) AS percent FROM c")
def _(spark, d):
    return op.multi_label_by_year(planted(spark, d), "text", tx.OBJECTIVES)


@query("taxonomy_subjects", f"WITH {_PLANTED}, c AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS class FROM pl WHERE regexp_matches(text, '{_re(p)}')" for n, p in tx.OPTIMIZATION_METHODS.items()) + "), u AS (SELECT * FROM c UNION ALL SELECT doc_id, 'unclassified' FROM pl WHERE doc_id NOT IN (SELECT doc_id FROM c)) SELECT class, doc_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(doc_id || '|3'), doc_id) AS r FROM u) WHERE r <= 12")
def _(spark, d):
    return op.class_subjects(planted(spark, d), "doc_id", "text", tx.OPTIMIZATION_METHODS, seed=3)


@query("feeder_resources", f"WITH {_PLANTED} " + " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", count(*) FILTER (regexp_matches(text, '{_re(p)}') AND regexp_matches(text, '{_re(q)}')) AS articles FROM pl" for a, p in tx.BENCHMARK_FEEDERS.items() for b, q in tx.FEEDER_RESOURCES.items()))
def _(spark, d):
    return op.co_occurrence(planted(spark, d), "text", tx.BENCHMARK_FEEDERS, tx.FEEDER_RESOURCES)


@query("uncertainty_resources", f"WITH {_PLANTED} " + " UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", count(*) FILTER (regexp_matches(text, '{_re(p)}') AND regexp_matches(text, '{_re(q)}')) AS articles FROM pl" for a, p in tx.UNCERTAINTY_PARADIGMS.items() for b, q in tx.UNCERTAINTY_RESOURCES.items()))
def _(spark, d):
    return op.co_occurrence(planted(spark, d), "text", tx.UNCERTAINTY_PARADIGMS, tx.UNCERTAINTY_RESOURCES)


@query("solver_ecosystems", f"WITH {_PLANTED}, s(class, ecosystem, articles) AS (" + " UNION ALL ".join(f"SELECT '{n}', '{tx.SOLVER_ECOSYSTEMS[n]}', count(*) FILTER (regexp_matches(text, '{p}')) FROM pl" for n, p in tx.SOLVERS.items()) + ") SELECT ecosystem, CAST(sum(articles) AS BIGINT) AS articles FROM s GROUP BY 1")
def _(spark, d):
    of = F.create_map(*(F.lit(x) for pair in tx.SOLVER_ECOSYSTEMS.items() for x in pair))
    return op.taxonomy(planted(spark, d), "text", tx.SOLVERS).groupBy(of[F.col("class")].alias("ecosystem")).agg(F.sum("articles").alias("articles"))


_RFIND = "CASE WHEN contains(w, {m}) THEN length(w) - strpos(reverse(w), reverse({m})) - length({m}) + 1 ELSE -1 END"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("text_chunks", f"""WITH RECURSIVE b AS (SELECT doc_id, trim(text, {_BLANK}) AS t FROM documents WHERE trim(text, {_BLANK}) <> ''),
c AS (SELECT doc_id, 0 AS seq, 0 AS start, NULL::VARCHAR AS piece, FALSE AS done FROM b UNION ALL
SELECT doc_id, seq + 1, greatest(stop - 200, start + 1), trim(substr(t, start + 1, stop - start), {_BLANK}), stop >= length(t) FROM
(SELECT doc_id, seq, start, t, CASE WHEN start + 1500 >= length(t) THEN length(t) WHEN p >= 750 THEN start + p + 1 WHEN s >= 750 THEN start + s + 1 ELSE start + 1500 END AS stop FROM
(SELECT c.doc_id, seq, start, t, {_RFIND.format(m="chr(10) || chr(10)")} AS p, {_RFIND.format(m="'. '")} AS s FROM (SELECT c.*, b.t, substr(b.t, c.start + 1, 1500) AS w FROM c JOIN b USING (doc_id) WHERE NOT done) c)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INT) AS seq, piece AS text, CAST(length(piece) AS INT) AS char_len FROM c WHERE piece <> ''""")
def _(spark, d):
    return op.chunked(table(spark, d, "documents"), "doc_id", "text")


_BURST = "[" + ", ".join(f"'{x}'" for x in CONCEPTS) + "]"
_CONCEPTS = f"cd AS (SELECT doc_id, lower(text) || ' ' || ({_BURST})[1 + CAST(doc_id // 25 % 12 AS INT)] || CASE WHEN doc_id % 25 BETWEEN 14 AND 17 THEN ' ' || ({_BURST})[1 + CAST(doc_id // 25 % 3 AS INT)] ELSE '' END AS text, CAST(2000 + doc_id % 25 AS INT) AS year FROM documents)"


def concept_years(spark, d):
    """(class, year, hits, total) of the twelve concepts over texts with their phrases."""
    docs, i, words = documents(spark, d), F.col("doc_id"), F.array(*(F.lit(x) for x in CONCEPTS))
    phrase = lambda n: F.get(words, (F.floor(i / 25) % n).cast("int"))
    text = F.concat_ws(" ", F.lower("text"), phrase(12), F.when((i % 25).between(14, 17), phrase(3)))
    docs = docs.withColumn("text", text)
    yearly = op.taxonomy_by_year(docs, "text", tx.FRONTIERS, low=2000).withColumnRenamed("articles", "hits")
    return yearly.join(docs.groupBy("year").agg(F.count("*").alias("total")), "year")


_COST = "-(k * ln(greatest(least({p}, 1 - 1e-12), 1e-12)) + (n - k) * ln(1 - greatest(least({p}, 1 - 1e-12), 1e-12)))"


@query("concept_bursts", f"WITH RECURSIVE {_CONCEPTS}, h AS (" + " UNION ALL ".join(f"SELECT '{n}' AS concept, year, count(*) FILTER (regexp_matches(text, '{_re(p)}')) AS k, count(*) AS n FROM cd GROUP BY 2" for n, p in tx.FRONTIERS.items()) + f"""),
y AS (SELECT *, CAST(row_number() OVER (PARTITION BY concept ORDER BY year) - 1 AS INT) AS i FROM h), p AS (SELECT concept, base, least(greatest(base * 2, base + 1e-9), 1 - 1e-9) AS high, ln(greatest(trials, 2)) AS up FROM (SELECT concept, sum(k) / sum(n) AS base, sum(n) AS trials FROM y GROUP BY 1 HAVING sum(k) >= 6)),
z AS (SELECT y.*, up, {_COST.format(p="base")} AS low_cost, {_COST.format(p="high")} AS high_cost FROM y JOIN p USING (concept)),
f AS (SELECT concept, i, low_cost AS c0, up + high_cost AS c1, 0 AS b0, 0 AS b1 FROM z WHERE i = 0 UNION ALL
SELECT z.concept, z.i, least(c0, c1) + low_cost, least(c0 + up, c1) + high_cost, CASE WHEN c0 <= c1 THEN 0 ELSE 1 END, CASE WHEN c0 + up <= c1 THEN 0 ELSE 1 END FROM f JOIN z ON z.concept = f.concept AND z.i = f.i + 1),
s AS (SELECT concept, i, CASE WHEN c0 <= c1 THEN 0 ELSE 1 END AS s FROM f WHERE i = (SELECT max(i) FROM y) UNION ALL SELECT s.concept, s.i - 1, CASE WHEN s.s = 0 THEN b0 ELSE b1 END FROM s JOIN f ON f.concept = s.concept AND f.i = s.i WHERE s.i > 0),
r AS (SELECT z.*, i - row_number() OVER (PARTITION BY concept ORDER BY i) AS run FROM s JOIN z USING (concept, i) WHERE s = 1)
SELECT concept, CAST(min(year) AS INT) AS "first", CAST(arg_min(year, (-k, year)) AS INT) AS peak, CAST(max(year) AS INT) AS "last", CAST(count(*) AS INT) AS years, round(greatest(sum(low_cost - high_cost), 0), 2) AS intensity, max(i) = (SELECT max(i) FROM y) AS active, CAST(sum(k) AS BIGINT) AS articles FROM r GROUP BY concept, run""")
def _(spark, d):
    return op.bursts(concept_years(spark, d))


@query("literal_search", "SELECT doc_id, md5(text) AS digest FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20")
def _(spark, d):
    return op.literal_search(table(spark, d, "documents"), "text", "License", 20, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
