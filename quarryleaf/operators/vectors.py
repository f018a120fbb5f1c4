"""Vector operators: cosine retrieval, near duplicates, novelty, centroids, drift, projections and themes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryleaf.operators.text import top_k

#: Vectors of one block of a blocked product: its size bounds what a task holds.
BLOCK = 2048


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in double precision; null where a norm is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def relevance(df: DataFrame, vector: str, anchor: Sequence[float], into: str = "relevance") -> DataFrame:
    """Cosine of each row's vector with one anchor."""
    return df.withColumn(into, cosine(F.col(vector), literal(anchor)))


def nearest(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """(id, score, rank): exact cosine top k of one query (ties: smaller id); zero vectors come last, unranked."""
    from pyspark.sql.window import Window

    scored = df.select(F.col(id_col), F.round(cosine(F.col(vector), literal(query)), 9).alias("score")).where("score is not null")
    best = scored.orderBy(F.desc("score"), id_col).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), id_col)))


def _blocks(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows with a block number: as many blocks as BLOCK rows fill, by a hash of the id."""
    n = df.select(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).alias("n"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return rows.join(F.broadcast(n)).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))  # n: one row


def _unit(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    m = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return pdf["id"].to_numpy(), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def similar_pairs(df: DataFrame, id_col: str, vector: str, least: float) -> DataFrame:
    """(a, b, similarity) with a < b and cosine of `least` or more: blocks of vectors meet once each, and each meeting
    is one matrix product. Rows with a null vector are left out."""
    rows = _blocks(df, id_col, vector)
    pairs = rows.select("id", "v", "block", "n").withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = pairs.select("id", "v", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block")

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left, right = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        (a, x), (b, y) = _unit(left), _unit(right)
        s = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        p, q = np.nonzero(s >= least)
        keep = a[p] < b[q] if i == j else np.ones(len(p), dtype=bool)
        lo, hi = np.minimum(a[p], b[q])[keep], np.maximum(a[p], b[q])[keep]
        return pd.DataFrame({"a": lo, "b": hi, "similarity": s[p, q][keep]})

    return cells.groupBy("i", "j").applyInPandas(meet, "a long, b long, similarity double")


def neighbours(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(id, other, similarity, rank): the exact k nearest of each vector by cosine, itself left out (ties: smaller id).
    Each meeting of two blocks gives the k best of each side; the best of those are merged."""
    rows = _blocks(df, id_col, vector)
    cells = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("id", "v", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block")

    def best(ids: np.ndarray, others: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        s = np.where(ids[:, None] == others[None, :], -np.inf, np.round(s, 9))
        order = np.lexsort((np.broadcast_to(others, s.shape), -s), axis=1)[:, :k]
        out = pd.DataFrame({"id": np.repeat(ids, order.shape[1]), "other": others[order].reshape(-1), "similarity": np.take_along_axis(s, order, axis=1).reshape(-1)})
        return out[np.isfinite(out["similarity"])]

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        (a, x), (b, y) = _unit(pdf[pdf["block"] == i]), _unit(pdf[pdf["block"] == j])
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "similarity": []})
        s = x @ y.T
        return best(a, b, s) if i == j else pd.concat([best(a, b, s), best(b, a, s.T)])

    near = cells.groupBy("i", "j").applyInPandas(meet, "id long, other long, similarity double")
    return top_k(near, "id", "similarity", "other", k)


def novelty(df: DataFrame, id_col: str, vector: str, k: int = 10) -> DataFrame:
    """(id, novelty): mean cosine distance to the k nearest others."""
    return neighbours(df, id_col, vector, k).groupBy("id").agg(F.avg(1 - F.col("similarity")).alias("novelty"))


def centroids(df: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """(group, n, centroid): mean vector of each group, aggregated element by element."""
    means = F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(size)))
    return df.groupBy(group).agg(F.count("*").alias("n"), means.alias("centroid"))


def drift(points: DataFrame, group: str, year: str, windows: Sequence[tuple[int, int]], x: str = "x", y: str = "y") -> DataFrame:
    """(group, first, last, n, x, y): centroid of each group's points within each window of years."""
    spans = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in windows))
    rows = points.withColumn("w", F.explode(F.filter(spans, lambda s: F.col(year).between(s["first"], s["last"]))))
    return rows.groupBy(group, F.col("w.first").alias("first"), F.col("w.last").alias("last")).agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


def reduced(df: DataFrame, vector: str, k: int, into: str = "reduced") -> DataFrame:
    """The first k principal components of unit-length, centred vectors, as an array."""
    base = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    unit = Normalizer(inputCol="_v", outputCol="_u").transform(base)
    centred = StandardScaler(inputCol="_u", outputCol="_c", withMean=True, withStd=False).fit(unit).transform(unit)
    out = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return out.withColumn(into, vector_to_array("_p")).drop("_v", "_u", "_c", "_p")


def theme_sweep(df: DataFrame, vector: str, ks: Sequence[int] = range(4, 13), seed: int = 42, least_share: float = 0.02) -> list[dict]:
    """For each k: Euclidean-squared silhouette, smallest cluster's share, and whether that is below `least_share`."""
    base = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))).cache()
    out = []
    for k in ks:
        got = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="theme").fit(base).transform(base)
        sizes = got.groupBy("theme").count().agg(F.min("count").alias("lo"), F.sum("count").alias("all")).first()
        score = ClusteringEvaluator(featuresCol="_v", predictionCol="theme").evaluate(got)
        out.append({"k": k, "silhouette": score, "smallest": sizes["lo"] / sizes["all"], "rejected": sizes["lo"] / sizes["all"] < least_share})
    base.unpersist()
    return out


def best_k(sweep: Sequence[dict], near: float = 0.005, fallback: int = 4) -> int:
    """The smallest k whose silhouette is within `near` of the best among those not rejected."""
    fine = [s for s in sweep if not s["rejected"]]
    if not fine:
        return fallback
    top = max(s["silhouette"] for s in fine)
    return min(s["k"] for s in fine if s["silhouette"] >= top - near)


def themes(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    base = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="theme").fit(base).transform(base).drop("_v")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, ari: chance-corrected agreement of two partitions, from the counts of their cells."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    c = cells.agg(F.sum(pairs("n")).alias("c"), F.sum("n").alias("all"))
    x = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("x"))
    y = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("y"))
    one = c.join(x).join(y)  # one row each
    expected = F.col("x") * F.col("y") / (F.col("all") * (F.col("all") - 1) / 2)
    return one.select(F.coalesce(F.try_divide(F.col("c") - expected, (F.col("x") + F.col("y")) / 2 - expected), F.lit(1.0)).alias("ari"))


def knn_overlap(df: DataFrame, id_col: str, vector: str, projection: str, k: int) -> DataFrame:
    """One row, overlap: the share of each row's k nearest vectors that are among its k nearest projections."""
    a = neighbours(df, id_col, vector, k).groupBy("id").agg(F.collect_set("other").alias("a"))
    b = neighbours(df, id_col, projection, k).groupBy("id").agg(F.collect_set("other").alias("b"))
    return a.join(b, "id").agg(F.avg(F.size(F.array_intersect("a", "b")) / F.lit(k)).alias("overlap"))


def parsed_vectors(df: DataFrame, column: str, into: str = "embedding") -> DataFrame:
    """Little-endian float32 bytes as arrays; null or ragged bytes give null."""

    def run(it):
        for batch in it:
            raw = batch.column(batch.schema.get_field_index(column)).to_pylist()
            vectors = [np.frombuffer(x, "<f4") if x and len(x) % 4 == 0 else None for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, into])

    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(into, ArrayType(FloatType()))]))
