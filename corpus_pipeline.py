"""Training-corpus pipeline: quality, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns what it keeps, with the columns of
`documents`; the last returns the pieces of packed sequences. The tables of labels and benchmark items come from sf_dir.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarryleaf.llm import quality
from quarryleaf.llm.common import written
from quarryleaf.llm.decontaminate import drop_contaminated
from quarryleaf.llm.exact_dedup import drop_exact_duplicates
from quarryleaf.llm.jaccard_join import drop_near_duplicates
from quarryleaf.llm.packing import pack


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of labels.quality accepts."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that differ in white space only."""
    return drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return drop_near_duplicates(docs, shingle=5, num=8, den=10)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, up to one word edit in five."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("pack", pack_sequences),
]

#: SQL can't express a trained classifier, edit distance to any window or online packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
