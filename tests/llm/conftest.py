import random

import pytest


@pytest.fixture
def odd_docs(spark):
    """Null and empty texts, null ids, ties, repeated rows, one long text, and columns whose names clash with inner ones."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "x", 5), (2, None, "y", 6), (3, "", "y", 7), (4, " \t\n", "z", 8), (5, "alpha beta gamma delta epsilon zeta", "x", 9),
        (5, "alpha beta gamma delta epsilon zeta", "x", 9), (None, "alpha  beta gamma delta epsilon zeta", None, None), (None, None, None, None), (6, "one", "n", 1), (7, "ONE", "n", 1),
        (8, " ".join(f"w{i}" for i in range(60_000)), "long", 2), (9, "é ü ß   日本語 \U0001f600", "u", 3),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, rows string, n long")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, rows string, n long")


def sentences(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"v{rng.randrange(vocabulary)}" for _ in range(n))
