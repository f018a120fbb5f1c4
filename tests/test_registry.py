import os
import re

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = sorted(n for n in SQL if not re.match(r"op\d+_|pipeline$", n))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return None
        if isinstance(v, float):
            return round(v, 4) + 0.0
        if hasattr(v, "isoformat"):
            return str(v)
        if isinstance(v, bool) or str(type(v)).find("bool") >= 0:
            return bool(v)
        return int(v) if hasattr(v, "__int__") and not isinstance(v, str) else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns == ["year", "F", "O", "total"]


def test_library_does_not_need_the_training_subpackage():
    """Nothing outside it imports it."""
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "quarryleaf"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "quarryleaf.llm" not in file.read_text(), file
