"""Queries against their SQL on the smallest tables, and the contract of the entry file."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list:
    def cell(x):
        if hasattr(x, "tolist") and hasattr(x, "__len__"):
            return str(list(x))
        return None if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)

    return sorted(tuple(str(cell(x)) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).columns == ["repo", "root", "id", "depth", "confidence"]


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("p") or k[1].isdigit() is False or k[1] in "1234"))
def test_against_sql(spark, db, name):
    got, want = entry.queries()[name](spark, D).toPandas(), db.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    if name == "p2_descendants":
        got["members"] = got["members"].map(lambda m: "\n".join(sorted(m.split("\n"))))
        want["members"] = want["members"].map(lambda m: "\n".join(sorted(m.split("\n"))))
    assert plain(got) == plain(want)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_llm():
    top = os.path.join(os.path.dirname(entry.__file__), "weftline")
    for at, _, files in os.walk(top):
        for f in files:
            if f.endswith(".py") and os.path.relpath(at, top).split(os.sep)[0] != "llm":
                assert "weftline.llm" not in open(os.path.join(at, f)).read(), f
