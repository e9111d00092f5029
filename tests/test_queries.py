"""Every query of the catalog against DuckDB on the smoke tables, and the entry point's contract."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
from sievelake.plans import catalog
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(_plain, value)) if isinstance(value, list | tuple) else value


def _rows(rows):
    return sorted((tuple(map(_plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = df.select(columns).collect()
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert _rows(got) == _rows(want.select(", ".join(columns)).fetchall())
    else:
        assert got


def test_entry(spark):
    assert 0 < entry_point.entry(spark).count() <= 10
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_without_the_training_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sievelake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sievelake.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    fresh = importlib.reload(entry_point)
    assert set(fresh.queries()) == set(catalog.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry_point)
