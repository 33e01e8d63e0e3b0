"""Queries against their SQL on the smallest tables, and the driver's entry points."""

from __future__ import annotations

import importlib
import sys

import duckdb
import pytest

from latticeworks import queries as reference

SF = "/root/testdata/sf0.001"
FAST = [n for n in reference.SQL if n not in ("fill_volume", "events_components", "keep_components", "describe_components", "volume2")]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in ("lineitem", "events", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, sql, name):
    df = reference.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    found = sql.execute(reference.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["gi", "gj", "gk"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "latticeworks.llm", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(reference.QUERIES) and set(entry.oracle_sql()) == set(reference.SQL)
    monkeypatch.undo()
    importlib.reload(entry)
