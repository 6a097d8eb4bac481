"""Every query of the library against its SQL, on the smallest tables."""

import glob
import importlib
import math
import os
import sys

import duckdb
import pytest

from panelforge.plans import registry


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return str(v) if type(v).__name__ in ("Decimal", "date", "datetime") else v


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sql, data, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted_rows(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = sql.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted_rows(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def test_entry_and_queries_without_the_optional_part(monkeypatch):
    """The optional subpackage may be missing: the entry points still import and list the rest."""
    for name in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or m.startswith("panelforge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "panelforge.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES)
    assert set(entry.oracle_sql()) == set(registry.ORACLE_SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_scans_are_pruned_and_pushed_down(spark, data, capsys):
    registry.QUERIES["sc_pruned_scan"](spark, data).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[1]


def test_totals_are_joined_after_aggregation(spark, data, capsys):
    registry.QUERIES["jn2_left_join"](spark, data).explain()
    plan = capsys.readouterr().out
    assert plan.index("Join") < plan.rindex("HashAggregate")
    assert "CartesianProduct" not in plan
