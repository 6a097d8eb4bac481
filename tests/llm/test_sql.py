"""The SQL of this part's queries against the queries, on the smallest tables and on pages that do have links."""

import glob
import os
import random

import duckdb
import pytest

from panelforge.llm import queries


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, data)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, found.fetchall())


def linked_pages(n=300):
    rng = random.Random(6)
    hosts = ["a.test", "B.test", "www.example.com", "x.net", "m.example.net", "y.org", "z.com"]
    url = lambda: f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/de/', '/es/', '/p/'])}{rng.choice(['', '7', '8', '../q', 'a/./b'])}{rng.choice(['', '?k=1', '#t'])}"
    relative = lambda: rng.choice(["up", "../up", "/en/9", "//y.org/es/3", "?k=2", "", "./here", "/es/.."])
    out = []
    for i in range(n):
        link = url() if rng.random() < 0.6 else relative()
        tag = rng.choice([f'<link rel="canonical" href="{link}">', f"<LINK href='{link}' REL=canonical>", f"<meta http-equiv='refresh' content='0; URL={link}'>", f"<!-- <link rel=canonical href={url()}> -->", f"<script>'<link rel=canonical href={url()}>'</script>", ""])
        out.append((i, rng.choice([url(), url(), url(), None, "no scheme"]), f"<html><head>{tag}</head></html>" if rng.random() < 0.95 else None))
    return out


@pytest.mark.parametrize("n", [300, 40, 0])
def test_verdicts_on_linked_pages_equal_their_sql(spark, tmp_path, n):
    df = spark.createDataFrame(linked_pages(n), "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["op8_url_verdicts"])
    names = [d[0] for d in found.description]
    got = queries.op8_url_verdicts(spark, str(tmp_path))
    rows = got.collect()
    assert rows_of(got.columns, rows) == rows_of(names, found.fetchall())
    if n == 300:
        assert any(r["verdict"] == "block" and r["rule"] is None for r in rows)
