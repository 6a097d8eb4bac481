import time

import pytest
from pyspark.sql import functions as F

from panelforge.llm import urlfilter as U
from panelforge.llm.components import connected_components

SCHEMA = "page_id long, url string, html string, host string"


def page(i, url, html=""):
    return (i, url, html, "clash")


def judge(spark, rows, **settings):
    return {r["page_id"]: r for r in U.url_verdicts(spark.createDataFrame(rows, SCHEMA), **settings).collect()}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.COM/en/1?x=/de/#y", "a.example.com", "/en/1", "com/en/", "block"), ("http://example.com/en/77", "example.com", "/en/77", "example.com/en/7", "allow"), ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"), ("http://m.example.net/de/81", "m.example.net", "/de/81", "example.net/de/8", "block"), ("http://x.org/es", "x.org", "/es", None, "allow"), ("http://x.org/ES/", "x.org", "/ES/", None, "allow"),
        ("http://x.org?q=/es/", "x.org", "", None, "allow"), ("x.org/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("://org/es/1", "org", "/es/1", "org/es/", "block"), ("a://b.org#://c/es/", "b.org", "", None, "allow"), ("", "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = judge(spark, [page(1, url, None)])[1]
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_decisions_spread_to_aliases(spark):
    rows = [
        page(1, "http://a.test/1", '<link rel="canonical" href="http://b.test/1">'), page(2, "http://b.test/1", "<meta http-equiv='refresh' content='0; URL=http://x.org/es/9'>"),
        page(3, "https://c.test/", "<LINK href=//b.test/1 REL=canonical>"), page(4, "http://c.test/#top"), page(5, "http://d.test/", '<link rel="stylesheet" href="http://x.org/es/9">'),
        page(6, "http://x.net/de/1", '<link rel="canonical" href="http://b.test/1">'), page(7, "http://e.test/dir/p", '<link rel="canonical" href="../up">'), page(8, "http://f.test/", '<link rel="canonical" href="/q?a=1&amp;b=2">'), page(9, "http://f.test/q?a=1&b=2", '<link rel=canonical href="http://x.com/en/3">'),
    ]
    got = {k: (r["rule"], r["verdict"]) for k, r in judge(spark, rows).items()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: ("net/de/", "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "block")}


def test_links_that_readers_do_not_see(spark):
    bad = '<link rel="canonical" href="http://x.org/es/1">'
    rows = [page(1, "http://a.test/1", f"<!-- {bad} -->"), page(2, "http://a.test/2", f"<script>var x = '{bad}'</script>"), page(3, "http://a.test/3", f"<!-- a --><head>{bad}</head>"), page(4, "http://a.test/4", f"<noscript>{bad}</noscript>")]
    assert {k: r["verdict"] for k, r in judge(spark, rows).items()} == {1: "allow", 2: "allow", 3: "block", 4: "allow"}


def test_dot_segments_and_empty_paths_are_one_page(spark):
    rows = [page(1, "http://a.test/x/y/p", '<link rel=canonical href="../z">'), page(2, "http://a.test/x/z", '<link rel=canonical href="http://b.test">'), page(3, "http://b.test/", '<link rel=canonical href="./../es/../q/.">'), page(4, "http://b.test/q/", '<link rel=canonical href="http://y.org/./es/1">')]
    assert {r["verdict"] for r in judge(spark, rows).values()} == {"block"}


def test_long_pages_hosts_and_equal_rules(spark):
    long_host = "a" * 50_000 + ".org"
    rows = [page(1, f"http://{long_host}/es/" + "p" * 50_000, "x" * 200_000 + '<link rel=canonical href="http://q.test/">'), page(None, "http://q.test/", None)]
    got = judge(spark, rows)
    assert got[1]["host"] == long_host and got[1]["verdict"] == "block" and got[None]["verdict"] == "block"
    rules = (("block", "a.b", "/c"), ("allow", "b", "/c/d"), ("allow", "a.b", "/c"))
    assert judge(spark, [page(1, "http://a.b/c/d")], rules=rules)[1]["rule"] == "a.b/c"


def test_given_redirects(spark):
    moves = spark.createDataFrame([("http://a.test/", "http://b.test/"), ("http://b.test/", "http://x.com/en/"), (None, "http://x.com/en/")], "from_url string, to_url string")
    assert judge(spark, [page(1, "http://a.test/"), page(2, "http://z.test/")], redirects=moves)[1]["verdict"] == "block"


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([page(1, "http://x.org/es/1"), page(1, "http://x.org/es/1")], SCHEMA)
    assert [r["verdict"] for r in U.url_verdicts(df).collect()] == ["block", "block"]
    assert U.url_verdicts(df.limit(0)).count() == 0


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "repeats", "empty"])
def test_components(spark, kind):
    import random

    rng = random.Random(5)
    edges = {
        "chain": [(i, i + 1) for i in range(120)], "star": [(500, i) for i in range(300)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], "repeats": [(2, 1), (1, 2), (2, 2), (None, 3), (4, 3), (4, 3)], "empty": [],
    }[kind]
    df = spark.createDataFrame(edges, "u long, v long")
    got = [(r["node"], r["root"]) for r in connected_components(df).collect()]
    assert len(got) == len(dict(got))
    assert dict(got) == brute(edges)


def test_main_path_has_no_python(spark, data, capsys):
    from panelforge.llm import queries

    queries.op8_url_verdicts(spark, data).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("piece", ["<link rel=canonical ", "<meta http-equiv=refresh ", "<script ", "<!-- ", "<style>--", "rel = ", "</script ", "<link rel=", "<!-->", "\t"])
def test_unclosed_tags_take_linear_time(spark, piece):
    """Pages of ten megabytes of one opening, before and behind a link; a cubic or quadratic pattern doesn't end here."""
    size = 10_000_000 // len(piece)
    html = [piece * size + "<link rel=canonical href=http://b.test/>", "<link rel=canonical href=http://b.test/>" + piece * size, "canonical" + piece * size]
    pages = spark.createDataFrame([(i, f"http://a.test/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(1)
    started = time.monotonic()
    links = U.html_links(pages).collect()
    assert time.monotonic() - started < 20
    assert ("a.test/1", "b.test/") in {(r["u"], r["v"]) for r in links}


def test_what_is_shown(spark):
    cases = {"a<!-- x -->b<!-- c": "a b<!-- c", "<script>x</script>y<script>z": " y<script>z", "<!--a--><!--b-->c": "  c", "none": "none", "": "", "<style a></script >t": " t"}
    df = spark.createDataFrame([(k,) for k in cases], "html string").select("html", U.shown(F.col("html")).alias("s"))
    assert {r["html"]: r["s"] for r in df.collect()} == cases
