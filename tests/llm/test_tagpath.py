import html as H
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest

from panelforge.llm import queries, tagpath as T

P = "Hello, world. This is long, and it is real text, of an article."
PAGES = [
    (f"<html><head><title>t</title><style>p{{}}</style><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head</h1><p>{P}<p>Two &amp; more,\n  of&nbsp;it.</article><footer>&copy; x. All rights, of course.</footer>", f"Head\n{P}\nTwo & more, of it."),
    (f'<body><div class="cookie-notice"><p>{P}</p></div><div id="content"><h1>T</h1><p>{P}</p><div>Second block, of text. Very.</div><p>Be.</p></div><div class="sidebar"><p>{P}</p></div><section id="comments"><p>{P}</p></section>', f"T\n{P}\nSecond block, of text. Very.\nBe."),
    (f"<body><p>{P}</p><p>{P} Again.</p><form><p>{P}</p><button>Go</button></form><aside><p>{P}</p></aside>", f"{P}\n{P} Again."),
    (f"<main><p>{P}</p></main><div role='complementary'><p>{P} {P}</p></div>", P),
    (f"<article><p><b>{P}<br>next<p>More, text. Here.</article><div class='ad'>{P}</div>", f"{P} next\nMore, text. Here."),
    (f"<div><article><p>Be.</p></article></div><footer>{P} {P}</footer>", "Be."),
    ("plain text, only.", "plain text, only."),
    ("", ""),
    (None, ""),
    ("<nav>menu</nav><footer>foot</footer>", ""),
    (f"<article><p>{P}</p><!-- <p>no</p> --><p>a &lt; b &#233; &unknown;</p><scr", f"{P}\na < b é &unknown;"),
    (f'<article><p title="a > b">{P}</p><div hidden>{P}</div><div style="display: none">{P}</div></article>', P),
    (f'<div class="page has-sidebar"><div class="site-header">Menu, here.</div><div><p>{P}</p></div></div>', P),
    (f'<div class="sidebar-layout sidebar"><article><p>{P}</p></article></div><div class="comments"><article class="comment"><p>{P}</p></article></div>', P),
    (f"<article><header><h1>Title</h1></header><p>{P}</p></article>", f"Title\n{P}"),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_templates(spark, html, want):
    df = spark.createDataFrame([(1, "u", html, "x")], "page_id long, url string, html string, text string")
    r = T.extract_main(df).first()
    assert r["text"] == want
    assert r["n_chars"] == len(want)


def article(page):
    """The blocks of the page's article, by plain patterns."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div)>", inner)]
    return "\n".join(x for x in parts if x)


def test_pages_keep_exactly_their_article(spark, data):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = queries.op4_main_text(spark, data).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == article(rows[r["page_id"]])


def anonymous(page, rng):
    """The page with containers that tell nothing, and with a notice, a long menu of links, and reader comments that may hold more text than the article."""
    pool = article(page).split()[:300]
    some = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    box = lambda body: f'<div class="x{rng.randrange(10**6)}">{body}</div>'
    comments, most = "", min(6000, len(article(page)) * rng.choice([0.3, 1, 2]))
    while len(comments) < most:
        comments += box(f"<div>{some(2)}</div><p>{some(rng.randint(3, 14))}</p>")
    links = "".join(f"<li><a href=/x>{some(8)}</a></li>" for _ in range(30))
    page = page.replace("</article>", "</article>" + box(comments) + box(f"<ul>{links}</ul><p>{some(8)}.</p>"), 1)
    page = page.replace("<nav>", box("<p>We use cookies, and so on. Accept them, please.</p>") + "<nav>", 1).replace('<div class="ad">', "<div>")
    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", page)


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


def right(pages):
    rng = random.Random(1)
    return sum(T.main_text(anonymous(p, rng)) == article(p) for p in pages) / len(pages)


def test_anonymous_containers(pages):
    assert right(pages) >= 0.95


@pytest.mark.parametrize(("noise", "most"), [(lambda real, g: g.permutation(real), 0.2), (lambda real, g: g.random(len(real)), 0.7), (lambda real, g: np.ones(len(real)), 0.85)])
def test_ratios_decide(pages, monkeypatch, noise, most):
    """With noise in the place of the ratios, or the amount of text alone, the same pages fail."""
    g, real = np.random.default_rng(1), T.path_scores
    monkeypatch.setattr(T, "path_scores", lambda page, fair: noise(real(page, fair), g))
    assert right(pages) < most


class Plain(HTMLParser):
    """Blocks of well-formed pages: (elements from the root, as (tag, number) pairs, text)."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.elements, self.blocks = [], [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, len(self.elements)))
        self.elements.append([t for t, _ in self.stack])

    def handle_endtag(self, tag):
        assert self.stack.pop()[0] == tag

    def handle_data(self, text):
        if text.strip():
            self.blocks.append((list(self.stack), text))


def brute_scores(page):
    seen = Plain(page)
    tags = lambda stack: [t for t, _ in stack]
    stops = lambda text: sum(c in ".,;:!?" for c in text)
    group = lambda stack: (stack[:-1], stack[-1][0])
    kin = [[t for s, t in seen.blocks if group(s) == group(stack)] for stack, _ in seen.blocks]
    own = [(sum(map(len, ts)) / len(ts), sum(map(stops, ts)) / len(ts)) for ts in kin]
    out = []
    for i, (stack, _) in enumerate(seen.blocks):
        nodes = sum(e == tags(stack) for e in seen.elements)
        same = [t for s, t in seen.blocks if tags(s) == tags(stack)]
        ratio = []
        for k, measure in enumerate((len, stops)):
            near = [(math.exp(-0.5 * (j - i) ** 2), own[j][k]) for j in range(len(own)) if abs(i - j) <= 2]
            ratio.append((sum(map(measure, same)) / nodes + own[i][k] + sum(w * v for w, v in near) / sum(w for w, _ in near)) / 3)
        headed = any(s[:-1] == stack[:-1] and s[-1][0] == "h1" for s, _ in seen.blocks) and stack[-2][0] != "body"
        out.append(math.log1p(ratio[0]) * math.log1p(ratio[1]) * (1.5 if headed else 1))
    return out


def test_scores_equal_a_plain_version():
    rng = random.Random(2)
    for _ in range(30):
        body = ""
        for _ in range(rng.randint(2, 5)):
            head = "<h1>A, b</h1>" if rng.random() < 0.5 else ""
            body += f"<div>{head}" + "".join(f"<{t}>{'word, ' * rng.randint(1, 9)}end.</{t}>" for t in rng.choices(["p", "li", "div"], k=rng.randint(1, 4))) + "<p></p></div>"
        page = f"<html><body>{body}</body></html>"
        seen = T.read(page)
        assert T.path_scores(seen, list(range(len(seen.text)))) == pytest.approx(brute_scores(page))


def test_ties_go_to_the_first():
    part = f"<div><h2>T</h2><p>{P}</p></div>"
    assert T.main_text(f"<body>{part}{part}</body>").startswith(f"T\n{P}")
    assert T.main_text(f"<article><p>{P} One.</p></article><article><p>{P} Two.</p></article>") == f"{P} One."


def test_names_weigh_but_ratios_may_outweigh_them():
    assert T.main_text(f'<body><div class="x"><h1>H</h1><p>{P}</p><p>{P}</p></div><div class="related"><p>{P}</p></div></body>') == f"H\n{P}\n{P}"
    assert T.main_text(f'<body><div class="notice"><h1>H</h1>{f"<p>{P}</p>" * 20}</div><div>Short.</div></body>') == "H\n" + "\n".join([P] * 20)


def test_rows_and_columns(spark):
    page = f"<article><p>{P}</p></article>"
    df = spark.createDataFrame([(None, None, page, "a", 1), (1, "u", page, "b", 2), (1, "u", page, "c", 3), (2, "v", f"<article><p>{'word, ' * 200_000}</p></article>", "d", 4)], "page_id long, url string, html string, text string, n_chars int")
    rows = sorted(T.extract_main(df).collect(), key=lambda r: (r["page_id"] or 0, r["url"] or ""))
    assert [r["text"] for r in rows[:3]] == [P] * 3 and (rows[0]["page_id"], rows[0]["url"]) == (None, None)
    assert rows[3]["n_chars"] == len("word, ") * 200_000 - 1


def test_long_and_deep_pages():
    assert T.main_text("<div>" * 3000 + P + "</div>" * 3000) == P
    assert T.main_text(f"<p>{'word, ' * 200_000}</p>") == ("word, " * 200_000).strip()
    assert T.main_text("<p a='" + "x" * 100_000) == ""
    assert T.main_text("<div>" * 60_000 + P + "</section>" * 60_000) == P


def test_paths_are_scored_by_length_and_punctuation():
    seen = T.read(f"<body><ul><li>one<li>two<li>three</ul><div><p>{P}</p><p>{P}</p></div>")
    scores = dict(zip([seen.tag[v] for v in seen.node], T.path_scores(seen, list(range(len(seen.node)))), strict=True))
    assert scores["p"] > scores["li"]


def test_empty_table(spark):
    assert T.extract_main(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
