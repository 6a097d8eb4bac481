"""HTML main-text extraction by tag-path ratios.

A page is read into blocks (text between block-level tags), each in a node of the page's tree. Text length and punctuation are aggregated per root-to-leaf
tag path (over all nodes of the path) and per group of like siblings; both ratios are smoothed over neighbouring blocks in page order and fused with
the share of text outside links. Names of classes and ids that speak of menus, adverts, notices, comments and the like, an open `article` or `main`, and
copyright lines are weights in that fusion, no verdicts of their own. Groups under half of the best score carry no mass; the content node is found by walking down from the
root as long as one child holds most of the mass. Of the parts inside it, those that score under a share of it go; the rest is the text.
Only tags and attributes whose meaning is fixed by HTML (scripts, `nav`, `form`, `aside`, `hidden`, roles) exclude outright.

Defined cases: null and empty pages give empty text; a page without markup is one block; unclosed tags are closed by their parents, truncated tags and comments
are dropped; `<br>` is white space; of nodes that tie the first in page order is taken; pages of any length and depth are read whole, in time linear in their length; repeated
pages are read each; a null key or url stays null; only key, url and html are read, so other columns don't matter; an empty table gives an empty one.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import batches, utf8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|math|object|canvas|video|audio)\b[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|</?\Z",
    re.S | re.I,
)
#: Elements without content, inline elements, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements and names that mark what is not the article.
APART = frozenset("head title nav footer aside form menu dialog button fieldset legend figcaption-ad".split())
_ROLE = re.compile(r"\b(?:navigation|banner|contentinfo|complementary|search|form|alert|alertdialog|dialog|menu|menubar|toolbar)\b")
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|menus?|nav|navbar|navigation|side|sidebar|rail|footer|foot|header|masthead|topbar|breadcrumbs?|crumbs|cookies?|consent|gdpr|notices?|alert|notification|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|related|recommend\w*|more-stories|popular|trending|comments?|commentlist|discussion|disqus|replies|reply|respond|reviews|feedback|widget|toolbar|pager|pagination|search|searchbox|copyright|legal|disclaimer|paywall|skip|hidden|noprint|outbrain|taboola)(?:$|[\s_-]|\d)",
    re.I,
)
#: Names that tell of a layout (`has-sidebar`), not of the part itself.
_LAYOUT = re.compile(r"(?:^|[_-])(?:has|with|no|without|wrap|wrapper|layout|grid)(?:$|[_-])", re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？·¿¡]")
_MAIN = frozenset(("article", "main"))
#: Elements whose own text stays with the node that holds them; all other block elements are containers.
_TEXTUAL = HEADINGS | frozenset("header hgroup p li ul ol dl dt dd pre blockquote figure figcaption address table thead tbody tfoot tr td th caption hr".split())
_LISTS = frozenset("ul ol dl table".split())
_RIGHTS = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
#: Weights of the fusion, shares of the best score, and shares of the mass.
FAINT, CENTRAL, HEADED, RIGHTS = 0.08, 2.0, 1.5, 0.05
CARRIES, STAYS, LEAF = 0.5, 0.35, 0.12
MOST, ARTICLE = 0.6, 0.25


class Page:
    """The tree of a page's block-level elements (node 0 is the page itself; parents come before their children) and its blocks of text."""

    def __init__(self) -> None:
        self.tag, self.parent, self.path = [""], [0], [0]
        #: Whether a node is excluded outright; whether names speak against it; whether it lies in an article.
        self.barred, self.faint, self.central = [False], [False], [False]
        self.nodes_of_path = Counter((0,))
        self.paths: dict[tuple[int, str], int] = {}
        #: Node, text, and characters inside links of each block.
        self.node: list[int] = []
        self.text: list[str] = []
        self.linked: list[int] = []

    def open(self, tag: str, parent: int, barred: bool, named: bool) -> int:
        path = self.paths.setdefault((self.path[parent], tag), len(self.paths) + 1)
        self.nodes_of_path[path] += 1
        main = tag in _MAIN
        # A whole article counts even in a container of a telling name, for names of wrappers mislead; an article in an article is a comment.
        faint = named or (self.central[parent] and tag == "article" if main else self.faint[parent])
        for column, value in ((self.tag, tag), (self.parent, parent), (self.path, path), (self.barred, barred or self.barred[parent]), (self.faint, faint), (self.central, main or self.central[parent])):
            column.append(value)
        return len(self.tag) - 1


def _marked(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is excluded outright, and whether its names speak against it. `inside`: an article is open."""
    if tag in APART or (tag == "header" and not inside):
        return True, False
    barred = named = False
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                named = named or any(_NAMED.search(x) and not _LAYOUT.search(x) for x in value.split())
            elif name == "role":
                barred = barred or bool(_ROLE.search(value.lower()))
            elif name == "style":
                barred = barred or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                barred = barred or name == "hidden" or value.lower() == "true"
    return barred, named


def read(page: str) -> Page:
    out = Page()
    stack, opened = [0], Counter()
    parts: list[str] = []
    links = linked = inside = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.node.append(stack[-1])
                out.text.append(text)
                out.linked.append(linked)
            parts = []
        linked = 0

    def leave(n: int) -> None:
        nonlocal inside
        for node in stack[n:]:
            inside -= out.tag[node] in _MAIN
            opened[out.tag[node]] -= 1
        del stack[n:]

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            said = _html.unescape(raw) if "&" in raw else raw
            parts.append(said)
            if links > 0:
                linked += len(said.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1] and m[1].lower() not in ("script", "style", "noscript", "template"):
                parts.append(" ")
            continue
        tag, closing, attrs = tag.lower(), (m[2] if m[3] else m[5]) == "/", (m[4] if m[3] else m[7]) or ""
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if closing else 1))
            elif tag in ("br", "img", "wbr"):
                parts.append(" " if tag != "wbr" else "")
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if closing:
            if opened[tag] > 0:
                leave(next(i for i in range(len(stack) - 1, 0, -1) if out.tag[stack[i]] == tag))
            continue
        ends, top = _CLOSES.get(tag, ()), out.tag[stack[-1]]
        if top == "p" or top in ends or top in HEADINGS and tag in HEADINGS:
            leave(len(stack) - 1)
        while ends and out.tag[stack[-1]] in ends:
            leave(len(stack) - 1)
        stack.append(out.open(tag, stack[-1], *_marked(tag, attrs, inside > 0)))
        opened[tag] += 1
        inside += tag in _MAIN
    text(page[at:])
    flush()
    return out


def _smoothed(values: np.ndarray, spread: float) -> np.ndarray:
    """Gaussian means over neighbouring blocks, two to each side at most."""
    kernel = np.exp(-0.5 * (np.arange(-2, 3) / spread) ** 2)
    return np.convolve(values, kernel)[2:-2] / np.convolve(np.ones(len(values)), kernel)[2:-2]


def _headed(page: Page, fair: list[int]) -> set[int]:
    """Nodes that have a heading among their children, the page and its body left out."""
    return {up for i in fair if page.tag[page.node[i]] in HEADINGS for up in (page.parent[page.node[i]],) if page.tag[up] not in ("", "html", "body")}


def path_scores(page: Page, fair: list[int], spread: float = 1.0) -> np.ndarray:
    """Fused ratio of each block of `fair`. Its length ratio is the mean of three: characters per node of its tag path, characters per block of its like siblings, and the
    latter smoothed in page order; its punctuation ratio likewise. Logs keep one long block from drowning the rest."""
    paths, groups = [page.path[page.node[i]] for i in fair], [(page.parent[page.node[i]], page.tag[page.node[i]]) for i in fair]
    by_path, by_group = {}, {}
    for i, path, group in zip(fair, paths, groups, strict=True):
        n, stops = len(page.text[i]), len(_PUNCTUATION.findall(page.text[i]))
        a, b = by_path.setdefault(path, [0, 0]), by_group.setdefault(group, [0, 0, 0, 0])
        a[0] += n
        a[1] += stops
        b[0] += 1
        b[1] += n
        b[2] += stops
        b[3] += min(n, page.linked[i])
    whole = np.array([(by_path[p][0] / page.nodes_of_path[p], by_path[p][1] / page.nodes_of_path[p]) for p in paths])
    own = np.array([(b[1] / b[0], b[2] / b[0], 1 - b[3] / b[1]) for b in map(by_group.__getitem__, groups)])
    length, stops = ((whole[:, k] + own[:, k] + _smoothed(own[:, k], spread)) / 3 for k in (0, 1))
    headed = _headed(page, fair)
    weight = [(FAINT if page.faint[v] else 1.0) * (CENTRAL if page.central[v] else 1.0) * (HEADED if page.parent[v] in headed else 1.0) * (RIGHTS if _RIGHTS.search(page.text[i]) and page.tag[v] not in HEADINGS else 1.0) for i in fair for v in (page.node[i],)]
    return np.log1p(length) * np.log1p(stops) * own[:, 2] * np.array(weight)


def _totals(page: Page, fair: list[int], values: np.ndarray) -> np.ndarray:
    """Sums of the blocks' values below each node."""
    out = np.zeros(len(page.tag))
    np.add.at(out, [page.node[i] for i in fair], values)
    out = out.tolist()
    for node in range(len(out) - 1, 0, -1):
        out[page.parent[node]] += out[node]
    return np.array(out)


def _content_node(page: Page, mass: np.ndarray, children: list[list[int]], headed: set[int], titled: set[int]) -> int:
    """Down from the root, to the child that holds most of the mass, until none does or an article's own heading would be left behind."""
    node = 0
    while page.tag[node] != "article":
        inner = [c for c in children[node] if mass[c] > 0 and (page.tag[c] not in _TEXTUAL or page.tag[c] in _LISTS or page.tag[node] in _LISTS or page.tag[node] in ("tbody", "thead", "tr"))]
        articles = [c for c in inner if page.tag[c] in _MAIN and mass[c] >= ARTICLE * mass[node]]
        if not articles and node not in headed and node not in titled:
            # Of several parts without telling tags, the only one with a heading of its own is like an article.
            own = [c for c in inner if c in headed]
            articles = own if len(own) == 1 and mass[own[0]] >= ARTICLE * mass[node] else []
        best = max(articles or inner, key=lambda c: mass[c], default=None)
        if best is None or not articles and (mass[best] < MOST * mass[node] or page.tag[node] == "main"):
            break
        if not articles and (page.tag[best] in ("ul", "ol", "dl") or node in headed or node in titled and not headed & {best, *children[best]}):
            break
        node = best
    return node


def content(page: Page) -> list[int]:
    """Numbers of the blocks that are the page's main text."""
    fair = [i for i, v in enumerate(page.node) if not page.barred[v]]
    if not fair:
        return []
    scores = path_scores(page, fair)
    sizes = np.array([len(page.text[i]) for i in fair], float)
    # Per group of like siblings, the mean score; the best group is that of most score and text.
    of_group: dict[tuple[int, str], list[float]] = {}
    groups = [(page.parent[page.node[i]], page.tag[page.node[i]]) for i in fair]
    for group, score, size in zip(groups, scores.tolist(), sizes.tolist(), strict=True):
        g = of_group.setdefault(group, [0.0, 0.0])
        g[0] += size
        g[1] += size * score
    mean = {g: s / n for g, (n, s) in of_group.items()}
    best = mean[max(mean, key=lambda g: mean[g] * np.log1p(of_group[g][0]))]
    carries = np.array([mean[g] >= CARRIES * best for g in groups])
    mass = _totals(page, fair, np.where(carries, sizes * scores, 0.0))
    if not mass[0] > 0:
        # No punctuation anywhere, or nothing but links: what is left is the text.
        mass = _totals(page, fair, sizes * np.array([FAINT if page.faint[page.node[i]] else 1.0 for i in fair]))
        best = 0.0
    held, gained = _totals(page, fair, sizes), _totals(page, fair, sizes * scores)
    linked = _totals(page, fair, np.array([min(len(page.text[i]), page.linked[i]) for i in fair], float))
    children: list[list[int]] = [[] for _ in page.tag]
    for node in range(1, len(page.tag)):
        if held[node] > 0:
            children[page.parent[node]].append(node)
    titled = {page.parent[page.node[i]] for i in fair if page.tag[page.node[i]] in HEADINGS}
    region = _content_node(page, mass, children, _headed(page, fair), titled)
    # Parts inside the region: containers and lone blocks under their share of the best score go, and lists of links.
    stays = np.zeros(len(page.tag), bool)
    stays[region] = True
    for node in range(region + 1, len(page.tag)):
        if not stays[page.parent[node]] or not held[node] > 0:
            continue
        tag, mean_score = page.tag[node], gained[node] / held[node]
        if tag in HEADINGS or page.parent[node] != region and page.tag[page.parent[node]] in _TEXTUAL:
            stays[node] = not page.faint[node] or page.faint[region]
        elif tag in _TEXTUAL:
            stays[node] = (tag not in _LISTS or linked[node] < 0.6 * held[node]) and (not page.faint[node] or page.faint[region] or mean_score >= STAYS * best)
        else:
            stays[node] = mean_score >= (STAYS if children[node] else LEAF) * best
    return [i for i in fair if stays[page.node[i]]]


def main_text(page: str) -> str:
    seen = read(page)
    return "\n".join(seen.text[i] for i in content(seen))


def extract_main(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(arrow, html):
            texts = [main_text(x.decode("utf-8", "replace")) for x in utf8(batch.column(html))]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(url).cast("string").alias(url), html).mapInArrow(run, f"{key} long, {url} string, text string, n_chars long")
