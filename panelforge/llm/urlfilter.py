"""URL filters with redirect equivalence, in DataFrame operations only.

Rules decide a url by host suffix and path prefix; the longest that fits wins. Urls that no rule fits take the
decision of their aliases: pages linked by a redirect (`<meta http-equiv=refresh>`) or a canonical link, or rows of
a given redirect table, form components, and a block of any member reaches the members without a rule. A member with an
explicit allow rule stays allowed.

Links in comments and scripts don't count; relative links and dot segments are resolved; of several rules of one length the first in order of host and path decides.

Defined cases: a url that is null or has no `://` has an empty host and path, no rule, and verdict allow; null html has
no links; comments and scripts that never end hide nothing, and tags that never end are none; repeated rows get the same verdict each; hosts, paths and pages of any length are read whole; null page ids stay null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm._base import store
from panelforge.llm.components import connected_components

#: (verdict, host, path) of the production rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: A tag up to its end, and what a canonical link and a redirect say within one.
_LINK, _META = r"(?i)<link\b[^>]*+>", r"(?i)<meta\b[^>]*+>"
_CANONICAL = r"(?is)\brel\s*+=\s*+[\"']?canonical\b"
_REFRESH = r"(?is)\bhttp-equiv\s*+=\s*+[\"']?refresh\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'>]+)"


#: The parts of a url after its first `://`: host, path, query.
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_QUERY = r"(?s)^.*?://[^/?#]*+[^?#]*+(\?[^#]*)"
#: Parts of a page that a reader doesn't parse as tags, and where the last of them can end.
_HIDDEN = r"(?is)<(?:script|style|noscript|template)\b.*?</(?:script|style|noscript|template)\s*+>"
_LAST_HIDDEN = r"(?is)^.*</(?:script|style|noscript|template)\s*+>"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def clean_path(path: Column) -> Column:
    """The path with its `.` and `..` segments resolved, and `/` for an empty one."""
    whole = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
    parent = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    fold = lambda kept, x: F.when(x == ".", kept).when(x == "..", parent(kept)).otherwise(F.concat(kept, F.array(x)))
    folded = F.aggregate(F.split(whole, "/", -1), F.array().cast("array<string>"), fold, lambda kept: F.array_join(kept, "/"))
    return F.when(path == "", "/").when(path.rlike(r"/\.\.?(?:/|$)"), folded).otherwise(path)


def url_key(url: Column) -> Column:
    """Identity of a url as a graph node: without scheme, fragment, dot segments and the case of its host; null without `://`."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), clean_path(path_of(url)), F.regexp_extract(url, _QUERY, 1)))


def resolved(link: Column, base: Column) -> Column:
    """`link` as an absolute url, as seen from `base`."""
    scheme = F.regexp_extract(base, r"^[^:/?#]*:", 0)
    site = F.concat(scheme, F.lit("//"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    return (
        F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(site, link)).when(link == "", F.lit(None)).otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def rule_verdict(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. A few rules, so a CASE list."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ranked]
    found = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in ranked]
    return reduce(lambda case, x: case.when(*x), zip(fits[1:], found[1:], strict=True), F.when(fits[0], found[0]))


def shown(html: Column) -> Column:
    """The page without comments, scripts and the like; what is opened and never closed stays. Patterns see the page up to the last end only, so every opening they try
    finds an end, and pages of unclosed tags take linear time too."""
    rest = F.substring_index(html, "-->", -1)
    plain = F.concat(F.regexp_replace(F.left(html, F.length(html) - F.length(rest)), "(?s)<!--.*?-->", " "), rest)
    return _without_hidden(plain)


def _without_hidden(html: Column) -> Column:
    closed = F.regexp_extract(html, _LAST_HIDDEN, 0)
    return F.concat(F.regexp_replace(closed, _HIDDEN, " "), F.substr(html, F.length(closed) + 1))


def html_links(pages: DataFrame) -> DataFrame:
    """(u, v): keys of the urls that a page declares to be itself, by redirect or canonical link, outside comments and scripts."""
    page = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select("url", shown(F.col("html")).alias("html"))
    # No tag ends behind the last `>`.
    ended = page.select("url", F.left("html", F.length("html") - F.length(F.substring_index("html", ">", -1))).alias("html"))
    tags = lambda tag, test: F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(test))
    canonical = F.transform(tags(_LINK, _CANONICAL), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(tags(_META, _REFRESH), lambda t: F.trim(F.regexp_extract(t, _TO, 1)))
    tagged = ended.select("url", F.explode(F.concat(canonical, refresh)).alias("link"))
    target = resolved(F.regexp_replace("link", "&amp;", "&"), F.col("url"))
    return tagged.select(url_key(F.col("url")).alias("u"), url_key(target).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")


def url_verdicts(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Judges every row of `pages` (page_id, url, html). `redirects` adds known edges, columns from_url and to_url."""
    links = html_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(url_key(F.col("from_url")).alias("u"), url_key(F.col("to_url")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v"))
    links = store(links.distinct(), "links")
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("own", rule_verdict(F.col("host"), F.col("path"), rules))
    judged = parts.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("own"), url_key(F.col("url")).alias("key"))
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    members = connected_components(links)
    # A member's own rule follows from its key, pages that were never fetched included.
    as_url = F.concat(F.lit("x://"), F.col("node"))
    ruled = members.withColumn("own", rule_verdict(host_of(as_url), path_of(as_url), rules))
    bad = ruled.where("own.verdict = 'block'").select("root").distinct()
    blocked = members.join(bad, "root", "left_semi").select(F.col("node").alias("key"), F.lit("block").alias("spread"))
    # Only the keys that rows without a rule need are joined; a key of many rows can be split, for `blocked` has each key once.
    return judged.join(blocked, "key", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"))
