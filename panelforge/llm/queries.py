"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontam, fim, gam, jaccard, lm, secretscan, sharding, simhash, tagpath, topk, urlfilter, variants, wfst
from panelforge.llm._base import vocabulary

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode_texts(table(spark, sf_dir, "documents"), wfst.load(vocabulary()))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(table(spark, sf_dir, "documents"), words=secretscan.vocabulary_words(vocabulary()))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpath.extract_main(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_verdicts(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_texts(table(spark, sf_dir, "documents"), width=5, percent=80)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform_texts(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    digests = [digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_top_k, op2_sentencepiece, op3_secrets, op4_main_text, op5_quality, op6_lm_score, op7_shards, op8_url_verdicts, op9_near_duplicates, op10_decontaminate,
        op11_ngram_jaccard, op12_spelling_variants, op13_fill_in_middle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # CRC-32 by its table, which the first step makes from the polynomial; shards by the running bytes before the middle of each row.
    "op7_shards": """
        WITH tab AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t
        ), h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), d AS (
            SELECT doc_id, CAST(length(x) // 2 + 16 AS BIGINT) AS size,
                   CAST(xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(x, '..'), lambda y: ('0x' || y)::UBIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INTEGER + 1]))) AS BIGINT) AS text_crc32
            FROM h, tab
        ), r AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size + size // 2 AS middle, sum(size) OVER () AS total FROM d),
        p AS (SELECT doc_id, size, text_crc32, CAST(least(39, floor(middle * 40 / total)) AS INTEGER) AS shard FROM r)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
    """,
    # Keys of urls, links by canonical and refresh tags, classes of linked keys by a recursive walk, and rules; a block in a class reaches its members without a rule.
    "op8_url_verdicts": r"""
        WITH RECURSIVE rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        tags AS (
            SELECT url, unnest(list_concat(
                list_transform(regexp_extract_all(seen, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
                list_transform(regexp_extract_all(seen, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: trim(regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''>]+)', 1))))) AS link
            FROM (SELECT url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style|noscript|template)\b.*?</(?:script|style|noscript|template)\s*>', ' ', 'g') AS seen FROM pages WHERE instr(url, '://') > 0)
        ), parts AS (
            SELECT url, replace(link, '&amp;', '&') AS link, regexp_extract(url, '^[^:/?#]*:') AS scheme, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS site, regexp_extract(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '(?s)^.*/') AS folder FROM tags
        ), ends AS (
            SELECT url AS a, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN scheme || link WHEN starts_with(link, '/') THEN scheme || '//' || site || link WHEN link = '' THEN NULL
                ELSE scheme || '//' || site || CASE WHEN folder = '' THEN '/' ELSE folder END || link END AS b FROM parts
        ), named AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a FROM ends UNION ALL SELECT b FROM ends) WHERE instr(url, '://') > 0),
        split AS (
            SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query FROM named
        ), keys AS (
            SELECT url, host, CASE WHEN path = '' THEN '/' WHEN regexp_matches(path, '/\.\.?(?:/|$)') THEN array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(path || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END, '/'), lambda x: [x])),
                lambda a, x: CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[:-2] ELSE a END ELSE list_concat(a, x) END), '/') ELSE path END AS path, query FROM split
        ), nodes AS (SELECT url, host || path || query AS k, host, path FROM keys),
        edges AS (SELECT x.k AS u, y.k AS v FROM ends JOIN nodes x ON x.url = a JOIN nodes y ON y.url = b WHERE x.k <> y.k), twoway AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
        walk(start, node) AS (SELECT DISTINCT u, u FROM twoway UNION SELECT start, v FROM walk JOIN twoway ON u = node),
        ruled AS (SELECT k, max_by(r.verdict, length(h || p)) AS verdict FROM nodes JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
        spread AS (SELECT DISTINCT start AS k FROM walk JOIN ruled ON ruled.k = node WHERE verdict = 'block'),
        a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
        fit AS (
            SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
            FROM (SELECT DISTINCT page_id, host, path FROM b) b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
        )
        SELECT b.page_id, b.host, b.path, fit.rule, coalesce(fit.verdict, CASE WHEN spread.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM b LEFT JOIN fit USING (page_id) LEFT JOIN nodes ON nodes.url = b.url LEFT JOIN spread ON spread.k = nodes.k
    """,
    # Runs and their checksums per document, words, their neighbours by the strings that one removal leaves, and chains of forms by a recursive walk.
    "op12_spelling_variants": r"""
        WITH RECURSIVE tab AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END)) AS t
        ), runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
            ) WHERE length(run) >= 6 GROUP BY ALL
        ), sums AS (
            SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda y: ('0x' || y)::UBIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INTEGER + 1]))) AS h FROM runs, tab
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM sums)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ), gone AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
        indel AS (SELECT DISTINCT g.word AS a, w.word AS b FROM gone g JOIN words w ON w.word = g.d),
        near AS (
            SELECT g.word AS a, o.word AS b FROM gone g JOIN gone o ON o.d = g.d AND o.i = g.i AND o.word <> g.word
            UNION ALL SELECT a, b FROM indel UNION ALL SELECT b, a FROM indel
        ), best AS (SELECT a, count(*) AS n_near, min({'m': -n, 'w': b}) AS best FROM near JOIN words ON word = b GROUP BY a),
        forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.w END AS form, CASE WHEN -best.m >= 5 * n THEN -best.m END AS form_n
            FROM words LEFT JOIN best ON a = word
        ), walk(word, root) AS (SELECT word, word FROM words UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = root WHERE form IS NOT NULL)
        SELECT word, form, walk.root, n, n_near, CAST(form_n AS BIGINT) AS form_n
        FROM forms JOIN walk USING (word) JOIN forms AS f(last, _n, _m, end_form, _fn) ON last = walk.root WHERE end_form IS NULL
    """,
    # Units by the pattern, draws from the digest of seed and key, and the parts as lists of units.
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, len(u) AS n, list_transform(range(4), lambda k: ('0x' || substr(s, 8 * k + 1, 8))::UBIGINT) AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS a, greatest(h[1] % (n + 1), h[2] % (n + 1))::BIGINT AS b, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 AS plain FROM h),
        p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c),
        o AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM o
    """,
}
