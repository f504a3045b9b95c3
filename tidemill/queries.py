"""A query for each operator over the generated tables or given rows, and the same in SQL for DuckDB."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import content, errors, ip, links, text, urls
from .functions.arguments import parse_arguments
from .functions.bind import bound
from .functions.html import attribute_peak
from .functions.markdown import DROPPED, markdown_of
from .operators import policy, redirects, robots, stats
from .plans import retrieval
from .sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, bytes):
        return "unhex('" + v.hex() + "')"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def given(name: str, columns: str, rows: Sequence[tuple], run: Callable[[DataFrame], DataFrame], out: str, want: Sequence[tuple]) -> None:
    """A query over given rows, whose SQL is the rows that must come out."""
    QUERIES[name] = lambda spark, _: run(spark.createDataFrame(rows, columns))
    types = [c.strip().split(" ") for c in out.split(",")]
    values = ", ".join("(" + ", ".join(f"CAST({quoted(v)} AS {t})" for v, (_, t) in zip(r, types, strict=True)) + ")" for r in want)
    SQL[name] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(n for n, _ in types)})"


# ---- pages ----------------------------------------------------------------------------------------------------------

#: What the generated pages' articles say, by regular expressions instead of a tokenizer.
ARTICLES = r"""
articles AS (SELECT page_id, url, html, regexp_extract(html, '<article>((?s:.)*?)(</article>|$)', 1) AS x FROM pages),
pieces AS (SELECT page_id, url, html, regexp_extract(x, '<h1>([^<]*)</h1>', 1) AS h,
  list_transform(regexp_extract_all(x, '<p>(?:<b>[^<]*<br>|[^<]*</p>)'), lambda p:
    CASE WHEN starts_with(p, '<p><b>') THEN '**' || trim(regexp_replace(regexp_extract(p, '<b>([^<]*)<br>', 1), '[ \t\n\r\f\v]+', ' ', 'g')) || '**'
         ELSE trim(regexp_replace(regexp_extract(p, '<p>([^<]*)</p>', 1), '[ \t\n\r\f\v]+', ' ', 'g')) END) AS ps FROM articles),
md AS (SELECT page_id, url, html, replace(replace('# ' || trim(regexp_replace(h, '[ \t\n\r\f\v]+', ' ', 'g')) || chr(10) || chr(10) || array_to_string(ps, chr(10) || chr(10)), '&quot;', '"'), '&amp;', '&') AS markdown FROM pieces)
"""


@query("WITH " + ARTICLES + "SELECT page_id, markdown, NULL::VARCHAR AS error FROM md")
def page_markdown(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", markdown_of(F.col("html"), F.col("url")).alias("m")).select("page_id", "m.markdown", "m.error")


RENDERED = """
SELECT page_id, url, least(length(markdown), {n})::BIGINT AS returned, length(markdown) > {n} AS more,
  CASE WHEN length(markdown) <= {n} THEN length(markdown)::BIGINT END AS total,
  substr(markdown, 1, {n}) || CASE WHEN length(markdown) > {n} THEN chr(10) || chr(10) || '{more}{n} to continue.]' ELSE '' END AS text
FROM md"""


@query("WITH " + ARTICLES + RENDERED.format(n=5000, more=text.MORE))
def page_render_first(spark, sf_dir):
    return retrieval.render_pages(read(spark, sf_dir, "pages"))


@query("WITH " + ARTICLES + RENDERED.format(n=300, more=text.MORE))
def page_render_short(spark, sf_dir):
    return retrieval.render_pages(read(spark, sf_dir, "pages"), length=300)


SITE = r"regexp_extract(url, '^([^:]*://[^/?#]*)', 1)"


@query(
    "WITH " + ARTICLES + r""",
one AS (SELECT regexp_replace(url, '#.*$', '') AS u, min(page_id) AS page_id FROM pages GROUP BY 1)
SELECT p.page_id AS request_id, p.url, p.url AS final_url, 200 AS status, 0 AS redirects, NULL::VARCHAR AS error_code,
  least(length(m.markdown), 2000)::BIGINT AS returned, length(m.markdown) > 2000 AS more,
  CASE WHEN length(m.markdown) <= 2000 THEN length(m.markdown)::BIGINT END AS total,
  substr(m.markdown, 1, 2000) || CASE WHEN length(m.markdown) > 2000 THEN chr(10) || chr(10) || 'MORE2000 to continue.]' ELSE '' END AS text
FROM pages p JOIN one ON regexp_replace(p.url, '#.*$', '') = one.u JOIN md m ON m.page_id = one.page_id""".replace("MORE", text.MORE)
)
def retrieved_pages(spark, sf_dir):
    """The whole plan over the pages, as if each were asked for by its url."""
    pages = read(spark, sf_dir, "pages")
    requests = pages.select(F.col("page_id").alias("request_id"), F.to_json(F.struct("url", F.lit(2000).alias("max_length"))).alias("args"))
    hosts = pages.select(F.lower(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1)).alias("host")).distinct()
    dns = hosts.select("host", F.lit(0).alias("ord"), F.lit("93.184.216.34").alias("ip"))
    first = pages.groupBy(F.regexp_replace("url", "#.*$", "").alias("url")).agg(F.min_by("html", "page_id").alias("html"))
    head = F.create_map(F.lit("Content-Type"), F.array(F.lit("text/html; charset=utf-8")))
    responses = first.select("url", F.lit(200).alias("status"), head.alias("headers"), F.col("html").cast("binary").alias("body"))
    return retrieval.run(requests, dns, responses)


@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, url FROM pages),
e AS (SELECT page_id, href, """ + SITE + r""" || href AS target FROM t)
SELECT page_id, href, list_reduce(list_prepend('', list_transform(string_split(target, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE url_encode(c) END)), lambda a, b: a || b) AS target FROM e
""")
def link_resolve(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    resolve = F.pandas_udf(lambda b, h: __import__("pandas").Series([links.destination(x, y) for x, y in zip(b, h)]), "string")
    return rows.select("page_id", "href", resolve("url", "href").alias("target"))


@query("SELECT page_id, false AS over_cap FROM pages")
def attribute_guard(spark, sf_dir):
    peak = F.pandas_udf(lambda s: s.map(attribute_peak).astype("int64"), "long")
    return read(spark, sf_dir, "pages").select("page_id", (peak("html") > 1024).alias("over_cap"))


@query(r"""
SELECT tag, sum(len(regexp_extract_all(html, '<' || tag || '(?:[\s>/])')))::BIGINT AS n
FROM pages, (SELECT unnest(['script', 'style', 'nav', 'footer', 'head', 'title', 'aside', 'form']) AS tag) GROUP BY tag
""")
def dropped_subtrees(spark, sf_dir):
    """How often elements start that the converter drops, and two others."""
    tags = ["script", "style", "nav", "footer", "head", "title", "aside", "form"]
    assert set(tags[:-1]) <= DROPPED
    pages = read(spark, sf_dir, "pages")
    counts = pages.agg(*(F.sum(F.size(F.regexp_extract_all("html", F.lit(rf"<{t}[\s>/]"), F.lit(0)))).cast("long").alias(t) for t in tags))
    return counts.unpivot([], tags, "tag", "n")


TOKENS = r"len(regexp_extract_all({}, '[^\x09-\x0D\x20\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+'))"
QUALITY = (
    "WITH " + ARTICLES + ", w AS (" + RENDERED.format(n=5000, more=text.MORE).replace("FROM md", ", html, markdown FROM md") + "), q AS (SELECT page_id, "
    + TOKENS.format("html") + " AS raw_tokens, " + TOKENS.format("markdown") + " AS full_tokens, " + TOKENS.format("text") + " AS window_tokens FROM w)"
)


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("m", markdown_of(F.col("html"), F.col("url")))
    pages = pages.withColumn("shown", text.render(text.window(F.col("m.markdown"), F.lit(0), F.lit(text.DEFAULT_LENGTH))))
    n = pages.select("page_id", "m.error", text.token_count(F.col("html")).alias("raw_tokens"), text.token_count(F.col("m.markdown")).alias("full_tokens"), text.token_count(F.col("shown")).alias("window_tokens"), text.script_leaked(F.col("html"), F.col("shown")).alias("script_leaked"))
    return n.withColumn("reduction_full", text.reduction(F.col("raw_tokens"), F.col("full_tokens"))).withColumn("reduction_windowed", text.reduction(F.col("raw_tokens"), F.col("window_tokens")))


@query(QUALITY + "SELECT page_id, raw_tokens::BIGINT AS raw_tokens, full_tokens::BIGINT AS full_tokens, window_tokens::BIGINT AS window_tokens, (raw_tokens - full_tokens) / raw_tokens AS reduction_full, (raw_tokens - window_tokens) / raw_tokens AS reduction_windowed, false AS script_leaked FROM q")
def token_reduction(spark, sf_dir):
    return _quality(spark, sf_dir).drop("error")


@query(QUALITY + "SELECT count(*) AS pages, 1.0::DOUBLE AS success_rate, median((raw_tokens - window_tokens) / raw_tokens) AS median_reduction, 0::BIGINT AS leaks, CASE WHEN median((raw_tokens - window_tokens) / raw_tokens) >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM q")
def corpus_verdict(spark, sf_dir):
    q = _quality(spark, sf_dir).withColumn("ok", F.col("error").isNull()).withColumn("reduction", F.col("reduction_windowed"))
    return stats.corpus_verdict(q)


@query(r"""
WITH u AS (SELECT page_id, 'pages' AS src, html AS t FROM pages UNION ALL SELECT doc_id, 'documents', text FROM documents)
SELECT src, regexp_matches(t, '(?i)^\s*(<!doctype html($|[\s>])|<(html|head|body)($|[\s>/]))') AS is_html, count(*) AS n FROM u GROUP BY 1, 2
""")
def html_sniff(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("html").alias("t"))
    d = read(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("text").alias("t"))
    return p.unionByName(d).groupBy("src", content.looks_like_html(F.col("t")).alias("is_html")).agg(F.count("*").alias("n"))


@query("SELECT 'utf-8' AS charset, count(*) AS n FROM pages")
def charset_meta(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(content.meta_charset(F.substring(F.col("html").cast("binary"), 1, 1024)).alias("charset"))
    return p.groupBy("charset").agg(F.count("*").alias("n"))


# ---- windows of text ------------------------------------------------------------------------------------------------

@query("""
SELECT doc_id, substr(text, 101, 500) AS text, 100::BIGINT AS start, greatest(0, least(500, length(text) - 100))::BIGINT AS returned, length(text) > 600 AS more,
  CASE WHEN length(text) <= 600 THEN length(text)::BIGINT END AS total FROM documents
""")
def doc_window(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", text.window(F.col("text"), F.lit(100), F.lit(500)).alias("w"))
    return d.select("doc_id", "w.*")


@query("""
SELECT doc_id, i::INT AS page_no, length(substr(text, i * 1000 + 1, 1000))::BIGINT AS returned, md5(substr(text, i * 1000 + 1, 1000)) AS digest
FROM (SELECT doc_id, text, unnest(range(greatest(length(text) - 1, 0) // 1000 + 1)) AS i FROM documents)
""")
def doc_pages(spark, sf_dir):
    p = text.pages(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1000)
    return p.select("doc_id", "page_no", "page.returned", F.md5("page.text").alias("digest"))


@query("SELECT doc_id, (greatest(length(text) - 1, 0) // 700 + 1)::BIGINT AS pages, true AS same FROM documents")
def doc_page_roundtrip(spark, sf_dir):
    p = text.pages(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", 700)
    parts = F.array_sort(F.collect_list(F.struct("page_no", "page.text")))
    return p.groupBy("doc_id", F.md5("text").alias("h")).agg(F.count("*").alias("pages"), F.md5(F.array_join(F.transform(parts, lambda x: x["text"]), "")).alias("again")).select("doc_id", "pages", (F.col("h") == F.col("again")).alias("same"))


@query("""
WITH w AS (SELECT doc_id, s, length(text) AS n, least(200, greatest(0, length(text) - s)) AS r, length(text) > s + 200 AS more FROM documents, (SELECT unnest([0, 10, 1000000]) AS s))
SELECT doc_id, s AS start, CASE
  WHEN s >= n THEN '[No content at start_index=' || s || ': the content is ' || n || ' characters long.]'
  WHEN more THEN chr(10) || chr(10) || 'MORE' || (s + r) || ' to continue.]'
  WHEN s > 0 THEN chr(10) || chr(10) || '[Total length: ' || n || ' characters.]' ELSE '' END AS footer FROM w
""".replace("MORE", text.MORE))
def render_footer(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (0, 10, 1_000_000)))).alias("start"), "text")
    d = d.withColumn("w", text.window(F.col("text"), F.col("start"), F.lit(200)))
    r = text.render(F.col("w"))
    return d.select("doc_id", "start", F.when(F.col("start") >= F.length("text"), r).otherwise(F.substr(r, F.length(F.col("w.text")) + 1)).alias("footer"))


@query("SELECT doc_id, sha256(text) || '  ' || doc_id AS line FROM documents")
def sha256_manifest(spark, sf_dir):
    return files.manifest(read(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("name").alias("doc_id"), "line")


# ---- urls, addresses, hosts -----------------------------------------------------------------------------------------

@query(r"""
SELECT page_id, starts_with(url, 'https') AS https, lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)) AS host,
  CASE WHEN starts_with(url, 'https') THEN 443 ELSE 80 END AS port, NULL::VARCHAR AS error_message FROM pages
""")
def url_check(spark, sf_dir):
    return urls.check_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "checked.https", "checked.host", "checked.port", "checked.error_message")


V4_VALUES = ", ".join(f"({i}, '{r}', '{k}', '{c}')" for i, (r, k, c) in enumerate(ip.V4_RANGES))


@query(f"""
WITH r AS (SELECT i, kind, category, list_reduce(list_transform(string_split(split_part(cidr, '/', 1), '.'), lambda x: x::BIGINT), lambda a, b: a * 256 + b) AS net,
  (2 ** (32 - split_part(cidr, '/', 2)::INT))::BIGINT AS size FROM (VALUES {V4_VALUES}) AS t(i, cidr, kind, category)),
a AS (SELECT (l_orderkey * 2654435761) % 4294967296 AS ip, l_linenumber FROM lineitem),
d AS (SELECT DISTINCT ip FROM a),
m AS (SELECT d.ip, min_by(r.kind, r.i) AS kind, min_by(r.category, r.i) AS category FROM d JOIN r ON d.ip >= r.net AND d.ip < r.net + r.size GROUP BY d.ip)
SELECT m.kind, m.category, count(*) AS n FROM a LEFT JOIN m USING (ip) GROUP BY 1, 2
""")
def ip_classify(spark, sf_dir):
    a = read(spark, sf_dir, "lineitem").select(ip.classify_v4((F.col("l_orderkey") * F.lit(2654435761)) % F.lit(4294967296)).alias("b"))
    return a.groupBy("b.kind", "b.category").agg(F.count("*").alias("n"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three answers for each supplier's host, some of them private."""
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), F.col("s_suppkey"), F.lit(".example")).alias("host"), "s_suppkey")
    s = s.withColumn("ord", F.explode(F.sequence(F.lit(0), (F.col("s_suppkey") % 3).cast("int"))))
    k = (F.col("s_suppkey") * 7 + F.col("ord") * 5) % 10
    addr = F.when(k < 7, F.concat(F.lit("8.8."), k, F.lit("."), F.col("s_suppkey") % 200)).when(k == 7, "10.1.2.3").when(k == 8, "169.254.169.254").otherwise("fe80::1")
    return s.select("host", "ord", F.when(F.col("s_suppkey") % 11 != 0, addr).alias("ip"))


ANSWERS = """
WITH s AS (SELECT s_suppkey, 'h' || s_suppkey || '.example' AS host, unnest(range(s_suppkey % 3 + 1)) AS o FROM supplier),
a AS (SELECT host, s_suppkey, o, (s_suppkey * 7 + o * 5) % 10 AS k FROM s),
b AS (SELECT host, o, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN k < 7 THEN '8.8.' || k || '.' || (s_suppkey % 200) WHEN k = 7 THEN '10.1.2.3' WHEN k = 8 THEN '169.254.169.254' ELSE 'fe80::1' END AS ip,
  CASE WHEN s_suppkey % 11 = 0 OR k < 7 THEN NULL WHEN k = 7 THEN {private} WHEN k = 8 THEN 'cloud metadata' ELSE 'link-local' END AS category FROM a)
, f AS (SELECT host, ip, min(o) AS o FROM b WHERE ip IS NOT NULL GROUP BY 1, 2), g AS (SELECT host, string_agg(ip, ',' ORDER BY o) AS ips FROM f GROUP BY host)
SELECT host, CASE WHEN count(ip) > 0 AND count(category) = 0 THEN any_value(ips) END AS addresses,
  CASE WHEN count(ip) = 0 THEN 'dns_failure' WHEN count(category) > 0 THEN 'blocked_target' END AS error_code,
  CASE WHEN count(ip) = 0 THEN 'hostname did not resolve' WHEN count(category) > 0 THEN 'hostname resolves to a non-public address (' || min_by(category, o) FILTER (WHERE category IS NOT NULL) || ')' END AS error_message
FROM b LEFT JOIN g USING (host) GROUP BY host
"""


def _resolved(spark, sf_dir, p: policy.Policy) -> DataFrame:
    return policy.resolve(_answers(spark, sf_dir), p).withColumn("addresses", F.array_join("addresses", ","))


@query(ANSWERS.format(private="'private'"))
def dns_policy(spark, sf_dir):
    return _resolved(spark, sf_dir, policy.Policy())


@query(ANSWERS.format(private="CASE WHEN s_suppkey IN (1, 11, 21) THEN NULL ELSE 'private' END"))
def allowlist_relax(spark, sf_dir):
    return _resolved(spark, sf_dir, policy.Policy(private_enabled=True, private_hosts=("h1.example", "h11.example", "h21.example")))


@query("""
WITH RECURSIVE n AS (SELECT count(*) AS c FROM supplier),
e AS (SELECT 'http://h' || s_suppkey || '/' AS f, 'http://h' || ((s_suppkey * 3 + 1) % c) || '/' AS t FROM supplier, n WHERE s_suppkey % 4 <> 0),
w AS (SELECT 'http://h' || s_suppkey || '/' AS url, 'http://h' || s_suppkey || '/' AS now, 0 AS hops FROM supplier
      UNION ALL SELECT w.url, e.t, hops + 1 FROM w JOIN e ON w.now = e.f WHERE hops < 5)
SELECT url, max_by(now, hops) AS final_url, max(hops)::INT AS hops, max(hops) = 5 AND max_by(now, hops) IN (SELECT f FROM e) AS too_many FROM w GROUP BY url
""")
def redirect_chain(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    page = lambda k: F.concat(F.lit("http://h"), k.cast("string"), F.lit("/"))
    n = s.count()
    edges = s.where("s_suppkey % 4 <> 0").select(page(F.col("s_suppkey")).alias("from_url"), page((F.col("s_suppkey") * 3 + 1) % n).alias("to_url"))
    return redirects.follow(s.select(page(F.col("s_suppkey")).alias("url")), edges)


ROBOTS_BODY = "User-agent: *\nDisallow: /en/1\nAllow: /en/12\nDisallow: /fr/\n\nUser-agent: other\nDisallow: /"


@query(r"""
WITH p AS (SELECT page_id, CASE WHEN regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) END AS path, regexp_extract(url, '\.([a-z]+)(?:[/?#]|$)', 1) AS top, url FROM pages)
SELECT page_id, NOT regexp_matches(url, '^https:') OR starts_with(path, '/en/12') OR NOT (starts_with(path, '/en/1') OR starts_with(path, '/fr/')) AS allowed FROM p
""")
def robots_pages(spark, sf_dir):
    """Each https origin has the same file; http origins have none."""
    pages = urls.check_urls(read(spark, sf_dir, "pages").select("page_id", "url"))
    pages = bound(pages, origin=urls.origin(F.col("checked")), https=F.col("checked.https")).drop("checked")
    have = pages.where("https").select("origin", F.lit(ROBOTS_BODY).alias("body")).distinct()
    j = pages.join(robots.records(have), "origin", "left")
    return j.select("page_id", robots.allowed(F.col("records"), F.lit("tidemill/0.1"), urls.path(F.col("url"))).alias("allowed"))


# ---- pages made from tables ----------------------------------------------------------------------------------------

def made(name: str, table: str, key: str, html: str, markdown: str) -> None:
    """A query over a page for each row of a table: html and the markdown that it must become, in SQL for both engines."""
    def run(spark, sf_dir):
        pages = read(spark, sf_dir, table).select(F.col(key).alias("id"), F.expr(html).alias("html"))
        return pages.select("id", markdown_of(F.col("html"), F.lit("https://tern.test/log/day.html")).alias("m")).select("id", "m.markdown", "m.error")

    QUERIES[name] = run
    SQL[name] = f"SELECT {key} AS id, {markdown} AS markdown, NULL::VARCHAR AS error FROM {table}"


def _both(sql: str) -> str:
    """SQL in which ~ is a line break."""
    return sql.replace("~", "' || chr(10) || '")


made(
    "markdown_headings", "nation", "n_nationkey",
    "'<h' || (n_nationkey % 6 + 1) || '>' || n_name || '</h' || (n_nationkey % 6 + 1) || '><hgroup>a</hgroup><figure>' || n_nationkey || '</figure><hr><p>end'",
    _both("repeat('#', (n_nationkey % 6 + 1)::INT) || ' ' || n_name || '~~a~~' || n_nationkey || '~~---~~end'"),
)
made(
    "markdown_lists", "supplier", "s_suppkey",
    "'<ol start=' || s_suppkey || '><li>' || s_name || '<ul><li>n' || s_nationkey || '<li>deep<ol><li>x</ol></ul><li>two</ol><ul><li>' || s_suppkey || '</ul>'",
    _both("s_suppkey || '. ' || s_name || '~  - n' || s_nationkey || '~  - deep~    1. x~' || (s_suppkey + 1) || '. two~~- ' || s_suppkey"),
)
made(
    "markdown_quotes_and_code", "supplier", "s_suppkey",
    "'<blockquote>' || s_name || '<blockquote>inner</blockquote></blockquote><pre><code class=lang-' || CASE WHEN s_suppkey % 2 = 0 THEN 'sql' ELSE 'c' END || '>a &lt; ' || s_suppkey || '\n  b\n</code></pre><p><code>x' || s_nationkey || '</code> <i>y</i> <strong>z</strong>'",
    _both("'> ' || s_name || '~~> > inner~~```' || CASE WHEN s_suppkey % 2 = 0 THEN 'sql' ELSE 'c' END || '~a < ' || s_suppkey || '~  b~```~~`x' || s_nationkey || '` *y* **z**'"),
)
made(
    "markdown_links_and_images", "customer", "c_custkey",
    "'<p><a href=\"../c(' || c_custkey || ')?n=' || c_nationkey || '&amp;x=1\">' || c_name || '</a> <a href=\"javascript:' || c_custkey || '\">no</a> <a href=\"#' || c_custkey || '\">top</a> <img src=\"//pics.test/' || c_custkey || '.png\" alt=\" no  ' || c_custkey || ' \"><img src=x.png>'",
    "'[' || c_name || '](https://tern.test/c%28' || c_custkey || '%29?n=' || c_nationkey || '&x=1) no top ![no ' || c_custkey || '](https://pics.test/' || c_custkey || '.png)'",
)
made(
    "markdown_tables", "customer", "c_custkey",
    "'<table><thead><tr><th>key<th>name | nation</tr></thead><tbody><tr><td>' || c_custkey || '<td><b>' || c_name || '</b> ' || c_nationkey || '</tr><tr><td></td></tr><tr><td>in<table><tr><td>' || c_nationkey || '</table></table>end'",
    _both("'| key | name \\| nation |~| --- | --- |~| ' || c_custkey || ' | **' || c_name || '** ' || c_nationkey || ' |~| in ' || c_nationkey || ' |~~end'"),
)
made(
    "markdown_dropped_parts", "orders", "o_orderkey",
    "'<head><title>t</title></head><div class=\"' || CASE WHEN o_orderkey % 3 = 0 THEN 'ad-box' WHEN o_orderkey % 3 = 1 THEN 'made' ELSE 'x popup' END || '\">a' || o_orderkey || '</div><section' || CASE WHEN o_orderkey % 2 = 0 THEN ' hidden' ELSE '' END || '>b</section><aside>c<aside>d</aside>e</aside><script>f</script><p style=\"display : none\">g<p class=ad>h'",
    _both("CASE WHEN o_orderkey % 3 = 1 THEN 'a' || o_orderkey || CASE WHEN o_orderkey % 2 = 1 THEN '~b' ELSE '' END || '~~' WHEN o_orderkey % 2 = 1 THEN 'b~~' ELSE '' END || 'g~~h'"),
)
made(
    "markdown_landmarks", "orders", "o_orderkey",
    "'<p>menu</p>' || CASE WHEN o_orderkey % 4 = 0 THEN '<main>' WHEN o_orderkey % 4 = 1 THEN '<article>' WHEN o_orderkey % 4 = 2 THEN '<div role=main>' ELSE '<div>' END || 'o' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '</main>' WHEN o_orderkey % 4 = 1 THEN '</article>' ELSE '</div>' END || '<article>more</article>foot'",
    _both("CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE 'o' || o_orderkey || '~~' END || 'more'"),
)


# ---- statistics -----------------------------------------------------------------------------------------------------

@query("SELECT event_type, count(*) AS n, round(median(value), 3) AS median, min(value) AS min, max(value) AS max, CASE WHEN count(*) >= 20 THEN quantile_disc(value, 0.95) END AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1")
def timing_stats(spark, sf_dir):
    return stats.timing_stats(read(spark, sf_dir, "events"), ["event_type"], "value")


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: a scenario for each type and day, the type of the day before as reference."""
    e = read(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts")).withColumn("valid", F.col("user_id") % 7 != 0).withColumn("reason", F.concat(F.lit("user "), F.col("user_id") % 7))
    s = stats.scenario_verdicts(e, ["event_type", "day"], "value", "valid", F.lit(60.0))
    return s.withColumn("scenario", F.concat_ws("/", "event_type", "day")).withColumn("bounded_vs", F.when(F.col("day") > 1, F.concat_ws("/", F.col("event_type"), F.col("day") - 1)))


SCENARIOS = """
WITH s AS (SELECT event_type, day(ts) AS d, count(*) AS runs, count(*) FILTER (WHERE user_id % 7 <> 0) AS valid_runs, median(value) FILTER (WHERE user_id % 7 <> 0) AS median,
  count(*) FILTER (WHERE user_id % 7 = 0) > 0 AS reasoned FROM events GROUP BY 1, 2),
v AS (SELECT *, event_type || '/' || d AS scenario, CASE WHEN d > 1 THEN event_type || '/' || (d - 1) END AS bounded_vs,
  CASE WHEN valid_runs < 10 THEN 'INVALID' WHEN median <= 60 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s)
"""


@query(SCENARIOS + "SELECT scenario, runs, valid_runs, median, CASE WHEN reasoned THEN 'user 0' ELSE '' END AS reasons, verdict FROM v")
def scenario_verdicts(spark, sf_dir):
    return _scenarios(spark, sf_dir).select("scenario", "runs", "valid_runs", "median", F.array_join("reasons", ",").alias("reasons"), "verdict")


@query(SCENARIOS + "SELECT max(median) AS gating_peak, count(*) AS scenarios FROM v WHERE event_type <> 'view' AND verdict <> 'INVALID'")
def gating_peak(spark, sf_dir):
    return stats.gating_peak(_scenarios(spark, sf_dir), F.col("event_type") != "view")


@query(SCENARIOS + """SELECT a.scenario, a.bounded_vs, round(a.median / b.median, 3) AS ratio, CASE WHEN b.median IS NULL THEN 'incomplete' WHEN a.median / b.median > 1.10 THEN 'over' ELSE 'within' END AS state
FROM v a LEFT JOIN v b ON a.bounded_vs = b.scenario AND b.verdict <> 'INVALID' WHERE a.bounded_vs IS NOT NULL AND a.verdict <> 'INVALID'""")
def boundedness(spark, sf_dir):
    return stats.boundedness(_scenarios(spark, sf_dir), "scenario", "bounded_vs")


@query(SCENARIOS + "SELECT event_type, CASE WHEN bool_or(verdict = 'INVALID') THEN 'INVALID' WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(d = 31) THEN 'INCOMPLETE' ELSE 'PASS' END AS verdict, CASE WHEN bool_or(verdict = 'FAIL') THEN 'do not release' WHEN bool_or(verdict = 'INVALID') THEN 'not decided' ELSE 'release' END AS decision FROM v GROUP BY 1")
def run_verdict(spark, sf_dir):
    s = _scenarios(spark, sf_dir).withColumn("state", F.when(F.col("verdict") == "FAIL", "missed").when(F.col("verdict") == "INVALID", "missing").otherwise("met"))
    any_ = lambda v: F.bool_or(F.col("verdict") == v)
    return s.groupBy("event_type").agg(stats.run_verdict(any_("INVALID"), any_("FAIL"), F.bool_or(F.col("day") == 31)).alias("verdict"), stats.release_decision(F.col("state")).alias("decision"))


MONTHS = "WITH m AS (SELECT c_nationkey AS platform, count(*) AS n, sum(c_acctbal) AS idle, max(c_acctbal) AS peak FROM customer GROUP BY 1), b AS (SELECT c_nationkey AS platform, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE sum(c_acctbal) * 0.8 END AS idle, max(c_acctbal) AS peak FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1)"


@query(MONTHS + """, l AS (SELECT m.platform, unnest(['idle', 'peak']) AS metric, unnest([m.idle, m.peak]) AS current, unnest([b.idle, b.peak]) AS baseline FROM m LEFT JOIN b USING (platform))
SELECT platform, metric, round(current, 6) AS current, round(baseline, 6) AS baseline, CASE WHEN baseline <> 0 THEN round(greatest(baseline * 1.1, baseline + 1536), 6) END AS limit,
CASE WHEN coalesce(baseline, 0) = 0 THEN 'no baseline' WHEN current > greatest(baseline * 1.1, baseline + 1536) THEN 'regression' ELSE 'ok' END AS verdict FROM l""")
def regression_gate(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    now = c.groupBy(F.col("c_nationkey").alias("platform")).agg(F.sum("c_acctbal").alias("idle"), F.max("c_acctbal").alias("peak"))
    old = now.where("platform % 3 <> 0").withColumn("idle", F.when(F.col("platform") % 5 == 0, 0.0).otherwise(F.col("idle") * 0.8))
    r = stats.regression(now, old, "platform", ["idle", "peak"])
    return r.select("platform", "metric", *(F.round(x, 6).alias(x) for x in ("current", "baseline", "limit")), "verdict")


@query("SELECT n_nationkey AS platform, CASE WHEN n_nationkey % 4 = 0 THEN 'new' ELSE 'old' END AS run FROM nation UNION ALL SELECT 100, 'new'")
def baseline_upsert(spark, sf_dir):
    old = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("platform"), F.lit("old").alias("run"))
    new = old.where("platform % 4 = 0").select("platform").union(spark.range(100, 101).select(F.col("id").cast("int"))).withColumn("run", F.lit("new"))
    return stats.upsert(old, new, "platform")


@query("SELECT c AS category, count(event_id) FILTER (WHERE value > 20) AS ok, count(event_id) AS total FROM (SELECT unnest(['click', 'purchase', 'view', 'never']) AS c) LEFT JOIN events ON event_type = c GROUP BY 1")
def smoke_by_category(spark, sf_dir):
    return stats.by_category(read(spark, sf_dir, "events"), "event_type", F.col("value") > 20, ["click", "purchase", "view", "never"]).withColumnRenamed("event_type", "category")


@query("SELECT median(value) FILTER (WHERE event_type = 'click') AS shipped, median(value) FILTER (WHERE event_type = 'view') AS bench, median(value) FILTER (WHERE event_type = 'view') - median(value) FILTER (WHERE event_type = 'click') AS delta, median(value) FILTER (WHERE event_type = 'click') / median(value) FILTER (WHERE event_type = 'view') AS ratio, abs(median(value) FILTER (WHERE event_type = 'click') / median(value) FILTER (WHERE event_type = 'view') - 1) <= 0.1 AS close FROM events")
def public_cross_check(spark, sf_dir):
    return stats.close_medians(read(spark, sf_dir, "events"), "event_type", "value", "click", "view")


@query("SELECT event_id, json_extract_string(props, '$.' || (SELECT min(k) FROM (SELECT unnest(json_keys(props)) AS k))) AS first FROM events WHERE event_id % 5 <> 0")
def jsonl_scan(spark, sf_dir):
    """Events' props as lines of a file, every fifth of them broken in one of two ways."""
    e = read(spark, sf_dir, "events")
    key = json.loads(e.select("props").first()[0])
    name = sorted(key)[0]
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# "), F.col("props"))).when(F.col("event_id") % 5 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return files.json_lines(e.select("event_id", line.alias("line")), f"`{name}` string").select("event_id", F.col(name).alias("first"))


# ---- given rows -----------------------------------------------------------------------------------------------------

given(
    "content_type",
    "id int, ct string",
    [(1, "text/html; charset=x"), (2, "Application/XHTML+xml"), (3, None), (4, ";x"), (5, "image/svg+xml"), (6, "application/vnd.api+json"), (7, "application/pdf"), (8, "x/é y"), (9, " TEXT/plain "), (10, "application/octet-stream")],
    lambda df: df.select("id", content.kind(F.col("ct")).alias("kind"), F.when(content.kind(F.col("ct")) == "unsupported", content.shown_type(F.col("ct"))).alias("shown")),
    "id INT, kind VARCHAR, shown VARCHAR",
    [(1, "html", None), (2, "html", None), (3, "unknown", None), (4, "unknown", None), (5, "text", None), (6, "text", None), (7, "unsupported", "application/pdf"), (8, "unsupported", "x/??y"), (9, "text", None), (10, "unsupported", "application/octet-stream")],
)

#: Urls, and host and port or what is wrong: a bad url, or a target that must not be asked.
_URLS = [
    ("http://tern.test", "tern.test", 80),
    ("HTTPS://Fjord.Test.:8443/a?b#c", "fjord.test", 8443),
    ("https://a-b_c.test/", "a-b_c.test", 443),
    ("http://tern.test\\@puffin.test/", "tern.test", 80),
    ("gopher://tern.test/", "scheme must be http or https"),
    ("tern.test/x", "must be an absolute http or https URL"),
    ("https:tern.test", "must be an absolute http or https URL with a host"),
    ("https:///x", "host is empty"),
    ("https://:80/", "host is empty"),
    ("https://cap:tain@tern.test/", "userinfo (user:password@) is not allowed"),
    ("https://tern\ttest/", "host contains whitespace, control or non-ASCII characters"),
    ("https://höfn.test/", "host contains whitespace, control or non-ASCII characters"),
    ("https://te%72n.test/", "host contains characters that are not allowed"),
    ("https://tern..test/", "malformed host name"),
    ("https://" + "a." * 127 + "test/", "malformed host name"),
    ("https://tern.test:0/", "port 0 is not allowed"),
    ("https://tern.test:70000/", "port out of range"),
    ("https://tern.test:12x/", "invalid port"),
    ("https://tern.test:123456/", "invalid port"),
    ("http://9.9.9.9/", "9.9.9.9", 80),
    ("http://0x9.0x9.011.9/", "9.9.9.9", 80),
    ("http://9.9.2313/", "9.9.9.9", 80),
    ("http://151587081/", "9.9.9.9", 80),
    ("http://9.9.9.9a/", "9.9.9.9a", 80),
    ("http://9.9.9.300/", "invalid numeric host"),
    ("http://9.9.9.9.9/", "invalid numeric host"),
    ("http://09.9.9.9/", "invalid numeric host"),
    ("http://tern.9/", "invalid numeric host"),
    ("http://[2001:4860::8888]:81/", "[2001:4860::8888]", 81),
    ("http://[2001:4860::8888", "unterminated IPv6 bracket"),
    ("http://[2001:4860::8888]81/", "junk after IPv6 address"),
    ("http://[fe80::9%25lo]/", "IPv6 zone identifiers are not allowed"),
    ("http://[2001::4860::1]/", "invalid IPv6 address"),
    ("http://127.9.9.9/", "127.9.9.9", 80, "IP address is not public (loopback)"),
    ("http://0x7f090909/", "127.9.9.9", 80, "IP address is not public (loopback)"),
    ("http://10.9.9.9:8080/", "10.9.9.9", 8080, "IP address is not public (private)"),
    ("http://[::ffff:172.16.9.9]/", "[::ffff:172.16.9.9]", 80, "IP address is not public (private)"),
    ("http://quay.LocalHost./", "quay.localhost", 80, "hostname is not public (loopback)"),
]
given(
    "url_check_corpus",
    "id int, url string",
    [(i, u) for i, (u, *_) in enumerate(_URLS)],
    lambda df: urls.check_urls(df).select("id", "checked.host", "checked.port", "checked.error_code", "checked.error_message"),
    "id INT, host VARCHAR, port INT, error_code VARCHAR, error_message VARCHAR",
    [(i, None, None, "invalid_argument", "url: " + r[0]) if len(r) == 1 else (i, *r, None, None) if len(r) == 2 else (i, *r[:2], "blocked_target", r[2]) for i, (_, *r) in enumerate(_URLS)],
)

given(
    "ip_classify_v6",
    "ip string",
    [(a,) for a in ("::", "::1", "fd00:ec2::254", "fd12::1", "fe80::1", "fec0::1", "ff02::1", "100::1", "2001:db8::1", "2001:0:1::1", "64:ff9b:1::1", "::8.8.8.8", "3fff:1::", "5f00::1", "100:0:0:1::5", "::ffff:127.0.0.1", "::ffff:8.8.8.8", "64:ff9b::10.0.0.1", "2002:a00:1::", "2002:808:808::", "2606:4700::1111", "::ffff:0:192.168.1.1", "168.63.129.16", "1.1.1.1")],
    lambda df: df.select("ip", ip.classify_text(F.col("ip")).alias("b")).select("ip", "b.kind", "b.category"),
    "ip VARCHAR, kind VARCHAR, category VARCHAR",
    [("::", "other", "unspecified"), ("::1", "loopback", "loopback"), ("fd00:ec2::254", "other", "cloud metadata"), ("fd12::1", "other", "unique local"), ("fe80::1", "other", "link-local"), ("fec0::1", "other", "site-local"), ("ff02::1", "other", "multicast"), ("100::1", "other", "discard-only"), ("2001:db8::1", "other", "documentation"), ("2001:0:1::1", "other", "reserved (protocol assignments, Teredo)"), ("64:ff9b:1::1", "other", "reserved (local-use NAT64)"), ("::8.8.8.8", "other", "deprecated IPv4-compatible"), ("3fff:1::", "other", "documentation"), ("5f00::1", "other", "reserved (SRv6 SIDs)"), ("100:0:0:1::5", "other", "reserved (dummy prefix)"), ("::ffff:127.0.0.1", "loopback", "loopback"), ("::ffff:8.8.8.8", None, None), ("64:ff9b::10.0.0.1", "private", "private"), ("2002:a00:1::", "private", "private"), ("2002:808:808::", None, None), ("2606:4700::1111", None, None), ("::ffff:0:192.168.1.1", "private", "private"), ("168.63.129.16", "other", "cloud metadata"), ("1.1.1.1", None, None)],
)

given(
    "charset_header",
    "id int, ct string",
    [(1, "text/html; charset=ISO-8859-1"), (2, 'text/html; charset = "utf-8"'), (3, "text/html; charset=bogus"), (4, "text/html"), (5, "text/html; x=y; charset='shift_jis'"), (6, "text/html; charset="), (7, None)],
    lambda df: df.select("id", content.header_charset(F.col("ct")).alias("charset")),
    "id INT, charset VARCHAR",
    [(1, "windows-1252"), (2, "utf-8"), (3, None), (4, None), (5, "shift_jis"), (6, None), (7, None)],
)

given(
    "body_decode",
    "id int, body binary, charset string",
    [(1, b"caf\xe9", "windows-1252"), (2, b"a\xffb", "utf-8"), (3, b"\xef\xbb\xbfx", "utf-8"), (4, b"\xff\xfea\x00", "windows-1252"), (5, b"\x82\xa0", "shift_jis"), (6, b"\xe2\x82", "utf-8"), (7, b"", "utf-8")],
    lambda df: df.select("id", content.decoded(F.col("body"), F.col("charset")).alias("text")),
    "id INT, text VARCHAR",
    [(1, "café"), (2, "a�b"), (3, "﻿x"), (4, "a"), (5, "あ"), (6, "�"), (7, "")],
)

_GZ = gzip.compress(b"first ", mtime=0)
given(
    "gzip_bodies",
    "id int, body binary",
    [(1, _GZ), (2, _GZ + b"trailing"), (3, _GZ + gzip.compress(b"second", mtime=0)), (4, gzip.compress(b"x" * 1000, mtime=0)), (5, _GZ[:-6]), (6, b"not gzip"), (7, b""), (8, _GZ[:10])],
    lambda df: df.select("id", content.unzipped(F.col("body"), 100).alias("z")).select("id", F.col("z.body").cast("string").alias("text"), "z.error"),
    "id INT, text VARCHAR, error VARCHAR",
    [(1, "first ", None), (2, "first ", None), (3, "first ", None), (4, None, "too_large"), (5, None, "bad_response"), (6, None, "bad_response"), (7, "", None), (8, None, "bad_response")],
)

given(
    "response_heads",
    "id int, headers map<string,array<string>>",
    [(1, {}), (2, {"Content-Encoding": ["gzip"]}), (3, {"content-encoding": ["GZIP ", "gzip"]}), (4, {"Content-Encoding": ["br"]}), (5, {"Content-Encoding": [""]}), (6, {"x": ["y" * 40_000]}), (7, {"x": ["y"] * 65})],
    lambda df: df.select("id", content.gzip_state(content.header(F.col("headers"), "content-encoding")).alias("coding"), content.headers_too_large(F.col("headers")).alias("too_large")),
    "id INT, coding VARCHAR, too_large BOOLEAN",
    [(1, "identity", False), (2, "gzip", False), (3, "unsupported", False), (4, "unsupported", False), (5, "identity", False), (6, "identity", True), (7, "identity", True)],
)

_UA = "page-reader/1.2.3"
_ROBOTS = [
    ("", "/x", True), ("User-agent: *\nDisallow: /private", "/private/a", False), ("User-agent: *\nDisallow: /private", "/public", True), ("User-agent: *\nDisallow:", "/x", True),
    ("User-agent: *\nDisallow: /\nAllow: /ok", "/ok/1", True), ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True), ("User-agent: page\nDisallow: /\n\nUser-agent: *\nDisallow:", "/x", False),
    ("User-agent: other\nDisallow: /", "/x", True), ("User-agent: a\nUser-agent: *\nDisallow: /p # note", "/p", False), ("Disallow: /\nUser-agent: *\nAllow: /", "/x", True), ("User-agent: *\nDisallow: /*.pdf", "/a.pdf", True),
    ("User-agent: page\nAllow: /\nUser-agent: page-reader\nDisallow: /", "/x", False), ("user-AGENT: *\r\nDISALLOW: /x\r\n", "/x", False), ("User-agent: *\nDisallow: /", "", False), ("no colon\nUser-agent *\n", "/", True),
]
given(
    "robots_allowed",
    "id int, origin string, body string, path string",
    [(i, f"o{i}", b, p) for i, (b, p, _) in enumerate(_ROBOTS)],
    lambda df: df.join(robots.records(df), "origin").select("id", robots.allowed(F.col("records"), F.lit(_UA), F.col("path")).alias("allowed")),
    "id INT, allowed BOOLEAN",
    [(i, a) for i, (_, _, a) in enumerate(_ROBOTS)],
)

given(
    "argument_checks",
    "id int, args string",
    list(enumerate(['{"url": "http://x", "max_length": 10, "start_index": 0, "raw": true, "more": 1}', '{"url": "u", "max_length": null, "raw": null}', "{}", '{"url": 5}', '{"url": "u", "max_length": 0}', '{"url": "u", "max_length": -1}', '{"url": "u", "max_length": 1.5}', '{"url": "u", "max_length": "5"}', '{"url": "u", "start_index": -3}', '{"url": "u", "raw": "yes"}', '{"url": "u", "start_index": true}', '{"url": null}', "not json", '{"url": "u", "raw": 1, "start_index": -1}'])),
    lambda df: df.select("id", parse_arguments(F.col("args")).alias("a")).select("id", "a.url", "a.max_length", "a.start_index", "a.raw", "a.error_message"),
    "id INT, url VARCHAR, max_length BIGINT, start_index BIGINT, raw BOOLEAN, error_message VARCHAR",
    [
        (0, "http://x", 10, 0, True, None), (1, "u", None, None, False, None), (2, None, None, None, None, "url: is required"), (3, None, None, None, None, "url: must be a string"), (4, None, None, None, None, "max_length: must be at least 1"),
        (5, None, None, None, None, "max_length: must be a non-negative whole number"), (6, None, None, None, None, "max_length: must be a non-negative whole number"), (7, None, None, None, None, "max_length: must be a non-negative whole number"),
        (8, None, None, None, None, "start_index: must be a non-negative whole number"), (9, None, None, None, None, "raw: must be true or false"), (10, None, None, None, None, "start_index: must be a non-negative whole number"), (11, None, None, None, None, "url: is required"),
        (12, None, None, None, None, "url: is required"), (13, None, None, None, None, "raw: must be true or false"),
    ],
)

given(
    "error_text",
    "code string, message string, status int",
    [("invalid_argument", "url: missing", None), ("http_error", None, 404), ("http_error", None, 429), ("http_error", None, 503), ("http_error", None, 300), ("http_error", None, 599), ("internal", "secret", None), ("too_large", errors.TOO_LARGE, None), ("too_many_redirects", errors.TOO_MANY_REDIRECTS, None)],
    lambda df: df.select(errors.tool_text(F.col("code"), F.coalesce("message", errors.http_message(F.col("status")))).alias("text")),
    "text VARCHAR",
    [
        ("error[invalid_argument]: url: missing",), ("error[http_error]: the server refused the request with HTTP status 404 (Not Found); retrying the same URL is unlikely to help",), ("error[http_error]: the server refused the request with HTTP status 429 (Too Many Requests); it may work if retried after a delay",),
        ("error[http_error]: the server failed with HTTP status 503 (Service Unavailable); it may work if retried later",), ("error[http_error]: the server answered with HTTP status 300 (Multiple Choices)",), ("error[http_error]: the server failed with HTTP status 599; it may work if retried later",),
        ("error[internal]: an unexpected internal error occurred; the server is still running, you may retry",), ("error[too_large]: the response is larger than the size limit",), ("error[too_many_redirects]: too many redirects",),
    ],
)

given(
    "attribute_counts",
    "html string",
    [("<img src=a alt='b c' width = \"9\" hidden>",), ("<p =odd = even>",), ("<br/clear/all/>",), ("<ol" + " start=1" * 1023 + ">",), ("<ol" + "\n\tx" * 1200,), ("<em title='<b c d'>",), ("3 < 4 > 2",), ("",)],
    lambda df: df.select(F.pandas_udf(lambda s: s.map(attribute_peak).astype("int64"), "long")("html").alias("n")),
    "n BIGINT",
    [(4,), (1,), (2,), (1023,), (1200,), (2,), (0,), (0,)],
)

given(
    "lcov_gate",
    "file string, line_no int, line string",
    [("f", i, x) for i, x in enumerate(["SF:/w/src/a.rs", "DA:1,1", "DA:2,0", "end_of_record", "SF:/w/src/b.rs", "DA:1,5", "DA:2,7", "end_of_record", "SF:/w/src/a.rs", "DA:9,3", "end_of_record", "DA:1,1"])],
    lambda df: files.coverage_gate(files.coverage(df), df.sparkSession.createDataFrame([("src/a.rs",), ("src/b.rs",)], "file string"), 80.0).withColumn("percent", F.round("percent", 3)),
    "file VARCHAR, hit BIGINT, found BIGINT, percent DOUBLE, overall DOUBLE, passed BOOLEAN",
    [("src/a.rs", 2, 3, 66.667, 80.0, True), ("src/b.rs", 2, 2, 100.0, 80.0, True)],
)

given(
    "toml_dependencies",
    "file string, line_no int, line string",
    [("t", i, x) for i, x in enumerate(["[package]", 'name = "p"', "[dependencies]", 'a = "1"', '"b-c" = { version = "2" }', "# d = 1", "a.features = []", "[dependencies.e]", 'version = "1"', "[dev-dependencies]", 'f = "1"'])],
    files.dependencies,
    "file VARCHAR, name VARCHAR",
    [("t", "a"), ("t", "b-c"), ("t", "e")],
)

given(
    "url_list_scan",
    "file string, line_no int, line string",
    [("l", i, x) for i, x in enumerate(["# c", "", "https://a.com/#x tls", "https://b.com", "https://c.com json extra", "https://d.com nope"], 1)],
    lambda df: files.url_list(df, ["tls", "json"]).select("line_no", "url", "category", "problem"),
    "line_no INT, url VARCHAR, category VARCHAR, problem VARCHAR",
    [(3, "https://a.com/#x", "tls", None), (4, "https://b.com", None, None), (5, None, None, "line 5: expected 'URL [category]', got 3 fields"), (6, None, None, "line 6: unknown category 'nope' (use one of tls, json)")],
)

given(
    "url_list_problems",
    "line_no int, url string, category string",
    [(1, "https://a.com", "tls"), (2, "https://a.com", None), (3, "http://b.com", None), (4, "https://u@c.com/", None), (5, "https://8.8.8.8/", None), (6, "ftp://x", None)],
    lambda df: files.list_problems(df, 10, ["tls", "json"]),
    "problem VARCHAR",
    [("line 2: duplicate URL",), ("line 3: must be https",), ("line 4: URL has userinfo",), ("line 5: IP-literal host",), ("line 6: not an absolute http(s) URL",), ("the list has 6 URLs; exactly 10 are needed",), ("no URL is tagged with category json",)],
)
