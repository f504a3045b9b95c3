"""URL filters: block decisions reach the aliases of a page over redirect and canonical-link edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import connected_components

#: Fixed values: (verdict, host, path) of the rules that op8 applies.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules are constants of the plan, met by each row; over this many, a table of them would have to be joined instead.
MOST_RULES = 1000


def after_scheme(url: Column) -> Column:
    """What stands after the first ://, null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(C.ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """The path without `.` and `..` segments, the latter with what they lead out of."""
    parts = F.split(F.regexp_replace(path, r"/\.{1,2}$", "$0/"), "/")
    step = lambda kept, p: F.when(p == ".", kept).when(p == "..", F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))).otherwise(F.concat(kept, F.array(p)))
    walked = F.aggregate(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), F.slice(parts, 1, 1), step)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.array_join(walked, "/")).otherwise(path)


def resource(url: Column) -> Column:
    """The url that names the same resource for sure: scheme and host in lower case, without default port, dot segments
    and the fragment."""
    scheme = C.ascii_lower(F.substring_index(url, "://", 1))
    host = host_of(url)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path, query = path_of(url), F.regexp_extract(after_scheme(url), r"^[^?#]*([^#]*)", 1)
    return F.coalesce(F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(without_dots(path)), query), url)


def resolved(base: Column, link: Column) -> Column:
    """link as seen from the page base; resource() takes its dot segments out."""
    link = F.replace(F.btrim(link, F.lit(C.SPACE)), F.lit("&amp;"), F.lit("&"))
    scheme = F.substring_index(base, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"^(.*/)[^/]*$", 1)
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path_of(base), link))
        .when(link.startswith("#"), F.lit(None))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def targets_of(html: Column) -> Column:
    """The links of a page's canonical tags and refresh redirects, unresolved."""
    quoted = r"""=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = lambda tag, name: F.concat(*(F.regexp_extract(tag, rf"(?is)\b{name}\s*{quoted}", i) for i in (1, 2, 3)))
    canonical = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), lambda t: F.rlike(value(t, "rel"), F.lit(r"(?i)(^|\s)canonical(\s|$)")))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.rlike(value(t, "http-equiv"), F.lit(r"(?i)^\s*refresh\s*$")))
    target = F.transform(refresh, lambda t: F.regexp_extract(value(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"']+)""", 1))
    return F.concat(F.transform(canonical, lambda t: value(t, "href")), target)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict>: the longest rule that fits; of rules for the same host and path, allow counts. Null if none
    fits. The rules are constants of the expression: nothing is joined, and no url of the input goes to the driver."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are constants of a plan")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    ordered = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow"), reverse=True)
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
    return F.coalesce(*(F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Verdicts on all rows of pages: _id, host, path, rule, verdict, alias_of (the least url of the page's class, null
    for a page without edges).

    A rule fits its host and all subdomains where the path starts with the rule's; the longest wins, and its verdict
    stands. Pages without one take part in the class of their aliases: urls joined by canonical links and refresh
    redirects in the html, and by redirects (from_url, to_url), in any number of steps; fragments don't tell resources
    apart. Such a page is blocked if a rule blocks a url of its class and none allows one there; else it is allowed.

    Null url or one without ://: empty host and path, no rule, no aliases, allowed. Null html: no links. Repeated rows
    get equal verdicts. An empty table gives an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    url, html = F.col(url_col).cast("string"), (F.col(html_col).cast("string") if html_col else F.lit(None).cast("string"))
    src = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("_host"), path_of(url).alias("_path"), F.when(F.locate("://", url) > 0, resource(url)).alias("_node"))
    named = pages.select(url.alias("_url"), targets_of(html).alias("_to")).where(F.size("_to") > 0).where("_url LIKE '%://%'")
    edges = named.select(resource(F.col("_url")).alias("a"), F.explode(F.transform("_to", lambda t: resource(resolved(F.col("_url"), t)))).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(resource(F.col("from_url").cast("string")), resource(F.col("to_url").cast("string"))))
    classes = connected_components(edges.where("a LIKE '%://%' AND b LIKE '%://%'"))

    members = C.written(classes.select("node", "component", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules).alias("_r")), "aliases")
    decided = members.where("_r IS NOT NULL").groupBy("component").agg(F.when(F.bool_or(F.col("_r.verdict") == "allow"), "allow").otherwise("block").alias("_class_verdict"))
    decided = C.written(decided, "alias-verdicts")
    aliases = members.join(decided, "component", "left").select(F.col("node").alias("_alias"), F.col("component").alias("alias_of"), "_class_verdict")
    aliases = C.written(aliases, "alias-classes")

    # Rows without a url have keys of their own, which match nothing and are no heavy one.
    key = F.coalesce("_node", F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string")))
    out = src.withColumn("_r", rule_of(F.col("_host"), F.col("_path"), rules)).withColumn("_key", key)
    out = out.join(aliases, F.col("_key") == F.col("_alias"), "left")
    return out.select("_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", "_class_verdict", F.lit("allow")).alias("verdict"), "alias_of")


def op8_redirect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(C.read(spark, sf_dir, "pages"), RULES)
    return out.select(F.col("_id").alias("page_id"), "host", "path", "rule", "verdict")
