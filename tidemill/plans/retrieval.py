"""Requests to results: check, resolve, look up, follow redirects, decode, convert, cut, render.

The tables that requests meet are plain relations: dns (host, ord, ip), responses (url, status, headers, body) and
robots (origin, body). Nothing here is stateful, so the same plan runs on a stream of requests.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import content, errors, text, urls
from ..functions.bind import bound
from ..functions.arguments import parse_arguments
from ..functions.markdown import markdown_of
from ..operators import policy as hosts
from ..operators import robots as robots_rules
from ..operators.redirects import MOST_REDIRECTS, STATUSES


@dataclass(frozen=True)
class Settings:
    policy: hosts.Policy = field(default_factory=hosts.Policy)
    cap_bytes: int = 10 * 1024 * 1024
    length_cap: int = 1_000_000
    enforce_robots: bool = False
    agent: str = "tidemill/0.1"


ERROR = "struct<code: string, message: string>"


def _failure(when: Column, code: Column | str, message: Column | str) -> Column:
    """struct<code, message> where `when` holds, else null. A row's error is the first of several, by coalesce()."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(lit(code).alias("code"), lit(message).alias("message")))


def _key(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def targets(df: DataFrame, url: str, answers: DataFrame, settings: Settings, redirect: bool) -> DataFrame:
    """Adds site, the url's origin, and error: what is wrong with the url itself or with its host's answers."""
    c, kept = F.col("checked"), df.columns
    df = urls.check_urls(df, url, settings.policy.allow_loopback, redirect)
    # Plain columns from here on: fields of a struct don't pass through generators and joins as well.
    df = df.select(*kept, c["error_code"].alias("_code"), c["error_message"].alias("_message"), F.when(c["host_kind"] == "name", c["host"]).alias("_host"), urls.origin(c).alias("site"))
    answers = answers.select(F.col("host").alias("_known"), F.col("error_code").alias("_dns_code"), F.col("error_message").alias("_dns_message"))
    df = df.withColumn("_name", F.when(F.col("_code").isNull(), F.col("_host"))).join(answers, F.col("_name") == F.col("_known"), "left")
    bad = _failure(F.col("_code").isNotNull(), F.col("_code"), F.col("_message"))
    unknown = _failure(F.col("_name").isNotNull() & F.col("_known").isNull(), "dns_failure", errors.NO_DNS)
    refused = _failure(F.col("_dns_code").isNotNull(), F.col("_dns_code"), F.col("_dns_message"))
    return df.select(*kept, "site", F.coalesce(bad, unknown, refused).alias("error"))


def redirect_edges(responses: DataFrame, dns: DataFrame, settings: Settings) -> DataFrame:
    """(_from, _to, _to_error): each redirect with its target checked, once however many requests come by. Every hop
    joins it, so it is kept in memory and on disk until it is unpersisted; an executor that is lost has its part made
    again."""
    return _edges(responses, hosts.resolve(dns, settings.policy, redirect=True), settings)


def _edges(responses: DataFrame, answers: DataFrame, settings: Settings) -> DataFrame:
    location = F.element_at(content.header(F.col("headers"), "location"), 1)
    moved = responses.where(F.col("status").isin(*STATUSES) & ~content.headers_too_large(F.col("headers")))
    moved = moved.select(_key(F.col("url")).alias("_from"), urls.resolve_location(F.col("url"), location).alias("_to")).where("_to IS NOT NULL")
    return targets(moved, "_to", answers, settings, redirect=True).select("_from", "_to", F.col("error").alias("_to_error")).persist(StorageLevel.MEMORY_AND_DISK)


def followed(df: DataFrame, edges: DataFrame) -> DataFrame:
    """current, redirects and error after the redirects. Edges are followed among themselves, a join for each hop; the
    rows of df meet the ends of their chains in one join. Where there are no redirects, Spark finds the joins empty."""
    step = edges.select(F.col("_from").alias("_at"), F.col("_to").alias("_next"), F.col("_to_error").alias("_next_error"))
    chain = edges.select("_from", F.col("_to").alias("_end"), F.lit(1).alias("_hops"), F.col("_to_error").alias("_end_error"))
    on = lambda more: F.when(F.col("_end_error").isNull() & more, _key(F.col("_end"))) == F.col("_at")
    for _ in range(MOST_REDIRECTS - 1):
        chain = chain.join(step, on(F.lit(True)), "left")
        chain = chain.select("_from", F.coalesce("_next", "_end").alias("_end"), (F.col("_hops") + F.col("_next").isNotNull().cast("int")).alias("_hops"), F.coalesce("_end_error", "_next_error").alias("_end_error"))
    chain = chain.join(step.select("_at"), on(F.col("_hops") == MOST_REDIRECTS), "left")
    chain = chain.select("_from", "_end", "_hops", F.coalesce("_end_error", _failure(F.col("_at").isNotNull(), "too_many_redirects", errors.TOO_MANY_REDIRECTS)).alias("_end_error"))
    keep = [c for c in df.columns if c not in ("current", "redirects", "error")]
    df = df.join(chain, F.when(F.col("error").isNull(), _key(F.col("current"))) == F.col("_from"), "left")
    return df.select(*keep, F.coalesce("_end", "current").alias("current"), (F.col("redirects") + F.coalesce("_hops", F.lit(0))).alias("redirects"), F.coalesce("error", "_end_error").alias("error"))


def answered(df: DataFrame, responses: DataFrame, cap: int) -> DataFrame:
    """The response at the end of the chain, its head judged: size, status, coding, media type, declared length."""
    r = responses.select(_key(F.col("url")).alias("_url"), "status", "headers", "body")
    df = df.join(r, F.when(F.col("error").isNull(), _key(F.col("current"))) == F.col("_url"), "left")
    head = lambda name: content.header(F.col("headers"), name)
    df = bound(df, content_type=F.element_at(head("content-type"), 1), coding=content.gzip_state(head("content-encoding")), declared=F.element_at(head("content-length"), 1).try_cast("long"), large_head=content.headers_too_large(F.col("headers")))
    df = bound(df, kind=content.kind(F.col("content_type")), header_charset=content.header_charset(F.col("content_type")))
    error = F.coalesce(
        F.col("error"),
        _failure(F.col("_url").isNull(), "network_error", errors.NO_CONNECTION),
        _failure(F.col("large_head"), "bad_response", errors.LARGE_HEADERS),
        _failure(~F.col("status").between(200, 299), "http_error", errors.http_message(F.col("status"))),
        _failure(F.col("coding") == "unsupported", "unsupported_encoding", "the response uses a content encoding that is not supported"),
        _failure(F.col("kind") == "unsupported", "unsupported_content_type", errors.unsupported_message(content.shown_type(F.col("content_type")))),
        _failure(F.col("declared") > cap, "too_large", errors.TOO_LARGE),
        _failure(F.octet_length("body") > cap, "too_large", errors.TOO_LARGE),
    )
    return bound(df, error=error).drop("_url", "headers", "declared", "large_head")


def converted(df: DataFrame, settings: Settings) -> DataFrame:
    """Adds content: the body unzipped, decoded and, for HTML that isn't asked for raw, converted as far as the window
    needs."""
    cap, upto = settings.cap_bytes, F.col("start_index") + text.effective_length(F.col("max_length"), settings.length_cap) + 1
    good, zipped = F.col("error").isNull(), F.col("coding") == "gzip"
    df = df.withColumn("_z", content.unzipped(F.when(good & zipped, F.col("body")), cap))
    df = df.withColumn("_bytes", F.when(good, F.when(zipped, F.col("_z.body")).otherwise(F.coalesce("body", F.lit(b"")))))
    sniffed = F.when((content.essence(F.col("content_type")) == "text/html") & F.col("header_charset").isNull(), F.substring("_bytes", 1, content.SNIFFED_BYTES))
    df = df.withColumn("charset", F.coalesce("header_charset", content.meta_charset(sniffed), F.lit("utf-8")))
    df = df.withColumn("_text", content.decoded(F.col("_bytes"), F.col("charset")))
    df = df.withColumn("_page", ~F.col("raw") & ((F.col("kind") == "html") | ((F.col("kind") == "unknown") & content.looks_like_html(F.substring("_text", 1, 512)))))
    html = F.when(F.col("kind") == "unknown", F.regexp_replace("_text", r"^\x{FEFF}", "")).otherwise(F.col("_text"))
    df = df.withColumn("_md", markdown_of(F.when(F.col("_page"), html), F.col("current"), upto))
    error = F.coalesce(
        F.col("error"),
        _failure(F.col("_z.error") == "too_large", "too_large", errors.TOO_LARGE),
        _failure(F.col("_z.error").isNotNull(), "bad_response", errors.CORRUPT_GZIP),
        _failure(F.col("_page") & F.col("_md.error").isNotNull(), "converter_limit", errors.CONVERTER_LIMIT),
    )
    return df.withColumn("error", error).withColumn("content", F.when(F.col("_page"), F.col("_md.markdown")).otherwise(F.col("_text"))).drop("_z", "_bytes", "_text", "_page", "_md", "body")


def run(requests: DataFrame, dns: DataFrame, responses: DataFrame, robots: DataFrame | None = None, settings: Settings | None = None, edges: DataFrame | None = None) -> DataFrame:
    """requests (request_id, args: a JSON object) to request_id, url, final_url, status, redirects, error_code, returned,
    more, total, text: what the caller gets, error or window. One row for each request, in no order.

    responses has one row for each url; dns any number for each host. A failed request is a row like others. Redirects
    are checked once each and followed among themselves. edges are redirect_edges() of the same tables, for a caller who
    wants to unpersist them afterwards. Nothing runs before the result is read.
    """
    settings = settings or Settings()
    answers = hosts.resolve(dns, settings.policy)
    after = answers if not settings.policy.private_hosts else hosts.resolve(dns, settings.policy, redirect=True)
    a = F.col("_a")
    df = bound(requests.select("request_id", "args"), _a=parse_arguments(F.col("args")))
    bad = _failure(a["error_code"].isNotNull(), a["error_code"], a["error_message"])
    df = df.select("request_id", a["url"].alias("url"), a["max_length"].alias("max_length"), F.coalesce(a["start_index"], F.lit(0)).alias("start_index"), F.coalesce(a["raw"], F.lit(False)).alias("raw"), bad.alias("bad_arguments"))
    df = targets(df, "url", answers, settings, redirect=False)
    error = F.coalesce("bad_arguments", "error")
    if settings.enforce_robots and robots is not None:
        rules = robots_rules.records(robots).select(F.col("origin").alias("_origin"), "records")
        df = df.join(rules, F.when(error.isNull(), F.col("site")) == F.col("_origin"), "left")
        path = urls.path(F.col("url"))
        error = F.coalesce(error, _failure(~robots_rules.allowed(F.col("records"), F.lit(settings.agent), path), "robots_disallowed", F.concat(F.lit("robots.txt disallows fetching "), path)))
    df = df.select("request_id", "url", "max_length", "start_index", "raw", F.col("url").alias("current"), F.lit(0).alias("redirects"), error.alias("error"))
    df = followed(df, _edges(responses, after, settings) if edges is None else edges)
    df = converted(answered(df, responses, settings.cap_bytes), settings)
    df = df.withColumn("window", text.window(F.col("content"), F.col("start_index"), text.effective_length(F.col("max_length"), settings.length_cap)))
    shown = text.with_header(text.render(F.col("window"), text.clamped_to(F.col("max_length"), settings.length_cap)), F.col("redirects"), urls.shown(F.col("current")), F.col("status"))
    ok = F.col("error").isNull()
    return df.select(
        "request_id",
        "url",
        F.when(ok, F.col("current")).alias("final_url"),
        F.when(ok, F.col("status")).alias("status"),
        "redirects",
        F.col("error.code").alias("error_code"),
        F.when(ok, F.col("window.returned")).alias("returned"),
        F.when(ok, F.col("window.more")).alias("more"),
        F.when(ok, F.col("window.total")).alias("total"),
        F.when(ok, shown).otherwise(errors.tool_text(F.col("error.code"), F.col("error.message"))).alias("text"),
    )


def render_pages(pages: DataFrame, start: int = 0, length: int = text.DEFAULT_LENGTH) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, returned, more, total, text: the plan's end for pages at hand."""
    md = pages.select("page_id", "url", markdown_of(F.col("html"), F.col("url"), F.lit(start + length + 1)).alias("_md"))
    w = md.select("page_id", "url", text.window(F.col("_md.markdown"), F.lit(start), F.lit(length)).alias("_w"))
    return w.select("page_id", "url", "_w.returned", "_w.more", "_w.total", text.render(F.col("_w")).alias("text"))
