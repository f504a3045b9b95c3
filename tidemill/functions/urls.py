"""URL checks as columns: scheme, authority, port, host and the host's address, with the error that a bad one gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ip
from .bind import bound

_NUMERIC_END = r"(^|\.)([0-9]+|0[xX][0-9a-fA-F]*)$"
LONGEST_HOST = 253


def _number(part: Column) -> Column:
    """A part of an IPv4 address, hex, octal or decimal; null if it is no number or too large for any part."""
    hexa, octal = part.rlike("^0[xX]"), part.rlike("^0.")
    digits = F.ltrim(F.when(hexa, F.substring(part, 3, F.length(part))).when(octal, F.substring(part, 2, F.length(part))).otherwise(part), F.lit("0"))
    valid = F.when(hexa, part.rlike("^0[xX][0-9a-fA-F]*$")).when(octal, part.rlike("^0[0-7]+$")).otherwise(part.rlike("^[0-9]+$"))
    fits = F.length(digits) <= F.when(hexa, 8).when(octal, 11).otherwise(10)
    value = F.when(hexa, F.conv(digits, 16, 10)).when(octal, F.conv(digits, 8, 10)).otherwise(digits)
    return F.when(valid & fits, F.when(digits == "", F.lit("0")).otherwise(value).cast("long"))


def v4_numbers(host: Column) -> Column:
    """The numbers of a host's parts, null for parts that are none; bind it before folded_v4()."""
    return F.transform(F.split(host, r"\."), _number)


def folded_v4(numbers: Column) -> Column:
    """The address that the numbers of one to four parts mean; null if they mean none."""
    n, last = F.size(numbers), F.element_at(numbers, -1)
    heads = F.slice(numbers, F.lit(1), F.greatest(n - 1, F.lit(0)))
    head = F.aggregate(heads, F.lit(0).cast("long"), lambda v, p: v * 256 + p)
    room = F.element_at(F.array(*(F.lit(256 ** (5 - k)).cast("long") for k in range(1, 5))), F.least(F.greatest(n, F.lit(1)), F.lit(4)))
    good = (n <= 4) & ~F.exists(numbers, lambda p: p.isNull()) & ~F.exists(heads, lambda p: p > 255) & (last < room)
    return F.when(good, head * room + last)


def canonical_name(host: Column) -> Column:
    return F.lower(F.regexp_replace(host, r"\.$", ""))


def check_urls(df: DataFrame, url_col: str = "url", allow_loopback: bool = False, redirect: bool = False, out: str = "checked") -> DataFrame:
    """Adds `out`: struct<https, host_kind, host, ip, hi, lo, port, error_code, error_message>.

    host_kind is name, v4 or v6; ip is the long of a v4 address, hi and lo the words of a v6 one. A url that breaks a
    rule has an error instead: the first rule in order decides. A bad url is an invalid argument, or a blocked target
    where it comes from a redirect. Null urls are bad. Only v6 hosts are parsed in Python; other columns of df stay.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    scheme = F.lower(F.when(url.contains(":"), F.substring_index(url, ":", 1)))
    rest = F.regexp_extract(url, r"(?s)^[^:]*:(.*)$", 1)
    t = bound(df, _cu_u=url, _cu_scheme=scheme, _cu_rest=rest, _cu_auth=F.regexp_extract(rest, r"(?s)^//([^/?#\\]*)", 1))
    bracket = F.startswith("_cu_auth", F.lit("["))
    host = F.when(bracket, F.regexp_extract("_cu_auth", r"(?s)^(\[[^\]]*\])", 1)).otherwise(F.substring_index("_cu_auth", ":", 1))
    t = bound(t, _cu_host=host)
    tail = F.expr("substring(_cu_auth, length(_cu_host) + 1)")
    t = bound(t, _cu_tail=tail, _cu_port=F.regexp_extract(tail, r"(?s)^:(.*)$", 1), _cu_bare=F.regexp_replace("_cu_host", r"\.$", ""))
    port = F.when(F.col("_cu_port") == "", F.when(F.col("_cu_scheme") == "https", 443).otherwise(80)).when(F.col("_cu_port").rlike("^[0-9]{1,5}$"), F.col("_cu_port").try_cast("int"))
    numeric = ~bracket & F.col("_cu_bare").rlike("^[A-Za-z0-9._-]+$") & F.col("_cu_bare").rlike(_NUMERIC_END)
    t = bound(t, _cu_portn=port, _cu_numbers=F.when(numeric, v4_numbers(F.col("_cu_bare"))))
    t = t.withColumn("_cu_v6", ip.v6_words(F.when(bracket, F.regexp_extract("_cu_host", r"^\[(.*)\]$", 1))))
    t = bound(t, _cu_v4=folded_v4(F.col("_cu_numbers")))

    bad = (
        F.when(~F.col("_cu_u").contains(":"), "must be an absolute http or https URL")
        .when(~F.col("_cu_scheme").isin("http", "https"), "scheme must be http or https")
        .when(~F.startswith("_cu_rest", F.lit("//")), "must be an absolute http or https URL with a host")
        .when(F.col("_cu_auth") == "", "host is empty")
        .when(F.col("_cu_auth").contains("@"), "userinfo (user:password@) is not allowed")
        .when(F.col("_cu_auth").rlike(r"[^\x21-\x7e]"), "host contains whitespace, control or non-ASCII characters")
        .when(bracket & (F.col("_cu_host") == ""), "unterminated IPv6 bracket")
        .when(bracket & (F.col("_cu_tail") != "") & ~F.startswith("_cu_tail", F.lit(":")), "junk after IPv6 address")
        .when(F.col("_cu_portn").isNull(), "invalid port")
        .when(F.col("_cu_portn") == 0, "port 0 is not allowed")
        .when(F.col("_cu_portn") > 65535, "port out of range")
        .when(bracket & F.col("_cu_host").contains("%"), "IPv6 zone identifiers are not allowed")
        .when(bracket & F.col("_cu_v6.hi").isNull(), "invalid IPv6 address")
        .when(F.col("_cu_host") == "", "host is empty")
        .when(~bracket & F.col("_cu_host").rlike("[^A-Za-z0-9._-]"), "host contains characters that are not allowed")
        .when(~bracket & ((F.col("_cu_bare") == "") | F.col("_cu_bare").rlike(r"^\.|\.\.|\.$") | (F.length("_cu_bare") > LONGEST_HOST)), "malformed host name")
        .when(~bracket & F.col("_cu_bare").rlike(_NUMERIC_END) & F.col("_cu_v4").isNull(), "invalid numeric host")
    )
    t = bound(t, _cu_bad=bad, _cu_kind=F.when(bracket, "v6").when(F.col("_cu_v4").isNotNull(), "v4").otherwise("name"))
    blocked = F.when(F.col("_cu_kind") == "v4", ip.classify_v4(F.col("_cu_v4"))).when(F.col("_cu_kind") == "v6", ip.classify_v6(F.col("_cu_v6.hi"), F.col("_cu_v6.lo")))
    t = bound(t, _cu_name=F.when(F.col("_cu_kind") == "name", F.lower("_cu_bare")), _cu_blocked=blocked)
    refused = F.when(F.col("_cu_blocked").isNotNull() & ~((F.col("_cu_blocked.kind") == "loopback") & F.lit(allow_loopback)), F.concat(F.lit("IP address is not public ("), F.col("_cu_blocked.category"), F.lit(")")))
    if not allow_loopback:
        refused = F.coalesce(refused, F.when((F.col("_cu_name") == "localhost") | F.endswith("_cu_name", F.lit(".localhost")), F.lit("hostname is not public (loopback)")))
    t = bound(t, _cu_refused=F.when(F.col("_cu_bad").isNull(), refused))
    ok = F.col("_cu_bad").isNull()
    host = F.when(F.col("_cu_kind") == "name", F.col("_cu_name")).when(F.col("_cu_kind") == "v4", ip.v4_text(F.col("_cu_v4"))).otherwise(F.lower("_cu_host"))
    code = F.when(~ok, F.lit("blocked_target" if redirect else "invalid_argument")).when(F.col("_cu_refused").isNotNull(), F.lit("blocked_target"))
    message = F.coalesce(F.col("_cu_bad") if redirect else F.concat(F.lit("url: "), F.col("_cu_bad")), F.col("_cu_refused"))
    checked = F.struct(
        F.when(ok, F.col("_cu_scheme") == "https").alias("https"),
        F.when(ok, F.col("_cu_kind")).alias("host_kind"),
        F.when(ok, host).alias("host"),
        F.when(ok, F.col("_cu_v4")).alias("ip"),
        F.when(ok, F.col("_cu_v6.hi")).alias("hi"),
        F.when(ok, F.col("_cu_v6.lo")).alias("lo"),
        F.when(ok, F.col("_cu_portn")).alias("port"),
        code.alias("error_code"),
        message.alias("error_message"),
    )
    return bound(t, **{out: checked}).select(*(F.col(f"`{c}`") for c in df.columns if c != out), out)


def authority(checked: Column) -> Column:
    """host[:port] of a checked url, the port only where it isn't the scheme's own."""
    default = F.when(checked["https"], 443).otherwise(80)
    return F.concat(checked["host"], F.when(checked["port"] == default, "").otherwise(F.concat(F.lit(":"), checked["port"].cast("string"))))


def origin(checked: Column) -> Column:
    return F.concat(F.when(checked["https"], "https://").otherwise("http://"), authority(checked))


def path(url: Column) -> Column:
    """The path of an absolute url, / for an empty one."""
    p = F.regexp_extract(F.replace(url, F.lit("\\"), F.lit("/")), r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def shown(url: Column) -> Column:
    """The url without userinfo and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^([^:]*://)[^/?#@]*@", "$1")


def resolve_location(base: Column, link: Column) -> Column:
    """A redirect's target as seen from the url it came from."""
    site = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    link = F.trim(link)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(F.substring_index(base, ":", 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path(base), link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), link))
        .otherwise(F.concat(site, folder, link))
    )
