"""What a response holds: media type, encoding, size, character set, and the text after decoding."""

from __future__ import annotations

import codecs
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE

# Media types that are text, and caps.
TEXT_TYPES = ["application/json", "application/xml", "application/javascript", "application/x-javascript", "application/ecmascript", "application/x-ndjson"]
MOST_HEADERS, HEADER_BYTES = 64, 32 * 1024
SNIFFED_BYTES = 1024

#: Labels whose meaning on the web is another than in Python's codecs.
WEB_LABELS = {
    "windows-1252": "ansi_x3.4-1968 ascii cp1252 cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii windows-1252 x-cp1252",
    "windows-1254": "cp1254 csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5 windows-1254 x-cp1254",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874",
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "utf-16le": "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le",
    "utf-16be": "unicodefffe utf-16be",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "shift_jis": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "euc-jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso-2022-jp": "csiso2022jp iso-2022-jp",
    "euc-kr": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "ibm866": "866 cp866 csibm866 ibm866",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
}
#: Families that are named alike: windows-125n and iso-8859-n, n as given.
WINDOWS_PAGES = (1250, 1251, 1253, 1255, 1256, 1257, 1258)
ISO_PARTS = (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)
PYTHON_CODECS = {"windows-874": "cp874", "macintosh": "mac_roman", "shift_jis": "cp932", "euc-kr": "cp949", "big5": "big5hkscs", "gbk": "gb18030", "iso-8859-8-i": "iso8859-8"}


def _labels() -> dict[str, str]:
    out = {label: name for name, labels in WEB_LABELS.items() for label in labels.split()}
    for n in WINDOWS_PAGES:
        out |= dict.fromkeys((f"windows-{n}", f"cp{n}", f"x-cp{n}"), f"windows-{n}")
    for n in ISO_PARTS:
        out |= dict.fromkeys((f"iso-8859-{n}", f"iso8859-{n}", f"iso8859{n}", f"iso_8859-{n}"), f"iso-8859-{n}")
    for n, k in ((2, 2), (3, 3), (4, 4), (10, 6)):
        out |= dict.fromkeys((f"latin{k}", f"l{k}", f"csisolatin{k}"), f"iso-8859-{n}")
    return out | {"latin-9": "iso-8859-15", "l9": "iso-8859-15", "cyrillic": "iso-8859-5", "arabic": "iso-8859-6", "greek": "iso-8859-7", "greek8": "iso-8859-7", "hebrew": "iso-8859-8", "visual": "iso-8859-8", "iso-8859-8-i": "iso-8859-8-i", "logical": "iso-8859-8-i"}


LABELS = _labels()


def essence(content_type: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(content_type, ";", 1), rf"^[{WHITE}]+|[{WHITE}]+$", ""))


def kind(content_type: Column) -> Column:
    """html, text, unknown (to be sniffed) or unsupported."""
    e = F.coalesce(essence(content_type), F.lit(""))
    return (
        F.when(e == "", "unknown")
        .when(e.isin("text/html", "application/xhtml+xml"), "html")
        .when(e.startswith("text/") | e.isin(*TEXT_TYPES) | e.endswith("+json") | e.endswith("+xml"), "text")
        .otherwise("unsupported")
    )


def shown_type(content_type: Column) -> Column:
    """The media type for a message: 100 characters, printable ASCII."""
    return F.regexp_replace(F.substring(essence(content_type), 1, 100), r"[^\x21-\x7e]", "?")


def looks_like_html(text: Column) -> Column:
    return text.rlike(rf"(?i)^[{WHITE}\x{{FEFF}}]*(<!doctype html($|[{WHITE}>])|<(html|head|body)($|[{WHITE}>/]))")


def gzip_state(encodings: Column) -> Column:
    """From the values of Content-Encoding: gzip, identity, or unsupported (two headers, or any other coding)."""
    v = F.lower(F.trim(F.element_at(encodings, 1)))
    none = encodings.isNull() | (F.size(encodings) == 0)
    return F.when(none, "identity").when(F.size(encodings) > 1, "unsupported").when(v.isin("", "identity"), "identity").when(v == "gzip", "gzip").otherwise("unsupported")


def headers_too_large(headers: Column) -> Column:
    """Of a map of name to values: over 64 values, or over 32 KiB of names and values."""
    flat = F.flatten(F.transform(F.map_entries(headers), lambda e: F.transform(e["value"], lambda v: F.octet_length(e["key"]) + F.octet_length(v))))
    return F.coalesce((F.size(flat) > MOST_HEADERS) | (F.aggregate(flat, F.lit(0), lambda a, b: a + b) > HEADER_BYTES), F.lit(False))


def header(headers: Column, name: str) -> Column:
    """The values of a header, whatever the case of its name; null without it."""
    hits = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.when(F.size(hits) > 0, F.flatten(F.transform(hits, lambda e: e["value"])))


def _label(text: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.try_element_at(known, F.lower(F.trim(text)))


def header_charset(content_type: Column) -> Column:
    """The encoding that the first charset parameter names; null without one, or where its label is unknown."""
    value = F.regexp_extract(content_type, r"(?i);[ \t]*charset[ \t]*=([^;]*)", 1)
    return _label(F.regexp_replace(F.regexp_replace(F.trim(value), "^\"+|\"+$", ""), "^'+|'+$", ""))


_META = re.compile(rb"<meta(?=[\s/>])([^>]*)", re.IGNORECASE)
_ATTRIBUTE = re.compile(rb"""([^\s=>/][^\s=>]*)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s>]*)))?""")


def meta_charset_of(head: bytes) -> str | None:
    """The encoding that a meta tag in the first bytes names."""
    for m in _META.finditer(head[:SNIFFED_BYTES].lower()):
        at: dict[bytes, bytes] = {}
        for a in _ATTRIBUTE.finditer(m[1]):
            at.setdefault(a[1], a[2] or a[3] or a[4] or b"")
        found = [at.get(b"charset", b"").strip()]
        if at.get(b"http-equiv", b"").strip() == b"content-type" and b"charset=" in at.get(b"content", b""):
            found.append(re.split(rb"[;\s]", at[b"content"].split(b"charset=", 1)[1].strip(), maxsplit=1)[0].strip(b"\"'"))
        for label in found:
            if name := LABELS.get(label.decode("latin-1")):
                return name
    return None


def meta_charset(body: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else meta_charset_of(bytes(b))), "string")(body)


def decode_bytes(body: bytes, encoding: str, bom: bool = True) -> str:
    """The body as text: a byte-order mark overrides the encoding where bom is set, bad sequences become U+FFFD."""
    if bom:
        for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
            if body.startswith(mark):
                return body[len(mark) :].decode(name, "replace")
    if encoding == "windows-1252":  # five bytes without a character there mean themselves
        return "".join(chr(b) if b in b"\x81\x8d\x8f\x90\x9d" else bytes([b]).decode("cp1252") for b in body) if any(b in body for b in b"\x81\x8d\x8f\x90\x9d") else body.decode("cp1252")
    return body.decode(PYTHON_CODECS.get(encoding, encoding), "replace")


def decoded(body: Column, encoding: Column) -> Column:
    """UTF-8 stays in the JVM, its byte-order mark too; other encodings are decoded in Python, where a mark overrides."""
    other = F.pandas_udf(lambda b, e: pd.Series([None if x is None or y is None else decode_bytes(bytes(x), y) for x, y in zip(b, e, strict=True)], dtype=object), "string")
    return F.when(encoding == "utf-8", F.make_valid_utf8(body.cast("string"))).otherwise(other(F.when(encoding != "utf-8", body), encoding))


def gunzip(body: bytes, cap: int) -> tuple[bytes | None, str | None]:
    """The first member of a gzip body, of at most cap bytes; what follows it is ignored."""
    if not body:
        return b"", None
    d = zlib.decompressobj(31)
    try:
        out = d.decompress(body, cap + 1)
        if len(out) > cap:
            return None, "too_large"
        if not d.eof and (d.decompress(d.unconsumed_tail, 1) or not d.eof):
            return None, "bad_response"
    except zlib.error:
        return None, "bad_response"
    return out, None


def unzipped(body: Column, cap: int) -> Column:
    """struct<body, error> of a gzip body."""

    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if b is None else gunzip(bytes(b), cap) for b in bodies], columns=["body", "error"])

    return F.pandas_udf(run, "body binary, error string")(body)
