"""Link targets: joined to the page's url, percent-encoded and checked."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import urlsplit

MOST_BYTES = 2048
SCHEMES = ("http", "https", "mailto", "tel")

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.\-]*):(.*)$", re.DOTALL)
_PATH_KEPT = set(map(ord, "!$%&'()*+,-./0123456789:;=@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]_abcdefghijklmnopqrstuvwxyz|~")) - {ord("\\")}
_QUERY_KEPT = set(range(0x21, 0x7F)) - set(map(ord, "\"#<>'"))
_FRAGMENT_KEPT = set(range(0x21, 0x7F)) - set(map(ord, '"<>`'))


def _encoded(s: str, kept: set[int]) -> str:
    if all(ord(c) in kept for c in s):
        return s
    return "".join(chr(b) if b in kept else f"%{b:02X}" for b in s.encode("utf-8", "replace"))


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        low, last = p.lower().replace("%2e", "."), i == len(parts) - 1
        if low == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def _host(authority: str, scheme: str) -> str | None:
    user, at, rest = authority.rpartition("@")
    host, colon, port = rest.rpartition(":") if not rest.endswith("]") and ":" in rest else (rest, "", "")
    if not host or (port and not port.isdigit()) or re.search(r"[\x00-\x20<>^|%\\#]", host):
        return None
    try:
        host = host.lower() if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    if port and (int(port) > 65535):
        return None
    port = "" if not port or int(port) == {"http": 80, "https": 443}[scheme] else f":{int(port)}"
    return user + at + host + port


def _web(scheme: str, rest: str) -> str | None:
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/").lstrip("/")
    authority, slash, path = rest.partition("/")
    host = _host(authority, scheme)
    if host is None:
        return None
    path = _without_dots("/" + _encoded(path, _PATH_KEPT))
    return f"{scheme}://{host}{path}" + (mark + _encoded(query, _QUERY_KEPT)) + (hash_ + _encoded(fragment, _FRAGMENT_KEPT))


@lru_cache(maxsize=4096)
def _base(base: str) -> tuple[str, str, str, str]:
    s = urlsplit(base)
    return s.scheme.lower(), s.netloc, s.path or "/", s.query


def join(base: str | None, link: str) -> str | None:
    """link as an absolute url; None if that can't be."""
    link = re.sub(r"[\t\n\r]", "", link)
    m = _SCHEME.match(link)
    if m and (scheme := m[1].lower()) not in ("http", "https"):
        return f"{scheme}:{_encoded(m[2], set(range(0x20, 0x7F)))}"
    if m and (not base or m[2][:1] in "/\\" or _base(base)[0] != m[1].lower()):
        return _web(m[1].lower(), m[2])
    if not base:
        return None
    if m:
        link = m[2]
    scheme, authority, path, query = _base(base)
    if scheme not in ("http", "https"):
        return None
    if link[:2].replace("\\", "/") == "//":
        return _web(scheme, link)
    if link[:1] in ("/", "\\"):
        return _web(scheme, f"//{authority}{link}")
    if link[:1] == "?":
        return _web(scheme, f"//{authority}{path}{link}")
    if link[:1] == "#" or not link:
        return _web(scheme, f"//{authority}{path}" + f"?{query}" * bool(query) + link)
    return _web(scheme, f"//{authority}{path.rpartition('/')[0]}/{link}")


def destination(base: str | None, link: str) -> str | None:
    """What markdown may link to: http, https, mailto or tel, no fragment of the page itself, of bounded length."""
    link = link.strip()
    if not link or link[0] == "#" or len(link.encode("utf-8", "replace")) > MOST_BYTES:
        return None
    url = join(base, link)
    if url is None or url.partition(":")[0] not in SCHEMES or len(url) > MOST_BYTES:
        return None
    return url.replace("(", "%28").replace(")", "%29").replace("<", "").replace(">", "")
