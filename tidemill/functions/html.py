"""An HTML tokenizer: text, tags with attributes, raw text elements, comments; and a guard against attribute floods."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5

MOST_ATTRIBUTES = 1024
LARGEST_TAG = 2 * 1024 * 1024

RAW_TEXT = frozenset(["script", "style", "xmp", "iframe", "noembed", "noframes"])
ESCAPABLE_RAW_TEXT = frozenset(["title", "textarea"])

_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#([0-9]+)|([A-Za-z][A-Za-z0-9]*));")
_NAME = re.compile(r"[^\t\n\f\r />]+")
_BARE_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
_SPACE_OR_SLASH = re.compile(r"[\t\n\f\r /]*")
_ATTRIBUTE = re.compile(r"""(=?[^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)("?)|'([^']*)('?)|([^\t\n\f\r >]*)))?""")
_COMMENT_END = re.compile(r"--!?>")
_PIECE = re.compile(r"""[<>"'=/]|[\t\n\f\r ]+|[^<>"'=/\t\n\f\r ]+""")


_PLAIN_TAG = re.compile(r"""<[A-Za-z][^\t\n\f\r />"'<=]*(?:[\t\n\f\r ]+[^\t\n\f\r "'=<>/]+(?:=(?:"[^"<]*"|'[^'<]*'|[^\t\n\f\r "'=<>]+))?)*[\t\n\f\r ]*/?>""")


class LimitError(Exception):
    """The page needs more than a converter may spend on it."""


def _entity(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", m[0])
    n = int(m[1], 16) if m[1] else int(m[2]) if len(m[2]) < 9 else 0x110000
    return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else m[0]


def unescape(s: str) -> str:
    """Decodes character references that end in a semicolon; others and unknown ones stay."""
    return _ENTITY.sub(_entity, s) if "&" in s else s


def attribute_peak(html: str) -> int:
    """The most attributes of anything that looks like a tag, wherever it stands.

    All candidates are followed at once: they differ only in the state of the grammar that they are in, so the largest
    count for each state is enough, and the time is linear in the page. Between candidates it skips to the next "<".
    """
    peak, at, n = 0, 0, len(html)
    live: dict[str, int] = {}
    while True:
        if not live:
            at = html.find("<", at)
            if at < 0 or at + 1 >= n:
                return peak
        m = _PIECE.match(html, at)
        if not m:
            return peak
        piece, at = m[0], m.end()
        c = piece[0]
        new: dict[str, int] = {}
        for state, count in live.items():
            if state in ("double", "single"):
                to = "before" if c == ('"' if state == "double" else "'") else state
            elif c == ">":
                continue
            elif c in "\t\n\f\r ":
                to = {"name": "before", "attribute": "after", "unquoted": "before"}.get(state, state)
            elif state == "unquoted":
                to = state
            elif state == "value":
                to = "double" if c == '"' else "single" if c == "'" else "unquoted"
            elif c == "/":
                to = "before"
            elif state == "name":
                to = state
            elif c == "=" and state in ("attribute", "after"):
                to = "value"
            elif state == "attribute":
                to = state
            else:
                to, count = "attribute", count + 1
                peak = max(peak, count)
            new[to] = max(new.get(to, 0), count)
        if c == "<" and at < n and html[at].isascii() and html[at].isalpha():
            new.setdefault("name", 0)
        live = new


def too_many_attributes(html: str) -> bool:
    """attribute_peak(html) > MOST_ATTRIBUTES, at less cost: a well-formed tag under 2 characters for each attribute of
    the limit is passed over as a whole, and has no other candidate in it."""
    at = html.find("<")
    while at >= 0:
        m = _PLAIN_TAG.match(html, at)
        if m and m.end() - at < 2 * MOST_ATTRIBUTES:
            at = m.end()
        elif at + 1 < len(html) and html[at + 1].isascii() and html[at + 1].isalpha():
            return attribute_peak(html[at:]) > MOST_ATTRIBUTES
        else:
            at += 1
        at = html.find("<", at)
    return False


def tokens(html: str) -> Iterator[tuple]:
    """("text", string, decode), ("start", name, attributes, position), ("end", name): names in lower case, of repeated
    attributes the first. An unfinished tag at the end gives nothing."""
    at, n, text = 0, len(html), ""
    find, bare_tag = html.find, _BARE_TAG.match
    while at < n:
        lt = find("<", at)
        if lt < 0 or lt + 1 >= n:
            text += html[at:]
            break
        if lt > at:
            text += html[at:lt]
        m = bare_tag(html, lt)
        c = html[lt + 1]
        if m or (c.isascii() and c.isalpha()) or (c == "/" and lt + 2 < n and html[lt + 2].isascii() and html[lt + 2].isalpha()):
            if m:
                closing, tag, attributes, at = m[1], m[2].lower(), {}, m.end()
            else:
                closing = c == "/"
                name = _NAME.match(html, lt + 1 + closing)
                tag = name[0].lower()
                attributes, at = _attributes(html, name.end())
            if text:
                yield ("text", text, True)
                text = ""
            if at < 0:
                return
            if at - lt > LARGEST_TAG:
                raise LimitError
            if closing:
                yield ("end", tag)
                continue
            yield ("start", tag, attributes, lt)
            if tag == "plaintext":
                yield ("text", html[at:], False)
                return
            if tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT:
                end = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.IGNORECASE).search(html, at)
                stop = end.start() if end else n
                if stop > at:
                    yield ("text", html[at:stop], tag in ESCAPABLE_RAW_TEXT)
                at = stop
        elif html.startswith("<!--", lt):
            if html.startswith(">", lt + 4) or html.startswith("->", lt + 4):
                at = html.index(">", lt + 4) + 1
            else:
                end = _COMMENT_END.search(html, lt + 4)
                at = end.end() if end else n
        elif c in "!?/":
            end = html.find(">", lt + 2 - (c == "/" and html.startswith("</>", lt)))
            if c == "/" and lt + 2 >= n:
                text += "</"
                break
            at = end + 1 if end >= 0 else n
        else:
            text += "<"
            at = lt + 1
    if text:
        yield ("text", text, True)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from `at` on and where the tag ends; -1 if it doesn't."""
    found: dict[str, str] = {}
    while True:
        at = _SPACE_OR_SLASH.match(html, at).end()
        if at >= len(html):
            return found, -1
        if html[at] == ">":
            return found, at + 1
        m = _ATTRIBUTE.match(html, at)
        if (m[2] is not None and not m[3]) or (m[4] is not None and not m[5]):
            return found, -1  # a quote that isn't closed
        found.setdefault(m[1].lower(), m[2] or m[4] or m[6] or "")
        at = m.end()
