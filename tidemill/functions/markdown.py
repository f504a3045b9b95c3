"""HTML pages to markdown: a writer driven by the tokenizer's events, and the Arrow-batched column function.

The page's elements are a stack; an end tag closes everything above its match, and an unmatched one is ignored. Output
is lazy: line breaks, prefixes and emphasis are written when content follows them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import links
from .html import LimitError, too_many_attributes, tokens, unescape

# Caps, which shape the output, and the lists of names that the drop rules know.
HOLDBACK_BYTES = 256 * 1024
STEP_CHARS, STEP_BYTES = 64 * 1024, 4 * 1024 * 1024
MOST_OPEN, MOST_NESTED = 256, 20_000
MOST_FRAMES, MOST_LISTS, MOST_DRAWN = 64, 64, 6
CELL_BYTES, ROW_BYTES, ROW_CELLS = 64 * 1024, 256 * 1024, 256
ALT_CHARS, LANGUAGE_CHARS = 512, 20

DROPPED = frozenset("script style noscript template svg canvas iframe object embed dialog head title nav footer aside select textarea button input".split())
END_TAG_OPTIONAL = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup html body".split())
NOISE_CONTAINERS = frozenset("div section ul ol form span".split())
NOISE_WORDS = frozenset("cookie cookies consent banner popup modal advert advertisement ad ads sidebar share newsletter".split())
HEAD_CONTENT = frozenset("title base link meta script style noscript template".split())
HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search".split())
BLOCKS = frozenset("div section main article header address form dl dt dd figcaption summary details hgroup fieldset legend center menu caption body html".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_SEPARATOR = re.compile("[\x1c-\x1f]")
_GAPS = re.compile(r"[^\S\x1c-\x1f]+")
EMPHASIS = {"em": "*", "i": "*", "cite": "*", "dfn": "*", "strong": "**", "b": "**"}


def _is_space(c: str) -> bool:
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _noise(token: str) -> bool:
    t = token.lower()
    return t in NOISE_WORDS or any(t[: m.start()] in NOISE_WORDS for m in re.finditer("[-_]", t))


def _hidden(at: dict[str, str]) -> bool:
    if not at:
        return False
    style = re.sub(r"\s", "", at.get("style", "")).lower()
    return "hidden" in at or at.get("aria-hidden", "").strip().lower() == "true" or "display:none" in style or "visibility:hidden" in style or at.get("role", "").strip().lower() in HIDDEN_ROLES


def _noisy(at: dict[str, str]) -> bool:
    return any(map(_noise, at.get("class", "").split())) or bool(at.get("id") and _noise(at["id"].strip()))


def _language(classes: str) -> str:
    for c in classes.split():
        for prefix in ("language-", "lang-"):
            if c.startswith(prefix):
                if name := re.sub(r"[^A-Za-z0-9+#._-]", "", c[len(prefix) :])[:LANGUAGE_CHARS]:
                    return name
                break
    return ""


class Table:
    """The rows of the one table that is drawn; tables inside it are ordinary blocks."""

    def __init__(self) -> None:
        self.plain = False  # given up: what follows are plain lines
        self.cell: list[str] | None = None
        self.cell_bytes = self.row_bytes = self.rows = 0
        self.row: list[str] = []
        self.heading = False


class Code:
    """A preformatted block, fenced once it has content."""

    def __init__(self) -> None:
        self.language, self.open, self.fresh, self.breaks, self.ticks = "", False, True, 0, 0


class Writer:
    def __init__(self, base: str | None):
        self.base, self.stage = base, "held"  # held until a landmark or the holdback's end; then "landmark" or "whole"
        self.inside = 0  # open landmarks
        self.skipping: list | None = None  # [tag, depth] of the dropped subtree
        self.open, self.nested = 0, Counter()
        self.stack: list[tuple[str, tuple | None]] = []
        self.step, self.step_bytes = 0, 0
        self.reset()

    def reset(self) -> None:
        self.out: list[str] = []
        self.bytes = self.chars = 0
        self.breaks, self.space = 0, False
        self.started = self.filled = False  # the line has its prefix; has content
        self.marker = self.heading = ""
        self.quotes, self.lists = 0, []
        self.frames: list[list] = []  # [kind, opening, closing, written]
        self.code: Code | None = None
        self.table, self.tables = Table(), 0
        self.drawing = False

    # -- output

    def emit(self, s: str) -> None:
        if not s:
            return
        n = len(s)
        self.chars += n
        if not s.isascii():
            n = len(s.encode("utf-8", "replace"))
        self.out.append(s)
        self.step_bytes += n
        if self.step_bytes > STEP_BYTES:
            raise LimitError
        if self.stage == "held":
            self.bytes += n
            if self.bytes > HOLDBACK_BYTES:
                self.stage = "whole"

    def put(self, s: str) -> None:
        t = self.table
        if t.cell is None:
            self.emit(s)
            return
        n = len(s) if s.isascii() else len(s.encode("utf-8", "replace"))
        if t.cell_bytes + n > CELL_BYTES:
            self.give_up()
            self.emit(s)
        else:
            t.cell.append(s)
            t.cell_bytes += n

    def begin(self) -> None:
        """Whatever must stand before content: breaks, the line's prefix, a space, pending emphasis."""
        if self.table.cell is None:
            self.emit(self.lead())
            return
        if self.space:
            if self.table.cell_bytes:
                self.put(" ")
            self.space = False
        if self.frames and not self.frames[-1][3]:
            for f in self.frames:
                if not f[3]:
                    f[3] = True
                    self.put(f[1])

    def lead(self) -> str:
        """begin() outside of cells, as the text that it writes."""
        out = ""
        if self.breaks:
            if self.out:
                out = "\n" * self.breaks
            self.breaks = 0
            self.started = self.filled = False
        if not self.started:
            out += self.prefix()
            self.started = True
        if self.space:
            if self.filled:
                out += " "
            self.space = False
        if self.frames and not self.frames[-1][3]:
            for f in self.frames:
                if not f[3]:
                    f[3] = True
                    out += f[1]
        return out

    def has_content(self) -> bool:
        return self.filled if self.table.cell is None else bool(self.table.cell_bytes)

    def prefix(self) -> str:
        if not (self.lists or self.quotes):  # markers and headings alone
            lead, self.marker, self.heading = self.marker + self.heading, "", ""
            return lead
        depth = min(len(self.lists), MOST_DRAWN + 1)
        lead = "> " * min(self.quotes, MOST_DRAWN) + "  " * max(0, depth - 1)
        item = self.marker or ("  " if depth and not self.heading else "")
        lead += item + self.heading
        self.marker = self.heading = ""
        return lead

    def content(self, s: str) -> None:
        if self.table.cell is None:
            self.emit(self.lead() + s)
        else:
            self.begin()
            self.put(s)
        self.filled = True

    def block(self, breaks: int) -> None:
        if self.frames:
            self.close_frames(0)
        if self.table.cell is not None:
            self.space = True
        else:
            self.breaks, self.space, self.heading = max(self.breaks, breaks), False, ""

    def close_frames(self, down_to: int) -> None:
        while len(self.frames) > down_to:
            f = self.frames.pop()
            if f[3]:
                self.put(f[2])

    def close_kind(self, kind: str) -> None:
        for i in range(len(self.frames) - 1, -1, -1):
            if self.frames[i][0] == kind:
                self.close_frames(i)
                return

    def frame(self, kind: str, opening: str, closing: str) -> tuple | None:
        if len(self.frames) >= MOST_FRAMES:
            return None
        self.frames.append([kind, opening, closing, False])
        return ("frame", kind)

    # -- text

    def visible(self) -> bool:
        return self.skipping is None and (self.stage != "landmark" or self.inside > 0)

    def text(self, s: str, decode: bool) -> None:
        if not self.visible():
            return
        if decode:
            s = unescape(s)
        if self.code is not None and self.table.cell is None:
            self.preformatted(s)
        else:
            self.inline(s)

    def inline(self, s: str) -> None:
        if "\0" in s:
            s = s.replace("\0", "�")
        if self.table.cell is not None or _SEPARATOR.search(s):
            self.inline_slowly(s)
            return
        words = s.split()
        if not words:
            self.space = self.space or (self.filled and bool(s))
            return
        if self.filled and s[0].isspace():
            self.space = True
        self.emit(self.lead() + " ".join(words))
        self.filled = True
        if s[-1].isspace():
            self.space = True

    def inline_slowly(self, s: str) -> None:
        """For cells, which may fill up, and for text with separators that aren't white space here."""
        at = 0
        for m in _GAPS.finditer(s):
            self.run(s[at : m.start()])
            if self.has_content():
                self.space = True
            at = m.end()
        self.run(s[at:])

    def run(self, word: str) -> None:
        """A word; one too long for its cell fills the cell up first."""
        if not word:
            return
        self.begin()
        if self.table.cell is not None and self.table.cell_bytes + 4 * len(word) > CELL_BYTES:
            for c in word:
                self.begin()
                self.put(c)
        else:
            self.put(word)
        self.filled = True

    def preformatted(self, s: str) -> None:
        for c in s.replace("\r", ""):
            code = self.code
            fresh, code.fresh = code.fresh, False
            if c == "\n":
                code.breaks += not fresh and code.open
                continue
            if not code.open:
                if _is_space(c):
                    continue
                code.open = True
                self.begin()
                self.put(f"```{code.language}\n")
            lead, code.breaks = "\n" * code.breaks, 0
            code.ticks = code.ticks + 1 if c == "`" else 0
            if code.ticks == 3:
                lead, code.ticks = lead + "​", 1
            self.put(lead + ("�" if c == "\0" else c))

    def end_code(self) -> None:
        if self.code is not None:
            if self.code.open:
                self.put("\n```")
            self.code, self.started, self.filled, self.breaks = None, False, False, 2
        self.block(2)

    # -- elements

    def start(self, name: str, at: dict[str, str], position: int) -> None:
        if position // STEP_CHARS != self.step:
            self.step, self.step_bytes = position // STEP_CHARS, 0
        void = name in VOID
        act = self.opened(name, void, at)
        if void:
            return
        self.stack.append((name, act))
        self.nested[name] += 1
        if len(self.stack) > MOST_NESTED:
            raise LimitError
        self.open += act is not None and act[0] != "skip"

    def opened(self, name: str, void: bool, at: dict[str, str]) -> tuple | None:
        """What the element's end has to do: (kind, detail, is a landmark), or None."""
        if self.skipping is not None:
            tag = self.skipping[0]
            if tag == name and not void:
                self.skipping[1] += 1
                return ("skip", self.skipping, False)
            if tag != "head" or name in HEAD_CONTENT or tag == name:
                return None
            self.skipping = None
        if name in DROPPED or (not void and name not in END_TAG_OPTIONAL and (_hidden(at) or (name in NOISE_CONTAINERS and _noisy(at)))):
            if void:
                return None
            self.skipping = [name, 1]
            return ("skip", self.skipping, False)
        full = self.open >= MOST_OPEN and not void
        landmark = False
        if name in ("main", "article") or ("role" in at and at["role"].strip().lower() == "main"):
            if self.stage == "held":
                self.reset()
                self.stage, self.inside, landmark = "landmark", 1, True
            elif self.stage == "landmark" and not full:
                self.inside += 1
                landmark = True
        act = None if full or not self.visible() else self.structure(name, at)
        if act is None:
            return ("none", None, True) if landmark else None
        return (*act, landmark)

    # What opening an element does; each gives (kind, detail) for its end, or None if the end does nothing.

    def structure(self, name: str, at: dict[str, str]) -> tuple | None:
        opener = OPENERS.get(name)
        return opener(self, name, at) if opener else None

    def open_block(self, name: str, at: dict[str, str]) -> tuple:
        breaks = 1 if name in BLOCKS else 2
        self.block(breaks)
        return ("block", breaks)

    def open_heading(self, name: str, at: dict[str, str]) -> tuple:
        self.block(2)
        self.heading = "#" * int(name[1]) + " "
        return ("block", 2)

    def open_emphasis(self, name: str, at: dict[str, str]) -> tuple | None:
        sign = EMPHASIS[name]
        return self.frame(sign, sign, sign)

    def open_code(self, name: str, at: dict[str, str]) -> tuple | None:
        if self.code is None:
            return self.frame("`", "`", "`")
        if not self.code.open:
            self.code.language = _language(at.get("class", "")) or self.code.language
        return None

    def open_link(self, name: str, at: dict[str, str]) -> tuple | None:
        self.close_kind("a")
        to = links.destination(self.base, unescape(at["href"])) if "href" in at else None
        return self.frame("a", "[", f"]({to})") if to else None

    def open_break(self, name: str, at: dict[str, str]) -> None:
        if self.table.cell is not None or self.code is not None:
            self.space = True
        elif self.out:
            self.breaks, self.space = min(self.breaks + 1, 2), False

    def open_rule(self, name: str, at: dict[str, str]) -> None:
        self.block(2)
        self.content("---")
        self.block(2)

    def open_list(self, name: str, at: dict[str, str]) -> tuple:
        self.block(1 if self.lists else 2)
        if len(self.lists) >= MOST_LISTS:
            return ("block", 1)
        first = at.get("start", "").strip().removeprefix("+")
        number = int(first) if first.isdecimal() and first.isascii() and len(first) < 21 and int(first) < 2**64 else 1
        self.lists.append([name == "ol", number])
        return ("list", None)

    def open_item(self, name: str, at: dict[str, str]) -> tuple:
        self.block(1)
        marker, top = "- ", self.lists[-1] if self.lists else None
        if top and top[0]:
            marker = f"{top[1]}. "
            top[1] = min(top[1] + 1, 2**64 - 1)
        if self.table.cell is None:
            self.marker = marker
        return ("item", None)

    def open_quote(self, name: str, at: dict[str, str]) -> tuple:
        self.block(2)
        self.quotes += 1
        return ("quote", None)

    def open_preformatted(self, name: str, at: dict[str, str]) -> tuple:
        self.block(2)
        if self.table.cell is None:
            self.code = Code()
        return ("pre", None)

    def drawn(self) -> bool:
        """Rows and cells belong to the table that is drawn."""
        return self.tables == 1 and self.drawing and not self.table.plain

    def open_table(self, name: str, at: dict[str, str]) -> tuple:
        if not self.tables:
            self.block(2)
            self.table, self.drawing = Table(), True
        self.tables += 1
        return ("table", None)

    def open_row(self, name: str, at: dict[str, str]) -> tuple:
        if self.drawn():
            self.end_row()
            self.table.heading = False
        else:
            self.block(1)
        return ("row", None)

    def open_cell(self, name: str, at: dict[str, str]) -> tuple:
        if self.drawn():
            self.close_frames(0)
            self.end_cell()
            self.table.cell, self.table.cell_bytes, self.space = [], 0, False
            self.table.heading |= name == "th"
        else:
            self.space = True
        return ("cell", None)

    def open_image(self, name: str, at: dict[str, str]) -> None:
        alt = re.sub(r"[\[\]\0]", "", " ".join(unescape(at.get("alt", "")).split()))[:ALT_CHARS]
        source = links.destination(self.base, unescape(at["src"])) if alt and "src" in at else None
        if source and source.startswith("http"):
            self.content(f"![{alt}]({source})")

    def end(self, name: str) -> None:
        if not self.nested[name]:
            return
        while True:
            top, act = self.stack.pop()
            self.nested[top] -= 1
            if act is not None:
                self.open -= act[0] != "skip"
                self.closed(*act)
            if top == name:
                return

    def closed(self, kind: str, detail: object, landmark: bool) -> None:
        CLOSERS[kind](self, detail)
        if landmark and self.stage == "landmark":
            self.inside = max(0, self.inside - 1)
            if not self.inside:
                self.block(2)

    def close_item(self, _: object) -> None:
        self.marker = ""
        self.block(1)

    def close_list(self, _: object) -> None:
        if self.lists:
            self.lists.pop()
        self.block(1 if self.lists else 2)

    def close_quote(self, _: object) -> None:
        self.quotes = max(0, self.quotes - 1)
        self.block(2)

    def close_cell(self, _: object) -> None:
        if self.drawn():
            self.close_frames(0)
            self.end_cell()

    def close_row(self, _: object) -> None:
        if self.drawn():
            self.end_row()
        else:
            self.block(1)

    def close_table(self, _: object) -> None:
        self.tables = max(0, self.tables - 1)
        if not self.tables:
            self.end_row()
            self.table, self.drawing = Table(), False
            self.block(2)

    def close_skipped(self, subtree: list) -> None:
        if subtree is self.skipping:
            subtree[1] -= 1
            if not subtree[1]:
                self.skipping = None

    # -- tables

    def end_cell(self) -> None:
        t = self.table
        if t.cell is None:
            return
        cell = "".join(t.cell).replace("|", "\\|")
        n = t.cell_bytes + cell.count("\\|")
        if t.row_bytes + n > ROW_BYTES:
            self.give_up()
            return
        t.cell, t.cell_bytes = None, 0
        if len(t.row) < ROW_CELLS:
            t.row.append(cell)
            t.row_bytes += n

    def end_row(self) -> None:
        self.end_cell()
        t = self.table
        row, t.row, t.row_bytes = t.row, [], 0
        if not any(row):
            return
        lines = ["| " + " | ".join(row) + " |"]
        if t.heading and not t.rows:
            lines.append("|" + " --- |" * len(row))
        t.rows += 1
        for line in lines:
            self.breaks = max(self.breaks, 1)
            self.content(line)
            self.breaks, self.started, self.filled = 1, False, False

    def give_up(self) -> None:
        """A layout table: its cells so far become lines, and the rest ordinary blocks."""
        t = self.table
        parts, t.plain = list(t.row), True
        if t.cell is not None:
            parts.append("".join(t.cell))
        t.row, t.row_bytes, t.cell, t.cell_bytes = [], 0, None, 0
        for part in filter(None, parts):
            self.breaks = max(self.breaks, 1)
            self.content(part)
        self.breaks, self.started, self.filled = 1, False, False

    def finish(self) -> str:
        self.close_frames(0)
        self.end_row()
        if self.code is not None:
            self.end_code()
        self.close_frames(0)
        return "".join(self.out)


OPENERS = {
    **dict.fromkeys(BLOCKS | {"p", "figure"}, Writer.open_block),
    **dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), Writer.open_heading),
    **dict.fromkeys(EMPHASIS, Writer.open_emphasis),
    **dict.fromkeys(("code", "tt", "kbd", "samp"), Writer.open_code),
    "a": Writer.open_link,
    "br": Writer.open_break,
    "hr": Writer.open_rule,
    "img": Writer.open_image,
    "ul": Writer.open_list,
    "ol": Writer.open_list,
    "li": Writer.open_item,
    "blockquote": Writer.open_quote,
    "pre": Writer.open_preformatted,
    "table": Writer.open_table,
    "tr": Writer.open_row,
    "td": Writer.open_cell,
    "th": Writer.open_cell,
}
CLOSERS = {
    "none": lambda w, _: None,
    "block": Writer.block,
    "frame": Writer.close_kind,
    "item": Writer.close_item,
    "list": Writer.close_list,
    "quote": Writer.close_quote,
    "pre": lambda w, _: w.end_code(),
    "cell": Writer.close_cell,
    "row": Writer.close_row,
    "table": Writer.close_table,
    "skip": Writer.close_skipped,
}


def to_markdown(html: str, base: str | None, enough: int | None = None) -> str:
    """The page as markdown. Raises LimitError for a page beyond the caps.

    With `enough`, it stops where so many characters are certain, and returns these or more of the whole: nothing that
    was written changes once a landmark is open or the holdback is over. What is behind the step that it stops in isn't
    looked at, so caps that only break there don't matter."""
    if enough is None and too_many_attributes(html):
        raise LimitError
    w, most, position = Writer(base), math.inf if enough is None else enough, 0
    for kind, *rest in tokens(html):
        if kind == "text":
            w.text(*rest)
            if w.chars >= most and w.stage != "held":
                if too_many_attributes(html[: (position // STEP_CHARS + 1) * STEP_CHARS]):
                    raise LimitError
                return "".join(w.out)
        elif kind == "start":
            position = rest[2]
            w.start(*rest)
        else:
            w.end(*rest)
    if enough is not None and too_many_attributes(html):
        raise LimitError
    return w.finish()


def _convert(html: pd.Series, base: pd.Series, enough: pd.Series) -> pd.DataFrame:
    out = []
    for h, b, n in zip(html, base, enough, strict=True):
        try:
            out.append((None, None) if h is None else (to_markdown(h, b, None if pd.isna(n) else int(n)), None))
        except LimitError:
            out.append((None, "converter_limit"))
    return pd.DataFrame(out, columns=["markdown", "error"])


def markdown_of(html: Column, base: Column, enough: Column | None = None) -> Column:
    """struct<markdown, error>: one Arrow-batched call for each page; project it once and select its fields. Where
    enough isn't null, the page is converted as far as that many characters need."""
    return F.pandas_udf(_convert, "markdown string, error string")(html, base, F.lit(None).cast("long") if enough is None else enough.cast("long"))
