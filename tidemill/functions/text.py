"""Windows of a text, the notes under them, token counts and other plain text columns. Lengths are code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as a class for Java's and RE2's regular expressions.
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
DEFAULT_LENGTH = 5000
#: Fixed value: the start of the note under a window that isn't the last.
MORE = "[More content available. Call fetch again with start_index="


def window(text: Column, start: Column, length: Column) -> Column:
    """struct<text, start, returned, more, total>: the code points [start, start + length); total only where the end is
    in sight. A start or length beyond any text is fine."""
    n = F.length(text).cast("long")
    start = start.cast("long")
    at = F.least(start, n)
    take = F.least(length.cast("long"), n - at)
    more = start < n - take
    cut = F.substring(text, (at + 1).cast("int"), take.cast("int"))
    return F.struct(cut.alias("text"), start.alias("start"), take.alias("returned"), more.alias("more"), F.when(~more, n).alias("total"))


def effective_length(asked: Column, cap: int) -> Column:
    return F.least(F.coalesce(asked, F.lit(DEFAULT_LENGTH)), F.lit(cap)).cast("long")


def clamped_to(asked: Column, cap: int) -> Column:
    """The cap, where the caller asked for more than it."""
    return F.when(asked > cap, F.lit(cap).cast("long"))


def render(w: Column, clamp: Column | None = None) -> Column:
    """A window as the text that a caller gets: what it holds, and notes on what is before and after it."""
    clamp = F.lit(None).cast("long") if clamp is None else clamp
    s = lambda c: c.cast("string")
    clamp_note = F.when(clamp.isNotNull(), F.concat(F.lit("[max_length was reduced to "), s(clamp), F.lit(" characters, the maximum.]")))
    beyond = w["total"].isNotNull() & (w["start"] >= w["total"])
    empty_note = F.concat(F.lit("[No content at start_index="), s(w["start"]), F.lit(": the content is "), s(w["total"]), F.lit(" characters long.]"))
    place = F.when(w["more"], F.concat(F.lit(MORE), s(w["start"] + w["returned"]), F.lit(" to continue.]"))).when(
        (w["start"] > 0) & w["total"].isNotNull(), F.concat(F.lit("[Total length: "), s(w["total"]), F.lit(" characters.]"))
    )
    notes = F.concat_ws("\n", clamp_note, place)
    return F.when(beyond, F.concat_ws("\n", empty_note, clamp_note)).when(notes == "", w["text"]).otherwise(F.concat(w["text"], F.lit("\n\n"), notes))


def with_header(body: Column, redirects: Column, url: Column, status: Column) -> Column:
    return F.when(redirects > 0, F.concat(F.lit("URL: "), url, F.lit("\nStatus: "), status.cast("string"), F.lit("\n\n"), body)).otherwise(body)


def pages(df: DataFrame, text_col: str, length: int) -> DataFrame:
    """Cuts each text into successive windows: adds page_no from 0, and page, a window. A text without characters has
    one empty page."""
    n = F.greatest(F.length(text_col) - 1, F.lit(0))
    numbered = df.withColumn("page_no", F.explode(F.sequence(F.lit(0), F.floor(n / length).cast("int"))))
    return numbered.withColumn("page", window(F.col(text_col), F.col("page_no") * length, F.lit(length)))


def token_count(text: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"[^{WHITE}]+"), F.lit(0))).cast("long")


def reduction(raw: Column, converted: Column) -> Column:
    return (raw - converted) / F.nullif(raw, F.lit(0))


def has_script(text: Column) -> Column:
    return text.rlike("(?i)<script")


def script_leaked(raw: Column, converted: Column) -> Column:
    return has_script(raw) & has_script(converted)
