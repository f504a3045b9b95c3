"""Requests as JSON: each field checked for its type, the first bad one named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST = (1 << 63) - 1
WHOLE = "must be a non-negative whole number"


def parse_arguments(args: Column) -> Column:
    """struct<url, max_length, start_index, raw, error_code, error_message> of a JSON object as a string.

    null is as good as absent; unknown keys are ignored; numbers over 2**63 - 1 are read as that.
    """
    v = F.try_parse_json(F.coalesce(args, F.lit("{}")))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    text = lambda k: F.get_json_object(args, f"$.{k}")
    number = lambda k: F.when(kind(k) == "BIGINT", text(k).try_cast("long")).when((kind(k) == "DECIMAL(20,0)") | (kind(k) == "DECIMAL(19,0)"), F.lit(MOST))
    absent = lambda k: kind(k) == "VOID"
    bad_number = lambda k: ~absent(k) & (number(k).isNull() | (number(k) < 0) | text(k).startswith("-"))
    error = (
        F.when(v.isNull(), "url: is required")
        .when(absent("url"), "url: is required")
        .when(kind("url") != "STRING", "url: must be a string")
        .when(bad_number("max_length"), f"max_length: {WHOLE}")
        .when(number("max_length") == 0, "max_length: must be at least 1")
        .when(~absent("raw") & (kind("raw") != "BOOLEAN"), "raw: must be true or false")
        .when(bad_number("start_index"), f"start_index: {WHOLE}")
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, text("url")).alias("url"),
        F.when(ok, number("max_length")).alias("max_length"),
        F.when(ok, number("start_index")).alias("start_index"),
        F.when(ok, F.coalesce(text("raw") == "true", F.lit(False))).alias("raw"),
        F.when(~ok, "invalid_argument").alias("error_code"),
        error.alias("error_message"),
    )
