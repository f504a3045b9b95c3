"""Errors as columns: a code, a message and the text that a caller sees."""

from __future__ import annotations

from http import HTTPStatus

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and messages.
CODES = [
    "invalid_argument", "blocked_target", "dns_failure", "too_large", "timeout", "unsupported_content_type", "unsupported_encoding",
    "http_error", "too_many_redirects", "network_error", "bad_response", "converter_limit", "robots_disallowed", "internal",
]
INTERNAL = "an unexpected internal error occurred; the server is still running, you may retry"
TOO_LARGE = "the response is larger than the size limit"
TOO_MANY_REDIRECTS = "too many redirects"
CORRUPT_GZIP = "the gzip body is corrupt"
LARGE_HEADERS = "the response headers are too large"
CONVERTER_LIMIT = "the page is too complex to convert within the memory limit; retry with raw=true"
NO_DNS = "hostname did not resolve"
TIMED_OUT = "the request timed out"
NO_CONNECTION = "could not connect to the host"


def reason(status: Column) -> Column:
    """" (Not Found)" and the like; empty for a status without a name."""
    names = {s.value: s.phrase for s in HTTPStatus} | {413: "Payload Too Large", 414: "URI Too Long", 416: "Range Not Satisfiable", 418: "I'm a teapot", 422: "Unprocessable Entity"}
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.concat(F.lit(" ("), F.try_element_at(known, status), F.lit(")")), F.lit(""))


def http_message(status: Column) -> Column:
    s = F.concat(F.lit("HTTP status "), status.cast("string"), reason(status))
    return (
        F.when(status.isin(408, 425, 429), F.concat(F.lit("the server refused the request with "), s, F.lit("; it may work if retried after a delay")))
        .when(status.between(400, 499), F.concat(F.lit("the server refused the request with "), s, F.lit("; retrying the same URL is unlikely to help")))
        .when(status.between(500, 599), F.concat(F.lit("the server failed with "), s, F.lit("; it may work if retried later")))
        .otherwise(F.concat(F.lit("the server answered with "), s))
    )


def unsupported_message(media_type: Column) -> Column:
    return F.concat(F.lit("the response is "), media_type, F.lit(", which is not text; only HTML, plain text, JSON and XML are returned"))


def tool_text(code: Column, message: Column) -> Column:
    """What a caller sees; the detail of an internal error stays in the log."""
    return F.concat(F.lit("error["), code, F.lit("]: "), F.when(code == "internal", F.lit(INTERNAL)).otherwise(message))
