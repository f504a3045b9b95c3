"""Responses over HTTP as a data source: each url is fetched once, from the addresses that it was checked for.

    spark.dataSource.register(PinnedHttpSource)
    spark.read.format("pinned_http").option("targets", json.dumps([{"url": ..., "addresses": [...]}])).load()

Redirects are not followed and proxies not used: the plan checks each hop before the next one is fetched. A failure is
a row with an error, never an exception. Lists of targets are dealt over partitions; for tables of targets use
responses_of(), which does the same per row.
"""

from __future__ import annotations

import http.client
import json
import socket
import ssl
import time
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADERS = {"Accept-Encoding": "gzip", "Accept": "text/html,text/plain;q=0.9,*/*;q=0.5", "User-Agent": "tidemill/0.1"}
SCHEMA = "url string, status int, headers map<string,array<string>>, body binary, error_code string, error_message string"


def get(url: str, addresses: list[str], timeout: float, cap: int) -> tuple:
    """One GET, from the first of the addresses that connects; the body up to cap bytes."""
    fail = lambda code, message: (url, None, None, None, code, message)
    parts, deadline = urlsplit(url), time.monotonic() + timeout
    https = parts.scheme == "https"
    connection = None
    for address in addresses:
        try:
            raw = socket.create_connection((address, parts.port or (443 if https else 80)), timeout=max(0.001, deadline - time.monotonic()))
            if https:
                raw = ssl.create_default_context().wrap_socket(raw, server_hostname=parts.hostname)
            connection = http.client.HTTPConnection(parts.hostname, parts.port, timeout=timeout)
            connection.sock = raw
            break
        except TimeoutError:
            return fail("timeout", "the request timed out")
        except OSError:
            continue
    if connection is None:
        return fail("network_error", "could not connect to the host")
    try:
        connection.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=HEADERS)
        response = connection.getresponse()
        headers: dict[str, list[str]] = {}
        for k, v in response.getheaders():
            headers.setdefault(k.lower(), []).append(v)
        declared = headers.get("content-length", ["0"])[0]
        if declared.isdigit() and int(declared) > cap:
            return fail("too_large", "the response is larger than the size limit")
        body = bytearray()
        while chunk := response.read(64 * 1024):
            body += chunk
            if len(body) > cap:
                return fail("too_large", "the response is larger than the size limit")
            if time.monotonic() > deadline:
                return fail("timeout", "the request timed out")
        return (url, response.status, headers, bytes(body), None, None)
    except TimeoutError:
        return fail("timeout", "the request timed out")
    except (http.client.HTTPException, ValueError):
        return fail("bad_response", "the response headers are too large or malformed")
    except OSError:
        return fail("network_error", "the connection failed")
    finally:
        connection.close()


class Slice(InputPartition):
    def __init__(self, targets: list[dict]):
        self.targets = targets


class PinnedHttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.targets = json.loads(options["targets"])
        self.timeout, self.cap, self.slices = float(options.get("timeout", 30)), int(options.get("maxBytes", 10 * 1024 * 1024)), int(options.get("slices", 8))

    def partitions(self) -> list[InputPartition]:
        return [Slice(self.targets[i :: self.slices]) for i in range(min(self.slices, len(self.targets)))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        for t in partition.targets:
            yield get(t["url"], t["addresses"], self.timeout, self.cap)


class PinnedHttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pinned_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PinnedHttpReader(self.options)


def responses_of(targets: DataFrame, timeout: float = 30.0, cap: int = 10 * 1024 * 1024) -> DataFrame:
    """The responses for a table of targets (url, addresses array<string>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([get(u, list(a), timeout, cap) for u, a in zip(b["url"], b["addresses"], strict=True)], columns=["url", "status", "headers", "body", "error_code", "error_message"]).astype({"status": "Int32"})

    return targets.select("url", "addresses").mapInPandas(run, SCHEMA)
