"""The retrieval plan over small tables, as a batch and as a stream; robots, sources, settings."""

import gzip
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text
from tidemill.operators.policy import Policy
from tidemill.plans import retrieval
from tidemill.sources import config, files, http as pinned

HTML = ["text/html"]
PAGE = "<html><head><title>t</title></head><body><h1>Hi</h1><p>" + "word " * 50 + "</p></body></html>"


def response(url, status=200, body=b"", **headers):
    return (url, status, {k.replace("_", "-"): (v if isinstance(v, list) else [v]) for k, v in headers.items()}, body)


@pytest.fixture(scope="module")
def world(spark):
    responses = [
        response("http://a.example/", body=PAGE.encode(), content_type="text/html"),
        response("http://a.example/gz", body=gzip.compress(PAGE.encode()), content_type="text/html", content_encoding="gzip"),
        response("http://a.example/bad", body=b"xx", content_type="text/html", content_encoding="gzip"),
        response("http://a.example/br", body=b"xx", content_type="text/html", content_encoding="br"),
        response("http://a.example/latin", body="<p>caf\xe9</p>".encode("latin-1"), content_type="text/html; charset=iso-8859-1"),
        response("http://a.example/meta", body=b"<meta charset=windows-1252><p>caf\xe9</p>", content_type="text/html"),
        response("http://a.example/sniff", body=b"\xef\xbb\xbf<!doctype html><p>x</p>"),
        response("http://a.example/plain", body=b"<p>x</p>", content_type="text/plain"),
        response("http://a.example/pdf", body=b"x", content_type="application/pdf"),
        response("http://a.example/big", body=b"x" * 5000, content_type="text/plain"),
        response("http://a.example/404", status=404, content_type="text/html"),
        response("http://a.example/r1", status=302, location="/r2"),
        response("http://a.example/r2", status=301, location="http://b.example/end#f"),
        response("http://b.example/end", body=b"end", content_type="text/plain"),
        response("http://a.example/inside", status=302, location="http://10.0.0.1/"),
        response("http://a.example/loop", status=307, location="http://a.example/loop"),
        response("http://a.example/nowhere", status=302),
    ]
    dns = [("a.example", 0, "8.8.8.8"), ("b.example", 0, "1.1.1.1"), ("private.example", 0, "10.0.0.1"), ("mixed.example", 0, "8.8.8.8"), ("mixed.example", 1, "127.0.0.1"), ("none.example", 0, None)]
    return (
        spark.createDataFrame(dns, "host string, ord int, ip string"),
        spark.createDataFrame(responses, "url string, status int, headers map<string,array<string>>, body binary"),
        spark.createDataFrame([("http://a.example", "User-agent: *\nDisallow: /plain")], "origin string, body string"),
    )


REQUESTS = {
    1: {"url": "http://a.example/"},
    2: {"url": "http://a.example/gz", "max_length": 20},
    3: {"url": "http://a.example/bad"},
    4: {"url": "http://a.example/br"},
    5: {"url": "http://a.example/latin"},
    6: {"url": "http://a.example/meta"},
    7: {"url": "http://a.example/sniff"},
    8: {"url": "http://a.example/plain"},
    9: {"url": "http://a.example/pdf"},
    10: {"url": "http://a.example/big"},
    11: {"url": "http://a.example/404"},
    12: {"url": "http://a.example/r1"},
    13: {"url": "http://a.example/inside"},
    14: {"url": "http://a.example/loop"},
    15: {"url": "http://private.example/"},
    16: {"url": "http://mixed.example/"},
    17: {"url": "http://none.example/"},
    18: {"url": "http://unknown.example/"},
    19: {"url": "ftp://a.example/"},
    20: {"url": "http://a.example/", "raw": True, "start_index": 6, "max_length": 4},
    21: {"url": "http://a.example/", "max_length": 99999},
    22: {"url": "http://a.example/", "start_index": 10**6},
    23: {"url": "http://a.example/nowhere"},
    24: {"url": "http://a.example/missing"},
    25: {"max_length": 5},
}


def requests(spark):
    return spark.createDataFrame([(i, json.dumps(a)) for i, a in REQUESTS.items()], "request_id long, args string")


def test_plan(spark, world):
    dns, responses, robots = world
    out = {r.request_id: r for r in retrieval.run(requests(spark), dns, responses, settings=retrieval.Settings(cap_bytes=4000, length_cap=1000)).collect()}
    assert sorted(out) == sorted(REQUESTS)
    want = {3: "bad_response", 4: "unsupported_encoding", 9: "unsupported_content_type", 10: "too_large", 11: "http_error", 13: "blocked_target", 14: "too_many_redirects", 15: "blocked_target", 16: "blocked_target", 17: "dns_failure", 18: "dns_failure", 19: "invalid_argument", 23: "http_error", 24: "network_error", 25: "invalid_argument"}
    assert {i: r.error_code for i, r in out.items() if r.error_code} == want
    assert out[1].text.startswith("# Hi\n\nword word") and out[1].total == 6 + 249
    assert out[2].text.startswith("# Hi\n\nword word word\n\n" + text.MORE + "20")
    assert out[5].text == out[6].text == "café" and out[7].text == "x" and out[8].text == "<p>x</p>"
    assert out[12].text == "URL: http://b.example/end\nStatus: 200\n\nend" and out[12].redirects == 2
    assert out[13].text == "error[blocked_target]: IP address is not public (private)"
    assert out[16].text == "error[blocked_target]: hostname resolves to a non-public address (loopback)"
    assert out[20].text.startswith("<hea\n\n[More")
    assert out[21].text.endswith("[max_length was reduced to 1000 characters, the maximum.]")
    assert out[22].text == "[No content at start_index=1000000: the content is 255 characters long.]"
    assert out[11].text.startswith("error[http_error]: the server refused the request with HTTP status 404 (Not Found)")


def test_robots_and_allowlist(spark, world):
    dns, responses, robots = world
    s = retrieval.Settings(policy=Policy(private_enabled=True, private_hosts=("private.example",)), enforce_robots=True)
    out = {r.request_id: r for r in retrieval.run(requests(spark), dns, responses, robots, s).collect()}
    assert out[8].error_code == "robots_disallowed" and out[8].text.endswith("robots.txt disallows fetching /plain")
    assert out[1].error_code is None and out[15].error_code == "network_error" and out[13].error_code == "blocked_target"


def test_stream_equals_batch(spark, world, tmp_path):
    from tidemill.streaming import requests as stream

    dns, responses, robots = world
    requests(spark).coalesce(1).write.json(f"{tmp_path}/in")
    stream.serve(stream.read_requests(spark, f"{tmp_path}/in"), dns, responses, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("request_id", "error_code", "text").collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(retrieval.run(requests(spark), dns, responses))


def test_partitioning_does_not_matter(spark, world):
    dns, responses, _ = world
    key = lambda df: sorted((r.request_id, r.text) for r in df.collect())
    assert key(retrieval.run(requests(spark).repartition(7), dns, responses)) == key(retrieval.run(requests(spark).coalesce(1), dns, responses))


class Handler(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(302 if self.path == "/r" else 200)
        self.send_header("Content-Type", "text/html")
        if self.path == "/r":
            self.send_header("Location", "/x")
        self.end_headers()
        self.wfile.write(b"x" * 100 if self.path == "/big" else b"<p>hello</p>")

    def log_message(self, *args):
        pass


def test_http_source(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        site = f"http://name.example:{server.server_port}"
        targets = [{"url": f"{site}{p}", "addresses": ["127.0.0.1"]} for p in ("/", "/r", "/big")] + [{"url": "http://name.example:1/", "addresses": ["127.0.0.1"]}]
        spark.dataSource.register(pinned.PinnedHttpSource)
        read = spark.read.format("pinned_http").option("targets", json.dumps(targets)).option("maxBytes", "50").load()
        out = {r.url.removeprefix(site): r for r in read.collect()}
        assert out["/"].status == 200 and bytes(out["/"].body) == b"<p>hello</p>" and out["/"].headers["content-type"] == HTML
        assert out["/r"].headers["location"] == ["/x"] and out["/big"].error_code == "too_large" and out["http://name.example:1/"].error_code == "network_error"
        table = spark.createDataFrame([(t["url"], t["addresses"]) for t in targets], "url string, addresses array<string>")
        assert {r.url: r.status for r in pinned.responses_of(table, cap=50).collect()} == {r.url: r.status for r in out.values()}
    finally:
        server.shutdown()


def test_config():
    c = config.load({"TIDEMILL_TIMEOUT_MS": "5", "TIDEMILL_ALLOW_LOOPBACK": "YES", "TIDEMILL_ALLOW_PRIVATE_HOSTS": "A.b, c.", "TIDEMILL_ROBOTS": "Enforce", "TIDEMILL_LOG": "debug"})
    assert (c.timeout_ms, c.allow_loopback, c.private_hosts, c.robots, c.log) == (5, True, ("a.b", "c"), "enforce", "debug")
    for name, value in {"TIDEMILL_TIMEOUT_MS": "0", "TIDEMILL_MAX_BYTES": "x", "TIDEMILL_ALLOW_LOOPBACK": "maybe", "TIDEMILL_ALLOW_PRIVATE_HOSTS": "1.2.3.4", "TIDEMILL_ROBOTS": "no", "TIDEMILL_LOG": "Debug"}.items():
        with pytest.raises(config.ConfigError, match=name):
            config.load({name: value})


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"kind": "host", "n": 1}\nnoise\n{"kind": "scen\n{"kind": "summary"}\n')
    (tmp_path / "p.html").write_text("<p>x")
    (tmp_path / "l.info").write_text("SF:a.rs\nDA:1,0\nDA:2,3\nend_of_record\n")
    rows = files.scan_json_lines(spark, f"{tmp_path}/a.jsonl", "kind string, n int").collect()
    assert [tuple(r) for r in rows] == [("host", 1), ("summary", None)]
    assert [tuple(r) for r in files.html_folder(spark, str(tmp_path)).collect()] == [("p.html", "<p>x")]
    assert [tuple(r) for r in files.coverage(files.numbered_lines(spark, f"{tmp_path}/l.info")).collect()] == [("a.rs", 1, 2)]
    expected = spark.createDataFrame([("p.html", 4, "0" * 64), ("q", 1, "")], "name string, size long, sha256 string")
    have = files.html_folder(spark, str(tmp_path)).select("name", F.col("html").cast("binary").alias("content"))
    assert {r.name: r.ok for r in files.verify_manifest(have, expected).collect()} == {"p.html": False, "q": False}
    assert files.markdown_table(spark.createDataFrame([(2, None), (1, "x")], "a int, b string"), ["a"]) == "| a | b |\n| --- | --- |\n| 1 | x |\n| 2 |  |"
