"""Requests over HTTP against a local server, form addresses, byte ranges, lines that cannot be read."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from streamloom.operators import lex
from streamloom.sources import readers


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802 - the base class names it
        if self.path == "/moved":
            self.send_response(302)
            self.send_header("Location", "/data")
            self.end_headers()
            return
        body, status = bytes(range(100)), 200
        if self.path == "/gone":
            body, status = b'{"why": "gone"}', 404
        span = self.headers.get("Range")
        if span:
            a, b = span.removeprefix("bytes=").split("-")
            body, status = body[int(a) : int(b) + 1], 206
        self.send_response(status)
        self.send_header("Content-Type", "application/json" if status == 404 else "video/mp4")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def test_fetch(spark, server):
    rows = [(0, f"{server}/data", None, None), (1, f"{server}/data", 10, 19), (2, f"{server}/moved", None, None), (3, f"{server}/gone", None, None), (4, "", None, None), (5, None, None, None), (6, "http://127.0.0.1:1/", None, None), (7, "file:///etc/passwd", None, None)]
    df = spark.createDataFrame(rows, "id int, url string, a long, z long")
    got = {r.id: r for r in readers.fetch(df, start_col="a", end_col="z", timeout=5).collect()}
    assert len(got) == len(rows)
    assert (got[0].status, bytes(got[0].content), got[0].content_type, got[0].fetch_error) == (200, bytes(range(100)), "video/mp4", None)
    assert (got[1].status, bytes(got[1].content), got[1].fetch_error) == (206, bytes(range(10, 20)), None)
    assert got[2].final_url == f"{server}/data" and got[2].fetch_error is None
    assert got[3].fetch_error.error == "Bad HTTP status code: 404 Not Found" and got[3].fetch_error.extra_info == '{"why": "gone"}'
    assert all(bytes(got[k].content) == b"" and got[k].fetch_error is None for k in (4, 5))
    assert all(got[k].fetch_error.error.startswith("TypeError: ") and got[k].content is None for k in (6, 7))
    assert readers.fetch(df.limit(0)).count() == 0


def test_byte_ranges_beyond_the_content(spark):
    rows = [(0, bytearray(b"abcdef"), 2, 3), (1, bytearray(b"abcdef"), 4, 1 << 40), (2, bytearray(b"abcdef"), 1 << 35, 1 << 36), (3, bytearray(b"abcdef"), None, 3), (4, None, 0, 1)]
    got = {r.id: r.content for r in readers.byte_range(spark.createDataFrame(rows, "id int, content binary, range_start long, range_end long")).collect()}
    assert [None if got[k] is None else bytes(got[k]) for k in range(5)] == [b"cd", b"ef", b"", b"abcdef", None]


def test_lines_end_where_one_cannot_be_read(spark):
    bodies = {"a": "#EXTM3U\r\nu\r\n\r\nv", "b": "#EXTM3U\nu\nx\ry\nz", "c": "#EXTM3U\ry\nz", "d": "#EXTM3U\nu\r", "e": "", "f": "no\rlist\n#EXTM3U"}
    rows = lex.lines(spark.createDataFrame(list(bodies.items()), "playlist_url string, body string")).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.playlist_url, r.line_no)):
        got.setdefault(r.playlist_url, []).append((r.raw, r.error is not None))
    assert [x for x, _ in got["a"]] == ["#EXTM3U", "u", "", "v"] and [x for x, _ in got["b"]] == ["#EXTM3U", "u"] and [x for x, _ in got["d"]] == ["#EXTM3U"]
    assert "e" not in got and all(len(got[k]) == 1 and got[k][0][1] for k in "cf")
    plan = lex.lines(spark.createDataFrame([("a", "b")], "playlist_url string, body string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
