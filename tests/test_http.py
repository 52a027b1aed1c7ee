import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lexloom.functions.embed import Http
from lexloom.sources import http


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(200 if self.path != "/no" else 404)
        self.send_header("Content-Type", "text/html")
        self.end_headers()
        self.wfile.write(b"x" * 50)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.send_response(200)
        self.end_headers()
        rows = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
        self.wfile.write(json.dumps({"data": rows[::-1]}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch(url):
    assert http.fetch(f"{url}/a") == (200, "text/html", "x" * 50) and http.fetch(f"{url}/no")[0] == 404
    with pytest.raises(ValueError):
        http.fetch(f"{url}/a", most=10)


def test_embeddings(url):
    p = Http(http.post, url, "m", "k", 2, size=2)
    assert p.embed_all(["a", "bbb", "cc"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]]
