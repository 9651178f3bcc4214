"""A local HTTP front over a compiled store: /api/ROUTE?name=value, read-only, this machine only."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlparse

from .operators.api import Api

PAGE = "<!doctype html><meta charset=utf-8><title>strataglyph</title><h1>strataglyph</h1><ul>{}</ul>"


def handler(api: Api) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def log_message(self, *_: object) -> None:
            pass

        def answer(self, status: int, body: str, kind: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            if url.path in ("/", "/index.html"):
                return self.answer(200, PAGE.format("".join(f'<li><a href="/api/{r}">{r}</a>' for r in api.ROUTES)), "text/html")
            if not url.path.startswith("/api/"):
                return self.answer(404, "not found", "text/plain")
            try:
                payload, status = api.call(url.path.removeprefix("/api/"), dict(parse_qsl(url.query))), 200
            except LookupError as error:
                payload, status = {"error": f"no such route: {error}"}, 404
            self.answer(status, json.dumps(payload, ensure_ascii=False, default=str), "application/json")

    return Handler


def server(api: Api, port: int = 8765) -> ThreadingHTTPServer:
    return ThreadingHTTPServer(("127.0.0.1", port), handler(api))
