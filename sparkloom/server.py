"""JSON over HTTP: /api/stats, graph, symbols, modules, impact, callers, callees, context and search."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from .session import SourceGraph


def answer(session: SourceGraph, url: str) -> tuple[int, object]:
    """Status and content for a request."""
    parts = urlsplit(url)
    given = {k: v[-1] for k, v in parse_qs(parts.query).items()}
    number = lambda name, default: int(given.get(name, default))
    routes = {
        "/api/stats": lambda: session.stats(),
        "/api/modules": lambda: session.modules(),
        "/api/graph": lambda: session.subgraph(given.get("seed"), number("depth", 1), number("limit", 200)),
        "/api/symbols": lambda: session.symbols(given.get("q", ""), number("limit", 50)),
        "/api/impact": lambda: session.impact(given["symbol"], number("depth", 2)),
        "/api/callers": lambda: session.callers(given["symbol"], number("depth", 2)),
        "/api/callees": lambda: session.callees(given["symbol"], number("depth", 2)),
        "/api/context": lambda: session.context(given["symbol"]),
        "/api/search": lambda: session.search(given["q"], number("k", 10)),
    }
    if parts.path not in routes:
        return 404, {"error": "not found"}
    try:
        return 200, routes[parts.path]()
    except Exception as error:  # a failed query must not end the server
        return 500, {"error": f"{type(error).__name__}: {error}"[:500]}


def serve(session: SourceGraph, host: str = "127.0.0.1", port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            self._send(*answer(session, self.path))

        def do_POST(self) -> None:
            self._send(405, {"error": "use GET"})

        def _send(self, status: int, content: object) -> None:
            body = json.dumps(content, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    ThreadingHTTPServer((host, port), Handler).serve_forever()
