"""An HTTP interface to a written index: a search page, /api/search, /api/stats and /health."""

from __future__ import annotations

import html
import json
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from quillspark.plans.parser import QueryError
from quillspark.plans.search import SearchIndex, format_bytes, format_duration, page_count, page_offset

PAGE_ROWS, PAGE_MOST = 10, 100


def number(text: str | None, least: int, otherwise: int, most: int | None = None) -> int:
    """text as a number within bounds, else a default."""
    try:
        value = int(text or "")
    except ValueError:
        return otherwise
    return value if value >= least and (most is None or value <= most) else otherwise


def answer(index: SearchIndex, target: str) -> tuple[int, str, str]:
    """Status, content type and body of a GET."""
    url = urlparse(target)
    q = {k: v[0] for k, v in parse_qs(url.query).items()}
    text = q.get("q", "").strip()
    as_json = "application/json; charset=utf-8"
    if url.path == "/health":
        return 200, as_json, json.dumps({"status": "ok", "time": datetime.now(UTC).isoformat()})
    if url.path == "/api/stats":
        return 200, as_json, json.dumps(index.stats())
    if url.path == "/api/search":
        if not text:
            return 400, as_json, json.dumps({"error": "the parameter q is missing"})
        try:
            return 200, as_json, index.search(text, number(q.get("limit"), 1, PAGE_ROWS), number(q.get("offset"), 0, 0)).to_json()
        except QueryError as e:
            return 400, as_json, json.dumps({"error": str(e)})
    if url.path in ("/", "/search"):
        return 200, "text/html; charset=utf-8", page(index, text, q)
    return 404, as_json, json.dumps({"error": "no such page"})


def page(index: SearchIndex, text: str, q: dict[str, str]) -> str:
    """The search page, with results if something is asked for."""
    form = f'<form action="/search"><input name="q" value="{html.escape(text, quote=True)}"><button>Search</button></form>'
    if not text:
        s = index.stats()
        return f"<!doctype html><title>Search</title>{form}<p>{s['total_docs']} documents, {format_bytes(s['index_size_bytes'])}</p>"
    limit, at = number(q.get("limit"), 1, PAGE_ROWS, PAGE_MOST), number(q.get("page"), 1, 1)
    try:
        found = index.search(text, limit, page_offset(at, limit))
    except QueryError as e:
        return f"<!doctype html><title>Search</title>{form}<p>{html.escape(str(e))}</p>"
    items = []
    for h in found.hits:
        first = lambda names, h=h: next((h[n] for n in names if isinstance(h.get(n), str)), None)
        head, body = first(("title", "name", "subject")), first(("body", "text", "content", "description")) or ""
        items.append(f'<li value="{h["rank"]}"><b>{html.escape("(untitled)" if head is None else head)}</b> {h["score"]:.4f}<br>{html.escape(body[:200])}{"..." if len(body) > 200 else ""}</li>')
    pages = page_count(found.total_matches, limit)
    links = "".join(f' <a href="/search?q={html.escape(text, quote=True)}&page={n}">{word}</a>' for n, word in ((at - 1, "previous"), (at + 1, "next")) if 1 <= n <= pages)
    return f"<!doctype html><title>Search</title>{form}<p>{found.total_matches} documents in {format_duration(found.took_ms)}</p><ol>{''.join(items)}</ol>{links}"


def serve(index: SearchIndex, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for the index, not yet running."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            try:
                status, kind, body = answer(index, self.path)
            except Exception as e:  # a request must not end the server
                status, kind, body = 500, "application/json; charset=utf-8", json.dumps({"error": str(e)[:200]})
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
