"""The engine over HTTP, with the standard library's server."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import SearchEngine
from .errors import BadRequest, EngineError, NotFound


def handle(engine: SearchEngine, lock: threading.Lock, method: str, path: str, body: bytes):
    """(status, answer) of a request."""
    def parsed() -> dict:
        try:
            d = json.loads(body or b"{}")
        except ValueError as e:
            raise BadRequest(f"invalid JSON: {e}") from e
        if not isinstance(d, dict):
            raise BadRequest("a JSON object is required")
        return d

    try:
        if (method, path) == ("GET", "/health"):
            return 200, "ok"
        if (method, path) == ("POST", "/documents/batch"):
            docs = parsed().get("documents")
            if not isinstance(docs, list):
                raise BadRequest("documents is required")
            with lock:
                return 200, engine.batch_insert(docs)
        if (method, path) == ("POST", "/ingestion/jobs"):
            return 200, {"job_id": engine.start_sync().id}
        if (method, path) == ("GET", "/ingestion/last"):
            return 200, engine.jobs.last().to_dict()
        if method == "GET" and path.startswith("/ingestion/jobs/"):
            return 200, engine.jobs.get(path.rpartition("/")[2]).to_dict()
        if (method, path) == ("POST", "/search"):
            return 200, engine.search_json(parsed())
        raise NotFound(f"no such route: {method} {path}")
    except EngineError as e:
        return e.status, {"error": str(e)}
    except Exception as e:
        return 500, {"error": str(e)}


def serve(engine: SearchEngine, addr: str | None = None) -> ThreadingHTTPServer:
    """A server, not yet started: call serve_forever()."""
    host, _, port = (addr or engine.config.addr).rpartition(":")
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = handle(engine, lock, self.command, self.path.split("?")[0], body)
            raw = found.encode() if isinstance(found, str) else json.dumps(found).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if isinstance(found, str) else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            return

    return ThreadingHTTPServer((host, int(port)), Handler)
