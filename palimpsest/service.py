"""An HTTP face of a store: POST /set, GET /get, DELETE /delete, GET /metrics."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import RLock
from urllib.parse import parse_qs, urlsplit

from palimpsest.model import ConflictError
from palimpsest.store import Store


def handler_for(store: Store) -> type[BaseHTTPRequestHandler]:
    lock = RLock()  # single writes come from one thread at a time

    class Handler(BaseHTTPRequestHandler):
        def _say(self, status: int, body: dict) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _key(self) -> bytes | None:
            found = parse_qs(urlsplit(self.path).query).get("key")
            return found[0].encode() if found else None

        def _commit(self, change) -> bool:
            with lock:
                txn = store.begin()
                change(txn)
                try:
                    txn.commit()
                    return True
                except ConflictError:
                    return False

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/set":
                return self._say(404, {"error": "no such route"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                key, value = body["key"].encode(), body["value"].encode()
            except (ValueError, KeyError, TypeError, AttributeError):
                return self._say(400, {"error": "a JSON object with key and value is asked for"})
            done = self._commit(lambda t: t.set(key, value))
            self._say(200 if done else 500, {"key": body["key"]} if done else {"error": "the commit failed"})

        def do_GET(self) -> None:
            route = urlsplit(self.path).path
            if route == "/metrics":
                return self._say(200, store.metrics())
            if route != "/get":
                return self._say(404, {"error": "no such route"})
            key = self._key()
            if key is None:
                return self._say(400, {"error": "no key"})
            with lock:
                value = store.begin().get(key)
            if value is None:
                return self._say(404, {"error": "not found"})
            self._say(200, {"key": key.decode(), "value": value.decode("utf-8", "replace")})

        def do_DELETE(self) -> None:
            if urlsplit(self.path).path != "/delete":
                return self._say(404, {"error": "no such route"})
            key = self._key()
            if key is None:
                return self._say(400, {"error": "no key"})
            done = self._commit(lambda t: t.delete(key))
            self._say(200 if done else 500, {"key": key.decode()} if done else {"error": "the commit failed"})

        def log_message(self, form: str, *args) -> None:
            store.log.debug("request", line=form % args)

    return Handler


def serve(store: Store, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound but not yet serving: call ``serve_forever``."""
    return ThreadingHTTPServer((host, port), handler_for(store))
