"""The engine over HTTP: a thin handler, one call of the engine for each route.

Changes are queued as jobs and answered with 202 and the job's place; ``run_jobs``
carries them out. Lists come in pages; answers are JSON, compressed if asked for.
"""

from __future__ import annotations

import gzip
import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from stemma.engine import Engine
from stemma.functions.ranges import valid
from stemma.plans import jobs

#: Bytes of a request's body at most.
MOST_BYTES = 64 << 20


class Refused(Exception):
    def __init__(self, status: int, why: str):
        super().__init__(why)
        self.status = status


def _page(rows: DataFrame, total: int | None = None) -> str:
    listed = rows.toJSON().collect()
    return f'{{"success": true, "rows": [{", ".join(listed)}], "totalRows": {len(listed) if total is None else total}}}'


def _number(options: dict[str, list[str]], name: str, default: int) -> int:
    try:
        return max(0, int(options.get(name, [default])[0]))
    except ValueError as why:
        raise Refused(400, f"{name} must be a number") from why


class Routes:
    """What each route does: (method, parts of the path, options, body) to (status, place, JSON)."""

    def __init__(self, engine: Engine):
        self.engine, self.lock = engine, threading.Lock()

    def answer(self, method: str, target: str, body: bytes) -> tuple[int, str | None, str]:
        url = urlsplit(target)
        parts, options = [p for p in url.path.split("/") if p], parse_qs(url.query)
        known: dict[str, Callable] = {"document": self._document, "association": self._association, "queue": self._queue, "index": self._index, "search": self._search}
        if not parts or parts[0] not in known:
            raise Refused(404, "no such place")
        try:
            return known[parts[0]](method, parts[1:], options, parse_qs(body.decode("utf-8", "replace"), keep_blank_values=True))
        except ValueError as why:
            raise Refused(400, str(why)) from why

    def _queued(self, *args, **named) -> tuple[int, str, str]:
        with self.lock:
            id = self.engine.enqueue(*args, **named)
        return 202, f"/queue/{id}/", json.dumps({"success": True, "id": id})

    def _document(self, method, parts, options, form):
        if method == "POST" and parts == ["test"]:
            return self._queued(jobs.COMMANDS[3])
        if len(parts) == 2:
            doctype, docid = map(int, parts)
            if method == "POST":
                return self._queued(jobs.COMMANDS[0], doctype, docid, values=form)
            if method == "DELETE":
                return self._queued(jobs.COMMANDS[1], doctype, docid)
            found = self.engine.get_document(doctype, docid).toJSON().take(1)
            if not found:
                raise Refused(404, "no such document")
            return 200, None, f'{{"success": true, "document": {found[0]}}}'
        if method != "GET" or len(parts) > 1:
            raise Refused(405, "a document has a type and an id")
        order = [x for v in options.get("order_by", []) for x in v.split(",")]
        rows, total = self.engine.list_documents(doctypes=parts[0] if parts else None, order_by=order, start=_number(options, "start", 0), limit=_number(options, "limit", 10))
        return 200, None, _page(rows, total)

    def _association(self, method, parts, options, form):
        if not all(map(valid, parts)) or len(parts) > 2:
            raise Refused(404, "ranges of document types are needed")
        source, target = [*parts, "", ""][:2]
        if method == "POST":
            return self._queued(jobs.COMMANDS[2], source=source, target=target)
        if method != "GET":
            raise Refused(405, "associations are replaced, not deleted")
        rows = self.engine.list_associations(source, target)
        order = ["doctype", "docid", "other_doctype", "other_docid"]
        return 200, None, _page(rows.orderBy(*order).offset(_number(options, "start", 0)).limit(_number(options, "limit", 10)), rows.count())

    def _queue(self, method, parts, options, form):
        if method != "GET" or len(parts) > 1:
            raise Refused(405, "the queue is read only")
        if not parts:
            rows = self.engine.queue()
            return 200, None, _page(rows.offset(_number(options, "start", 0)).limit(_number(options, "limit", 100)), rows.count())
        found = self.engine.queue_item(int(parts[0])).take(1)
        if not found:
            raise Refused(404, "no such job")
        status = {jobs.COMPLETED: 201, jobs.FAILED: 400}.get(found[0]["status"], 202)
        return status, found[0]["location"], json.dumps({"success": status != 400, "job": found[0].asDict()})

    def _index(self, method, parts, options, form):
        return 200, None, _page(self.engine.list_index(_number(options, "start", 0), _number(options, "limit", 100)))

    def _search(self, method, parts, options, form):
        if method != "POST" or len(parts) > 1:
            raise Refused(405, "a text is posted")
        found = self.engine.search(form.get("text", [""])[0], parts[0] if parts else None, _number(options, "limit", 10))
        return 200, None, _page(found)


def server(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is bound and not yet started."""
    routes = Routes(engine)

    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BYTES:
                    raise Refused(413, "too large")
                status, place, text = routes.answer(self.command, self.path, self.rfile.read(size))
            except Refused as why:
                status, place, text = why.status, None, json.dumps({"success": False, "error": str(why)})
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            if place:
                self.send_header("Location", place)
            if "gzip" in self.headers.get("Accept-Encoding", ""):
                data = gzip.compress(data, 1)
                self.send_header("Content-Encoding", "gzip")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _do

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(engine: Engine, port: int = 8080, pause: float = 1.0) -> None:
    """Serve until interrupted; jobs are carried out in between."""
    made = server(engine, port)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    stop = threading.Event()
    try:
        while not stop.wait(pause):
            engine.run_jobs()
    finally:
        made.shutdown()
