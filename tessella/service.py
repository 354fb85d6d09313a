"""The engine over HTTP, by the standard library: questions, streamed answers, uploads, statistics.

``Service.answer`` maps a request to a response without any socket, so it can be tested and mounted elsewhere.
"""

from __future__ import annotations

import email.parser
import email.policy
import hmac
import json
import logging
import threading
import time
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import unquote

from tessella.config import Settings
from tessella.engine import Engine, Mismatch
from tessella.sources import documents as sources

log = logging.getLogger("tessella")
VERSION = "0.2"
PAGE = """<!doctype html><meta charset="utf-8"><title>Tessella</title><form id=f><input id=q size=80 autofocus><button>Ask</button></form><div id=a></div><ul id=s></ul><script>
f.onsubmit=async e=>{e.preventDefault();a.textContent='';s.textContent='';const r=await fetch('/v1/query/stream',{method:'POST',body:JSON.stringify({question:q.value})}),d=r.body.getReader(),t=new TextDecoder();let b='';
for(;;){const{done,value}=await d.read();if(done)break;b+=t.decode(value,{stream:true});let i;while((i=b.indexOf('\\n\\n'))>=0){const[k,v]=b.slice(0,i).split('\\n').map(x=>x.slice(x.indexOf(': ')+2));b=b.slice(i+2);const x=JSON.parse(v);
if(k==='token')a.textContent+=x;if(k==='sources')for(const y of x)s.append(Object.assign(document.createElement('li'),{textContent:y.location||y.chunk_id}));if(k==='error')a.textContent=x}}}</script>"""


@dataclass
class Statistics:
    """Counts of all requests, and latencies of the last ``window``."""

    window: int = 1000
    requests: int = 0
    errors: int = 0
    abstentions: int = 0
    latencies: deque = field(default_factory=deque)
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def answered(self, made: dict[str, Any]) -> None:
        with self.lock:
            self.requests += 1
            self.abstentions += made["abstained"]
            self.latencies.append(made["timings_ms"]["total"])
            while len(self.latencies) > self.window:
                self.latencies.popleft()

    def failed(self) -> None:
        with self.lock:
            self.errors += 1

    def now(self) -> dict[str, Any]:
        """Percentiles are nearest ranks, halves to the even one."""
        with self.lock:
            found = sorted(self.latencies)
            rank = lambda p: round(found[min(len(found) - 1, round(p * (len(found) - 1)))], 2) if found else None
            rate = round(self.abstentions / self.requests, 4) if self.requests else None
            return {"requests": self.requests, "errors": self.errors, "abstention_rate": rate, "latency_ms": {f"p{p}": rank(p / 100) for p in (50, 95, 99)}}


class Problem(Exception):
    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


@dataclass
class Response:
    status: int
    body: bytes | Iterator[bytes]
    kind: str = "application/json"
    headers: dict[str, str] = field(default_factory=dict)


class JsonLog(logging.Formatter):
    """A line of JSON for each record."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})


def uploads(kind: str, body: bytes) -> list[tuple[str, bytes]]:
    """Names and bytes of the files in a multipart body."""
    message = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(b"content-type: " + kind.encode() + b"\r\n\r\n" + body)
    return [(part.get_filename() or "upload.txt", part.get_payload(decode=True) or b"") for part in message.iter_parts()] if message.is_multipart() else []


class Service:
    def __init__(self, engine: Engine, settings: Settings | None = None) -> None:
        self.engine, self.settings, self.stats = engine, settings or Settings(), Statistics()
        self.routes = {("GET", "/v1/config"): self.config, ("POST", "/v1/query"): self.query, ("POST", "/v1/query/stream"): self.stream, ("POST", "/v1/documents"): self.upload, ("GET", "/v1/documents"): self.documents, ("GET", "/v1/stats"): lambda r: self.stats.now()}

    def answer(self, method: str, path: str, body: bytes = b"", headers: dict[str, str] | None = None) -> Response:
        began, given = time.perf_counter(), {k.lower(): v for k, v in (headers or {}).items()}
        name = given.get("x-request-id") or uuid.uuid4().hex[:12]
        try:
            out = self._answer(method, path.split("?")[0], body, given)
        except Problem as p:
            out = Response(p.status, json.dumps({"detail": str(p)}).encode())
        except Mismatch as p:
            out = Response(409, json.dumps({"detail": str(p)}).encode())
        except ValueError as p:
            out = Response(400, json.dumps({"detail": str(p)}).encode())
        except Exception as p:
            self.stats.failed()
            log.exception("request %s failed", name)
            out = Response(500, json.dumps({"detail": type(p).__name__}).encode())
        took = 1000 * (time.perf_counter() - began)
        out.headers |= {"x-request-id": name, "server-timing": f"total;dur={took:.1f}"}
        log.info("%s %s %s %.1f ms [%s]", method, path, out.status, took, name)
        return out

    def _answer(self, method: str, path: str, body: bytes, headers: dict[str, str]) -> Response:
        if (method, path) == ("GET", "/"):
            return Response(200, PAGE.encode(), "text/html; charset=utf-8")
        if (method, path) == ("GET", "/health"):
            return Response(200, json.dumps(self.health()).encode())
        if self.settings.api_key and not hmac.compare_digest(headers.get("x-api-key", "").encode(), self.settings.api_key.encode()):
            raise Problem(401, "a valid key is needed")
        if method == "DELETE" and path.startswith("/v1/documents/"):
            return self.delete(unquote(path.removeprefix("/v1/documents/")))
        if (method, path) not in self.routes:
            raise Problem(404, "no such place")
        made = self.routes[method, path]((headers, body))
        return made if isinstance(made, Response) else Response(200, json.dumps(made, ensure_ascii=False).encode())

    def health(self) -> dict[str, Any]:
        try:
            n = self.engine.counts()
        except KeyError:
            n = {"documents": 0, "chunks": 0}
        return {"status": "ok", "version": VERSION, "collection": self.engine.collection, **n, "embedder": self.engine.embedder.name, "config_id": self.engine.config.fingerprint()}

    def config(self, request) -> dict[str, Any]:
        return {"config_id": self.engine.config.fingerprint(), "pipeline": asdict(self.engine.config), "embedder": self.engine.embedder.name}

    def _asked(self, body: bytes) -> tuple[str, int | None]:
        try:
            data = json.loads(body)
            question, k = data["question"], data.get("k")
        except (ValueError, KeyError, TypeError, AttributeError) as p:
            raise Problem(422, "a question is needed") from p
        if not isinstance(question, str) or not 1 <= len(question) <= 2000 or (k is not None and (not isinstance(k, int) or not 1 <= k <= 50)):
            raise Problem(422, "a question has 1 to 2000 characters, k is 1 to 50")
        return question, k

    def query(self, request) -> dict[str, Any]:
        try:
            made = self.engine.ask(*self._asked(request[1]))
        except KeyError as p:
            raise Problem(409, "no documents have been taken into this collection yet") from p
        self.stats.answered(made)
        return made

    def stream(self, request) -> Response:
        asked = self._asked(request[1])

        def events() -> Iterator[bytes]:
            said = lambda e, d: f"event: {e}\ndata: {json.dumps(d, ensure_ascii=False)}\n\n".encode()
            try:
                for e in self.engine.stream(*asked):
                    if e["event"] == "done":
                        self.stats.answered(e["data"])
                    yield said(e["event"], e["data"])
            except KeyError:
                yield said("error", "no documents have been taken into this collection yet")
            except Exception as p:
                self.stats.failed()
                log.exception("stream failed")
                yield said("error", type(p).__name__)

        return Response(200, events(), "text/event-stream", {"cache-control": "no-cache"})

    def upload(self, request) -> dict[str, Any]:
        headers, body = request
        rows, most = [], self.settings.max_upload_mb << 20
        for name, data in uploads(headers.get("content-type", ""), body):
            if not name.lower().endswith(tuple(sources.EXTENSIONS)):
                raise Problem(415, f"unsupported file type: {name}")
            if len(data) > most:
                raise Problem(413, f"{name} is over {self.settings.max_upload_mb} MB")
            try:
                rows.append(sources.load_bytes(name, data))
            except Exception as p:
                raise Problem(422, f"{name} can't be read: {p}") from p
        if not rows:
            raise Problem(422, "no files")
        return self.engine.ingest(self.engine.spark.createDataFrame(rows, sources.DOCUMENT))

    def documents(self, request) -> list[dict[str, Any]]:
        try:
            return [r.asDict() for r in self.engine.list_documents().collect()]
        except KeyError:
            return []

    def delete(self, doc_id: str) -> Response:
        try:
            gone = self.engine.delete_document(doc_id)
        except KeyError:
            gone = False
        if not gone:
            raise Problem(404, f"no document {doc_id!r}")
        return Response(204, b"")


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8000, settings: Settings | None = None) -> None:
    """Answers until it is stopped."""
    service = Service(engine, settings)
    if service.settings.log_json:
        for handler in logging.getLogger().handlers:
            handler.setFormatter(JsonLog())

    class Handler(BaseHTTPRequestHandler):
        def _any(self) -> None:
            body = self.rfile.read(int(self.headers.get("content-length") or 0))
            out = service.answer(self.command, self.path, body, dict(self.headers))
            self.send_response(out.status)
            for k, v in {"content-type": out.kind, **out.headers}.items():
                self.send_header(k, v)
            self.end_headers()
            for part in [out.body] if isinstance(out.body, bytes) else out.body:
                self.wfile.write(part)
                self.wfile.flush()

        do_GET = do_POST = do_DELETE = _any

    ThreadingHTTPServer((host, port), Handler).serve_forever()
