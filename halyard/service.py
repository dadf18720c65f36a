"""The service: its routes as a function from request to (status, body), and an HTTP
adapter over it, with logged rows flushed in the background."""

from __future__ import annotations

import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession

from . import openapi
from .functions.metadata import Filter
from .model import BadRequest, EngineConfig, EngineError, IndexType, Metric, check_vector
from .plans.collection import Engine
from .streaming.flush import FlushWorker

log = logging.getLogger(__name__)


def _field(body: Any, name: str, kind: type | tuple, required: bool = True) -> Any:
    if not isinstance(body, dict):
        raise BadRequest("body must be a JSON object")
    v = body.get(name)
    if v is None and not required:
        return None
    if v is None or not isinstance(v, kind) or isinstance(v, bool):
        raise BadRequest(f"field {name} is missing or of a wrong type")
    return v


class Service:
    def __init__(self, spark: SparkSession, config: EngineConfig | None = None):
        self.config = config or EngineConfig()
        self.engine = Engine(spark, self.config)
        self._write = threading.Lock()
        self.worker = FlushWorker(self.engine)

    def start(self) -> Service:
        """Begin flushing logged rows in the background."""
        self.worker.start()
        return self

    def close(self) -> None:
        """Let the insert in progress end, then flush what is logged."""
        with self._write:
            self.worker.stop()

    def handle(self, method: str, path: str, body: Any = None) -> tuple[int, dict | str]:
        """(status, body); a body that is text is a page."""
        parts = [p for p in path.split("?")[0].split("/") if p]
        try:
            match method, parts:
                case "GET", ["health"]:
                    return 200, {"status": "ok"}
                case "GET", ["api-doc", "openapi.json"]:
                    return 200, openapi.document()
                case "GET", ["swagger-ui", *_]:
                    return 200, openapi.page()
                case "POST", ["collections"]:
                    return self._create(body)
                case "GET", ["collections", id_]:
                    return 200, self.engine.collection(id_).detail()
                case "POST", ["collections", id_, "vectors"]:
                    return self._insert(id_, body)
                case "POST", ["collections", id_, "search"]:
                    return self._search(id_, body)
            return 404, {"error": "Not found"}
        except EngineError as e:
            return e.status, {"error": str(e)}

    def _create(self, body: Any) -> tuple[int, dict]:
        name, dimension = _field(body, "name", str), _field(body, "dimension", int)
        metric = Metric.parse(_field(body, "metric", str))
        if metric is None:
            raise BadRequest("Invalid metric. Use: cosine, euclidean, dot_product")
        index = IndexType.parse(_field(body, "index", str, required=False) or "flat")
        c = self.engine.create(name, dimension, metric, index)
        return 201, {"id": c.id, "name": c.name}

    def _insert(self, id_: str, body: Any) -> tuple[int, dict]:
        c = self.engine.collection(id_)
        vector, metadata = _field(body, "vector", list), _field(body, "metadata", dict)
        external = _field(body, "external_id", str, required=False)
        check_vector(vector, c.dimension, "Vector")
        with self._write:
            try:
                return 201, {"id": c.insert(vector, metadata, external)}
            except EngineError:
                raise
            except Exception:
                log.exception("insert failed")
                raise EngineError("Failed to persist write") from None

    def _search(self, id_: str, body: Any) -> tuple[int, dict]:
        c = self.engine.collection(id_)
        where = _field(body, "filter", dict, required=False)
        rows = c.search(_field(body, "vector", list), _field(body, "k", int), Filter.parse(where) if where else None)
        return 200, {"results": [{"id": r["id"], "score": r["score"], "vector": list(r["vector"]), "external_id": r["external_id"], "metadata": {k: json.loads(v) for k, v in r["metadata"].items()}} for r in rows.collect()]}


def http_server(service: Service) -> ThreadingHTTPServer:
    """A server on the configured host and port; the caller runs and stops it.
    The background flush runs from here on to ``server_close()``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                status, body = service.handle(self.command, self.path, json.loads(raw) if raw else None)
            except ValueError:
                status, body = 400, {"error": "body is not JSON"}
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            log.info(*args)

    class Server(ThreadingHTTPServer):
        def server_close(self) -> None:
            super().server_close()  # waits for requests in progress
            service.close()

        daemon_threads = False

    service.start()
    return Server((service.config.host, service.config.port), Handler)
