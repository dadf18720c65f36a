"""The service's OpenAPI document and a page that lists it."""

from __future__ import annotations

import html
from typing import Any

_TEXT, _WHOLE, _VECTOR, _OBJECT = {"type": "string"}, {"type": "integer"}, {"type": "array", "items": {"type": "number", "format": "float"}}, {"type": "object", "additionalProperties": True}


def _of(required: dict[str, Any], optional: dict[str, Any] | None = None) -> dict:
    return {"type": "object", "required": list(required), "properties": required | (optional or {})}


def _ref(name: str) -> dict:
    return {"$ref": f"#/components/schemas/{name}"}


SCHEMAS = {
    "HealthResponse": _of({"status": _TEXT}),
    "ErrorResponse": _of({"error": _TEXT}),
    "CollectionCreateRequest": _of({"name": _TEXT, "dimension": {"type": "integer", "minimum": 1}, "metric": {"type": "string", "enum": ["cosine", "euclidean", "dot_product"]}}, {"index": {"type": "string", "enum": ["flat", "hnsw"], "default": "flat"}}),
    "CollectionCreateResponse": _of({"id": _TEXT, "name": _TEXT}),
    "CollectionDetailResponse": _of({"id": _TEXT, "name": _TEXT, "dimension": _WHOLE, "metric": _TEXT, "vector_count": _WHOLE}),
    "VectorInsertRequest": _of({"vector": _VECTOR, "metadata": _OBJECT}, {"external_id": _TEXT}),
    "VectorInsertResponse": _of({"id": _WHOLE}),
    "Filter": _of({"op": {"type": "string", "enum": ["eq"]}, "key": _TEXT, "value": {}}),
    "SearchRequest": _of({"vector": _VECTOR, "k": {"type": "integer", "minimum": 0}}, {"filter": _ref("Filter")}),
    "SearchResult": _of({"id": _WHOLE, "score": {"type": "number"}, "vector": _VECTOR, "metadata": _OBJECT}, {"external_id": {"type": "string", "nullable": True}}),
    "SearchResponse": _of({"results": {"type": "array", "items": _ref("SearchResult")}}),
}
#: method, path, what it does, request, status and body of success, statuses of failure
ROUTES = [
    ("get", "/health", "Service health", None, 200, "HealthResponse", []),
    ("post", "/collections", "Create a collection", "CollectionCreateRequest", 201, "CollectionCreateResponse", [400, 500]),
    ("get", "/collections/{id}", "A collection's settings and size", None, 200, "CollectionDetailResponse", [400, 404]),
    ("post", "/collections/{id}/vectors", "Insert a vector", "VectorInsertRequest", 201, "VectorInsertResponse", [400, 404, 500]),
    ("post", "/collections/{id}/search", "The best vectors for a query", "SearchRequest", 200, "SearchResponse", [400, 404]),
]


def document() -> dict:
    body = lambda name: {"content": {"application/json": {"schema": _ref(name)}}}
    paths: dict[str, dict] = {}
    for method, path, what, request, status, answer, failures in ROUTES:
        op = {"summary": what, "responses": {str(status): {"description": what} | body(answer)} | {str(f): {"description": "Error"} | body("ErrorResponse") for f in failures}}
        if request:
            op["requestBody"] = {"required": True} | body(request)
        if "{id}" in path:
            op["parameters"] = [{"name": "id", "in": "path", "required": True, "schema": _TEXT}]
        paths.setdefault(path, {})[method] = op
    return {"openapi": "3.0.3", "info": {"title": "Halyard", "version": "1"}, "paths": paths, "components": {"schemas": SCHEMAS}}


def page() -> str:
    """The routes as HTML, without anything to load from elsewhere."""
    rows = "".join(f"<tr><td>{m.upper()}</td><td><code>{html.escape(p)}</code></td><td>{html.escape(w)}</td><td>{r or ''}</td><td>{s} {a}</td></tr>" for m, p, w, r, s, a, _ in ROUTES)
    return f'<!doctype html><title>Halyard API</title><h1>Halyard API</h1><p><a href="/api-doc/openapi.json">openapi.json</a></p><table>{rows}</table>'
