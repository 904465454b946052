"""The analysis endpoints as a WSGI application: any server can run it, and :func:`answer` works without one.

Model answers come from a function that the caller sets; without it the endpoints that need one say 503.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

#: What may be asked for: kind, and the fields of the request that are passed on.
KINDS = {"honeypot": ("duration", "commands", "downloads", "login_attempts"), "phishing": ("content", "url"), "cve": ("cve_id", "description", "patch_diff")}
#: Direct endpoints by path.
DIRECT = {"/classify-attacker": "honeypot", "/detect-phishing": "phishing", "/score-cve": "cve"}

Model = Callable[[str, dict], dict]


def answer(method: str, path: str, body: bytes, model: Model | None) -> tuple[int, dict]:
    """API-1: status and body of a request. 404 for other paths, 400 for bodies that aren't objects and unknown kinds, 503 without a model."""
    if path == "/health":
        return 200, {"status": "ok" if model else "loading"}
    kind = DIRECT.get(path)
    if method != "POST" or not (kind or path == "/analyze"):
        return 404, {"detail": "unknown path"}
    if model is None:
        return 503, {"detail": "no model"}
    try:
        asked = json.loads(body or b"{}")
    except ValueError:
        asked = None
    if not isinstance(asked, dict):
        return 400, {"detail": "the body must be a JSON object"}
    data = asked if kind else asked.get("data") or {}
    kind = kind or asked.get("type")
    if kind not in KINDS:
        return 400, {"detail": f"unknown type: {kind}"}
    return 200, model(kind, {k: data[k] for k in KINDS[kind] if k in data})


def application(model: Model | None = None):
    """The WSGI callable."""
    words = {200: "OK", 400: "Bad Request", 404: "Not Found", 503: "Service Unavailable"}

    def app(environ: dict, start_response) -> Iterable[bytes]:
        size = int(environ.get("CONTENT_LENGTH") or 0)
        body = environ["wsgi.input"].read(size) if size else b""
        status, found = answer(environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/"), body, model)
        start_response(f"{status} {words[status]}", [("Content-Type", "application/json")])
        return [json.dumps(found).encode()]

    return app
