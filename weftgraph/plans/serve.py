"""An engine over HTTP, and as tools over JSON-RPC (lines on stdin, or HTTP)."""

from __future__ import annotations

import json
import sys
import time
from collections import deque
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..operators import explore
from .engine import QueryEngine

PROTOCOL, NAME = "2024-11-05", "weftgraph"


class RateLimit:
    """Requests of a client in the last 60 seconds."""

    def __init__(self, most: int = 100, window: float = 60.0):
        self.most, self.window, self.seen = most, window, {}

    def allow(self, client: str) -> bool:
        times, now = self.seen.setdefault(client, deque()), time.monotonic()
        while times and now - times[0] > self.window:
            times.popleft()
        if len(times) >= self.most:
            return False
        times.append(now)
        return True


class Tools:
    """The tools: name, what for, parameters, handler. ``register`` adds more."""

    def __init__(self, engine: QueryEngine, package: dict | None = None):
        self.engine, self.package, self.tools = engine, package or {}, {}
        text, number = {"type": "string"}, {"type": "integer"}
        rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  each handler bounds its rows
        e, g = engine, lambda: engine.data.source
        for name, description, parameters, handler in (
            ("search_entities", "Entities with a text in them", {"query": text, "entity_type": text, "limit": number}, lambda query, entity_type=None, limit=10: rows(explore.search(g(), query, entity_type, min(limit, 500)))),
            ("get_entity", "An entity's facts", {"iri": text}, lambda iri: rows(explore.facts(g(), iri).limit(500))),
            ("get_related", "An entity's neighbours", {"iri": text, "predicate": text, "depth": number}, lambda iri, predicate=None, depth=1: rows(explore.neighbours(g(), iri, depth, predicate))),
            ("query_graph", "Run SPARQL", {"sparql": text, "role": text}, lambda sparql, role=None: rows(e.execute_sparql(sparql, role))),
            ("ask_question", "Ask in plain words", {"question": text, "role": text}, lambda question, role=None: asdict(e.ask(question, role))),
            ("get_schema", "Tables and relationships", {"role": text}, lambda role=None: e.get_schema(role)),
            ("get_lineage", "Where the graph comes from", {}, lambda: self.package.get("lineage") or rows(explore.lineage(g()).limit(500))),
            ("get_metrics", "Numeric properties and timings", {"subject": text}, lambda subject=None: {"properties": [r["predicate"] for r in rows(explore.numeric_properties(g(), subject))], "timings": e.metrics.report()}),
            ("semantic_search", "Entities by shared words", {"query": text, "top_k": number}, lambda query, top_k=10: rows(explore.token_overlap(g(), query, min(top_k, 500)))),
            ("list_sources", "Source tables", {}, lambda: [{"name": t["name"], "entity": t["entity"]} for t in e.schema.tables]),
            ("get_audit_log", "The last events", {"limit": number}, lambda limit=50: list(e.audit.events)[-limit:]),
            ("get_pii_policy", "Masked columns", {}, lambda: {t["name"]: {c: s["mask"] for c, s in t["columns"].items() if s.get("mask")} for t in e.schema.tables}),
            ("generate_sparql", "SPARQL for a question", {"question": text}, lambda question: {"sparql": e.generate_sparql(question)[0]}),
            ("validate_sparql", "Check SPARQL", {"sparql": text}, lambda sparql: e.validate_sparql(sparql)),
            ("execute_sparql", "Run SPARQL", {"sparql": text, "role": text}, lambda sparql, role=None: rows(e.execute_sparql(sparql, role))),
            ("ask_graph", "Ask within a session", {"question": text, "session_id": text, "role": text}, lambda question, session_id=None, role=None: asdict(e.ask(question, role, session_id))),
            ("start_session", "Begin a session", {}, lambda: {"session_id": e.start_session()}),
            ("get_manifest", "The package's manifest", {}, lambda: self.package.get("manifest") or {}),
        ):
            self.register(name, description, parameters, handler)

    def register(self, name: str, description: str, parameters: dict, handler) -> None:
        self.tools[name] = (description, {"type": "object", "properties": parameters}, handler)

    def handle(self, message: dict) -> dict | None:
        """One JSON-RPC message; None for notifications."""
        method, params, answer = message.get("method"), message.get("params") or {}, {"jsonrpc": "2.0", "id": message.get("id")}
        if method == "initialize":
            return answer | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": "1"}}}
        if method == "ping":
            return answer | {"result": {}}
        if method and method.startswith("notifications/"):
            return None
        if method == "tools/list":
            return answer | {"result": {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in self.tools.items()]}}
        if method == "tools/call":
            if params.get("name") not in self.tools:
                return answer | {"error": {"code": -32602, "message": f"no tool {params.get('name')!r}"}}
            try:
                value = self.tools[params["name"]][2](**(params.get("arguments") or {}))
                return answer | {"result": {"content": [{"type": "text", "text": json.dumps(value, default=str)}], "isError": False}}
            except Exception as x:  # noqa: BLE001  a tool's failure is an answer
                return answer | {"result": {"content": [{"type": "text", "text": str(x)}], "isError": True}}
        return answer | {"error": {"code": -32601, "message": f"no method {method!r}"}}

    def stdio(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip():
                try:
                    answer = self.handle(json.loads(line))
                except ValueError:
                    answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}
                if answer is not None:
                    print(json.dumps(answer), file=out, flush=True)


def routes(engine: QueryEngine, tools: Tools):
    """(method, path) -> handler(body, role). {id} stands for a path's last but one part."""
    e = engine
    rows = lambda df: [r.asDict() for r in df.collect()]

    def openapi(*_):
        paths: dict = {}
        for method, path in table:
            paths.setdefault(path, {})[method.lower()] = {"responses": {"200": {"description": "JSON"}}}
        return {"openapi": "3.0.0", "info": {"title": NAME, "version": "1"}, "paths": paths}

    table = {
        ("GET", "/health"): lambda b, r: e.health(),
        ("GET", "/schema"): lambda b, r: e.get_schema(r),
        ("GET", "/relationships"): lambda b, r: e.schema.relationships,
        ("GET", "/manifest"): lambda b, r: tools.package.get("manifest") or {},
        ("GET", "/lineage"): lambda b, r: tools.package.get("lineage") or {},
        ("GET", "/metrics"): lambda b, r: e.metrics.report(),
        ("GET", "/openapi.json"): openapi,
        ("POST", "/sessions"): lambda b, r: {"session_id": e.start_session()},
        ("POST", "/sparql/generate"): lambda b, r: {"sparql": e.generate_sparql(b["question"])[0]},
        ("POST", "/sparql/validate"): lambda b, r: e.validate_sparql(b["sparql"]),
        ("POST", "/sparql/execute"): lambda b, r: {"rows": rows(e.execute_sparql(b["sparql"], r))},
        ("POST", "/ask"): lambda b, r: asdict(e.ask(b["question"], r)),
        ("POST", "/sessions/{id}/ask"): lambda b, r: asdict(e.ask(b["question"], r, b["id"])),
        ("POST", "/mcp"): lambda b, r: tools.handle(b) or {},
    }
    return table


def server(engine: QueryEngine, host: str = "127.0.0.1", port: int = 0, token: str | None = None, package: dict | None = None, limit: RateLimit | None = None) -> ThreadingHTTPServer:
    """An HTTP server (not yet serving). With ``token`` every request needs it as bearer; the role is the body's role or X-Role."""
    tools = Tools(engine, package)
    table, limit = routes(engine, tools), limit or RateLimit()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, status: int, value) -> None:
            body = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def handle_one(self) -> None:
            if token and self.headers.get("Authorization") != f"Bearer {token}":
                return self.reply(401, {"error": "unauthorised"})
            if not limit.allow(self.client_address[0]):
                return self.reply(429, {"error": "too many requests"})
            path = self.path.partition("?")[0]
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                parts = path.strip("/").split("/")
                if len(parts) == 3 and parts[0] == "sessions":
                    body, path = body | {"id": parts[1]}, f"/sessions/{{id}}/{parts[2]}"
                found = table.get((self.command, path))
                if found is None:
                    return self.reply(404, {"error": f"no {self.command} {path}"})
                return self.reply(200, found(body, body.get("role") or self.headers.get("X-Role")))
            except KeyError as x:
                return self.reply(400, {"error": f"missing or unknown: {x}"})
            except ValueError as x:
                return self.reply(400, {"error": str(x)})
            except Exception as x:  # noqa: BLE001
                return self.reply(500, {"error": str(x).splitlines()[0]})

        do_GET = do_POST = handle_one

    return ThreadingHTTPServer((host, port), Handler)


__all__ = ["RateLimit", "Tools", "routes", "server"]
