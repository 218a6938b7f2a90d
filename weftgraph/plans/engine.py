"""Asking a graph: generate, check, run, filter, explain, record."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import deque
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nl, policy, sparql
from .dataset import TripleSet
from .meta import now


class Audit:
    """Events in a JSONL file and in memory. ``where`` reads a log of any size with Spark."""

    def __init__(self, path: str | None = None, actor: str = "system", keep: int = 1000):
        self.path, self.actor, self.events, self._lock = path, actor, deque(maxlen=keep), threading.Lock()

    def record(self, action: str, details: dict, actor: str | None = None, ticket: str = "") -> dict:
        event = {"event_id": str(uuid.uuid4()), "timestamp": now(), "actor": actor or self.actor, "action": action, "details": json.dumps(details, default=str), "ticket_ref": ticket}
        with self._lock:
            self.events.append(event)
            if self.path:
                Path(self.path).parent.mkdir(parents=True, exist_ok=True)
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write(json.dumps(event) + "\n")
        return event

    @staticmethod
    def where(spark: SparkSession, path: str, action: str | None = None, actor: str | None = None, since: str | None = None, until: str | None = None, mentions: str | None = None) -> DataFrame:
        """F8: all conditions given must hold; ``mentions`` is looked for in the details."""
        rows = spark.read.schema("event_id string, timestamp string, actor string, action string, details string, ticket_ref string").json(path)
        for ok, value in ((lambda v: F.col("action") == v, action), (lambda v: F.contains("actor", F.lit(v)), actor), (lambda v: F.col("timestamp") >= v, since), (lambda v: F.col("timestamp") <= v, until), (lambda v: F.contains("details", F.lit(v)), mentions)):
            rows = rows.where(ok(value)) if value is not None else rows
        return rows


class Metrics:
    """Counts, means and maxima of timings; one lock, since requests come in threads."""

    def __init__(self):
        self._lock, self._seen = threading.Lock(), {}

    def add(self, name: str, seconds: float) -> None:
        with self._lock:
            n, total, most = self._seen.get(name, (0, 0.0, 0.0))
            self._seen[name] = n + 1, total + seconds, max(most, seconds)

    def report(self) -> dict:
        with self._lock:
            return {k: {"count": n, "avg": t / n, "max": m} for k, (n, t, m) in self._seen.items()}


@dataclass
class Turn:
    question: str
    query: str
    rows: list[dict]
    entities: list[str]


@dataclass
class Session:
    """The last turns, and what pronouns stand for."""

    id: str
    turns: list[Turn] = field(default_factory=list)

    def context(self, last: int = 5, sample: int = 3) -> list[dict]:
        return [{"question": t.question, "query": t.query, "sample": t.rows[:sample]} for t in self.turns[-last:]]

    def resolve(self, question: str) -> str:
        """they, them, those, these: the last turn's entity; it, that, this: its first row's first IRI, else the entity."""
        if not self.turns or not self.turns[-1].entities:
            return question
        last = self.turns[-1]
        focus = next((v for r in last.rows[:1] for v in r.values() if v and re.match("https?://", v)), last.entities[0])
        question = re.sub(r"\b(they|them|those|these)\b", last.entities[0], question, flags=re.I)
        return re.sub(r"\b(it|that|this)\b", focus, question, flags=re.I)


@dataclass
class Answer:
    question: str
    query: str
    rows: list[dict]
    text: str
    confidence: float
    evidence: list[dict]
    errors: list[str] = field(default_factory=list)
    session: str | None = None


class QueryEngine:
    """C18, C27. ``model`` is an optional callable (messages -> SPARQL text) asked once to mend a query that does not parse (C14)."""

    def __init__(self, data: TripleSet, schema: nl.Schema, policies: policy.Policies | None = None, query_policy: policy.QueryPolicy | None = None, audit: Audit | None = None, model=None):
        self.data, self.schema, self.policies, self.query_policy = data, schema, policies or policy.Policies(), query_policy or policy.QueryPolicy()
        self.audit, self.metrics, self.model, self.sessions, self._lock = audit or Audit(), Metrics(), model, {}, threading.Lock()
        self.planner = nl.Planner(schema)

    def get_schema(self, role: str | None = None) -> dict:
        return {"namespace": self.schema.namespace, "tables": self.policies.of(role).filter_schema(self.schema.tables), "relationships": self.schema.relationships}

    def prompt(self, question: str, role: str | None = None, most: int = 12_000) -> list[dict]:
        """Messages for a model: the schema (cut to ``most`` characters), the rules and the question."""
        schema = json.dumps(self.get_schema(role), default=str)[:most]
        return [{"role": "system", "content": f"Write one read-only SPARQL query with a LIMIT. No SERVICE, no updates. Schema: {schema}"}, {"role": "user", "content": question}]

    def generate_sparql(self, question: str) -> tuple[str, nl.Plan]:
        plan = self.planner.plan(question)
        text = self.planner.to_sparql(plan)
        if text is None and self.model:
            text = self.model(self.prompt(question))
        return text or "", plan

    def validate_sparql(self, text: str) -> dict:
        query, errors = self.query_policy.check(text)
        return {"valid": query is not None, "errors": errors, "form": query.form if query else None, "limit": query.limit if query else None}

    def execute_sparql(self, text: str, role: str | None = None) -> DataFrame:
        """The answer as strings, redacted and filtered for the role; ValueError with all errors of the query."""
        query, errors = self.query_policy.check(text)
        if query is None:
            self.audit.record("query_rejected", {"query": text, "errors": errors}, role)
            raise ValueError("; ".join(errors))
        began, who = time.time(), self.policies.of(role)
        data = self.data
        if who.deny_properties or who.mask_properties or who.allow_properties or who.deny_entities or who.allow_entities:
            # what is denied is taken out before the query, and the answer is filtered, too
            data = TripleSet(who.filter_triples(data.source), distinct=False)
        out = who.filter_rows(policy.redact(sparql.run(data, query, self.query_policy.default_limit), self.query_policy.denied_terms))
        self.metrics.add("execute", time.time() - began)
        self.audit.record("query", {"query": text}, role)
        return out

    def evidence(self, text: str) -> list[dict]:
        """F16: tables and relationships that the query names."""
        tables = [{"kind": "table", "name": t["name"], "entity": t["entity"]} for t in self.schema.tables if re.search(rf"[#:/]{re.escape(t['entity'])}\b", text)]
        return tables + [{"kind": "relationship", "name": r["name"], "predicate": r["predicate"]} for r in self.schema.relationships if re.search(rf"[#:]{re.escape(re.split('[:#/]', r['predicate'])[-1])}\b", text)]

    def start_session(self) -> str:
        with self._lock:
            s = Session(str(uuid.uuid4()))
            self.sessions[s.id] = s
        return s.id

    def ask(self, question: str, role: str | None = None, session: str | None = None) -> Answer:
        began = time.time()
        own = self.sessions.get(session) if session else None
        if session and own is None:
            raise KeyError(session)
        resolved = own.resolve(question) if own else question
        text, plan = self.generate_sparql(resolved)
        checked = self.validate_sparql(text)
        if not checked["valid"] and self.model:
            text = self.model([*self.prompt(resolved, role), {"role": "user", "content": f"Mend this query: {text}. Errors: {checked['errors']}"}])
            checked = self.validate_sparql(text)
        if not checked["valid"]:
            return Answer(question, text, [], "no query could be made", 0.0, [], checked["errors"], session)
        rows = [r.asDict() for r in self.execute_sparql(text, role).collect()]  # max_rows of the role at most
        if own:
            with self._lock:
                own.turns.append(Turn(question, text, rows[:20], plan.entities))
        self.metrics.add("ask", time.time() - began)
        said = f"{next(iter(rows[0].values()))}" if len(rows) == 1 and len(rows[0]) == 1 else f"{len(rows)} rows"
        return Answer(question, text, rows, said, plan.confidence, self.evidence(text), [], session)

    def count(self) -> int:
        return self.data.source.count()

    def health(self) -> dict:
        return {"status": "ok", "tables": len(self.schema.tables)}


def evaluate(engine: QueryEngine, cases: list[dict]) -> dict:
    """Cases with question, min_rows, sparql_contains, sparql_not_contains, evidence_entities."""
    results = []
    for c in cases:
        try:
            a = engine.ask(c["question"])
            named = {e.get("entity") for e in a.evidence}
            lists = lambda k: [c[k]] if isinstance(c.get(k), str) else c.get(k) or []  # noqa: B023, E731
            failed = [f"fewer than {c['min_rows']} rows"] if len(a.rows) < c.get("min_rows", 0) else []
            failed += [f"the query lacks {t}" for t in lists("sparql_contains") if t not in a.query] + [f"forbidden: {t}" for t in lists("sparql_not_contains") if t in a.query]
            failed += [f"no evidence of {e}" for e in lists("evidence_entities") if e not in named]
            results.append({"question": c["question"], "passed": not failed and not a.errors, "valid": not a.errors, "executed": not a.errors, "failures": failed + a.errors, "forbidden": sum(f.startswith("forbidden") for f in failed)})
        except Exception as e:  # noqa: BLE001  a case that breaks is a failed case
            results.append({"question": c["question"], "passed": False, "valid": False, "executed": False, "failures": [str(e)], "forbidden": 0})
    rate = lambda k: sum(r[k] for r in results) / len(results) if results else 0.0
    return {"cases": results, "pass_rate": rate("passed"), "valid_rate": rate("valid"), "execution_rate": rate("executed"), "forbidden_failures": sum(r["forbidden"] for r in results)}
