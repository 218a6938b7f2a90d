"""A graph agent: questions by a language model where there is one, else by the planner; tries again with the errors it got."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import local_name
from ..operators import explore
from . import policy
from .engine import QueryEngine

Messages = list[dict[str, str]]


class Provider(Protocol):
    """What answers messages (role, content) with text."""

    name: str

    def generate(self, messages: Messages) -> str: ...


class MockProvider:
    """Says the same whatever it is asked: for tests, and where there is no model."""

    name = "mock"

    def __init__(self, text: str = "SELECT ?s ?p ?o WHERE { ?s ?p ?o } LIMIT 50"):
        self.text = text

    def generate(self, messages: Messages) -> str:
        return self.text


class HttpProvider:
    """A model behind HTTP: posts {"model", "messages"} as JSON, and reads the text at ``answer`` (keys and positions, by dots). The
    key is read from the environment variable ``key_env``; ``post(url, body, headers)`` replaces HTTP in tests."""

    name = "http"

    def __init__(self, endpoint: str, model: str = "", answer: str = "choices.0.message.content", key_env: str | None = None, post: Callable[[str, dict, dict], dict] | None = None):
        self.endpoint, self.model, self.answer, self.post = endpoint, model, answer, post or _post
        self.headers = {"Content-Type": "application/json"}
        if key_env:
            if not os.environ.get(key_env):
                raise ValueError(f"{key_env} is not set")
            self.headers["Authorization"] = f"Bearer {os.environ[key_env]}"

    def generate(self, messages: Messages) -> str:
        found = self.post(self.endpoint, {"model": self.model, "messages": messages}, self.headers)
        for step in self.answer.split("."):
            found = found[int(step) if isinstance(found, list) else step]
        return found


def _post(url: str, body: dict, headers: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST")
    with urllib.request.urlopen(request, timeout=60) as response:
        return json.load(response)


PROVIDERS: dict[str, Callable[..., Provider]] = {"mock": MockProvider, "http": HttpProvider}


def provider(name: str, **options) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name!r}: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)


#: What a query's text adds to its confidence, from 0.5 to 0.95 at most.
SIGNS = {"FILTER": 0.1, "GROUP BY": 0.1, "ORDER BY": 0.05, "SELECT": 0.15}


def confidence(text: str) -> float:
    """SELECT counts with a WHERE only; braces that match add 0.1."""
    upper = text.upper()
    score = 0.5 + sum(w for sign, w in SIGNS.items() if sign in upper and (sign != "SELECT" or "WHERE" in upper))
    return round(min(0.95, score + 0.1 * (0 < text.count("{") == text.count("}"))), 2)


class GraphAgent:
    """C17. Queries go through the engine, so its limits, roles and audit hold."""

    def __init__(self, engine: QueryEngine, model: Provider | None = None, tries: int = 3, role: str | None = None):
        self.engine, self.model, self.tries, self.role = engine, model, tries, role

    def summary(self) -> str:
        """A line for each entity and its properties, and for each relationship, as far as the role may know them."""
        schema = self.engine.get_schema(self.role)
        entity = {t["name"]: t["entity"] for t in schema["tables"]}
        lines = [f"{t['entity']}: {', '.join(local_name(s.get('property') or c) for c, s in t['columns'].items())}" for t in schema["tables"]]
        ends = ((r, entity.get(r["from_table"]), entity.get(r["to_table"])) for r in schema["relationships"])
        return "\n".join([*lines, *(f"{a} -{local_name(r['predicate'])}-> {b}" for r, a, b in ends if a and b)])

    def query(self, question: str) -> str:
        """SPARQL for a question. What the model writes is checked; its errors go into the next of ``tries`` tries, and the
        planner's query is the last resort. ValueError if that does not hold either."""
        messages = [{"role": "system", "content": f"Write one SPARQL SELECT query and nothing else. The graph:\n{self.summary()}"}, {"role": "user", "content": question}]
        for _ in range(self.tries if self.model else 0):
            text = self.model.generate(messages).strip().removeprefix("```sparql").removeprefix("```").removesuffix("```").strip()
            errors = self.engine.validate_sparql(text)["errors"]
            if not errors:
                return text
            messages = [*messages, {"role": "assistant", "content": text}, {"role": "user", "content": f"This query is not valid: {'; '.join(errors)}. Write it anew."}]
        planner = self.engine.planner
        text = planner.to_sparql(planner.plan(question)) or ""
        if errors := self.engine.validate_sparql(text)["errors"]:
            raise ValueError("; ".join(errors))
        return text

    def ask(self, question: str, max_rows: int = 50) -> DataFrame:
        return self.engine.execute_sparql(self.query(question), self.role).limit(max_rows)

    def explain(self, question: str, max_rows: int = 50) -> dict:
        """The query, the number of its rows (``max_rows`` at most), how sure it is, and questions that may follow."""
        text = self.query(question)
        n = self.engine.execute_sparql(text, self.role).limit(max_rows).count()
        return {"question": question, "sparql": text, "result_count": n, "confidence": confidence(text), "suggested_followups": self.followups(question, n)}

    def followups(self, question: str, rows: int, most: int = 3) -> list[str]:
        """By the declared edges from and to the entities that the question names."""
        tables = self.engine.get_schema(self.role)["tables"]
        if not rows:
            return [f"Show {t['entity']}" for t in tables[:most]]
        named, ways = self.engine.planner.plan(question).entities, self.engine.planner.ways
        known = {t["entity"] for t in tables}
        next_to = dict.fromkeys(e["to"] for a in named for e in ways.leaving.get(a, ()) if e["to"] in known and e["to"] not in named)
        return [*(f"Show each {named[0]} and its {b}" for b in next_to), f"How many {named[0]} are there?"][:most]

    def context(self, question: str, depth: int = 2, max_results: int = 10, limit: int = 50) -> list[str]:
        """Edges around the subjects that the question's longer words name, as text; bounded by the limits."""
        triples = self.engine.data.source
        who = self.engine.policies.of(self.role)
        triples = policy.redact(who.filter_triples(triples), self.engine.query_policy.denied_terms)
        subjects: dict[str, None] = {}
        for word in dict.fromkeys(w.strip("?.,!\"'") for w in question.split()):
            if len(word) > 3 and len(subjects) < max_results:
                subjects |= dict.fromkeys(r.subject for r in explore.search(triples, word, limit=max_results - len(subjects)).collect())
        out: dict[str, None] = {}
        for s in subjects:
            facts = explore.facts(triples, s).orderBy("predicate").limit(limit)
            out |= dict.fromkeys(f"{s} {local_name(r.predicate)} {', '.join(r.objects)}" for r in facts.select("predicate", F.slice("objects", 1, limit).alias("objects")).collect())
            out |= dict.fromkeys(f"{r.subject} {local_name(r.predicate)} {r.object}" for r in explore.neighbours(triples, s, depth, limit=limit).collect())
        return list(out)

    def rag(self, question: str, depth: int = 2, max_results: int = 10) -> str:
        """The model's answer from the graph around what the question names."""
        if self.model is None:
            raise ValueError("an answer in words needs a model")
        found = "\n".join(self.context(question, depth, max_results))
        return self.model.generate([{"role": "system", "content": f"Answer from these statements only, and say so if they do not tell:\n{found}"}, {"role": "user", "content": question}])
