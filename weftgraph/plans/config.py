"""Project configuration: YAML or JSON into one shape, checked for form."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from ..functions.terms import pascal
from ..operators.compile import Relationship
from ..sources.readers import looks_remote

#: The configuration's JSON Schema.
_TEXT, _FLAG = {"type": "string"}, {"type": "boolean"}
SCHEMA = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "required": ["project", "tables"],
    "properties": {
        "project": {"type": "object", "required": ["name", "namespace"], "properties": {"name": _TEXT, "namespace": _TEXT | {"format": "uri"}, "output_dir": _TEXT, "strict": _FLAG, "incremental": _FLAG}},
        "tables": {
            "type": "array",
            "minItems": 1,
            "items": {
                "type": "object",
                "required": ["name", "source", "entity", "primary_key"],
                "properties": {
                    "name": _TEXT, "source": _TEXT, "format": _TEXT, "entity": _TEXT, "primary_key": _TEXT,
                    "columns": {"type": "object", "additionalProperties": {"properties": {"property": _TEXT, "required": _FLAG, "type": _TEXT, "pii": _FLAG, "mask": {"enum": ["hash", "hash32", "partial", "redact", "pseudonymize", "tokenize", "drop"]}}}},
                },
            },
        },
        "relationships": {"type": "array", "items": {"type": "object", "properties": {"name": _TEXT, "from": {"type": "object"}, "to": {"type": "object"}, "predicate": _TEXT, "inverse_predicate": _TEXT, "cardinality": {"enum": ["many_to_one", "one_to_one", "one_to_many", "many_to_many"]}, "required": _FLAG}}},
        "outputs": {"type": "object"}, "security": {"type": "object"}, "iri": {"type": "object"}, "store": {},
    },
}


class ConfigError(ValueError):
    def __init__(self, errors: list[dict]):
        super().__init__("; ".join(f"{e['path']}: {e['message']}" for e in errors))
        self.errors = errors


def load(path: str) -> dict:
    """A file with ${VARIABLE} filled from the environment (an unset one is an error), normalised."""
    text = Path(path).read_text(encoding="utf-8")

    def fill(m: re.Match) -> str:
        if m[1] not in os.environ and m[2] is None:
            raise ConfigError([{"path": path, "message": f"environment variable {m[1]} is not set"}])
        return os.environ.get(m[1], m[2] or "")

    text = re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", fill, text)
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    return normalize(raw or {}, str(Path(path).resolve().parent))


@dataclass(frozen=True)
class Field:
    """One field of the normalised form: where it may stand in a configuration, by dotted paths of which the first with a value counts,
    what it is without one, and what is made of the value found."""

    name: str
    paths: tuple[str, ...]
    default: object = None
    made: Callable = lambda value: value


def _field(name: str, *paths: str, default=None, made: Callable = lambda value: value) -> Field:
    return Field(name, paths or (name,), default, made)


def _at(spec, path: str):
    """What a dotted path leads to; None if a step is missing."""
    for step in path.split("."):
        spec = spec.get(step) if isinstance(spec, dict) else None
    return spec


def _read(fields: list[Field], spec: dict, flags: bool = False) -> dict:
    """The fields' values. A value that is false or empty counts as none, but where ``flags`` are read."""
    out = {}
    for f in fields:
        values = (v for v in (_at(spec, p) for p in f.paths) if (v is not None if flags else v))
        out[f.name] = f.made(next(values, f.default))
    return out


def _named_columns(columns) -> dict:
    """Columns as a mapping: given so, or as a list of mappings with names, or of names."""
    if isinstance(columns, list):
        return {c["name"]: c for c in columns} if columns and isinstance(columns[0], dict) else {c: {} for c in columns}
    return dict(columns or {})


def _both(*names: str) -> tuple[str, ...]:
    """A project's fields may stand beside ``project`` in older files."""
    return tuple(p for n in names for p in (f"project.{n}", n))


_PROJECT = [
    _field("name", *_both("name"), default="project"),
    _field("namespace", *_both("namespace"), default="https://example.com/kg"),
    _field("output_dir", *_both("output_dir"), default="gold", made=str),
]
_FLAGS = [
    _field("strict", *_both("strict"), default=True, made=bool),
    _field("fail_on_invalid_fk", *_both("fail_on_invalid_fk"), default=True, made=bool),
    _field("fail_on_missing_pk", *_both("fail_on_missing_pk"), default=True, made=bool),
    _field("fail_on_duplicate_pk", *_both("fail_on_duplicate_pk"), default=True, made=bool),
    _field("incremental", *_both("incremental"), default=False, made=bool),
]
_TABLE = [
    _field("name"),
    _field("source", "source", "path", "table"),
    _field("format"),
    _field("entity", "entity", "entity_type"),
    _field("primary_key", "primary_key", "id_column"),
    _field("columns", "columns", "property_map", made=_named_columns),
    _field("masks", "pii_policy.columns", made=_named_columns),
]
_RELATIONSHIP = [
    _field("name"),
    _field("from_table", "from.table", "from_table", "source_table"),
    _field("from_column", "from.column", "from_column", "source_column"),
    _field("to_table", "to.table", "to_table", "target_table", "to_entity"),
    _field("to_column", "to.column", "to_column", "target_column", default="id"),
    _field("predicate"),
    _field("inverse_predicate"),
    _field("cardinality", default="many_to_one"),
    _field("required", default=False, made=bool),
    _field("declared_by", "declared_by", "actor", default="unknown"),
    _field("ticket", "ticket", "ticket_ref", default=""),
    _field("description", "description", "justification", default=""),
]
_REST = [
    _field("iri", default={"strategy": "namespace"}),
    _field("governance", default={}),
    _field("security", default={}),
    _field("outputs", "outputs", "output", default={}, made=lambda v: {"files": v} if isinstance(v, list) else v),
    _field("store", made=lambda v: v if isinstance(v, dict) else {"enabled": bool(v), "path": v}),
]


def _table(raw: dict, base_dir: str, default_mask: str) -> dict:
    t = _read(_TABLE, raw)
    t["name"] = t["name"] or Path(str(t["source"])).stem
    t["entity"] = t["entity"] or pascal(t["name"])
    source, masks = t["source"], t.pop("masks")
    if source and t["format"] != "table" and not looks_remote(str(source)) and not os.path.isabs(str(source)):
        t["source"] = os.path.normpath(os.path.join(base_dir, str(source)))
    t["columns"] = {c: {"property": s} if isinstance(s, str) else dict(s or {}) for c, s in t["columns"].items()}
    for c, strategy in masks.items():
        t["columns"].setdefault(c, {})["mask"] = strategy or default_mask
    for spec in t["columns"].values():
        if spec.get("pii") and not spec.get("mask"):
            spec["mask"] = default_mask
    return t


def _relationship(raw: dict, actor: str | None) -> dict:
    r = _read(_RELATIONSHIP, {"declared_by": actor} | raw)
    r["predicate"] = r["predicate"] or f"ex:{r['name'] or 'relatedTo'}"
    r["name"] = r["name"] or f"{r['from_table']}_{r['from_column']}_to_{r['to_table']}"
    return r


def normalize(raw: dict, base_dir: str = ".") -> dict:
    """The current form (project, tables) and the older one (sources with entity_type, id_column and property_map) in one, by the
    fields above. Personal data without a mask of its own gets governance.pii.default_mask, else hash."""
    out = {"project": _read(_PROJECT, raw) | _read(_FLAGS, raw, flags=True)} | _read(_REST, raw)
    default_mask = _at(raw, "governance.pii.default_mask") or "hash"
    out["tables"] = [_table(t, base_dir, default_mask) for t in raw.get("tables") or raw.get("sources") or []]
    out["relationships"] = [_relationship(r, raw.get("actor")) for r in raw.get("relationships") or []]
    return out


def formats(config: dict) -> list[str]:
    """Outputs.rdf.formats, else the extensions of outputs.files, else all four."""
    names = {"ttl": "turtle", "nt": "ntriples", "rdf": "rdfxml", "json-ld": "jsonld", "xml": "rdfxml"}
    out = config["outputs"]
    asked = (out.get("rdf") or {}).get("formats") or [str(f.get("format") or f.get("path", "")).rpartition(".")[2] if isinstance(f, dict) else str(f).rpartition(".")[2] for f in out.get("files") or []]
    return list(dict.fromkeys(names.get(f, f) for f in asked)) or ["turtle", "jsonld", "ntriples", "rdfxml"]


def lint(config: dict) -> list[dict]:
    """The form, without reading data: all errors at once."""
    errors = []
    fail = lambda path, message: errors.append({"path": path, "message": message})
    if not re.match("https?://", config["project"]["namespace"]):
        fail("project.namespace", "the namespace is no http(s) IRI")
    if not config["tables"]:
        fail("tables", "there are no tables")
    seen = set()
    for i, t in enumerate(config["tables"]):
        for k in ("name", "source", "entity", "primary_key"):
            if not t.get(k):
                fail(f"tables[{i}].{k}", f"{k} is missing")
        if t["name"] in seen:
            fail(f"tables[{i}].name", f"table {t['name']} is declared twice")
        seen.add(t["name"])
    masks, legal = {}, SCHEMA["properties"]["tables"]["items"]["properties"]["columns"]["additionalProperties"]["properties"]["mask"]["enum"]
    for t in config["tables"]:
        for c, s in t["columns"].items():
            if not s.get("mask"):
                continue
            masks.setdefault(t["name"], set()).add(c)
            if s["mask"] not in legal:
                fail(f"tables.{t['name']}.columns.{c}.mask", f"no mask {s['mask']!r}")
            if c == t.get("primary_key"):
                fail(f"tables.{t['name']}.columns.{c}.mask", "a masked key would cut the edges to it")
    for r in config["relationships"]:
        if r["from_column"] in masks.get(r["from_table"], ()):
            fail(f"relationships.{r['name']}", f"{r['from_table']}.{r['from_column']} is masked, so its edges would lead nowhere")
    return errors


def relationships(config: dict) -> list[Relationship]:
    return [Relationship(**r) for r in config["relationships"]]
