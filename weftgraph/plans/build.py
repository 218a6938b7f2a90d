"""From a configuration to a graph package on disk."""

from __future__ import annotations

import html
import json
import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import compile as C
from ..operators import mask, validate, versions
from ..sources import export, readers, store
from ..functions.terms import predicate_iri
from . import config as cfg
from . import meta, nl
from .dataset import TableGraph, TripleSet


@dataclass
class Result:
    build_id: str
    output_dir: str
    triple_count: int
    table_count: int
    relationship_count: int
    output_files: list[str]
    duration_seconds: float
    validation_status: str
    skipped: bool = False


#: What plugins do to each source table and to the triples before they are written.
PRE_PROCESSORS: dict[str, object] = {}
POST_PROCESSORS: dict[str, object] = {}


def tables_of(spark: SparkSession, config: dict, salt: str = "") -> list[C.Table]:
    """Read, prepared and masked tables with their predicates and links."""
    ns, out = config["project"]["namespace"], []
    entity = {t["name"]: t["entity"] for t in config["tables"]}
    keys = {t["name"]: t["primary_key"] for t in config["tables"]}
    for t in config["tables"]:
        df = readers.read_table(spark, t["source"], t.get("format"))
        for f in PRE_PROCESSORS.values():
            df = f(df)
        df = mask.apply(df, {c: s["mask"] for c, s in t["columns"].items() if s.get("mask") and c in df.columns}, salt)
        properties = {c: predicate_iri(s["property"], ns) for c, s in t["columns"].items() if s.get("property")}
        links = {r["from_column"]: entity[r["to_table"]] for r in config["relationships"] if r["from_table"] == t["name"] and r["to_table"] in entity and r["to_column"] == keys[r["to_table"]]}
        out.append(C.Table(t["name"], df, t["entity"], t["primary_key"], properties, links))
    return out


def salt_of(config: dict) -> str:
    """What hash masks are salted with: the environment variable that governance.pii.salt_env names, else WEFTGRAPH_SALT. A hash without a
    salt is undone by a dictionary, so hash masks without one are an error."""
    variable = ((config.get("governance") or {}).get("pii") or {}).get("salt_env") or "WEFTGRAPH_SALT"
    salt = os.environ.get(variable, "")
    hashed = [f"{t['name']}.{c}" for t in config["tables"] for c, s in t["columns"].items() if s.get("mask") in ("hash", "hash32")]
    if hashed and not salt:
        raise cfg.ConfigError([{"path": f"tables.{name}", "message": f"a hash mask needs a salt in {variable}"} for name in hashed])
    return salt


def check(spark: SparkSession, config: dict) -> dict:
    """Every error and warning there is, with the tables' profiles."""
    errors, warnings, profiles, tables = cfg.lint(config), [], {}, {}
    for t in config["tables"]:
        if not t.get("source") or not t.get("primary_key"):
            continue
        try:
            df = readers.read_table(spark, t["source"], t.get("format"))
            table = C.Table(t["name"], df, t["entity"], t["primary_key"])
            found = validate.check_table(table, [c for c, s in t["columns"].items() if s.get("required")], list(t["columns"]))
        except Exception as e:  # noqa: BLE001  a source that cannot be read is one of the errors to be listed
            errors.append({"path": f"tables.{t['name']}.source", "message": f"cannot be read: {str(e).splitlines()[0]}"})
            continue
        tables[t["name"]] = table
        errors += found["errors"]
        warnings += found["warnings"]
        profiles[t["name"]] = found["profile"]
    for r in cfg.relationships(config):
        errors += validate.check_relationship(r, tables)
    return {"valid": not errors, "errors": errors, "warnings": warnings, "profiles": profiles}


def graph_of(spark: SparkSession, config: dict, unique: set[str] | None = None, salt: str = "") -> TableGraph:
    strategy = config["iri"].get("strategy", "namespace")
    return TableGraph(spark, tables_of(spark, config, salt), cfg.relationships(config), config["project"]["namespace"], unique, strategy)


def build(spark: SparkSession, config: dict, output_dir: str | None = None, fail_on_error: bool = True, actor: str = "system") -> Result:
    """Check, compile, write the set of triples once as Parquet, derive every export from it, and record how it came about.

    Small files (reports, manifest, ontology) go to ``output_dir`` by the driver; the graph and its exports are written by the
    executors, so ``output_dir`` must be a folder that all of them share. I1, I4: with ``incremental`` a build whose tables and
    configuration have the fingerprints of the last one is skipped."""
    from .engine import Audit

    began, out, ns = time.time(), output_dir or config["project"]["output_dir"], config["project"]["namespace"]
    os.makedirs(out, exist_ok=True)
    report = check(spark, config)
    files = [_json(out, "validation_report.json", report)]
    if report["errors"] and fail_on_error:
        raise cfg.ConfigError(report["errors"])
    if config["project"]["strict"] and len(config["tables"]) > 1 and not config["relationships"]:
        raise cfg.ConfigError([{"path": "relationships", "message": "a strict project with several tables declares its relationships"}])
    tables = tables_of(spark, config, salt_of(config))
    marks = {t.name: [str(x) for x in versions.fingerprint(t.df).first()] for t in tables}
    known = f"{out}/manifest.json"
    if config["project"]["incremental"] and os.path.exists(known):
        with open(known, encoding="utf-8") as f:
            old = json.load(f)
        if old.get("fingerprints") == marks and old.get("config") == json.loads(json.dumps(config, default=str)):
            return Result(old["build_id"], out, old["triple_count"], len(tables), len(config["relationships"]), [], time.time() - began, old["validation_status"], True)
    strategy = config["iri"].get("strategy", "namespace")
    triples = C.graph(tables, cfg.relationships(config), ns, spark, strategy, bool(config["iri"].get("emit_pk_literal")))
    sources = {t["name"]: str(t["source"]) for t in config["tables"]}
    rows = {n: p["row_count"] for n, p in report["profiles"].items()}
    triples = C.union([triples, meta.catalog(spark, sources, ns, config["project"]["name"]), meta.provenance(spark, sources, ns)], spark)
    for f in POST_PROCESSORS.values():
        triples = f(triples)
    store.write(triples, f"{out}/store")
    stored = store.read(spark, f"{out}/store")
    files.append(f"{out}/store")
    for name in cfg.formats(config):
        export.write(stored, f"{out}/graph.{name}", name)
        files.append(f"{out}/graph.{name}")
    for name, text in (("ontology.ttl", meta.ontology(config)), ("shapes.ttl", meta.shapes(config))):
        files.append(_text(out, name, text))
    counts = {r.predicate: r["count"] for r in stored.groupBy("predicate").count().collect()}  # as many as configured predicates
    build_id, status = str(uuid.uuid4()), "failed" if report["errors"] else "passed"
    lineage = {"build_id": build_id, "tables": [{"table": t["name"], "source": sources[t["name"]], "entity": t["entity"], "masked": {c: s["mask"] for c, s in t["columns"].items() if s.get("mask")}} for t in config["tables"]], "relationships": config["relationships"]}
    files.append(_json(out, "lineage.json", lineage))
    manifest = {"build_id": build_id, "created_at": meta.now(), "name": config["project"]["name"], "namespace": ns, "triple_count": sum(counts.values()), "predicate_counts": counts, "row_counts": rows, "fingerprints": marks, "config": config, "validation_status": status}
    files.append(_json(out, "manifest.json", manifest))
    cells = "".join(f"<tr><td>{html.escape(p)}</td><td>{n}</td></tr>" for p, n in sorted(counts.items()))
    files.append(_text(out, "build_report.html", f"<!doctype html><title>{html.escape(config['project']['name'])}</title><h1>{html.escape(config['project']['name'])}</h1><p>{sum(counts.values())} triples, validation {status}</p><table><tr><th>Predicate<th>Triples</tr>{cells}</table>"))
    Audit(f"{out}/audit.jsonl", actor).record("build", {"build_id": build_id, "triples": sum(counts.values()), "status": status})
    return Result(build_id, out, sum(counts.values()), len(tables), len(config["relationships"]), [*files, f"{out}/audit.jsonl"], time.time() - began, status)


def _text(folder: str, name: str, text: str) -> str:
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return f"{folder}/{name}"


def _json(folder: str, name: str, value) -> str:
    return _text(folder, name, json.dumps(value, indent=2, default=str))


def open_package(spark: SparkSession, folder: str):
    """The engine over a built package: its stored triples, and the schema, roles and denied terms of its configuration."""
    from . import policy
    from .engine import Audit, QueryEngine

    with open(f"{folder}/manifest.json", encoding="utf-8") as f:
        manifest = json.load(f)
    config = manifest["config"]
    security = config.get("security") or {}
    known = set(policy.QueryPolicy.__dataclass_fields__)
    rules = policy.QueryPolicy(**{k: v for k, v in (security.get("query") or {}).items() if k in known})
    data = StoredTriples(spark, f"{folder}/store", manifest["predicate_counts"])
    return QueryEngine(data, nl.Schema.from_config(config), policy.Policies.from_config(security), rules, Audit(f"{folder}/audit.jsonl"))


class StoredTriples(TripleSet):
    """A store's triples: a constant predicate reads its own directory only; joins are ordered by the manifest's counts."""

    def __init__(self, spark: SparkSession, path: str, counts: dict[str, int]):
        self.path, self.counts = path, counts
        super().__init__(store.read(spark, path), distinct=False)

    def scan(self, predicate: str | None) -> DataFrame:
        return TripleSet(store.read(self.spark, self.path, predicate), distinct=False).scan(predicate)

    def size(self, predicate: str | None) -> int:
        return self.counts.get(predicate, 0) if predicate else sum(self.counts.values())


def inspect(folder: str) -> dict:
    """C28."""
    known = f"{folder}/manifest.json"
    if os.path.exists(known):
        with open(known, encoding="utf-8") as f:
            return json.load(f)
    return {"files": sorted(os.listdir(folder))}


__all__ = ["Result", "build", "check", "graph_of", "inspect", "open_package", "salt_of", "tables_of"]
