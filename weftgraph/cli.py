"""Command line: python -m weftgraph.cli COMMAND."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import asdict

#: Starter projects by name.
STARTERS = {
    "customer360": {"tables": {"customers": ("Customer", "customer_id", {"name": {"property": "schema:name", "mask": "partial"}, "email": {"property": "schema:email", "mask": "hash"}, "segment": {"property": "ex:segment"}}), "products": ("Product", "product_id", {"name": {"property": "schema:name"}, "risk_level": {"property": "ex:riskLevel"}}), "orders": ("Order", "order_id", {"amount": {"property": "ex:amount", "type": "integer"}})}, "links": [("orders", "customer_id", "customers", "customer_id", "ex:placedBy", "ex:placedOrder"), ("orders", "product_id", "products", "product_id", "ex:contains", None)]},
    "insurance": {"tables": {"customers": ("Customer", "customer_id", {"name": {"property": "schema:name", "mask": "partial"}}), "policies": ("Policy", "policy_id", {"status": {"property": "ex:status"}}), "claims": ("Claim", "claim_id", {"claim_amount": {"property": "ex:claimAmount", "type": "integer"}, "status": {"property": "ex:status"}})}, "links": [("policies", "customer_id", "customers", "customer_id", "ex:heldBy", None), ("claims", "policy_id", "policies", "policy_id", "ex:underPolicy", None)]},
}


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("weftgraph").getOrCreate()


def _show(value) -> None:
    print(json.dumps(value, indent=2, default=str))


def starter(name: str) -> dict:
    s = STARTERS[name]
    return {
        "project": {"name": name, "namespace": f"https://data.example/{name}", "output_dir": "gold"},
        "tables": [{"name": t, "source": f"data/{t}.csv", "entity": e, "primary_key": k, "columns": c} for t, (e, k, c) in s["tables"].items()],
        "relationships": [{"name": f"{a}_{b}", "from": {"table": a, "column": c}, "to": {"table": b, "column": d}, "predicate": p} | ({"inverse_predicate": i} if i else {}) for a, c, b, d, p, i in s["links"]],
    }


def _commands() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="weftgraph")
    sub = out.add_subparsers(dest="command", required=True)

    def add(name: str, help: str, *arguments: tuple) -> None:
        p = sub.add_parser(name, help=help)
        for names, options in arguments:
            p.add_argument(*names, **options)

    package, question, config = (("package",), {}), (("question",), {}), (("-c", "--config"), {"default": "project.yml"})
    role, output, port = (("--role",), {}), (("-o", "--output"), {}), (("--port",), {"type": int, "default": 8080})
    add("build", "build a package", config, output)
    add("distributed-build", "build a package; Spark deals the work", config, output, (("--partitions",), {"type": int, "default": 0}))
    add("validate", "check configuration and data", config)
    add("schema", "print the configuration's JSON Schema")
    add("ontology", "print ontology and shapes", config)
    add("init", "write a starter project", (("template",), {"choices": sorted(STARTERS)}), (("--path",), {"default": "project.yml"}))
    add("inspect", "show a package's manifest", package)
    add("report", "where a package's report is", package)
    add("query", "run SPARQL", package, (("sparql",), {}), role)
    add("ask", "ask in plain words", package, question, role)
    add("chat", "ask from stdin, in one session", package, role)
    add("generate-sparql", "print the SPARQL of a question", package, question)
    add("eval", "run evaluation cases", package, (("cases",), {}))
    add("profile", "measure a package's graph", package)
    add("diff", "compare two packages", (("old",), {}), (("new",), {}))
    add("push-store", "send a package to a SPARQL endpoint", package, (("endpoint",), {}), (("--token",), {}))
    add("api", "serve REST and tools over HTTP", package, port, (("--token",), {}))
    add("serve", "serve REST and tools over HTTP", package, port, (("--token",), {}))
    add("mcp", "serve tools over stdin", package)
    add("studio", "write an HTML page about a package", package, output)
    add("doctor", "check the installation")
    add("benchmark", "time a synthetic build", (("--rows",), {"type": int, "default": 10_000}))
    return out


def main(argv: list[str] | None = None) -> int:
    from .plans import build, engine, meta, serve
    from .plans import config as cfg

    a = _commands().parse_args(argv)
    opened = lambda: build.open_package(_spark(), a.package)
    try:
        if a.command in ("build", "distributed-build"):
            spark = _spark()
            if getattr(a, "partitions", 0):
                spark.conf.set("spark.sql.shuffle.partitions", a.partitions)
            _show(asdict(build.build(spark, cfg.load(a.config), a.output)))
        elif a.command == "validate":
            report = build.check(_spark(), cfg.load(a.config))
            _show(report)
            return int(not report["valid"])
        elif a.command == "schema":
            _show(cfg.SCHEMA)
        elif a.command == "ontology":
            config = cfg.load(a.config)
            print(meta.ontology(config) + meta.shapes(config))
        elif a.command == "init":
            import yaml

            if os.path.exists(a.path):
                raise ValueError(f"{a.path} exists")
            with open(a.path, "w", encoding="utf-8") as f:
                yaml.safe_dump(starter(a.template), f, sort_keys=False)
        elif a.command == "inspect":
            _show(build.inspect(a.package))
        elif a.command == "report":
            print(os.path.join(a.package, "build_report.html"))
        elif a.command == "query":
            _show([r.asDict() for r in opened().execute_sparql(a.sparql, a.role).collect()])
        elif a.command == "ask":
            _show(asdict(opened().ask(a.question, a.role)))
        elif a.command == "chat":
            e = opened()
            session = e.start_session()
            for line in sys.stdin:
                if line.strip():
                    _show(asdict(e.ask(line.strip(), a.role, session)))
        elif a.command == "generate-sparql":
            print(opened().generate_sparql(a.question)[0])
        elif a.command == "eval":
            import yaml

            with open(a.cases, encoding="utf-8") as f:
                cases = yaml.safe_load(f)
            report = engine.evaluate(opened(), cases.get("questions", cases) if isinstance(cases, dict) else cases)
            _show(report)
            return int(report["pass_rate"] < 1)
        elif a.command == "profile":
            from .operators import profile

            _show(profile.profile(opened().data.source).first().asDict())
        elif a.command == "diff":
            from .operators import versions
            from .sources import store

            spark = _spark()
            old, new = (store.read(spark, f"{p}/store") for p in (a.old, a.new))
            _show({"added": versions.added(old, new).count(), "removed": versions.added(new, old).count(), "modified": versions.modified(old, new).count()})
        elif a.command == "push-store":
            from .sources import export

            export.push(opened().data.source, a.endpoint, {"Authorization": f"Bearer {a.token}"} if a.token else None)
        elif a.command in ("api", "serve"):
            serve.server(opened(), port=a.port, token=a.token, package={"manifest": build.inspect(a.package)}).serve_forever()
        elif a.command == "mcp":
            serve.Tools(opened(), {"manifest": build.inspect(a.package)}).stdio()
        elif a.command == "studio":
            m = build.inspect(a.package)
            path = a.output or os.path.join(a.package, "studio.html")
            with open(path, "w", encoding="utf-8") as f:
                f.write(f"<!doctype html><title>{m.get('name')}</title><pre>{json.dumps(m, indent=1).replace('<', '&lt;')}</pre>")
            print(path)
        elif a.command == "doctor":
            import importlib.util

            _show({p: importlib.util.find_spec(p) is not None for p in ("pyspark", "pandas", "pyarrow", "numpy", "yaml")})
        elif a.command == "benchmark":
            from .operators import compile as C

            spark = _spark()
            n, began = a.rows, time.time()
            customers = spark.range(n).selectExpr("concat('c', id) AS customer_id", "element_at(array('VIP', 'Standard'), cast(id % 2 + 1 AS int)) AS segment")
            orders = spark.range(n).selectExpr("concat('o', id) AS order_id", f"concat('c', id % {n}) AS customer_id", "cast(id % 1000 AS double) AS amount")
            tables = [C.Table("customers", customers, "Customer", "customer_id"), C.Table("orders", orders, "Order", "order_id", links={"customer_id": "Customer"})]
            rel = C.Relationship("placed_by", "orders", "customer_id", "customers", "customer_id", "ex:placedBy")
            count = C.graph(tables, [rel], "https://data.example/bench", spark).count()
            seconds = time.time() - began
            _show({"rows": 2 * n, "triples": count, "seconds": seconds, "triples_per_second": count / seconds})
    except (ValueError, OSError, KeyError) as x:
        print(f"error: {x}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
