import io
import json
import os
import threading
import urllib.error
import urllib.request

import pytest

from weftgraph import cli
from weftgraph.plans import build, engine, nl, policy, serve
from weftgraph.plans import config as cfg
from weftgraph.plans.dataset import TripleSet


@pytest.fixture(scope="module")
def package(spark, tmp_path_factory):
    os.environ["WEFTGRAPH_SALT"] = "pepper"
    home = tmp_path_factory.mktemp("project")
    (home / "data").mkdir()
    (home / "data/customers.csv").write_text("customer_id,name,email,segment\nC1,Ann Alder,a@x.org,VIP\nC2,Bob Birch,b@x.org,Standard\n")
    (home / "data/products.csv").write_text("product_id,name,risk_level\nP1,Saw,High\nP2,Hat,Low\n")
    (home / "data/orders.csv").write_text("order_id,customer_id,product_id,amount\nO1,C1,P1,1200\nO2,C2,P2,30\n")
    raw = cli.starter("customer360") | {"security": {"roles": {"analyst": {"mask_properties": ["Saw"], "max_rows": 5}, "outsider": {"deny_entities": ["Customer"]}}}}
    config = cfg.normalize(raw, str(home))
    result = build.build(spark, config, str(home / "gold"))
    return home, config, result, build.open_package(spark, str(home / "gold"))


def test_package(spark, package):
    home, config, result, e = package
    # 28 data triples (literals and edges 6 + 4 + 6 less none, types 6, declared edges 2 + 2 + 2) and 45 of catalog and provenance
    assert result.validation_status == "passed" and e.data.source.where("kind in ('data', 'type', 'edge')").count() == 28
    assert result.triple_count == 73
    values = {r.object for r in e.data.source.collect()}
    assert "Ann Alder" not in values and "An*****er" in values and not any("@" in v for v in values)
    for name in ("manifest.json", "lineage.json", "validation_report.json", "ontology.ttl", "shapes.ttl", "build_report.html", "audit.jsonl"):
        assert (home / "gold" / name).exists()
    again = build.build(spark, config | {"project": config["project"] | {"incremental": True}}, str(home / "inc"))
    skipped = build.build(spark, config | {"project": config["project"] | {"incremental": True}}, str(home / "inc"))
    assert not again.skipped and skipped.skipped and skipped.build_id == again.build_id


def test_questions(package):
    e = package[3]
    assert e.ask("how many customers").rows == [{"count": "2"}]
    vip = e.ask("show VIP customers and their orders")
    assert {r["entity"].rpartition("/")[2] for r in vip.rows} == {"C1"} and {"Customer", "Order"} <= {x.get("entity") for x in vip.evidence}
    assert e.ask("count orders above 100").rows == [{"count": "1"}]
    assert e.ask("count orders of high-risk products").rows == [{"count": "1"}]
    assert "?s ?p ?o" in e.ask("list triples").query
    s = e.start_session()
    e.ask("show customers", session=s)
    assert e.ask("how many of them are there", session=s).rows == [{"count": "2"}]
    with pytest.raises(KeyError):
        e.ask("x", session="none")
    report = engine.evaluate(e, [{"question": "show VIP customers", "min_rows": 1, "sparql_contains": "vip", "evidence_entities": ["Customer"]}, {"question": "list triples", "min_rows": 1, "sparql_contains": ["?s ?p ?o"]}, {"question": "show customers", "sparql_not_contains": ["SELECT"]}])
    assert report["pass_rate"] == pytest.approx(2 / 3) and report["forbidden_failures"] == 1


def test_policies(package):
    e = package[3]
    q = "SELECT ?n WHERE { ?p schema:name ?n } ORDER BY ?n"
    assert "[MASKED]" in {r.n for r in e.execute_sparql(q, "analyst").collect()} and "Saw" in {r.n for r in e.execute_sparql(q).collect()}
    assert len(e.execute_sparql(q, "outsider").collect()) == 2
    assert not e.validate_sparql("INSERT DATA { <a:b> <a:c> 1 }")["valid"] and e.validate_sparql(q)["limit"] == 500
    with pytest.raises(ValueError):
        e.execute_sparql("DROP ALL")
    strict = policy.QueryPolicy(max_characters=20, denied_terms=["email"])
    assert len(strict.check("SELECT ?email WHERE { ?s ?p ?email }")[1]) == 2
    inner = policy.QueryPolicy(default_limit=7).check("SELECT * { { SELECT ?s { ?s ?p ?o } LIMIT 2 } }")[0]
    assert inner.limit == 7
    assert [t["entity"] for t in policy.Role(deny_entities=["Order"]).filter_schema(e.schema.tables)] == ["Customer", "Product"]


def test_model_is_asked_once_to_mend(package):
    e = package[3]
    seen = []

    def model(messages):
        seen.append(messages)
        return "SELECT (COUNT(*) AS ?n) { ?s ?p ?o }"

    own = engine.QueryEngine(e.data, nl.Schema("no iri at all <", e.schema.tables, e.schema.relationships), model=model)
    assert own.ask("customers").rows == [{"n": "73"}] and len(seen) == 1


def test_rest_and_tools(package):
    e = package[3]
    server = serve.server(e, token="t", package={"manifest": {"name": "x"}})
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, token="t"):
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {token}"}, method=method)
        with urllib.request.urlopen(r, timeout=120) as answer:
            return json.loads(answer.read())

    assert call("GET", "/health")["status"] == "ok" and call("GET", "/manifest") == {"name": "x"} and "/ask" in call("GET", "/openapi.json")["paths"]
    session = call("POST", "/sessions", {})["session_id"]
    assert call("POST", f"/sessions/{session}/ask", {"question": "how many orders"})["rows"] == [{"count": "2"}]
    assert call("POST", "/sparql/validate", {"sparql": "x"})["valid"] is False
    for path, token, status in (("/health", "wrong", 401), ("/nothing", "t", 404)):
        with pytest.raises(urllib.error.HTTPError) as x:
            call("GET", path, token=token)
        assert x.value.code == status
    server.shutdown()
    tools, out = serve.Tools(e), io.StringIO()
    ask = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search_entities", "arguments": {"query": "vip"}}}, {"jsonrpc": "2.0", "id": 4, "method": "nothing"}]
    tools.stdio([json.dumps(m) for m in ask] + ["no json"], out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, 2, 3, 4, None] and len(answers[1]["result"]["tools"]) == 18
    assert "C1" in answers[2]["result"]["content"][0]["text"] and "error" in answers[3]
    limit = serve.RateLimit(2)
    assert [limit.allow("a") for _ in range(3)] == [True, True, False] and limit.allow("b")


def test_audit(spark, package):
    home = package[0]
    rows = engine.Audit.where(spark, str(home / "gold/audit.jsonl"), action="query", mentions="schema:name").collect()
    assert rows and all(r.action == "query" for r in rows)


def test_config_forms_and_errors(spark, tmp_path, monkeypatch):
    old = cfg.normalize({"name": "n", "sources": [{"path": "a/b.csv", "entity_type": "B", "id_column": "k", "property_map": {"v": "schema:name"}}], "relationships": [{"source_table": "b", "source_column": "c", "target_table": "d"}]}, "/base")
    assert old["tables"][0] == {"name": "b", "source": "/base/a/b.csv", "format": None, "entity": "B", "primary_key": "k", "columns": {"v": {"property": "schema:name"}}} and old["relationships"][0]["to_column"] == "id"
    bad = cfg.normalize({"project": {"namespace": "x"}, "tables": [{"name": "t", "source": "none.csv", "primary_key": "k", "columns": {"v": {"mask": "rot13"}, "k": {"pii": True}}}, {"name": "t", "source": "s3://bucket/none.csv"}]}, str(tmp_path))
    paths = {e["path"] for e in build.check(spark, bad)["errors"]}
    assert {"project.namespace", "tables[1].name", "tables[1].primary_key", "tables.t.columns.v.mask", "tables.t.columns.k.mask", "tables.t.source"} <= paths
    with pytest.raises(cfg.ConfigError):
        build.build(spark, bad, str(tmp_path / "out"))
    (tmp_path / "c.yml").write_text("project: {name: ${P}, namespace: ${N:-https://a.example}}\ntables: []\n")
    monkeypatch.setenv("P", "mine")
    assert cfg.load(str(tmp_path / "c.yml"))["project"]["namespace"] == "https://a.example"
    monkeypatch.delenv("P")
    with pytest.raises(cfg.ConfigError):
        cfg.load(str(tmp_path / "c.yml"))


def test_cli(package, tmp_path, capsys):
    assert cli.main(["schema"]) == 0 and cli.main(["init", "insurance", "--path", str(tmp_path / "p.yml")]) == 0 and cli.main(["init", "insurance", "--path", str(tmp_path / "p.yml")]) == 1
    gold = str(package[0] / "gold")
    for command in (["inspect", gold], ["report", gold], ["ask", gold, "how many customers"], ["generate-sparql", gold, "show orders"], ["profile", gold], ["diff", gold, gold], ["studio", gold], ["doctor"], ["benchmark", "--rows", "100"], ["query", gold, "ASK { ?s ?p ?o }"]):
        assert cli.main(command) == 0, command
    assert '"triples": 600' in capsys.readouterr().out


def test_documented_access_rules():
    """A list of policies with their roles; allowed, denied and masked properties; unknown keys are errors."""
    rules = policy.Policies.from_config({"policies": [{"role": "default", "max_rows": 500}, {"role": "analyst", "deny_properties": ["schema:email", "schema:telephone"], "mask_properties": ["email", "phone"], "max_rows": 200}, {"role": "restricted", "allow_entities": ["Customer", "Order"], "deny_properties": ["email", "phone", "ssn"], "max_rows": 50}]})
    assert rules.of("analyst").max_rows == 200 and rules.of("nobody").max_rows == 500 and "https://schema.org/email" in rules.of("analyst").deny_properties
    tables = [{"name": "c", "entity": "Customer", "primary_key": "id", "columns": {"email": {}, "name": {"property": "schema:name"}}}, {"name": "p", "entity": "Product", "primary_key": "id", "columns": {}}]
    assert [(t["entity"], list(t["columns"])) for t in rules.of("restricted").filter_schema(tables)] == [("Customer", ["name"])]
    assert list(policy.Role(allow_properties=["schema:name"]).filter_schema(tables)[0]["columns"]) == ["name"]
    assert policy.Policies.from_config({"policies": [{"role": "a"}]}).of("b").max_rows == 0 and policy.Policies.from_config({}).of("b").max_rows == 500
    for bad in ({"policies": [{"role": "a", "deny": ["x"]}]}, {"roles": {"a": {"denied_terms": ["x"]}}}, {"policies": [{"max_rows": 3}]}, {"polices": []}):
        with pytest.raises(ValueError):
            policy.Policies.from_config(bad)


def test_masked_and_denied_properties_are_kept_from_queries(spark):
    ns = "https://data.example/x"
    rows = [("1", "https://schema.org/email", "a@x.org"), ("1", "https://schema.org/telephone", "123"), ("1", "https://schema.org/name", "Ann")]
    triples = spark.createDataFrame([(f"{ns}/Customer/{s}", p, o, False, None, None, "c", "data") for s, p, o in rows], "subject string, predicate string, object string, is_iri boolean, datatype string, lang string, source_table string, kind string")
    e = engine.QueryEngine(TripleSet(triples), nl.Schema(ns, [], []), policy.Policies.from_config({"policies": [{"role": "analyst", "deny_properties": ["schema:telephone"], "mask_properties": ["email"]}]}))
    found = {r.v for r in e.execute_sparql("SELECT ?v WHERE { ?s ?p ?v }", "analyst").collect()}
    assert found == {"[MASKED]", "Ann"}


def test_a_hash_mask_needs_a_salt(monkeypatch):
    raw = {"tables": [{"name": "t", "source": "t.csv", "primary_key": "k", "columns": {"mail": {"pii": True}, "n": "schema:name"}}]}
    assert cfg.normalize(raw)["tables"][0]["columns"]["mail"]["mask"] == "hash"
    config = cfg.normalize(raw | {"governance": {"pii": {"default_mask": "hash32", "salt_env": "OTHER_SALT"}}})
    assert config["tables"][0]["columns"]["mail"]["mask"] == "hash32"
    monkeypatch.delenv("OTHER_SALT", raising=False)
    with pytest.raises(cfg.ConfigError):
        build.salt_of(config)
    monkeypatch.setenv("OTHER_SALT", "s")
    assert build.salt_of(config) == "s"


def test_glossary_and_ways():
    schema = nl.Schema("https://data.example/x", [{"name": n, "entity": n.title(), "primary_key": "id", "columns": {}} for n in ("a", "b", "c", "d")], [{"name": f"{x}{y}", "from_table": x, "to_table": y, "predicate": f"ex:{x}{y}", "inverse_predicate": None, "description": ""} for x, y in (("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"))])
    planner = nl.Planner(schema, glossary=[{"term": "D", "synonyms": ["destination"]}])
    assert [e["predicate"] for e in planner.path("A", "D")] == ["ex:ac", "ex:cd"] and planner.path("D", "A") == [] and planner.path("A", "A") == []
    assert planner.plan("count every destination").entities == ["D"]
    assert [(f["operator"], f["value"]) for f in nl.comparisons("more than 5 and below 7.5")] == [(">", "5"), ("<", "7.5")]
