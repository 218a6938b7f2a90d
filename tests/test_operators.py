import random
import uuid
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import terms
from weftgraph.operators import compile as C
from weftgraph.operators import explore, mask, profile, resolve, validate, versions
from weftgraph.plans import sparql
from weftgraph.plans.commerce import NAMESPACE as NS
from weftgraph.plans.dataset import TableGraph, TripleSet
from weftgraph.plans.sparql_parser import SparqlError, parse
from weftgraph.sources import export, readers, store
from weftgraph.streaming import append


def shop(spark):
    customers = spark.createDataFrame([(1, "Ann", "VIP", None), (2, "Bob", None, ["a", "b"]), (3, None, "Std", [])], "customer_id long, name string, segment string, tags array<string>")
    orders = spark.createDataFrame([(10, 1, 5.0), (11, 1, 1.5e9), (12, None, 0.0001), (13, 9, 2.0)], "order_id long, buyer long, amount double")
    tables = [C.Table("customers", customers, "Customer", "customer_id"), C.Table("orders", orders, "Order", "order_id", {"amount": f"{NS}#amount"}, {"buyer": "Customer"})]
    return tables, [C.Relationship("placed_by", "orders", "buyer", "customers", "customer_id", "ex:placedBy", "ex:placed")]


def test_names():
    assert terms.sanitize(" 9 Lives!-x ") == "_9_lives_x" and terms.sanitize("!!") == "entity"
    assert terms.safe("a-b") == "a_b" and terms.safe("1a") == "_1a" and terms.pascal("order_line items") == "OrderLineItems"
    assert terms.expand("FOAF:name").endswith("foaf/0.1/name") and terms.expand("ex:a") == "ex:a"
    assert terms.predicate_iri("schema:name", NS) == "https://schema.org/name" and terms.predicate_iri("foaf:name", NS + "/") == f"{NS}#name" and terms.predicate_iri("placed by", NS) == f"{NS}#placed_by"
    assert [terms.role(c, None) for c in ("id", "customer_id", "claim_line_id", "fk_customer", "parent_ref")] == ["primary_key", "primary_key", "literal", "foreign_key", "foreign_key"]
    assert len(terms.VOCABULARY) == 63


def test_uuid5(spark):
    got = [r.iri for r in spark.range(50).select(terms.minted(NS, "A", F.col("id"), "uuid5").alias("iri")).collect()]
    assert got == [f"{NS}/A/{uuid.uuid5(uuid.NAMESPACE_DNS, f'{NS}/A/{i}')}" for i in range(50)]
    with pytest.raises(ValueError):
        terms.minted(NS, "A", F.lit(1), "other")


def test_compile_counts_and_forms(spark):
    tables, rels = shop(spark)
    rows = C.graph(tables, rels, NS, spark).collect()
    # customers: 2 names, 2 segments, 2 tags, 3 types; orders: 3 buyers, 4 amounts, 4 types; 3 edges and inverses
    assert len(rows) == 2 + 2 + 2 + 3 + 3 + 4 + 4 + 3 * 2
    amounts = {r.object for r in rows if r.predicate.endswith("#amount")}
    assert amounts == {"5.0", "1500000000.0", "0.0001", "2.0"}
    assert all(r.is_iri for r in rows if r.predicate.endswith("/tags"))


def test_scale_ladder_counts(spark):
    n = 200
    columns = {"policyholder": 5, "policy": 7, "claim": 9, "payment": 7}
    tables = [C.Table(t, spark.range(n).select(F.col("id").alias(f"{t}_id"), *(F.lit(f"v{i}").alias(f"c{i}") for i in range(k))), t.title(), f"{t}_id") for t, k in columns.items()]
    assert sum(C.table_triples(t, NS).count() for t in tables) == 28 * n


def test_key_detection_and_inference(spark):
    tables, _ = shop(spark)
    frames = {t.name: t.df for t in tables} | {"customer_notes": spark.createDataFrame([(1, 1)], "note long, customer_id long")}
    assert C.detect_primary_key(frames["customers"]) == "customer_id"
    assert C.infer_relationships(frames, {"customers": "customer_id", "orders": "order_id"}) == [{"source_table": "customer_notes", "source_column": "customer_id", "target_table": "customers", "target_column": "customer_id"}]


def both(spark, text):
    """The virtual graph with stars must give what plain triples give."""
    tables, rels = shop(spark)
    virtual = TableGraph(spark, tables, rels, NS)
    plain = TripleSet(C.graph(tables, rels, NS, spark))
    text = f"PREFIX ex: <{NS}#> PREFIX n: <{NS}/> " + text
    a, b = (sorted(map(tuple, sparql.run(d, text).collect()), key=str) for d in (virtual, plain))
    assert a == b
    return a


def test_stars_equal_triples(spark):
    assert len(both(spark, "SELECT * WHERE { ?o a ex:Order ; ex:amount ?a ; ex:placedBy ?c }")) == 3
    assert len(both(spark, "SELECT * WHERE { ?o a ex:Order ; ex:amount ?a . ?o ex:placedBy ?c . ?c a ex:Customer ; schema:name ?n }")) == 2
    assert len(both(spark, "SELECT ?s ?t WHERE { ?s a ex:Customer ; n:tags ?t ; schema:name ?x }")) == 2
    assert both(spark, "SELECT ?n WHERE { ?c a ex:Customer OPTIONAL { ?c schema:name ?n } }") == [("Ann",), ("Bob",), (None,)]
    assert both(spark, "SELECT (COUNT(*) AS ?n) WHERE { ?s ?p ?o }") == [("26",)]
    assert both(spark, "ASK { ?s n:nothing ?o }") == [(False,)]
    assert both(spark, "SELECT ?x ?y WHERE { ?x (ex:placedBy/ex:placed)* ?y . ?x a ex:Order FILTER(?x != ?y) }") == [(f"{NS}/Order/10", f"{NS}/Order/11"), (f"{NS}/Order/11", f"{NS}/Order/10")]
    assert both(spark, 'SELECT ?c WHERE { ?c a ex:Customer MINUS { ?c n:segment "VIP" } FILTER NOT EXISTS { ?c schema:name "Bob" } }') == [(f"{NS}/Customer/3",)]
    assert both(spark, "SELECT ?b WHERE { VALUES ?a { 1 2 UNDEF } BIND(COALESCE(?a, 7) + 1 AS ?b) }") == [("2",), ("3",), ("8",)]
    assert both(spark, 'SELECT (SUM(?a) AS ?s) (AVG(?a) AS ?m) (SAMPLE(?a) AS ?x) WHERE { ?o ex:amount ?a FILTER(?a < 10 && isNumeric(?a) && datatype(?a) = xsd:double) }')[0][2] == "0.0001"
    assert both(spark, 'SELECT ?t WHERE { ?o ex:amount ?a FILTER(?a IN (2, 5)) BIND(STRAFTER(STR(?o), "Order/") AS ?t) } ORDER BY DESC(?t) LIMIT 1') == [("13",)]


def test_errors_are_told():
    for text, part in (("", "empty"), ("DELETE WHERE { ?s ?p ?o }", "DELETE"), ("SELECT * WHERE { SERVICE <x:y> { ?s ?p ?o } }", "SERVICE"), ("SELECT * { ?s zz:p ?o }", "prefix"), ("SELECT * { ?s ?p ?o } LIMIT x", "LIMIT"), ("SELECT * { ?s ?p ?o", "end")):
        with pytest.raises(SparqlError, match=part):
            parse(text)
    assert parse("BASE <http://a/> PREFIX : <b#> SELECT * { ?s :add \"drop\" }").form == "select"


def test_checks_report_everything(spark):
    tables, rels = shop(spark)
    by_name = {t.name: t for t in tables}
    assert [e["message"] for e in validate.check_relationship(rels[0], by_name)] == ["1 orphan values, among them 9"]
    required = C.Relationship("r", "orders", "buyer", "customers", "segment", "ex:r", required=True)
    assert [e["message"].split()[0] for e in validate.check_relationship(required, by_name)] == ["required", "2"]
    assert validate.check_relationship(C.Relationship("r", "orders", "x", "customers", "y", "ex:r"), by_name)[1]["message"] == "unknown column customers.y"
    assert validate.check_relationship(C.Relationship("r", "nowhere", "x", "customers", "y", "ex:r"), by_name)[0]["message"] == "unknown table nowhere"
    bad = C.Table("t", spark.createDataFrame([(1, None, None), (1, None, "x"), (None, None, None)], "k long, a string, b string"), "T", "k")
    found = validate.check_table(bad, ["b"], ["zz"])
    assert len(found["errors"]) == 4 and len(found["warnings"]) == 2 and found["profile"]["row_count"] == 3


def test_masks(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abcdefg"), (3, None), (4, "a@b.c"), (5, "+12-3")], "id long, v string")
    got = lambda s: [r.v for r in mask.apply(df, {"v": s}, "x").orderBy("id").collect()]
    assert got("partial")[:3] == ["****", "ab***fg", None] and got("redact")[2] is None and got("pseudonymize")[3].endswith("@example.com") and got("pseudonymize")[4].startswith("+X-XXX-")
    assert len(set(got("tokenize"))) == 5 and mask.apply(df, {"v": "drop"}).columns == ["id"]
    with pytest.raises(ValueError):
        got("none")
    assert mask.detect(["email", "firstName", "description", "zip", "client_ip", "amount"]) == {"email": "EMAIL_ADDRESS", "firstName": "PERSON", "zip": "LOCATION", "client_ip": "IP_ADDRESS"}


def test_fuzzy_loses_no_pair(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    other = ["".join(c if rng.random() > 0.1 else rng.choice("abcdeX") for c in w) for w in base] + ["", "ABC", "abcabc"]
    a = C.Table("a", spark.createDataFrame(list(enumerate(base)), "k long, v string"), "A", "k")
    b = C.Table("b", spark.createDataFrame(list(enumerate(other)), "k long, v string"), "B", "k")
    want = {(x, y) for x in base for y in other if x and y and SequenceMatcher(None, x.lower(), y.lower()).ratio() >= 0.85}
    assert {(r.a_value, r.b_value) for r in resolve.fuzzy(a, b, ("v", "v")).collect()} == want


def test_same_as_makes_every_pair_once_and_shuffles_none(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(resolve, "CELL_ROWS", 3, raising=False)
    # keys repeat with equal and other values, or are null; many share one value, a few have one of their own
    rows = lambda n: [(rng.choice([None, *range(n)]), rng.choice(["x", "x", "x", "y", "z", "", None, str(i)])) for i in range(2 * n)]
    one, two = rows(30), rows(20)
    a = C.Table("a", spark.createDataFrame(one, "k long, v string"), "A", "k")
    b = C.Table("b", spark.createDataFrame(two, "k long, v string"), "B", "k")
    met = {("x", "x"), ("x", "y"), ("y", "x"), ("z", "z"), ("", ""), ("1", "2"), ("w", "x")}
    found = resolve.same_as(a, b, ("v", "v"), spark.createDataFrame([*met, *met], "a_value string, b_value string"), NS)
    iri = lambda e, k: None if k is None else f"{NS}/{e}/{k}"
    want = {(iri("A", k), iri("B", j)) for k, v in one for j, w in two if (v, w) in met}
    got = [(r.subject, r.object) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert found.columns == C.COLUMNS and found.select("kind", "source_table", "is_iri", "predicate").distinct().collect() == [("sameas", "a", True, terms.SAME_AS)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
    empty = resolve.same_as(a, b, ("v", "v"), spark.createDataFrame([], "a_value string, b_value string"), NS)
    assert empty.collect() == []


def test_versions_store_and_exports(spark, tmp_path):
    tables, rels = shop(spark)
    triples = C.graph(tables, rels, NS, spark)
    store.write(triples, f"{tmp_path}/g")
    back = store.read(spark, f"{tmp_path}/g")
    assert back.count() == C.as_set(triples).count() and store.read(spark, f"{tmp_path}/g", f"{NS}#amount").count() == 4
    v = store.Versions(spark, f"{tmp_path}/v")
    v.snapshot(triples, "one")
    v.snapshot(triples.where("predicate not like '%amount'"), "two", "fewer")
    d = v.diff("one", "two")
    assert (d["added"], d["removed"]) == (0, 4) and len(d["removed_samples"]) == 4 and v.latest()["tag"] == "two"
    with pytest.raises(KeyError):
        v.checkout("three")
    assert versions.fingerprint(triples).first() == versions.fingerprint(triples.repartition(5)).first() != versions.fingerprint(triples.limit(3)).first()
    odd = C.manual_triples(spark, [{"subject": "u:s", "predicate": "u:p", "object": 'a "q" \\ \n\t', "datatype": terms.XSD + "string"}, {"subject": "u:s", "predicate": "u:p", "object": "b", "lang": "de"}, {"subject": "u:s", "predicate": "u:q", "object": "u:o", "is_iri": True}])
    export.write(odd, f"{tmp_path}/nt", "ntriples")
    again = readers.read_ntriples(spark, f"{tmp_path}/nt")
    key = ["subject", "predicate", "object", "is_iri", "datatype", "lang"]
    assert sorted(map(tuple, again.select(key).collect()), key=str) == sorted(map(tuple, odd.select(key).collect()), key=str)
    import json
    import xml.dom.minidom

    export.single_file(odd, f"{tmp_path}/x.rdf", "rdfxml")
    xml.dom.minidom.parse(f"{tmp_path}/x.rdf")
    export.single_file(odd, f"{tmp_path}/x.json", "jsonld")
    assert json.load(open(f"{tmp_path}/x.json"))[0]["@id"] == "u:s"
    export.write(odd, f"{tmp_path}/ttl", "turtle")
    with pytest.raises(ValueError):
        export.write(odd, f"{tmp_path}/no", "other")
    assert "INSERT DATA" in export.insert_statements(odd).first().update


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,x\n")
    (tmp_path / "a.tsv").write_text("id\tv\n1\tx\n")
    (tmp_path / "a.json").write_text('[{"id": 1, "v": "x"}]')
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n')
    for kind in ("csv", "tsv", "json", "jsonl"):
        assert [tuple(r) for r in readers.read_table(spark, str(tmp_path / f"a.{kind}")).select("id", "v").collect()] == [(1, "x")]
    import pandas as pd

    assert readers.read_table(spark, pd.DataFrame({"a": [1]})).count() == 1
    readers.register("twice", lambda s, source, **o: s.range(int(source) * 2))
    assert readers.read_table(spark, "3", "twice").count() == 6
    for source, error in (("x.unknown", ValueError), (5, TypeError)):
        with pytest.raises(error):
            readers.read_table(spark, source)


def test_profile_and_explore(spark):
    tables, rels = shop(spark)
    triples = C.graph(tables, rels, NS, spark)
    p = profile.profile(triples).first()
    assert (p.total_triples, p.entity_types) == (26, 2) and p.broken_references == 2  # the two tags; customer 9 is a subject by its inverse edge
    assert [r.subject for r in explore.search(triples, "ann", limit=5).collect()] == [f"{NS}/Customer/1"]
    assert explore.neighbours(triples, f"{NS}/Customer/1", depth=3, limit=100).agg(F.max("hop")).first()[0] == 2
    assert explore.token_overlap(triples, "vip customer", 1).first().score == 2
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "k long, v array<float>")
    assert [r.k for r in explore.vector_top_k(v, "k", "v", [1.0, 0.1], 5).collect()] == [1, 3, 2]


def test_stream_equals_batch(spark, tmp_path):
    spark.range(20).selectExpr("id AS k", "concat('v', id) AS v").write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("k long, v string").parquet(f"{tmp_path}/in")
    append.append(C.Table("t", rows, "T", "k"), NS, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40


def test_constant_subjects_reach_the_scan(spark, tmp_path):
    """A constant IRI becomes a filter on the key, by a scan that knows it; other spellings and types find nothing."""
    spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(50)], "k long, v string, g int").write.parquet(f"{tmp_path}/t")
    t = C.Table("t", spark.read.parquet(f"{tmp_path}/t"), "Thing", "k", links={"g": "Thing"})
    g = TableGraph(spark, [t], [], NS)
    plain = C.as_set(C.graph([t], [], NS, spark))
    key = ["subject", "predicate", "object"]
    for iri in (f"{NS}/Thing/7", f"{NS}/Thing/2", f"{NS}/Thing/07", f"{NS}/Thing/x", f"{NS}/Thing/99999999999999999999", f"{NS}/Other/7"):
        assert sorted(map(tuple, g.with_subject(iri).source.select(*key).collect())) == sorted(map(tuple, plain.where(F.col("subject") == iri).select(*key).collect()))
        assert sorted(map(tuple, g.around(iri).source.select(*key).collect())) == sorted(map(tuple, plain.where((F.col("subject") == iri) | (F.col("is_iri") & (F.col("object") == iri))).select(*key).collect()))
    plan = g.with_subject(f"{NS}/Thing/7").source._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,7)" in plan


def test_predicate_counts_without_triples(spark):
    tables, rels = shop(spark)
    want = {r.predicate: r["count"] for r in C.graph(tables, rels, NS, spark).groupBy("predicate").count().collect()}
    assert {r.predicate: r.n for r in profile.predicate_counts(tables, rels, NS).collect()} == want


def test_ntriples_that_do_not_parse_are_an_error(spark, tmp_path):
    (tmp_path / "g.nt").write_text('# a comment\n\n<a:s> <a:p> "o" .\nno triple\n')
    assert readers.read_ntriples(spark, f"{tmp_path}/g.nt", strict=False).count() == 1
    with pytest.raises(Exception, match="no triple"):
        readers.read_ntriples(spark, f"{tmp_path}/g.nt").collect()


def test_registry_and_removed_tables(spark):
    tables, rels = shop(spark)
    known = C.Registry(rels)
    assert known.get("placed_by") is rels[0] and known.list("orders") == known.list("customers") == rels and known.list("other") == []
    assert known.to_dict()["placed_by"]["predicate"] == "ex:placedBy"
    with pytest.raises(ValueError, match="twice"):
        known.declare(rels[0])
    known.remove("placed_by")
    assert known.list() == []
    with pytest.raises(KeyError):
        known.get("placed_by")
    g = TableGraph(spark, tables, rels, NS).without_table("orders")
    key = ["subject", "predicate", "object"]
    assert sorted(map(tuple, g.source.select(*key).collect())) == sorted(map(tuple, C.as_set(C.graph(tables[:1], [], NS, spark)).select(*key).collect()))
    with pytest.raises(KeyError):
        g.without_table("orders")
