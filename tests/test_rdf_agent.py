import pytest

from weftgraph.functions.terms import PREFIXES, RDF_TYPE, XSD
from weftgraph.operators import compile as C
from weftgraph.plans import agent, nl, policy, sparql
from weftgraph.plans.dataset import TableGraph, TripleSet
from weftgraph.plans.engine import QueryEngine
from weftgraph.sources import export, rdf

RDF = PREFIXES["rdf"]
TURTLE = """@prefix ex: <http://x/> . # a comment
PREFIX : <http://y#>
@base <http://b/d/> .
<s> a ex:Thing, ex:Other ; ex:says "a \\"b\\"\\u00e9\\n", 'c'@en-GB ; ex:n 1, -2.5, 1e3 ; ex:ok true ;.
ex:t :long \"\"\"two "quoted"
lines\"\"\"^^ex:kind ; ex:has [ ex:in _:b1 ; ex:v "" ] .
_:b1 ex:list (1 <z>) . [] ex:alone :o . ex:a.b ex:p ex:c\\,d .
"""


def statements(parser, text):
    return list(parser(text, "file").statements())


def test_turtle():
    got = statements(rdf.Turtle, TURTLE)
    said = {(s, p): (o, i, d, l) for s, p, o, i, d, l in got}
    b = "http://b/d/s"
    assert [g[2] for g in got if g[:2] == (b, RDF_TYPE)] == ["http://x/Thing", "http://x/Other"]
    assert [g[2:] for g in got if g[1] == "http://x/says"] == [('a "b"é\n', False, XSD + "string", None), ("c", False, None, "en-GB")]
    assert [(g[2], g[4]) for g in got if g[1] == "http://x/n"] == [("1", XSD + "integer"), ("-2.5", XSD + "decimal"), ("1e3", XSD + "double")]
    assert said[b, "http://x/ok"] == ("true", False, XSD + "boolean", None)
    assert said["http://x/t", "http://y#long"] == ('two "quoted"\nlines', False, "http://x/kind", None)
    inner = said["http://x/t", "http://x/has"][0]
    assert inner.startswith("_:") and said[inner, "http://x/v"] == ("", False, XSD + "string", None)
    named = said[inner, "http://x/in"][0]
    cell = said[named, "http://x/list"][0]
    assert said[cell, RDF + "first"][0] == "1"
    after = said[cell, RDF + "rest"][0]
    assert said[after, RDF + "first"][0] == "http://b/d/z" and said[after, RDF + "rest"][0] == RDF + "nil"
    assert said["http://x/a.b", "http://x/p"][0] == "http://x/c,d" and len(got) == 19
    assert statements(rdf.Turtle, "") == [] and statements(rdf.Turtle, "# nothing") == []
    for bad in ("<a> <b> .", "<a> <b> <c>", "zz:a <b> <c> .", '"a" <b> <c> .', "<a> <b> <c> ; ] .", "<a> <b> ( <c> ."):
        with pytest.raises(ValueError, match="no Turtle"):
            statements(rdf.Turtle, bad)


def test_rdfxml():
    text = f"""<?xml version="1.0"?><rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://x/" xml:base="http://b/d"><e:Thing rdf:about="s" e:short="v" xml:lang="de">
    <e:name>N &amp; M</e:name><e:n rdf:datatype="{XSD}integer">7</e:n><e:to rdf:resource="http://o"/><e:in><rdf:Description rdf:nodeID="k"><e:deep>d</e:deep></rdf:Description></e:in>
    <e:part rdf:parseType="Resource"><e:q/></e:part></e:Thing><rdf:Bag rdf:ID="bag"><rdf:li>a</rdf:li><rdf:li>b</rdf:li></rdf:Bag></rdf:RDF>"""
    got = statements(rdf.RdfXml, text)
    said = {(s, p): (o, i, d, l) for s, p, o, i, d, l in got}
    s = "http://b/s"
    assert said[s, RDF_TYPE][0] == "http://x/Thing" and said[s, "http://x/short"] == ("v", False, None, "de")
    assert said[s, "http://x/name"] == ("N & M", False, None, "de") and said[s, "http://x/n"] == ("7", False, XSD + "integer", None)
    assert said[s, "http://x/to"][:2] == ("http://o", True)
    assert said[said[s, "http://x/in"][0], "http://x/deep"][0] == "d" and said[said[s, "http://x/part"][0], "http://x/q"][0] == ""
    assert said["http://b/d#bag", RDF + "_1"][0] == "a" and said["http://b/d#bag", RDF + "_2"][0] == "b" and len(got) == 12
    with pytest.raises(ValueError, match="Literal"):
        statements(rdf.RdfXml, f'<r:RDF xmlns:r="{RDF}"><r:Description r:about="a"><p xmlns="http://x/" r:parseType="Literal">x</p></r:Description></r:RDF>')


def test_files_come_back(spark, tmp_path):
    """What the exporters write is read as it was, odd literals, languages and clashing prefixes included; an empty graph, too."""
    odd = ["", 'q"uo\\te', "a\nb\tc\r", "<&>", "é ☃", " . ; # @en ^^", "\\u0041"]
    rows = [{"subject": f"http://x/s{i}", "predicate": "http://x/p#q", "object": o, "is_iri": False, "datatype": XSD + "string"} for i, o in enumerate(odd)]
    rows += [{"subject": "http://x/s,1", "predicate": PREFIXES["schema"] + "name", "object": "http://x/o", "is_iri": True}, {"subject": "http://x/s", "predicate": "http://x/n", "object": "7", "is_iri": False, "datatype": XSD + "integer"}]
    triples = C.manual_triples(spark, rows)
    for format, read in (("turtle", rdf.read_turtle), ("rdfxml", rdf.read_rdfxml)):
        export.write(triples, str(tmp_path / format), format)
        columns = ["subject", "predicate", "object", "is_iri", "datatype"]
        want, got = (sorted(map(tuple, d.select(*columns).collect()), key=str) for d in (triples, read(spark, str(tmp_path / format))))
        if format == "rdfxml":  # XML reads a carriage return as a line's end
            want = sorted((tuple(v.replace("\r", "\n") if isinstance(v, str) else v for v in w) for w in want), key=str)
        assert got == want, format
        export.write(triples.where("false"), str(tmp_path / f"{format}-none"), format)
        assert read(spark, str(tmp_path / f"{format}-none")).count() == 0


def graph(spark):
    people = spark.createDataFrame([(1, "Ann", 3), (2, "Bob", None), (3, None, 1)], "id long, name string, boss long")
    tables = [C.Table("people", people, "Person", "id")]
    return TableGraph(spark, tables, [], "http://x/g"), TripleSet(C.graph(tables, [], "http://x/g", spark))


def test_exists_within_expressions(spark):
    def ask(text):
        a, b = (sorted(map(tuple, sparql.run(d, "PREFIX x: <http://x/g/> PREFIX ex: <http://x/g#> " + text).collect()), key=str) for d in graph(spark))
        assert a == b
        return [tuple(v.rpartition("/")[2] if v else v for v in r) for r in a]

    person = "?s a ex:Person"
    assert ask(f"SELECT * {{ {person} FILTER(EXISTS {{ ?s schema:name ?n }}) }}") == [("1",), ("2",)]
    assert ask(f"SELECT ?s {{ {person} FILTER(!EXISTS {{ ?s schema:name ?n }} || EXISTS {{ ?s x:boss ?x FILTER(?x = 3) }}) }}") == [("1",), ("3",)]
    assert ask(f"SELECT ?s ?b {{ {person} BIND(IF(NOT EXISTS {{ ?s x:boss ?x FILTER(?x > 2) }}, 'few', 'many') AS ?b) }}") == [("1", "many"), ("2", "few"), ("3", "few")]
    assert ask(f"SELECT ?s {{ {person} FILTER(EXISTS {{ ?z x:boss ?x }} && NOT EXISTS {{ ?z x:chief ?x }}) }}") == [("1",), ("2",), ("3",)]
    assert ask(f"SELECT ?s ?n {{ {person} OPTIONAL {{ ?s schema:name ?n FILTER(EXISTS {{ ?s x:boss ?b }} || false) }} }}") == [("1", "Ann"), ("2", None), ("3", None)]
    with pytest.raises(sparql.SparqlError, match="inner group"):
        ask(f"SELECT ?s {{ {person} ; x:boss ?b OPTIONAL {{ ?t schema:name ?n FILTER(EXISTS {{ ?t x:boss ?b }} || false) }} }}")


def test_providers(monkeypatch):
    assert agent.provider("mock", text="x").generate([]) == "x" and "LIMIT" in agent.provider("mock").generate([])
    monkeypatch.setenv("MODEL_KEY", "k")
    sent = []
    http = agent.provider("http", endpoint="http://m", model="m", key_env="MODEL_KEY", post=lambda *a: sent.append(a) or {"choices": [{"message": {"content": "ok"}}]})
    assert http.generate([{"role": "user", "content": "q"}]) == "ok"
    assert sent[0][1] == {"model": "m", "messages": [{"role": "user", "content": "q"}]} and sent[0][2]["Authorization"] == "Bearer k"
    monkeypatch.delenv("MODEL_KEY")
    with pytest.raises(ValueError, match="MODEL_KEY"):
        agent.provider("http", endpoint="http://m", key_env="MODEL_KEY")
    with pytest.raises(ValueError, match="no provider"):
        agent.provider("other")


class Scripted:
    name = "scripted"

    def __init__(self, *texts):
        self.texts, self.heard = list(texts), []

    def generate(self, messages):
        self.heard.append(messages)
        return self.texts.pop(0)


def test_agent(spark):
    people = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "id long, name string")
    orders = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "id long, person long")
    tables = [C.Table("people", people, "Person", "id"), C.Table("orders", orders, "Order", "id")]
    relation = C.Relationship("placed", "orders", "person", "people", "id", "ex:placedBy", "ex:placed")
    schema = nl.Schema("http://x/g", [{"name": "people", "entity": "Person", "primary_key": "id", "columns": {"name": {"property": "schema:name"}}}, {"name": "orders", "entity": "Order", "primary_key": "id", "columns": {}}], [dict(relation.__dict__)])
    roles = policy.Policies({"clerk": policy.Role(deny_entities=["Order"], deny_properties=["schema:name"])})
    e = QueryEngine(TripleSet(C.graph(tables, [relation], "http://x/g", spark)), schema, roles)
    plain = agent.GraphAgent(e)
    assert plain.summary().splitlines() == ["Person: name", "Order: ", "Order -placedBy-> Person"]
    assert "name" not in agent.GraphAgent(e, role="clerk").summary() and "Order" not in agent.GraphAgent(e, role="clerk").summary()
    told = plain.explain("how many person")
    assert told["result_count"] == 1 and "COUNT" in told["sparql"] and told["suggested_followups"] == ["Show each Person and its Order", "How many Person are there?"]
    good = "SELECT ?n WHERE { ?p schema:name ?n } LIMIT 5"
    model = Scripted("DROP ALL", f"```sparql\n{good}\n```")
    assert sorted(r.n for r in agent.GraphAgent(e, model).ask("names?").collect()) == ["Ann", "Bob"]
    assert "not valid" in model.heard[1][-1]["content"] and agent.GraphAgent(e, Scripted(good)).ask("names?", max_rows=1).count() == 1
    hopeless = agent.GraphAgent(e, Scripted("a", "b", "c"))
    assert "COUNT" in hopeless.query("how many order") and len(hopeless.model.heard) == 3
    talk = Scripted("Ann has two orders.")
    assert agent.GraphAgent(e, talk).rag("orders of Person 1?") == "Ann has two orders." and "placedBy" in talk.heard[0][0]["content"]
    known = plain.context("what about Bobs friend Bob, or Anna? Person")
    assert any("placedBy" in line for line in known)
    assert not any("Ann" in line for line in agent.GraphAgent(e, role="clerk").context("about Person"))
    with pytest.raises(ValueError, match="model"):
        plain.rag("x")
    assert agent.confidence("SELECT ?a WHERE { ?a ?b ?c FILTER(?c > 1) } GROUP BY ?a ORDER BY ?a") == 0.95 and agent.confidence("") == 0.5
