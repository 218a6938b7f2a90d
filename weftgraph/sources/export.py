"""Triples as text: column expressions, written by the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import PREFIXES, XSD, escaped, xml_escaped

_EXTRA: dict[str, str] = {}
_SERIALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_prefix(prefix: str, iri: str) -> None:
    """K8: a prefix for Turtle."""
    _EXTRA[prefix] = iri


def prefixes() -> dict[str, str]:
    return PREFIXES | _EXTRA


def ntriples(triples: DataFrame) -> DataFrame:
    """K2: a line a triple. Literals keep their datatype, also string."""
    literal = F.concat(F.lit('"'), escaped(F.col("object")), F.lit('"'))
    tail = F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit("@"), "lang")).when(F.col("datatype").isNotNull() & (F.col("datatype") != ""), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise("")
    o = F.when(F.col("is_iri"), F.concat(F.lit("<"), "object", F.lit(">"))).otherwise(F.concat(literal, tail))
    return triples.select(F.concat(F.lit("<"), "subject", F.lit("> <"), "predicate", F.lit("> "), o, F.lit(" .")).alias("value"))


def _compact(iri: Column) -> Column:
    """A prefixed name where a known namespace leaves a plain local name; else the IRI in brackets."""
    out = F.when(F.lit(False), "")
    for p, ns in prefixes().items():
        rest = F.substring(iri, F.lit(len(ns) + 1), F.length(iri))
        out = out.when(F.startswith(iri, F.lit(ns)) & F.rlike(rest, F.lit(r"^[A-Za-z_][A-Za-z0-9_-]*$")), F.concat(F.lit(f"{p}:"), rest))
    return out.otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def turtle_header() -> list[str]:
    return [f"@prefix {p}: <{ns}> ." for p, ns in prefixes().items()]


def turtle(triples: DataFrame) -> DataFrame:
    """K1: a statement a triple, without the header (which every file of a directory needs). String literals carry no datatype."""
    literal = F.concat(F.lit('"'), escaped(F.col("object")), F.lit('"'))
    typed = F.col("datatype").isNotNull() & ~F.col("datatype").isin("", XSD + "string")
    tail = F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit("@"), "lang")).when(typed, F.concat(F.lit("^^"), _compact(F.col("datatype")))).otherwise("")
    o = F.when(F.col("is_iri"), _compact(F.col("object"))).otherwise(F.concat(literal, tail))
    return triples.select(F.concat(_compact(F.col("subject")), F.lit(" "), _compact(F.col("predicate")), F.lit(" "), o, F.lit(" .\n")).alias("value"))


def jsonld(triples: DataFrame) -> DataFrame:
    """K3: a node a subject; each predicate has the list of its values."""
    value = F.when(F.col("is_iri"), F.to_json(F.struct(F.col("object").alias("@id")))).otherwise(
        F.to_json(F.struct(F.col("object").alias("@value"), F.when(F.coalesce("lang", F.lit("")) == "", F.nullif("datatype", F.lit(""))).alias("@type"), F.nullif("lang", F.lit("")).alias("@language")))
    )
    by_predicate = triples.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list(value)).alias("values"))
    entry = F.concat(F.to_json(F.array("predicate")).substr(F.lit(2), F.length(F.to_json(F.array("predicate"))) - 2), F.lit(":["), F.array_join("values", ","), F.lit("]"))
    nodes = by_predicate.groupBy("subject").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    head = F.to_json(F.struct(F.col("subject").alias("@id")))
    return nodes.select(F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(","), F.array_join("entries", ","), F.lit("}")).alias("value"))


def jsonld_each(triples: DataFrame) -> DataFrame:
    """A node a triple."""
    return triples.select(F.to_json(F.struct(F.col("subject").alias("@id"), "predicate", "object")).alias("value"))


def rdfxml(triples: DataFrame) -> DataFrame:
    """K4: a description a triple, with the predicate's own namespace and the literal's datatype."""
    ns, name = F.regexp_extract("predicate", "^(.*[/#:])([^/#:]*)$", 1), F.regexp_extract("predicate", "^(.*[/#:])([^/#:]*)$", 2)
    attributes = F.when(F.col("is_iri"), F.concat(F.lit(' rdf:resource="'), xml_escaped(F.col("object")), F.lit('"/>'))).otherwise(
        F.concat(F.when(F.coalesce("lang", F.lit("")) != "", F.concat(F.lit(' xml:lang="'), "lang", F.lit('"'))).when(F.coalesce("datatype", F.lit("")) != "", F.concat(F.lit(' rdf:datatype="'), "datatype", F.lit('"'))).otherwise(""), F.lit(">"), xml_escaped(F.col("object")), F.lit("</p:"), name, F.lit(">"))
    )
    return triples.select(F.concat(F.lit('<rdf:Description rdf:about="'), xml_escaped(F.col("subject")), F.lit('"><p:'), name, F.lit(' xmlns:p="'), xml_escaped(ns), F.lit('"'), attributes, F.lit("</rdf:Description>")).alias("value"))


for _names, _f in ((("ntriples", "nt"), ntriples), (("turtle", "ttl"), turtle), (("jsonld", "json-ld"), jsonld), (("rdfxml", "rdf", "xml"), rdfxml), (("jsonld-each",), jsonld_each)):
    for _n in _names:
        _SERIALIZERS[_n] = _f


def register_serializer(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    _SERIALIZERS[name] = f


def lines(triples: DataFrame, format: str) -> DataFrame:
    """K7: an unknown format is an error."""
    if format not in _SERIALIZERS:
        raise ValueError(f"no format {format!r}: {', '.join(sorted(_SERIALIZERS))}")
    return _SERIALIZERS[format](triples)


def write(triples: DataFrame, path: str, format: str) -> None:
    """A directory of text files, written in parallel. Turtle declares its prefixes first in each file; JSON-LD has a node a line;
    RDF/XML has the descriptions, to be put into one rdf:RDF element by ``single_file``."""
    out = lines(triples, format)
    if format in ("turtle", "ttl"):
        header = "\n".join(turtle_header()) + "\n"

        def headed(batches):
            import pyarrow as pa

            first = True
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(([header] if first else []) + b.column(0).to_pylist())], ["value"])
                first = False

        out = out.mapInArrow(headed, "value string")
    out.write.mode("overwrite").text(path)


def single_file(triples: DataFrame, path: str, format: str) -> None:
    """One well-formed file on the driver's disk, line by line (for exports that fit one)."""
    body = (r.value for r in lines(triples, format).orderBy("value").toLocalIterator())
    with open(path, "w", encoding="utf-8") as f:
        if format in ("turtle", "ttl"):
            f.write("\n".join(turtle_header()) + "\n\n")
        if format in ("rdfxml", "rdf", "xml"):
            f.write('<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="' + PREFIXES["rdf"] + '">\n')
        many = format in ("jsonld", "json-ld", "jsonld-each")
        f.write("[" * many)
        for i, line in enumerate(body):
            f.write((",\n" if many and i else "") + line + ("" if many else "\n"))
        f.write("]" * many + ("</rdf:RDF>\n" if format in ("rdfxml", "rdf", "xml") else ""))


def insert_statements(triples: DataFrame, batch: int = 1000) -> DataFrame:
    """K9: SPARQL updates of ``batch`` triples each, as text."""
    numbered = ntriples(triples).withColumn("part", F.floor(F.monotonically_increasing_id() / batch))
    return numbered.groupBy("part").agg(F.concat(F.lit("INSERT DATA {\n"), F.array_join(F.collect_list("value"), "\n"), F.lit("\n}")).alias("update")).select("update")


def push(triples: DataFrame, endpoint: str, headers: dict[str, str] | None = None, batch: int = 1000, post: Callable | None = None) -> None:
    """Sends the updates from the executors; ``post(url, body, headers)`` replaces HTTP in tests. A failed request is
    retried with its task; inserting a triple twice changes nothing."""
    headers = {"Content-Type": "application/sparql-update"} | (headers or {})

    def send(rows):
        import urllib.request

        for r in rows:
            if post is not None:
                post(endpoint, r["update"], headers)
            else:
                urllib.request.urlopen(urllib.request.Request(endpoint, r["update"].encode(), headers, method="POST"), timeout=60).close()

    insert_statements(triples, batch).foreachPartition(send)
