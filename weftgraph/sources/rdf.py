"""Reading Turtle and RDF/XML. Statements there depend on what stands before them in their file (prefixes, subjects), so a file is
read whole by one task; a graph of many files, as ``export.write`` makes it, is read by as many tasks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import PREFIXES, RDF_TYPE, XSD
from ..operators.compile import COLUMNS

RDF = PREFIXES["rdf"]
#: (subject, predicate, object, is_iri, datatype, lang); blank nodes are told by their leading "_:".
Statement = tuple[str, str, str, bool, str | None, str | None]

_TOKEN = re.compile(
    r"""(?P<skip>[\s]+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\x00-\x20]*>)
    |(?P<text>\"\"\"(?:\"{0,2}(?:[^"\\]|\\.))*\"\"\"|'''(?:'{0,2}(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:\w(?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+))
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\.)(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\.)*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\.))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<sign>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        return chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", one, text, flags=re.S) if "\\" in text else text


class Turtle:
    """The statements of one Turtle text. What does not parse is a ValueError that says where."""

    def __init__(self, text: str, file: str = "", base: str = ""):
        self.text, self.base, self.prefixes, self.out = text, base, {}, []
        self.file, self.blanks = f"{zlib.crc32(file.encode()):08x}", 0
        self.tokens = self._tokens()
        self._next()

    def _tokens(self) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if m is None:
                self._fail(at)
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0], at
            at = m.end()
        yield "end", "", at

    def _next(self) -> None:
        self.kind, self.token, self.at = next(self.tokens)

    def _fail(self, at: int):
        raise ValueError(f"no Turtle at character {at}: {self.text[at : at + 60]!r}")

    def _take(self, *signs: str) -> None:
        if self.token not in signs:
            self._fail(self.at)
        self._next()

    def statements(self) -> Iterator[Statement]:
        while self.kind != "end":
            self._directive() if self.token.lower() in ("@prefix", "@base", "prefix", "base") else self._triples()
            yield from self.out
            self.out = []

    def _directive(self) -> None:
        what, dotted = self.token.lower().lstrip("@"), self.token.startswith("@")
        self._next()
        prefix = None
        if what == "prefix":
            prefix = self.token[:-1]
            if self.kind != "name" or not self.token.endswith(":"):
                self._fail(self.at)
            self._next()
        if self.kind != "iri":
            self._fail(self.at)
        iri = self._iri()
        if prefix is None:
            self.base = iri
        else:
            self.prefixes[prefix] = iri
        if dotted:
            self._take(".")

    def _iri(self) -> str:
        token, kind = self.token, self.kind
        if kind == "iri":
            iri = urljoin(self.base, _unescaped(token[1:-1])) if self.base else _unescaped(token[1:-1])
        elif kind == "name" and token.partition(":")[0] in self.prefixes:
            prefix, _, local = token.partition(":")
            iri = self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        else:
            self._fail(self.at)
        self._next()
        return iri

    def _blank(self, label: str | None = None) -> str:
        if label is None:
            self.blanks += 1
        return f"_:f{self.file}-{label or f'.{self.blanks}'}"

    def _triples(self) -> None:
        bare = self.token == "["
        subject, is_iri = self._node()[:2]
        if not is_iri:
            self._fail(self.at)
        if not (bare and self.token == "."):
            self._predicates(subject)
        self._take(".")

    def _predicates(self, subject: str) -> None:
        while True:
            if self.kind == "word" and self.token == "a":
                self._next()
                predicate = RDF_TYPE
            else:
                predicate = self._iri()
            self.out.append((subject, predicate, *self._node()))
            while self.token == ",":
                self._next()
                self.out.append((subject, predicate, *self._node()))
            if self.token != ";":
                return
            while self.token == ";":
                self._next()
            if self.token in (".", "]") or self.kind == "end":
                return

    def _node(self) -> tuple[str, bool, str | None, str | None]:
        kind, token = self.kind, self.token
        if kind in ("iri", "name"):
            return self._iri(), True, None, None
        if kind == "blank":
            self._next()
            return self._blank(token[2:]), True, None, None
        if token == "[":
            self._next()
            node = self._blank()
            if self.token != "]":
                self._predicates(node)
            self._take("]")
            return node, True, None, None
        if token == "(":
            return self._collection(), True, None, None
        if kind == "text":
            return self._literal()
        if kind == "number":
            self._next()
            return token, False, XSD + ("double" if "e" in token.lower() else "decimal" if "." in token else "integer"), None
        if kind == "word" and token in ("true", "false"):
            self._next()
            return token, False, XSD + "boolean", None
        self._fail(self.at)

    def _literal(self) -> tuple[str, bool, str | None, str | None]:
        quotes = 3 if self.token[:3] in ('"""', "'''") and len(self.token) >= 6 else 1
        text = _unescaped(self.token[quotes:-quotes])
        self._next()
        if self.kind == "lang":
            lang = self.token[1:]
            self._next()
            return text, False, None, lang
        if self.token == "^^":
            self._next()
            return text, False, self._iri(), None
        return text, False, XSD + "string", None

    def _collection(self) -> str:
        self._next()
        items = []
        while self.token != ")":
            items.append(self._node())
        self._next()
        rest = RDF + "nil"
        for item in reversed(items):
            cell = self._blank()
            self.out += [(cell, RDF + "first", *item), (cell, RDF + "rest", rest, True, None, None)]
            rest = cell
        return rest


class RdfXml:
    """The statements of one RDF/XML text: a document, or descriptions alone as ``export.write`` puts them into a file."""

    _XML = "{http://www.w3.org/XML/1998/namespace}"

    def __init__(self, text: str, file: str = ""):
        bare = re.match(r"\s*(<\?xml|<!|<(\w+:)?RDF\b)", text) is None
        self.root = ElementTree.fromstring(f'<rdf:RDF xmlns:rdf="{RDF}">{text}</rdf:RDF>' if bare else text)
        self.file, self.blanks = f"{zlib.crc32(file.encode()):08x}", 0

    def statements(self) -> Iterator[Statement]:
        base = self.root.get(self._XML + "base", "")
        for node in self.root if self.root.tag == f"{{{RDF}}}RDF" else [self.root]:
            yield from self._description(node, self._name(node, base), base, None)

    def _name(self, node: ElementTree.Element, base: str) -> str:
        rdf = lambda name: node.get(f"{{{RDF}}}{name}")
        if rdf("about") is not None:
            return urljoin(base, rdf("about")) if base else rdf("about")
        if rdf("ID") is not None:
            return f"{base}#{rdf('ID')}"
        return self._blank(rdf("nodeID"))

    def _blank(self, label: str | None) -> str:
        if label is None:
            self.blanks += 1
        return f"_:f{self.file}-{label or f'.{self.blanks}'}"

    @staticmethod
    def _iri(tag: str) -> str:
        return "".join(tag[1:].split("}", 1))

    def _attributes(self, element: ElementTree.Element, subject: str, lang: str | None) -> Iterator[Statement]:
        for key, value in element.items():
            if key == f"{{{RDF}}}type":
                yield subject, RDF_TYPE, value, True, None, None
            elif key.startswith("{") and not key.startswith((self._XML, f"{{{RDF}}}")):
                yield subject, self._iri(key), value, False, None if lang else XSD + "string", lang

    def _description(self, node: ElementTree.Element, subject: str, base: str, lang: str | None) -> Iterator[Statement]:
        base, lang = node.get(self._XML + "base", base), node.get(self._XML + "lang", lang)
        if node.tag != f"{{{RDF}}}Description":
            yield subject, RDF_TYPE, self._iri(node.tag), True, None, None
        yield from self._attributes(node, subject, lang)
        items = 0
        for p in node:
            predicate = self._iri(p.tag)
            if predicate == RDF + "li":
                items += 1
                predicate = f"{RDF}_{items}"
            yield from self._property(p, subject, predicate, base, p.get(self._XML + "lang", lang))

    def _property(self, p: ElementTree.Element, subject: str, predicate: str, base: str, lang: str | None) -> Iterator[Statement]:
        resource, kind = p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}parseType")
        if kind not in (None, "Resource"):
            raise ValueError(f"rdf:parseType {kind!r} is not read")
        if kind == "Resource":
            inner = self._blank(None)
            yield subject, predicate, inner, True, None, None
            for q in p:
                yield from self._property(q, inner, self._iri(q.tag), base, lang)
        elif resource is not None or p.get(f"{{{RDF}}}nodeID") is not None:
            target = self._blank(p.get(f"{{{RDF}}}nodeID")) if resource is None else urljoin(base, resource) if base else resource
            yield subject, predicate, target, True, None, None
            yield from self._attributes(p, target, lang)
        elif len(p):
            for node in p:
                target = self._name(node, base)
                yield subject, predicate, target, True, None, None
                yield from self._description(node, target, base, lang)
        else:
            datatype = p.get(f"{{{RDF}}}datatype")
            yield subject, predicate, p.text or "", False, datatype or (None if lang else XSD + "string"), None if datatype else lang or None


def _read(spark: SparkSession, path: str, parser) -> DataFrame:
    """Whole files of ``path`` through ``parser``; 10,000 statements at a time."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(c, pa.bool_() if c == "is_iri" else pa.string()) for c in names])
        for b in batches:
            for file, text in zip(*(c.to_pylist() for c in b.columns)):
                rows: list[Statement] = []
                for s in parser(text, file).statements():
                    rows.append(s)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    names = ["subject", "predicate", "object", "is_iri", "datatype", "lang"]
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    found = files.mapInArrow(run, "subject string, predicate string, object string, is_iri boolean, datatype string, lang string")
    return found.withColumns({"source_table": F.lit(""), "kind": F.lit("data")}).select(*COLUMNS)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files. A file with an error fails the read."""
    return _read(spark, path, Turtle)


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    """Triples of RDF/XML files. XML literals and collections are errors, not skipped."""
    return _read(spark, path, RdfXml)
