"""A hand-written parser for read-only SPARQL 1.1 queries.

What is not in the grammar is an error that names the word found, so updates, SERVICE and GRAPH cannot get through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.terms import PREFIXES, RDF_TYPE, XSD


class SparqlError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    value: str
    is_iri: bool = False
    datatype: str = XSD + "string"
    lang: str = ""


@dataclass(frozen=True)
class Path:
    """op: seq, alt, inv, plus, star, opt."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Call:
    """An operator or function; distinct: of an aggregate; sep: of GROUP_CONCAT."""

    name: str
    args: tuple
    distinct: bool = False
    sep: str = " "


@dataclass
class Triple:
    s: object
    p: object
    o: object


@dataclass
class Group:
    items: list = field(default_factory=list)


@dataclass
class Node:
    """kind: filter, optional, union, minus, bind, values, exists."""

    kind: str
    args: tuple


@dataclass
class Query:
    form: str
    where: Group
    select: list = field(default_factory=list)  # of Var or (expression, Var); empty: *
    distinct: bool = False
    group: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order: list = field(default_factory=list)  # of (expression, ascending)
    limit: int | None = None
    offset: int = 0
    template: list = field(default_factory=list)


_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<string>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<var>[?$]\w+)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w.-]*)?(?P<colon>:)(?P<local>(?:[\w%-]|\.(?=[\w%-])|\\[-_~.!$&'()*+,;=/?\#@%])*)
    |(?P<word>[A-Za-z_]\w*)|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/|^?+=<>!-])""",
    re.X | re.S,
)
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}
_FUNCTIONS = {"STR", "LCASE", "UCASE", "CONTAINS", "STRSTARTS", "STRENDS", "REGEX", "STRLEN", "SUBSTR", "REPLACE", "CONCAT", "BOUND", "COALESCE", "IF", "ISIRI", "ISURI", "ISLITERAL", "ISBLANK", "ISNUMERIC", "DATATYPE", "LANG", "ABS", "ROUND", "CEIL", "FLOOR", "YEAR", "MONTH", "DAY", "STRAFTER", "STRBEFORE", "IRI", "URI", "SAMETERM", "LANGMATCHES", "MD5", "SHA256"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        kind = "pname" if m["colon"] else m.lastgroup
        if kind != "space":
            out.append((kind, m.group()))
    return [*out, ("end", "the end")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at, self.anonymous, self.base = _tokens(text), 0, 0, ""
        self.prefixes = {p: PREFIXES[p] for p in ("rdf", "rdfs", "owl", "xsd", "schema")}

    # tokens
    def peek(self, ahead: int = 0) -> str:
        kind, text = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return text.upper() if kind == "word" else text

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def next(self) -> str:
        text = self.peek()
        self.at += 1
        return text

    def take(self, *texts: str) -> str | None:
        return self.next() if self.peek() in texts and self.kind() in ("word", "mark") else None

    def need(self, text: str) -> str:
        if not (found := self.take(text)):
            raise SparqlError(f"expected {text}, found {self.tokens[self.at][1]!r}")
        return found

    def fail(self, where: str):
        raise SparqlError(f"{self.tokens[self.at][1]!r} is not supported {where}")

    # queries
    def query(self) -> Query:
        while word := self.take("PREFIX", "BASE"):
            if word == "BASE":
                self.base = self.iri_ref()
            else:
                name = self.next()
                if not name.endswith(":"):
                    raise SparqlError(f"{name!r} is no prefix")
                self.prefixes[name[:-1]] = self.iri_ref()
        out = self.form()
        if self.kind() != "end":
            self.fail("after the query")
        return out

    def iri_ref(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "iri":
            self.fail("here: an IRI in <> is expected")
        self.at += 1
        return text[1:-1] if ":" in text or not self.base else self.base + text[1:-1]

    def form(self) -> Query:
        if self.take("SELECT"):
            return self.select()
        if self.take("ASK"):
            self.take("WHERE")
            return Query("ask", self.group())
        if self.take("CONSTRUCT"):
            template = Group()
            self.need("{")
            while not self.take("}"):
                self.triples(template)
            self.need("WHERE")
            return self.modifiers(Query("construct", self.group(), template=template.items))
        if self.take("DESCRIBE"):
            targets = []
            while self.kind() in ("var", "iri", "pname"):
                targets.append(self.term())
            where = self.group() if self.take("WHERE") or self.peek() == "{" else Group()
            return self.modifiers(Query("describe", where, select=targets))
        self.fail("as a query form (SELECT, ASK, CONSTRUCT and DESCRIBE are)")

    def select(self) -> Query:
        out = Query("select", Group(), distinct=bool(self.take("DISTINCT", "REDUCED")))
        if not self.take("*"):
            while True:
                if self.kind() == "var":
                    out.select.append(self.variable())
                elif self.take("("):
                    e = self.expression()
                    self.need("AS")
                    out.select.append((e, self.variable()))
                    self.need(")")
                else:
                    break
            if not out.select:
                self.fail("in SELECT")
        self.take("WHERE")
        out.where = self.group()
        return self.modifiers(out)

    def modifiers(self, q: Query) -> Query:
        if self.take("GROUP"):
            self.need("BY")
            while self.kind() == "var" or self.peek() == "(":
                if self.take("("):
                    e = self.expression()
                    q.group.append((e, self.variable()) if self.take("AS") else e)
                    self.need(")")
                else:
                    q.group.append(self.variable())
        if self.take("HAVING"):
            while self.peek() == "(":
                q.having.append(self.primary())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                if word := self.take("ASC", "DESC"):
                    q.order.append((self.primary(), word == "ASC"))
                elif self.kind() == "var" or self.peek() == "(" or self.peek() in _FUNCTIONS:
                    q.order.append((self.primary(), True))
                else:
                    break
        while word := self.take("LIMIT", "OFFSET"):
            n = self.next()
            if not n.isdigit():
                raise SparqlError(f"{word} needs a whole number, not {n!r}")
            if word == "LIMIT":
                q.limit = int(n)
            else:
                q.offset = int(n)
        return q

    # patterns
    def group(self) -> Group:
        self.need("{")
        out = Group()
        if self.peek() == "SELECT":
            self.next()
            out.items.append(self.select())
            self.need("}")
            return out
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                negated = bool(self.take("NOT"))
                if self.take("EXISTS"):
                    out.items.append(Node("exists", (self.group(), negated)))
                else:
                    out.items.append(Node("filter", (self.primary(),)))
            elif word := self.take("OPTIONAL", "MINUS"):
                out.items.append(Node(word.lower(), (self.group(),)))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.items.append(Node("bind", (e, self.variable())))
                self.need(")")
            elif self.take("VALUES"):
                out.items.append(self.values())
            elif self.peek() == "{":
                sides = [self.group()]
                while self.take("UNION"):
                    sides.append(self.group())
                out.items.append(Node("union", tuple(sides)) if len(sides) > 1 else sides[0])
            elif self.kind() in ("var", "iri", "pname", "string", "number") or self.peek() == "[":
                self.triples(out)
            else:
                self.fail("in a group")
        return out

    def values(self) -> Node:
        many = bool(self.take("("))
        names = []
        while self.kind() == "var":
            names.append(self.variable())
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
            row = tuple(None if self.take("UNDEF") else self.term() for _ in names)
            if many:
                self.need(")")
            rows.append(row)
        return Node("values", (tuple(names), tuple(rows)))

    def triples(self, out: Group) -> None:
        s = self.blank(out) if self.peek() == "[" else self.term()
        if self.peek() in (".", "}") and isinstance(s, Var) and s.name.startswith("_:"):
            self.take(".")
            return
        self.properties(s, out)
        self.take(".")

    def properties(self, s, out: Group) -> None:
        while True:
            p = self.variable() if self.kind() == "var" else self.path()
            while True:
                out.items.append(Triple(s, p, self.blank(out) if self.peek() == "[" else self.term()))
                if not self.take(","):
                    break
            more = False
            while self.take(";"):
                more = True
            if not more or self.peek() in (".", "}", "]"):
                return

    def blank(self, out: Group) -> Var:
        self.need("[")
        self.anonymous += 1
        v = Var(f"_:{self.anonymous}")
        if not self.take("]"):
            self.properties(v, out)
            self.need("]")
        return v

    def variable(self) -> Var:
        if self.kind() != "var":
            self.fail("here: a variable is expected")
        return Var(self.next()[1:])

    def path(self):
        sides = [self.sequence()]
        while self.take("|"):
            sides.append(self.sequence())
        return Path("alt", tuple(sides)) if len(sides) > 1 else sides[0]

    def sequence(self):
        steps = [self.step()]
        while self.take("/"):
            steps.append(self.step())
        return Path("seq", tuple(steps)) if len(steps) > 1 else steps[0]

    def step(self):
        if self.take("^"):
            return Path("inv", (self.step(),))
        if self.take("("):
            p = self.path()
            self.need(")")
        elif self.tokens[self.at] == ("word", "a"):
            self.next()
            p = Term(RDF_TYPE, True, "")
        else:
            p = self.term()
            if not p.is_iri:
                raise SparqlError(f"{p.value!r} is no predicate")
        if mark := self.take("*", "+", "?"):
            p = Path({"*": "star", "+": "plus", "?": "opt"}[mark], (p,))
        return p

    def term(self):
        kind, text = self.tokens[self.at]
        if kind == "var":
            return self.variable()
        if kind == "iri":
            return Term(self.iri_ref(), True, "")
        if kind == "pname":
            self.at += 1
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"prefix {prefix!r} is not declared")
            return Term(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), True, "")
        if kind == "string":
            self.at += 1
            cut = 3 if text[:3] in ('"""', "'''") else 1
            plain = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}
            value = re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else plain.get(m[1], m[1]), text[cut:-cut], flags=re.S)
            if self.kind() == "lang":
                return Term(value, False, "", self.next()[1:].lower())
            if self.take("^^"):
                return Term(value, False, self.term().value)
            return Term(value)
        sign = self.next() if self.peek() in ("-", "+") and self.tokens[self.at + 1][0] == "number" else ""
        if self.kind() == "number":
            n = self.next()
            return Term(sign + n if sign == "-" else n, False, XSD + ("double" if "e" in n.lower() else "decimal" if "." in n else "integer"))
        if word := self.take("TRUE", "FALSE"):
            return Term(word.lower(), False, XSD + "boolean")
        self.fail("as a term")

    # expressions
    def expression(self):
        left = self.conjunction()
        while self.take("||"):
            left = Call("||", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.relation()
        while self.take("&&"):
            left = Call("&&", (left, self.relation()))
        return left

    def relation(self):
        left = self.sum()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            return Call(op, (left, self.sum()))
        negated = self.peek() == "NOT" and self.peek(1) == "IN" and bool(self.next())
        if self.take("IN"):
            self.need("(")
            args = []
            while not self.take(")"):
                args.append(self.expression())
                self.take(",")
            found = Call("IN", (left, *args))
            return Call("!", (found,)) if negated else found
        return left

    def sum(self):
        left = self.product()
        while op := self.take("+", "-"):
            left = Call(op, (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while op := self.take("*", "/"):
            left = Call(op, (left, self.unary()))
        return left

    def unary(self):
        if self.take("!"):
            return Call("!", (self.unary(),))
        if self.peek() == "-" and self.tokens[self.at + 1][0] != "number" and self.next():
            return Call("-", (Term("0", False, XSD + "integer"), self.unary()))
        return self.primary()

    def primary(self):
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        negated = self.peek() == "NOT" and self.peek(1) == "EXISTS" and bool(self.next())
        if self.take("EXISTS"):
            found = Call("EXISTS", (self.group(),))
            return Call("!", (found,)) if negated else found
        word = self.peek()
        if self.kind() == "word" and word in _AGGREGATES:
            self.next()
            self.need("(")
            distinct = bool(self.take("DISTINCT"))
            args = () if self.take("*") else (self.expression(),)
            sep = " "
            if self.take(";"):
                if self.next() != "SEPARATOR":
                    self.fail("in GROUP_CONCAT")
                self.need("=")
                sep = self.term().value
            self.need(")")
            return Call(word, args, distinct, sep)
        if self.kind() == "word" and word in _FUNCTIONS:
            self.next()
            return Call(word, self.arguments())
        t = self.term()
        if isinstance(t, Term) and t.is_iri and self.peek() == "(":
            return Call(t.value, self.arguments())
        return t

    def arguments(self) -> tuple:
        self.need("(")
        args = []
        while not self.take(")"):
            args.append(self.expression())
            self.take(",")
        return tuple(args)


def parse(text: str) -> Query:
    if not text or not text.strip():
        raise SparqlError("the query is empty")
    return Parser(text).query()
