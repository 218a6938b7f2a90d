"""SPARQL algebra as DataFrame operators.

A solution is a row with a column for each variable, a term struct or null (unbound). Basic graph patterns become equi-joins on
shared variables, ordered by the number of constants and always connected where the query is; stars over tables become one
projection (see ``dataset``). Optional is a left join, minus and exists are anti and semi joins, filters are column expressions
whose errors count as false. Closures of property paths are rounds of joins with the rows new in the last round.
"""

from __future__ import annotations

from dataclasses import fields, is_dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import XSD
from . import shared
from .dataset import STRING, TripleSet, constant, matches, term
from .sparql_parser import Call, Group, Node, Path, Query, SparqlError, Term, Triple, Var, parse

MAX_ROUNDS = 200
_NUMERIC = [XSD + n for n in ("integer", "int", "long", "short", "byte", "decimal", "double", "float", "unsignedByte", "unsignedShort", "unsignedInt", "unsignedLong", "nonNegativeInteger", "positiveInteger")]
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


class Solutions:
    """Rows, and which variables may be unbound in them."""

    def __init__(self, df: DataFrame, maybe: set[str] = frozenset()):
        self.df, self.maybe = df, set(maybe)

    @property
    def names(self) -> list[str]:
        return self.df.columns


def _unit(spark: SparkSession) -> DataFrame:
    return spark.range(1).select()


class Value:
    """An expression's value in its forms; null where it has none (an error or an unbound variable)."""

    def __init__(self, text: Column | None = None, number: Column | None = None, truth: Column | None = None, of: Column | None = None, constant: bool = False):
        self.of, self.constant = of, constant
        if of is not None:
            text, numeric = of["v"], of["t"].isin(_NUMERIC)
            number = F.when(numeric, text.try_cast("double"))
            truth = F.when(of["t"] == XSD + "boolean", F.lower(text).isin("true", "1")).when(numeric, text.try_cast("double") != 0).when(~of["i"], text != "")
        self.is_number, self.is_truth = number is not None and of is None, truth is not None and of is None
        self.text = text if text is not None else _plain(number) if number is not None else truth.cast("string")
        self.number = number
        self.truth = truth if truth is not None else number != 0 if number is not None else self.text != ""

    def as_term(self) -> Column:
        if self.of is not None:
            return self.of
        kind = "double" if self.is_number else "boolean" if self.is_truth else "string"
        if self.is_number:
            whole = (self.number == F.floor(self.number)) & (F.abs(self.number) < 1e15)
            return F.when(whole, term(self.text, False, XSD + "integer")).otherwise(term(self.text, False, XSD + "double"))
        return term(self.text, False, XSD + kind)


def _plain(number: Column) -> Column:
    """Whole numbers without a point."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


def _number(v: Value) -> Column:
    """For comparisons: a plain text that reads as a number counts as one, as many sources have no types; never NaN."""
    n = v.number if v.number is not None and v.of is None else v.text.try_cast("double")
    return F.when(~F.isnan(n), n)


def evaluate(e, names: set[str]) -> Value:
    if isinstance(e, Var):
        return Value(of=F.col(f"`{e.name}`")) if e.name in names else Value(text=F.lit(None).cast("string"), of=None)
    if isinstance(e, Term):
        if e.datatype in _NUMERIC:
            return Value(number=F.lit(float(e.value)), constant=True)
        if e.datatype == XSD + "boolean":
            return Value(truth=F.lit(e.value == "true"), constant=True)
        return Value(of=constant(e), constant=True)
    go = lambda i: evaluate(e.args[i], names)
    name = e.name
    if name in ("||", "&&"):
        a, b = go(0).truth, go(1).truth
        return Value(truth=a | b if name == "||" else a & b)
    if name == "!":
        return Value(truth=~go(0).truth)
    if name in ("=", "!=", "<", ">", "<=", ">="):
        found = _compared(go(0), go(1), "=" if name == "!=" else name)
        return Value(truth=~found if name == "!=" else found)
    if name == "IN":
        first = go(0)
        return Value(truth=reduce(lambda x, y: x | y, (_compared(first, evaluate(a, names), "=") for a in e.args[1:]), F.lit(False)))
    if name in ("+", "-", "*", "/"):
        a, b = _number(go(0)), _number(go(1))
        return Value(number={"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b)}[name]())
    if name == "BOUND":
        return Value(truth=F.col(f"`{e.args[0].name}`").isNotNull() if e.args[0].name in names else F.lit(False))
    if name == "COALESCE":
        return Value(of=F.coalesce(*(evaluate(a, names).as_term() for a in e.args)))
    if name == "IF":
        return Value(of=F.when(go(0).truth, go(1).as_term()).when(~go(0).truth, go(2).as_term()))
    if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
        iri = go(0).as_term()["i"]
        return Value(truth=F.lit(False) & iri if name == "ISBLANK" else ~iri if name == "ISLITERAL" else iri)
    if name == "ISNUMERIC":
        return Value(truth=go(0).as_term()["t"].isin(_NUMERIC))
    if name == "DATATYPE":
        return Value(of=term(F.nullif(go(0).as_term()["t"], F.lit("")), True))
    if name == "LANG":
        return Value(text=go(0).as_term()["l"])
    if name == "SAMETERM":
        return Value(truth=go(0).as_term() == go(1).as_term())
    if name in ("IRI", "URI"):
        return Value(of=term(go(0).text, True))
    if name.startswith(XSD):
        return _cast(go(0), name[len(XSD) :])
    texts = [evaluate(a, names).text for a in e.args]
    t = texts[0] if texts else None
    if name == "STR":
        return Value(text=t)
    if name in ("LCASE", "UCASE", "MD5"):
        return Value(text={"LCASE": F.lower, "UCASE": F.upper, "MD5": F.md5}[name](t))
    if name == "SHA256":
        return Value(text=F.sha2(t.cast("binary"), 256))
    if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
        return Value(truth={"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](t, texts[1]))
    if name in ("REGEX", "REPLACE"):
        flags = F.lit("") if len(texts) <= 2 + (name == "REPLACE") else F.concat(F.lit("(?"), texts[-1], F.lit(")"))
        pattern = F.concat(flags, texts[1])
        return Value(truth=F.rlike(t, pattern)) if name == "REGEX" else Value(text=F.regexp_replace(t, pattern, texts[2]))
    if name == "STRLEN":
        return Value(number=F.length(t).cast("double"))
    if name == "SUBSTR":
        start = _number(go(1)).cast("int")
        return Value(text=F.substring(t, start, _number(go(2)).cast("int") if len(texts) > 2 else F.length(t)))
    if name == "CONCAT":
        return Value(text=F.concat(*texts))
    if name in ("STRAFTER", "STRBEFORE"):
        at = F.position(texts[1], t)
        return Value(text=F.when(at == 0, "").otherwise(F.substring(t, at + F.length(texts[1]), F.length(t)) if name == "STRAFTER" else F.substring(t, F.lit(1), at - 1)))
    if name == "LANGMATCHES":
        return Value(truth=(F.lower(t) == F.lower(texts[1])) | ((texts[1] == "*") & (t != "")) | F.startswith(F.lower(t), F.concat(F.lower(texts[1]), F.lit("-"))))
    if name in ("ABS", "ROUND", "CEIL", "FLOOR"):
        n = _number(go(0))
        return Value(number={"ABS": F.abs, "ROUND": lambda x: F.floor(x + 0.5), "CEIL": F.ceil, "FLOOR": F.floor}[name](n).cast("double"))
    if name in ("YEAR", "MONTH", "DAY"):
        return Value(number={"YEAR": F.year, "MONTH": F.month, "DAY": F.day}[name](t.try_cast("timestamp")).cast("double"))
    if name in _AGGREGATES:
        raise SparqlError(f"{name} stands outside SELECT, HAVING and ORDER BY of a grouped query")
    raise SparqlError(f"function {name} is not supported")


def _cast(v: Value, kind: str) -> Value:
    if kind in ("decimal", "double", "float", "integer", "int", "long"):
        n = F.when(~F.isnan(v.text.try_cast("double")), v.text.try_cast("double"))
        return Value(number=F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n)).cast("double") if kind in ("integer", "int", "long") else n)
    if kind == "boolean":
        return Value(truth=v.text.try_cast("boolean"))
    if kind == "string":
        return Value(text=v.text)
    return Value(of=term(v.text, False, XSD + kind))


def _compared(a: Value, b: Value, op: str) -> Column:
    pick = {"=": lambda x, y: x == y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if a.is_number or b.is_number:
        return pick(_number(a), _number(b))
    if a.is_truth or b.is_truth:
        return pick(a.truth, b.truth)
    texts = pick(a.text, b.text)
    if a.of is None or b.of is None:
        return texts
    numbers = a.of["t"].isin(_NUMERIC) & b.of["t"].isin(_NUMERIC)
    if op == "=":
        # equal terms, or equal numbers; a plain constant also equals its text in any datatype
        loose = (a.of["i"] == b.of["i"]) & texts if a.constant or b.constant else a.of == b.of
        return F.when(numbers, pick(a.number, b.number)).otherwise(loose)
    return F.when(numbers, pick(a.number, b.number)).otherwise(texts)


def _true(e, names) -> Column:
    return F.coalesce(evaluate(e, set(names)).truth, F.lit(False))


class Compiler:
    def __init__(self, data: TripleSet):
        self.data, self.spark = data, data.spark

    # groups
    def group(self, g: Group) -> Solutions:
        out: Solutions | None = None
        filters, pending = [], []

        def settle(out):
            nonlocal pending
            if pending:
                out = self.join(out, self.bgp(pending)) if out else self.bgp(pending)
                pending = []
            return out

        for item in g.items:
            if isinstance(item, Triple):
                pending.append(item)
                continue
            if isinstance(item, Node) and item.kind in ("filter", "exists"):
                filters.append(item)
                continue
            out = settle(out)
            if isinstance(item, Group):
                out = self.join(out, self.group(item))
            elif isinstance(item, Query):
                out = self.join(out, self.select(item))
            elif item.kind == "optional":
                out = self.optional(out or Solutions(_unit(self.spark)), item.args[0])
            elif item.kind == "union":
                out = self.join(out, reduce(self.union, map(self.group, item.args)))
            elif item.kind == "minus":
                out = self.minus(out, self.group(item.args[0]))
            elif item.kind == "bind":
                e, v = item.args
                base = out or Solutions(_unit(self.spark))
                flagged, e = self.flagged(base, e)
                bound = flagged.df.withColumn(v.name, evaluate(e, set(flagged.names)).as_term())
                out = Solutions(bound.select(*(f"`{n}`" for n in base.names if n != v.name), f"`{v.name}`"), base.maybe | {v.name})
            elif item.kind == "values":
                out = self.join(out, self.values(*item.args))
        out = settle(out) or Solutions(_unit(self.spark))
        for f in filters:
            if f.kind == "filter":
                flagged, e = self.flagged(out, f.args[0])
                out = Solutions(flagged.df.where(_true(e, flagged.names)).select(*(f"`{n}`" for n in out.names)), out.maybe)
            else:
                out = self.exists(out, *f.args)
        return out

    def values(self, names, rows) -> Solutions:
        kind = "struct<v: string, i: boolean, t: string, l: string>"
        data = [tuple(None if t is None else (t.value, t.is_iri, "" if t.is_iri or t.lang else t.datatype, t.lang) for t in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{v.name}` {kind}" for v in names))
        return Solutions(df, {v.name for i, v in enumerate(names) if any(r[i] is None for r in rows)})

    def join(self, a: Solutions | None, b: Solutions, how: str = "inner", on=None) -> Solutions:
        """On compatible values of the shared variables; where one may be unbound, the other's value counts."""
        if a is None:
            return b
        shared = [n for n in a.names if n in b.names]
        if not shared:
            return Solutions(a.df.crossJoin(b.df) if how == "inner" else a.df.join(b.df, F.lit(True), how), a.maybe | b.maybe | (set(b.names) if how == "left" else set()))
        right = b.df.select(*(F.col(f"`{n}`").alias(f"{n}\x00r" if n in shared else n) for n in b.names))
        loose = [n for n in shared if n in a.maybe or n in b.maybe]
        cond = F.lit(True)
        for n in shared:
            l, r = F.col(f"`{n}`"), F.col(f"`{n}\x00r`")
            cond = cond & ((l == r) | l.isNull() | r.isNull() if n in loose else l == r)
        out = a.df.join(right, cond, how)
        for n in loose:
            out = out.withColumn(n, F.coalesce(F.col(f"`{n}`"), F.col(f"`{n}\x00r`")))
        own = set(b.names) - set(a.names)
        return Solutions(out.drop(*(f"{n}\x00r" for n in shared)), (a.maybe & (b.maybe | set(a.names) - set(b.names))) | (b.maybe - set(a.names)) | (a.maybe & set(shared) if how == "left" else set()) | (own if how == "left" else set()))

    def optional(self, a: Solutions, g: Group) -> Solutions:
        """A filter directly in the optional group sees the variables outside, so it is part of the join's condition."""
        inner = self.own_filters(a, g)
        b = self.group(Group([i for i in g.items if i not in inner]))
        outside = {n for f in inner for n in _variables(f.args[0])} & set(a.names) - set(b.names)
        if not outside:
            return self.join(a, Solutions(reduce(lambda df, f: df.where(_true(f.args[0], df.columns)), inner, b.df), b.maybe), "left")
        key = "\x00row"
        numbered = a.df.withColumn(key, F.struct(F.monotonically_increasing_id(), F.spark_partition_id()))
        matched = self.join(Solutions(numbered, a.maybe), b)
        matched = Solutions(reduce(lambda df, f: df.where(_true(f.args[0], df.columns)), inner, matched.df), matched.maybe)
        alone = numbered.join(matched.df.select(key), key, "left_anti")
        return Solutions(matched.df.unionByName(alone, allowMissingColumns=True).drop(key), a.maybe | b.maybe | set(b.names) - set(a.names))

    def union(self, a: Solutions, b: Solutions) -> Solutions:
        return Solutions(a.df.unionByName(b.df, allowMissingColumns=True), a.maybe | b.maybe | set(a.names) ^ set(b.names))

    def minus(self, a: Solutions | None, b: Solutions) -> Solutions:
        shared = [n for n in (a.names if a else []) if n in b.names]
        if not shared:
            return a or Solutions(_unit(self.spark))
        right = b.df.select(*(F.col(f"`{n}`").alias(f"{n}\x00r") for n in shared)).distinct()
        cond, overlap = F.lit(True), F.lit(False)
        for n in shared:
            l, r = F.col(f"`{n}`"), F.col(f"`{n}\x00r`")
            cond = cond & ((l == r) | l.isNull() | r.isNull() if n in a.maybe | b.maybe else l == r)
            overlap = overlap | (l.isNotNull() & r.isNotNull())
        if set(shared) <= a.maybe | b.maybe:
            cond = cond & overlap
        return Solutions(a.df.join(right, cond, "left_anti"), a.maybe)

    def exists(self, a: Solutions, g: Group, negated: bool) -> Solutions:
        inner = self.own_filters(a, g)
        b = self.group(Group([i for i in g.items if i not in inner]))
        shared = [n for n in a.names if n in b.names]
        right = b.df.select(*(F.col(f"`{n}`").alias(f"{n}\x00r" if n in shared else n) for n in b.names))
        cond = F.lit(True)
        for n in shared:
            l, r = F.col(f"`{n}`"), F.col(f"`{n}\x00r`")
            cond = cond & ((l == r) | l.isNull() | r.isNull() if n in a.maybe | b.maybe else l == r)
        for f in inner:
            cond = cond & _true(f.args[0], {*a.names, *b.names})
        return Solutions(a.df.join(right, cond, "left_anti" if negated else "left_semi"), a.maybe)

    def flagged(self, a: Solutions, e) -> tuple[Solutions, object]:
        """For each EXISTS within an expression a column that says whether it holds, and the expression with that column's name in its
        place. It is asked once for each combination of the variables that the pattern shares, and joined by them."""
        if not isinstance(e, Call):
            return a, e
        if e.name != "EXISTS":
            args = []
            for x in e.args:
                a, x = self.flagged(a, x)
                args.append(x)
            return a, replace(e, args=tuple(args))
        flag, keys = f"\x00exists{len(a.names)}", sorted(_mentioned(e.args[0]) & set(a.names))
        asked = a.df.select(*(f"`{n}`" for n in keys)).distinct() if keys else _unit(self.spark)
        held = self.exists(Solutions(asked, a.maybe & set(keys)), e.args[0], False).df.select(*(F.col(f"`{n}`").alias(f"{n}\x00r") for n in keys), F.lit(True).alias("\x00held"))
        same = reduce(lambda c, n: c & F.col(f"`{n}`").eqNullSafe(F.col(f"`{n}\x00r`")), keys, F.lit(True))
        truth = term(F.coalesce(F.col("`\x00held`"), F.lit(False)).cast("string"), False, XSD + "boolean").alias(flag)
        return Solutions(a.df.join(held, same, "left").select(*(f"`{n}`" for n in a.names), truth), a.maybe), Var(flag)

    def own_filters(self, a: Solutions, g: Group) -> list[Node]:
        """The filters of a group that see the variables outside. One with an EXISTS within is left to the group, which must bind what it names."""
        filters = [i for i in g.items if isinstance(i, Node) and i.kind == "filter"]
        nested = [f for f in filters if any(c.name == "EXISTS" for c in _calls(f.args[0]))]
        bound = _mentioned([i for i in g.items if i not in filters])
        if any(_mentioned(f) & set(a.names) - bound for f in nested):
            raise SparqlError("an EXISTS within an inner group's expression cannot name variables of the outer group alone")
        return [f for f in filters if f not in nested]

    # patterns
    def bgp(self, patterns: list[Triple]) -> Solutions:
        parts: list[Solutions] = []
        rest = list(patterns)
        for s in dict.fromkeys(p.s for p in patterns if isinstance(p.s, Var)):
            own = [p for p in rest if p.s == s]
            if found := self.data.star(s, own):
                df, left = found
                parts.append(Solutions(df))
                rest = [p for p in rest if p.s != s] + left
        weight = lambda p: (sum(isinstance(x, Var) for x in (p.s, p.o)), self.data.size(p.p.value) if isinstance(p.p, Term) else 1000)
        waiting = parts + [self.pattern(p) for p in sorted(rest, key=weight)]
        out = waiting.pop(0)
        while waiting:
            at = next((i for i, w in enumerate(waiting) if set(w.names) & set(out.names)), 0)
            out = self.join(out, waiting.pop(at))
        return out

    def pattern(self, p: Triple) -> Solutions:
        if isinstance(p.p, Var):
            one = isinstance(p.s, Term) and p.s.is_iri
            rows, known = (self.data.with_subject(p.s.value) if one else self.data).scan(None), [(p.p, term(F.col("p"), True))]
        elif isinstance(p.p, Path) and p.p.op in ("plus", "star") and (isinstance(p.s, Term) or isinstance(p.o, Term)):
            rows, known = self.reachable(p.p, p.s, p.o), []
        else:
            rows, known = self.path(p.p), []
        iri = term(F.col("s"), True) if dict(rows.dtypes)["s"] == "string" else F.col("s")
        known += [(p.s, iri), (p.o, F.col("o"))]
        bound, keep = {}, F.lit(True)
        for x, value in known:
            if isinstance(x, Term):
                keep = keep & ((F.col("s") == x.value) if x is p.s and dict(rows.dtypes)["s"] == "string" and x.is_iri else matches(value, x))
            elif x.name in bound:
                keep = keep & (bound[x.name] == value)
            else:
                bound[x.name] = value
        return Solutions(rows.where(keep).select(*(c.alias(n) for n, c in bound.items())))

    def reachable(self, p: Path, s, o) -> DataFrame:
        """(s, o) of a closure with a constant end: only what that end reaches is followed, never all pairs. A path of
        no steps leads from the constant to itself, whether or not the graph knows it."""
        forward = isinstance(s, Term)
        start = s if forward else o
        edges = self.path(p.args[0]).select(self._as_term("s", p.args[0]), "o").distinct()
        edges = edges if forward else edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
        out = closure(edges, edges.where(matches(F.col("s"), start)))
        if p.op == "star":
            out = out.union(self.spark.range(1).select(constant(start).alias("s"), constant(start).alias("o"))).distinct()
        return out if forward else out.select(F.col("o").alias("s"), F.col("s").alias("o"))

    def path(self, p) -> DataFrame:
        """(s, o) of a path; s a string for a plain predicate, a term for all else."""
        if isinstance(p, Term):
            return self.data.scan(p.value).select("s", "o")
        step = lambda x: self.path(x).select(self._as_term("s", x), "o")
        if p.op == "inv":
            return step(p.args[0]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if p.op == "alt":
            return reduce(DataFrame.unionByName, map(step, p.args))
        if p.op == "seq":
            out = step(p.args[0])
            for x in p.args[1:]:
                out = out.select("s", F.col("o").alias("mid")).join(step(x).select(F.col("s").alias("mid"), "o"), "mid").select("s", "o")
            return out
        edges = step(p.args[0]).distinct()
        nodes = edges.select(F.col("s").alias("n")).union(edges.select("o")).distinct().select(F.col("n").alias("s"), F.col("n").alias("o"))
        if p.op == "opt":
            return edges.union(nodes).distinct()
        return closure(edges).union(nodes).distinct() if p.op == "star" else closure(edges)

    def _as_term(self, name: str, p) -> Column:
        return term(F.col(name), True).alias(name) if isinstance(p, Term) else F.col(name)

    # query forms
    def select(self, q: Query) -> Solutions:
        found = self.group(q.where)
        aggregated = q.group or any(isinstance(s, tuple) and _has_aggregate(s[0]) for s in q.select) or q.having
        if aggregated:
            found = self.aggregate(q, found)
            names = [s.name if isinstance(s, Var) else s[1].name for s in q.select]
            out = found
        else:
            out = found
            for s in q.select:
                if isinstance(s, tuple):
                    out = Solutions(out.df.withColumn(s[1].name, evaluate(s[0], set(out.names)).as_term()), out.maybe | {s[1].name})
            names = [s.name if isinstance(s, Var) else s[1].name for s in q.select] or [n for n in out.names if not n.startswith("_:")]
        df, null = out.df, F.lit(None).cast("struct<v: string, i: boolean, t: string, l: string>")
        chosen = [(F.col(f"`{n}`") if n in df.columns else null).alias(n) for n in names]
        order = [x for e, up in q.order for x in _order_keys(evaluate(e, set(df.columns)), up)]
        keys = [f"\x00o{i}" for i in range(len(order))]
        df = df.select(*chosen, *(c.alias(k) for k, (c, _) in zip(keys, order)))
        sort = [F.col(f"`{k}`").asc_nulls_first() if up else F.col(f"`{k}`").desc_nulls_last() for k, (_, up) in zip(keys, order)]
        if q.distinct:
            df = df.dropDuplicates(names)
        if sort:
            # ties by the terms themselves, so that limits give the same rows each time
            df = df.orderBy(*sort, *(F.col(f"`{n}`") for n in names))
        df = df.drop(*keys)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, {n for n in names if n in out.maybe or n not in out.names})

    def aggregate(self, q: Query, found: Solutions) -> Solutions:
        df, keys = found.df, []
        for g in q.group:
            if isinstance(g, Var):
                keys.append(g.name)
            else:
                e, name = (g[0], g[1].name) if isinstance(g, tuple) else (g, f"\x00g{len(keys)}")
                df = df.withColumn(name, evaluate(e, set(df.columns)).as_term())
                keys.append(name)
        aggs: dict[Call, tuple[str, Column, str]] = {}
        exprs = [s[0] for s in q.select if isinstance(s, tuple)] + q.having + [e for e, _ in q.order]
        for call in dict.fromkeys(c for e in exprs for c in _calls(e) if c.name in _AGGREGATES):
            aggs[call] = (f"\x00a{len(aggs)}", *_aggregate(call, set(df.columns)))
        grouped = df.groupBy(*(F.col(f"`{k}`") for k in keys))
        out = grouped.agg(*(c.alias(n) for n, c, _ in aggs.values())) if aggs else grouped.agg(F.count("*").alias("\x00n")).drop("\x00n")
        for n, _, kind in aggs.values():
            if kind != "term":
                out = out.withColumn(n, Value(number=F.col(f"`{n}`").cast("double")).as_term() if kind == "number" else term(F.col(f"`{n}`"), False, STRING))
        swap = lambda e: Var(aggs[e][0]) if e in aggs else Call(e.name, tuple(map(swap, e.args)), e.distinct, e.sep) if isinstance(e, Call) else e
        for s in q.select:
            if isinstance(s, tuple):
                out = out.withColumn(s[1].name, evaluate(swap(s[0]), set(out.columns)).as_term())
        for h in q.having:
            out = out.where(_true(swap(h), out.columns))
        q.order = [(swap(e), up) for e, up in q.order]
        return Solutions(out, set(out.columns))


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """One or more steps along (s, o), from ``seeds`` among the edges or from all: rounds that extend only the pairs new in the
    round before, until there are none. Every round is settled in the shared folder, so that lineage stays short; cycles end since known pairs are not new."""
    settle = _settler(edges.sparkSession)
    seen = fresh = settle((edges if seeds is None else seeds).distinct())
    for _ in range(MAX_ROUNDS):
        longer = fresh.select("s", F.col("o").alias("mid")).join(edges.select(F.col("s").alias("mid"), "o"), "mid").select("s", "o").distinct()
        fresh = settle(longer.join(seen, ["s", "o"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = settle(seen.unionByName(fresh))
    raise SparqlError(f"a path is longer than {MAX_ROUNDS} steps")


def _settler(spark: SparkSession):
    shared.folder(spark)
    return lambda df: df.checkpoint(eager=True)


def _mentioned(x) -> set[str]:
    """All variables that stand anywhere in a part of a query."""
    if isinstance(x, Var):
        return {x.name}
    parts = x if isinstance(x, list | tuple) else [getattr(x, f.name) for f in fields(x)] if is_dataclass(x) else ()
    return {n for p in parts for n in _mentioned(p)}


def _variables(e) -> set[str]:
    return {e.name} if isinstance(e, Var) else {n for a in e.args for n in _variables(a)} if isinstance(e, Call) else set()


def _calls(e):
    if isinstance(e, Call):
        yield e
        if e.name not in _AGGREGATES:
            for a in e.args:
                yield from _calls(a)


def _has_aggregate(e) -> bool:
    return any(c.name in _AGGREGATES for c in _calls(e))


def _order_keys(v: Value, up: bool) -> list[tuple[Column, bool]]:
    """Numbers by value and before texts, then texts."""
    n = v.number if v.number is not None else F.lit(None).cast("double")
    return [(n, up), (v.text, up)]


def _aggregate(call: Call, names: set[str]) -> tuple[Column, str]:
    """The aggregate column, and what it holds: a number, text or a term."""
    if call.name == "COUNT":
        if not call.args:
            return F.count("*"), "number"
        value = evaluate(call.args[0], names).as_term()
        return F.count_distinct(value) if call.distinct else F.count(value), "number"
    v = evaluate(call.args[0], names)
    n = _number(v)
    if call.name in ("SUM", "AVG"):
        f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda x: F.sum_distinct(x) / F.count_distinct(x)}[call.name, call.distinct]
        return F.coalesce(f(n), F.lit(0.0)), "number"
    if call.name in ("MIN", "MAX", "SAMPLE"):
        pick = F.max if call.name == "MAX" else F.min  # a sample is the least, so that reruns agree
        keyed = F.when(v.text.isNotNull(), F.struct(v.number if v.number is not None else F.lit(None).cast("double"), v.text, v.as_term().alias("term")))
        return pick(keyed)["term"], "term"
    parts = F.collect_set(v.text) if call.distinct else F.collect_list(v.text)
    return F.array_join(F.array_sort(parts), call.sep), "text"  # sorted, so that reruns agree


def rows(found: DataFrame) -> DataFrame:
    """Solutions as strings: the value of each term, null if unbound."""
    return found.select(*(F.col(f"`{n}`")["v"].alias(n) for n in found.columns))


def run(data: TripleSet, text: str | Query, default_limit: int | None = None) -> DataFrame:
    """A query's answer as strings: a column for each variable; ``result`` (boolean) of ASK; subject, predicate, object (and
    is_iri, datatype, lang) of CONSTRUCT and DESCRIBE, as a set."""
    q = parse(text) if isinstance(text, str) else text
    c = Compiler(data)
    if q.form == "select":
        if q.limit is None and default_limit is not None:
            q.limit = default_limit
        return rows(c.select(q).df)
    if q.form == "ask":
        return c.group(q.where).df.limit(1).agg((F.count("*") > 0).alias("result"))
    if q.form == "construct":
        found = c.group(q.where).df
        parts = []
        for t in q.template:
            at = [constant(x) if isinstance(x, Term) else F.col(f"`{x.name}`") if x.name in found.columns else F.lit(None).cast("struct<v: string, i: boolean, t: string, l: string>") for x in (t.s, t.p, t.o)]
            parts.append(found.select(*(x.alias(n) for x, n in zip(at, "spo"))).where("s is not null and p is not null and o is not null and s.i and p.i"))
        made = reduce(DataFrame.unionByName, parts)
    else:
        found = c.group(q.where).df if q.where.items else None
        named = [x for x in q.select if isinstance(x, Term)]
        wanted = [found.select(F.col(f"`{x.name}`")["v"].alias("s")) for x in q.select if isinstance(x, Var) and found is not None and x.name in found.columns]
        if named:
            wanted.append(data.spark.createDataFrame([(x.value,) for x in named], "s string"))
        if not wanted:
            raise SparqlError("DESCRIBE names nothing")
        made = data.scan(None).join(reduce(DataFrame.union, wanted).distinct(), "s", "left_semi").select(term(F.col("s"), True).alias("s"), term(F.col("p"), True).alias("p"), "o")
    out = made.distinct().select(F.col("s.v").alias("subject"), F.col("p.v").alias("predicate"), F.col("o.v").alias("object"), F.col("o.i").alias("is_iri"), F.col("o.t").alias("datatype"), F.col("o.l").alias("lang"))
    limit = q.limit if q.limit is not None else default_limit
    return out if limit is None else out.orderBy(*out.columns).limit(limit)
