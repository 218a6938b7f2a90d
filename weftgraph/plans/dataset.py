"""What a query reads: a graph as named parts, so that a pattern touches only the parts that can answer it.

``TripleSet`` is any DataFrame of triples (a store's Parquet is partitioned by predicate, so constants prune partitions).
``TableGraph`` is the virtual graph of tables: a constant predicate is read from the source columns that make it, and a star of
constant predicates on one entity is a single projection of its table instead of a join for each predicate.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms
from ..operators import compile as C
from .sparql_parser import Term, Triple, Var

STRING = terms.XSD + "string"


def term(value: Column, is_iri: Column | bool, datatype: Column | str | None = None, lang: Column | str = "") -> Column:
    """A term as a struct without nulls inside, so that equal terms are equal structs; null without a value."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    is_iri, lang = lit(is_iri), F.coalesce(lit(lang), F.lit(""))
    kind = F.when(is_iri | (lang != ""), F.lit("")).otherwise(F.coalesce(lit(datatype).cast("string"), F.lit(STRING)))
    return F.when(value.isNotNull(), F.struct(value.alias("v"), is_iri.alias("i"), kind.alias("t"), lang.alias("l")))


def constant(t: Term) -> Column:
    return term(F.lit(t.value), t.is_iri, t.datatype or STRING, t.lang)


def matches(col: Column, t: Term) -> Column:
    """Is the term column the constant? On plain fields, so that filters can be pushed down."""
    if t.is_iri:
        return (col["v"] == t.value) & col["i"]
    return (col["v"] == t.value) & ~col["i"] & (col["t"] == ("" if t.lang else t.datatype or STRING)) & (col["l"] == t.lang)


class TripleSet:
    """Triples as (s, p, o): s and p strings, o a term."""

    def with_subject(self, iri: str) -> TripleSet:
        """The triples of a subject."""
        return TripleSet(self.source.where(F.col("subject") == iri))

    def __init__(self, triples: DataFrame, distinct: bool = True):
        self.spark = triples.sparkSession
        self.source = C.as_set(triples) if distinct else triples

    def scan(self, predicate: str | None) -> DataFrame:
        rows = self.source if predicate is None else self.source.where(F.col("predicate") == predicate)
        return rows.select(F.col("subject").alias("s"), F.col("predicate").alias("p"), term(F.col("object"), F.col("is_iri"), F.col("datatype"), F.col("lang")).alias("o"))

    def star(self, subject: Var, patterns: list[Triple]) -> tuple[DataFrame, list[Triple]] | None:
        return None

    def size(self, predicate: str | None) -> int:
        """A guess of how many triples a predicate has, to order joins by: none here."""
        return 1 if predicate else 100


class TableGraph(TripleSet):
    """The graph that ``compile.graph`` makes of tables, never built as a whole unless a pattern asks for every predicate.

    Tables in ``unique`` have a checked unique key; only they are read as stars, since a star takes one value of a predicate for
    each row."""

    def __init__(self, spark: SparkSession, tables: list[C.Table], relationships: list[C.Relationship], namespace: str, unique: set[str] | None = None, strategy: str = "namespace"):
        self.spark, self.tables, self.relationships, self.namespace, self.strategy = spark, {t.name: t for t in tables}, relationships, namespace, strategy
        self.unique = {t.name for t in tables} if unique is None else unique

    @cached_property
    def source(self) -> DataFrame:
        return C.as_set(C.graph(list(self.tables.values()), self.relationships, self.namespace, self.spark, self.strategy))

    def without_table(self, name: str) -> TableGraph:
        """The graph of the other tables, without the relationships that the table is an end of."""
        if name not in self.tables:
            raise KeyError(name)
        others = [t for t in self.tables.values() if t.name != name]
        kept = [r for r in self.relationships if name not in (r.from_table, r.to_table)]
        return TableGraph(self.spark, others, kept, self.namespace, self.unique - {name}, self.strategy)

    def with_subject(self, iri: str) -> TripleSet:
        """The part of the graph that can hold triples of this subject: a table whose entity it is, filtered by the key, and declared
        edges whose end it is, filtered by the column that makes it. Everything else is left out."""
        return self._part(iri, subjects_only=True)

    def around(self, iri: str) -> TripleSet:
        """The same with triples that have the IRI as their object."""
        return self._part(iri, subjects_only=False)

    def _part(self, iri: str, subjects_only: bool) -> TripleSet:
        parts: list[DataFrame] = []

        def rows_with(t: C.Table, column: str, entity: str) -> DataFrame | None:
            key = terms.key_of(iri, self.namespace, entity, t.df.schema[column].dataType, self.strategy)
            if key is None:
                return None
            if key is NotImplemented:
                return t.df.where(terms.minted(self.namespace, entity, F.col(f"`{column}`"), self.strategy) == iri)
            return t.df.where(F.col(f"`{column}`") == F.lit(key))

        def of(t: C.Table, df: DataFrame) -> C.Table:
            return C.Table(t.name, df, t.entity, t.primary_key, t.properties, t.links)

        for t in self.tables.values():
            own = rows_with(t, t.primary_key, t.entity)
            if own is not None:
                parts += [C.table_triples(of(t, own), self.namespace, strategy=self.strategy), C.type_triples(of(t, own), self.namespace, self.strategy)]
            for column, entity in () if subjects_only else t.links.items():
                pointing = rows_with(t, column, entity)
                if pointing is not None:
                    parts.append(C.table_triples(of(t, pointing.select(*dict.fromkeys([t.primary_key, column]))), self.namespace, strategy=self.strategy))
        for r in self.relationships:
            a, b = self.tables[r.from_table], self.tables[r.to_table]
            ends = [rows_with(a, a.primary_key, a.entity), rows_with(a, r.from_column, b.entity) if r.to_column == b.primary_key else (a.df if iri.startswith(f"{terms.base(self.namespace)}/{b.entity}/") else None)]
            for df in ends:
                if df is not None:
                    parts.append(C.edge_triples(r, self.tables | {a.name: of(a, df)}, self.namespace, self.strategy))
        found = C.union(parts, self.spark)
        hit = F.col("subject") == iri
        return TripleSet(found.where(hit if subjects_only else hit | (F.col("is_iri") & (F.col("object") == iri))))

    @cached_property
    def columns(self) -> dict[str, list[tuple[str, str]]]:
        """(table, column) pairs by the predicate that they make."""
        out: dict[str, list[tuple[str, str]]] = {}
        for t in self.tables.values():
            for c in t.df.columns:
                if c != t.primary_key:
                    out.setdefault(C.predicate_of(t, c, self.namespace), []).append((t.name, c))
        return out

    def _class(self, t: C.Table) -> str:
        return f"{terms.base(self.namespace)}#{terms.safe(t.entity)}"

    def _edges(self, predicate: str) -> list[tuple[C.Relationship, bool]]:
        iri = lambda p: p and terms.predicate_iri(p, self.namespace)
        return [(r, inverse) for r in self.relationships for inverse, p in ((False, r.predicate), (True, r.inverse_predicate)) if iri(p) == predicate]

    def _subject(self, t: C.Table) -> Column:
        return terms.minted(self.namespace, t.entity, F.col(f"`{t.primary_key}`"), self.strategy)

    def _value(self, t: C.Table, column: str) -> Column | None:
        """The term that a column makes; None for lists, which make many."""
        kind, col = t.df.schema[column].dataType, F.col(f"`{column}`")
        if column in t.links:
            return term(terms.minted(self.namespace, t.links[column], col, self.strategy), True)
        if isinstance(kind, T.ArrayType) or terms.role(column, kind, t.primary_key) == "foreign_key":
            return None
        return term(terms.lexical(col, kind), False, terms.xsd_of(kind))

    def scan(self, predicate: str | None) -> DataFrame:
        if predicate is None:
            return super().scan(None)
        parts, p = [], F.lit(predicate).alias("p")
        if predicate == terms.RDF_TYPE:
            parts += [t.df.where(F.col(f"`{t.primary_key}`").isNotNull()).select(self._subject(t).alias("s"), p, term(F.lit(self._class(t)), True).alias("o")) for t in self.tables.values()]
        for name, column in self.columns.get(predicate, []):
            t = self.tables[name]
            value = self._value(t, column)
            if value is None:
                slim = C.Table(t.name, t.df.select(*dict.fromkeys([t.primary_key, column])), t.entity, t.primary_key, t.properties, t.links)
                parts.append(TripleSet(C.table_triples(slim, self.namespace, strategy=self.strategy), distinct=False).scan(None))
            else:
                parts.append(t.df.where(F.col(f"`{column}`").isNotNull() & F.col(f"`{t.primary_key}`").isNotNull()).select(self._subject(t).alias("s"), p, value.alias("o")))
        for r, _ in self._edges(predicate):
            edges = C.edge_triples(r, self.tables, self.namespace, self.strategy)
            parts.append(TripleSet(edges.where(F.col("predicate") == predicate), distinct=False).scan(None))
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o struct<v: string, i: boolean, t: string, l: string>")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        single = len(parts) == 1 and self._one_each(predicate)
        return out if single else out.distinct()

    def _one_each(self, predicate: str) -> bool:
        """Does the only part have no repeated triple by the tables' unique keys?"""
        if columns := self.columns.get(predicate):
            return columns[0][0] in self.unique and not isinstance(self.tables[columns[0][0]].df.schema[columns[0][1]].dataType, T.ArrayType)
        if edges := self._edges(predicate):
            r = edges[0][0]
            return r.from_table in self.unique and r.to_column == self.tables[r.to_table].primary_key
        return all(n in self.unique for n in self.tables)

    def star(self, subject: Var, patterns: list[Triple]) -> tuple[DataFrame, list[Triple]] | None:
        """One projection of one table for as many of the patterns on ``subject`` as it makes alone; and the other patterns."""
        classes = [p.o.value for p in patterns if isinstance(p.p, Term) and p.p.value == terms.RDF_TYPE and isinstance(p.o, Term)]
        table = next((t for t in self.tables.values() if classes[:1] == [self._class(t)]), None)
        if table is None or table.name not in self.unique or sum(self._class(t) == classes[0] for t in self.tables.values()) > 1:
            return None
        known: list[tuple[Triple, Column]] = []
        rest: list[Triple] = []
        for p in patterns:
            value = None
            if isinstance(p.p, Term) and p.p.is_iri:
                if p.p.value == terms.RDF_TYPE:
                    value = term(F.lit(self._class(table)), True)
                else:
                    # subjects of this class come from this table only, so other tables' columns cannot answer
                    own = [c for t, c in self.columns.get(p.p.value, []) if t == table.name]
                    edges = self._edges(p.p.value)
                    if len(own) == 1 and not edges:
                        value = self._value(table, own[0])
                    elif not own and len(edges) == 1 and not edges[0][1] and edges[0][0].from_table == table.name:
                        r = edges[0][0]
                        target = self.tables[r.to_table]
                        if r.to_column == target.primary_key:
                            value = term(terms.minted(self.namespace, target.entity, F.col(f"`{r.from_column}`"), self.strategy), True)
            if value is None:
                rest.append(p)
            else:
                known.append((p, value))
        if len(known) < 2:
            return None
        subject_term = term(self._subject(table), True)
        out, bound = table.df.where(F.col(f"`{table.primary_key}`").isNotNull()), {subject.name: subject_term}
        keep = F.lit(True)
        for p, value in known:
            if isinstance(p.o, Term):
                keep = keep & matches(value, p.o)
            elif p.o.name in bound:
                keep = keep & (bound[p.o.name] == value)
            else:
                bound[p.o.name] = value
                keep = keep & value.isNotNull()
        return out.where(keep).select(*(c.alias(n) for n, c in bound.items())), rest
