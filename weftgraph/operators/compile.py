"""Tables to triples: one projection a table, no Python on the rows.

The triples of a table are the exploded array of its columns' (predicate, object, ...) structs, so a table is scanned once,
all in one stage of generated code, whatever its number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import terms

TRIPLE = "subject string, predicate string, object string, is_iri boolean, datatype string, lang string, source_table string, kind string"
COLUMNS = [c.split()[0] for c in TRIPLE.split(", ")]


@dataclass
class Table:
    """A table to compile. properties: predicate by column; links: target entity by column whose values are keys."""

    name: str
    df: DataFrame
    entity: str
    primary_key: str
    properties: dict[str, str] = field(default_factory=dict)
    links: dict[str, str] = field(default_factory=dict)


@dataclass
class Relationship:
    name: str
    from_table: str
    from_column: str
    to_table: str
    to_column: str
    predicate: str
    inverse_predicate: str | None = None
    cardinality: str = "many_to_one"
    required: bool = False
    declared_by: str = "unknown"
    ticket: str = ""
    description: str = ""


def predicate_of(table: Table, column: str, namespace: str) -> str:
    """Configured, else by the vocabulary, else the namespace's own name."""
    if column in table.properties:
        return terms.expand(table.properties[column])
    auto = terms.auto_property(column)
    return terms.expand(auto) if auto else f"{terms.base(namespace)}/{terms.sanitize(column)}"


def _triple(p: str, o: Column, is_iri: bool, datatype: str | None, kind: str) -> Column:
    return F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit(is_iri).alias("is_iri"), F.lit(datatype).cast("string").alias("datatype"), F.lit(kind).alias("kind"))


class Registry:
    """Declared relationships by name. A second declaration of a name is an error, so that none replaces another without a word."""

    def __init__(self, relationships: list[Relationship] = ()):
        self._by_name: dict[str, Relationship] = {}
        for r in relationships:
            self.declare(r)

    def declare(self, relationship: Relationship) -> Relationship:
        if relationship.name in self._by_name:
            raise ValueError(f"relationship {relationship.name} is declared twice")
        self._by_name[relationship.name] = relationship
        return relationship

    def get(self, name: str) -> Relationship:
        return self._by_name[name]

    def list(self, table: str | None = None) -> list[Relationship]:
        """All, or those that a table is an end of, as declared."""
        return [r for r in self._by_name.values() if table in (None, r.from_table, r.to_table)]

    def remove(self, name: str) -> Relationship:
        return self._by_name.pop(name)

    def to_dict(self) -> dict[str, dict]:
        return {name: dict(r.__dict__) for name, r in self._by_name.items()}


def _exploded(df: DataFrame, subject: Column, source: str, structs: Column) -> DataFrame:
    out = df.select(subject.alias("subject"), F.explode(structs).alias("t")).where("subject is not null and t.object is not null")
    return out.select("subject", "t.predicate", "t.object", "t.is_iri", "t.datatype", F.lit(None).cast("string").alias("lang"), F.lit(source).alias("source_table"), "t.kind")


def table_triples(table: Table, namespace: str, emit_pk_literal: bool = False, strategy: str = "namespace") -> DataFrame:
    """A triple for each row and column but the key; nulls give none; list items a triple each. Rows without a
    key give none. A column of another entity's keys gives edges."""
    plain, lists = [], []
    for f in table.df.schema.fields:
        if f.name == table.primary_key and not emit_pk_literal:
            continue
        col, p = F.col(f"`{f.name}`"), predicate_of(table, f.name, namespace)
        if f.name in table.links:
            # an edge is made from the value, by the same minter as the target's subjects
            plain.append(_triple(p, terms.minted(namespace, table.links[f.name], col, strategy), True, None, "data"))
        elif f.name != table.primary_key and terms.role(f.name, f.dataType, table.primary_key) == "foreign_key":
            target = terms.pascal(f.name.lower().removeprefix("fk_").removesuffix("_ref"))
            plain.append(_triple(p, terms.minted(namespace, target, col, strategy), True, None, "data"))
        elif isinstance(f.dataType, T.ArrayType):
            lists.append(_items(col, p, f.dataType))
        else:
            plain.append(_triple(p, terms.lexical(col, f.dataType), False, terms.xsd_of(f.dataType), "data"))
    parts = ([F.array(*plain)] if plain else []) + lists
    if not parts:
        return table.df.sparkSession.createDataFrame([], TRIPLE)
    subject = terms.minted(namespace, table.entity, F.col(f"`{table.primary_key}`"), strategy)
    return _exploded(table.df, subject, table.name, parts[0] if len(parts) == 1 else F.concat(*parts))


def _items(col: Column, p: str, kind: T.ArrayType) -> Column:
    return F.transform(F.coalesce(col, F.array().cast(kind)), lambda x: _triple(p, terms.lexical(x, kind.elementType), True, None, "data"))


def type_triples(table: Table, namespace: str, strategy: str = "namespace") -> DataFrame:
    """The class of each row's entity."""
    kind = f"{terms.base(namespace)}#{terms.safe(table.entity)}"
    subject = terms.minted(namespace, table.entity, F.col(f"`{table.primary_key}`"), strategy)
    return _exploded(table.df, subject, table.name, F.array(_triple(terms.RDF_TYPE, F.lit(kind), True, None, "type")))


def edge_triples(rel: Relationship, tables: dict[str, Table], namespace: str, strategy: str = "namespace") -> DataFrame:
    """The declared edge of each row with both keys, and its inverse. If the target column is not the target's
    key, the key is looked up by a join."""
    source, target = tables[rel.from_table], tables[rel.to_table]
    pairs = source.df.select(F.col(f"`{source.primary_key}`").alias("a"), F.col(f"`{rel.from_column}`").alias("b")).where("a is not null and b is not null")
    if rel.to_column != target.primary_key:
        keys = target.df.select(F.col(f"`{rel.to_column}`").alias("by"), F.col(f"`{target.primary_key}`").alias("key"))
        pairs = pairs.join(keys, F.col("b").cast("string") == F.col("by").cast("string")).select("a", F.col("key").alias("b"))
    pairs = pairs.select(terms.minted(namespace, source.entity, F.col("a"), strategy).alias("a"), terms.minted(namespace, target.entity, F.col("b"), strategy).alias("b"))
    ends = [F.struct(F.col("a").alias("s"), F.lit(terms.predicate_iri(rel.predicate, namespace)).alias("p"), F.col("b").alias("o"))]
    if rel.inverse_predicate:
        ends.append(F.struct(F.col("b").alias("s"), F.lit(terms.predicate_iri(rel.inverse_predicate, namespace)).alias("p"), F.col("a").alias("o")))
    out = pairs.select(F.explode(F.array(*ends)).alias("e")).where("e.s is not null and e.o is not null")
    none = F.lit(None).cast("string")
    return out.select(F.col("e.s").alias("subject"), F.col("e.p").alias("predicate"), F.col("e.o").alias("object"), F.lit(True).alias("is_iri"), none.alias("datatype"), none.alias("lang"), F.lit(source.name).alias("source_table"), F.lit("edge").alias("kind"))


def manual_triples(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Triples given one by one: subject, predicate, object, is_iri, datatype, lang."""
    return spark.createDataFrame([(r["subject"], r["predicate"], r["object"], bool(r.get("is_iri")), r.get("datatype"), r.get("lang"), r.get("source_table", ""), r.get("kind", "data")) for r in rows], TRIPLE)


def union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    """The bag of all triples."""
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], TRIPLE)


def graph(tables: list[Table], relationships: list[Relationship], namespace: str, spark: SparkSession, strategy: str = "namespace", emit_pk_literal: bool = False) -> DataFrame:
    """All data, type and edge triples, lazily, as a bag."""
    by_name = {t.name: t for t in tables}
    if strategy == "uuid4" and relationships:
        raise ValueError("random IRIs cannot be linked: choose another strategy or declare no relationships")
    parts = [part for t in tables for part in (table_triples(t, namespace, emit_pk_literal, strategy), type_triples(t, namespace, strategy))]
    return union(parts + [edge_triples(r, by_name, namespace, strategy) for r in relationships], spark)


def as_set(triples: DataFrame) -> DataFrame:
    """H2: the set of terms, as queries see them."""
    return triples.dropDuplicates(["subject", "predicate", "object", "is_iri", "datatype", "lang"])


def column_analysis(table: Table, namespace: str) -> list[dict]:
    """Role, types, automatic property, nulls and distinct values of every column, from one aggregation."""
    cols = table.df.schema.fields
    aggs = [x for i, f in enumerate(cols) for x in (F.count(F.col(f"`{f.name}`")).alias(f"n{i}"), F.count_distinct(F.col(f"`{f.name}`")).alias(f"d{i}"))]
    row = table.df.agg(F.count("*").alias("rows"), *aggs).first()
    return [
        {"column": f.name, "dtype": f.dataType.simpleString(), "xsd": terms.xsd_of(f.dataType), "role": terms.role(f.name, f.dataType, table.primary_key), "property": terms.auto_property(f.name), "nullable": row[f"n{i}"] < row["rows"], "n_unique": row[f"d{i}"] + (row[f"n{i}"] < row["rows"])}
        for i, f in enumerate(cols)
    ]


def detect_primary_key(df: DataFrame) -> str | None:
    """The first column with a key's name, no nulls and no repeated value; all candidates in one aggregation."""
    names = [c for c in df.columns if terms.role(c, T.StringType()) == "primary_key"]
    if not names:
        return None
    row = df.agg(F.count("*").alias("rows"), *(x for i, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}")))).first()
    return next((c for i, c in enumerate(names) if row[f"n{i}"] == row["rows"] == row[f"d{i}"]), None)


def infer_relationships(tables: dict[str, DataFrame], keys: dict[str, str | None]) -> list[dict]:
    """Foreign keys by name: x_id for a table x or xs scores 5, a partial match 2; the best wins."""
    out = []
    for name, df in tables.items():
        for c in df.columns:
            if c == keys.get(name) or not c.lower().endswith("_id"):
                continue
            stem, best = c.lower()[:-3], (0, "")
            for t in tables:
                low = t.lower()
                one = low.rstrip("s") if low.endswith("s") else low
                score = 5 if stem in (one, low) else 2 if stem in low or low in stem else 0
                best = max(best, (score, t), key=lambda x: x[0])
            if best[0]:
                out.append({"source_table": name, "source_column": c, "target_table": best[1], "target_column": keys.get(best[1]) or "id"})
    return out
