"""Measures of a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.terms import RDF_TYPE, local_column, predicate_iri
from . import compile as C


def class_distribution(triples: DataFrame) -> DataFrame:
    """Entities by class (local name)."""
    return triples.where((F.col("predicate") == RDF_TYPE) & F.col("is_iri")).groupBy(local_column(F.col("object")).alias("class")).agg(F.count("*").alias("n"))


def property_distribution(triples: DataFrame) -> DataFrame:
    """A8."""
    return triples.groupBy("predicate").agg(F.count("*").alias("n"))


def predicate_counts(tables: list[C.Table], relationships: list[C.Relationship], namespace: str) -> DataFrame:
    """A8 without making a triple: a table's triples by predicate are its columns' counts of values (of items in lists), one narrow
    aggregation a table; declared edges are the rows with both ends, counted after the lookup where the target is found by another column."""
    spark, parts, by_name = tables[0].df.sparkSession, [], {t.name: t for t in tables}
    for t in tables:
        key, counts, made = F.col(f"`{t.primary_key}`").isNotNull(), {}, set(t.df.columns) - {t.primary_key}
        for c in (c for c in t.df.columns if c in made):
            value = F.coalesce(F.size(F.filter(f"`{c}`", lambda x: x.isNotNull())), F.lit(0)) if isinstance(t.df.schema[c].dataType, T.ArrayType) and c not in t.links else F.col(f"`{c}`").isNotNull().cast("int")
            counts.setdefault(C.predicate_of(t, c, namespace), []).append(F.coalesce(F.sum(F.when(key, value)), F.lit(0)))
        counts.setdefault(RDF_TYPE, []).append(F.count_if(key))
        for r in relationships:
            if r.from_table == t.name and r.to_column == by_name[r.to_table].primary_key:
                both = F.count_if(key & F.col(f"`{r.from_column}`").isNotNull())
                for p in filter(None, (r.predicate, r.inverse_predicate)):
                    counts.setdefault(predicate_iri(p, namespace), []).append(both)
        pairs = F.array(*(F.struct(F.lit(p).alias("predicate"), reduce(lambda x, y: x + y, n).cast("long").alias("n")) for p, n in counts.items()))
        parts.append(t.df.agg(pairs.alias("pairs")).select(F.explode("pairs").alias("e")).select("e.*"))
    for r in relationships:
        if r.to_column != by_name[r.to_table].primary_key:
            parts.append(C.edge_triples(r, by_name, namespace).groupBy("predicate").agg(F.count("*").alias("n")))
    return C.union(parts, spark).groupBy("predicate").agg(F.sum("n").alias("n")).where("n > 0")


def references(triples: DataFrame) -> DataFrame:
    """IRIs that triples other than types point to, once each."""
    return triples.where(F.col("is_iri") & (F.col("predicate") != RDF_TYPE)).select(F.col("object").alias("iri")).distinct()


def unreferenced(triples: DataFrame) -> DataFrame:
    """Subjects that nothing points to."""
    return triples.select(F.col("subject").alias("iri")).distinct().join(references(triples), "iri", "left_anti")


def broken(triples: DataFrame) -> DataFrame:
    """IRIs pointed to that are no subjects."""
    return references(triples).join(triples.select(F.col("subject").alias("iri")), "iri", "left_anti")


def profile(triples: DataFrame) -> DataFrame:
    """A4 to A6, one row: all nine measures, exactly.

    Terms are gathered once, each with whether it is a subject, an object, a reference; so distinct counts, unreferenced subjects
    and broken references need one shuffle of pre-aggregated terms instead of one for each."""
    is_type = F.col("predicate") == RDF_TYPE
    edge = F.col("is_iri") & ~is_type
    ends = F.explode(F.array(F.struct(F.col("subject").alias("term"), F.lit(True).alias("s"), F.lit(False).alias("o"), F.lit(False).alias("r")), F.struct(F.col("object").alias("term"), F.lit(False).alias("s"), F.lit(True).alias("o"), edge.alias("r"))))
    of_terms = triples.select(ends.alias("e")).groupBy("e.term").agg(*(F.max(f"e.{c}").alias(c) for c in "sor"))
    nodes = of_terms.agg(F.count_if("s").alias("unique_subjects"), F.count_if("o").alias("unique_objects"), F.count_if(F.col("s") & ~F.col("r")).alias("orphan_entities"), F.count_if(F.col("r") & ~F.col("s")).alias("broken_references"))
    kinds = triples.groupBy("predicate", "is_iri", F.when(is_type, F.col("object")).alias("class")).agg(F.count("*").alias("n"))
    counts = kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_triples"), F.count_distinct("predicate").alias("unique_predicates"), F.count_distinct("class").alias("entity_types"),
        F.coalesce(F.sum(F.when(edge, F.col("n"))), F.lit(0)).alias("relationship_edges"), F.count_distinct(F.when(~F.col("is_iri"), F.col("predicate"))).alias("literal_columns"),
    )
    return counts.crossJoin(nodes)  # one row each
