"""Looking around in a graph: search, facts, neighbours, numbers, overlap and vectors. Every limit follows a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import PREFIXES, RDF_TYPE


def search(triples: DataFrame, text: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
    """the first ``limit`` subjects with the text (any case) in a term, each with its first such triple."""
    needle = F.lit(text.lower())
    hit = reduce(lambda x, y: x | y, (F.contains(F.lower(c), needle) for c in ("subject", "predicate", "object")))
    found = triples.where(hit)
    if entity_type:
        found = found.where(F.contains(F.lower("subject"), F.lit(entity_type.lower())))
    return found.groupBy("subject").agg(F.min(F.struct("predicate", "object")).alias("t")).orderBy("subject").limit(limit).select("subject", "t.predicate", "t.object")


def facts(triples: DataFrame, iri: str) -> DataFrame:
    """(predicate, objects) of a subject; objects sorted."""
    return triples.where(F.col("subject") == iri).groupBy("predicate").agg(F.array_sort(F.collect_list("object")).alias("objects"))


def neighbours(triples: DataFrame, iri: str, depth: int = 1, predicate: str | None = None, limit: int = 20) -> DataFrame:
    """Edges in and out up to ``depth`` hops, nearest first: (hop, direction, subject, predicate, object)."""
    edges = triples.where(F.col("is_iri") & (F.col("predicate") != RDF_TYPE)).select("subject", "predicate", "object")
    if predicate:
        edges = edges.where(F.contains("predicate", F.lit(predicate)))
    frontier, out = triples.sparkSession.createDataFrame([(iri,)], "node string"), None
    seen = frontier
    for hop in range(1, depth + 1):
        step = edges.join(frontier, F.col("subject") == F.col("node")).select(F.lit(hop).alias("hop"), F.lit("out").alias("direction"), "subject", "predicate", "object", F.col("object").alias("to"))
        step = step.unionByName(edges.join(frontier, F.col("object") == F.col("node")).select(F.lit(hop).alias("hop"), F.lit("in").alias("direction"), "subject", "predicate", "object", F.col("subject").alias("to")))
        out = step if out is None else out.unionByName(step)
        frontier = step.select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = seen.union(frontier)
    if out is None:
        raise ValueError("depth starts at 1")
    first = out.groupBy("direction", "subject", "predicate", "object").agg(F.min("hop").alias("hop"))
    return first.orderBy("hop", "direction", "subject", "predicate", "object").limit(limit).select("hop", "direction", "subject", "predicate", "object")


def lineage(triples: DataFrame) -> DataFrame:
    """triples about where things come from."""
    return triples.where(F.contains("predicate", F.lit("prov")) | F.contains("predicate", F.lit("derivedFrom")) | F.contains("predicate", F.lit("source")) | F.startswith("predicate", F.lit(PREFIXES["prov"])))


def numeric_properties(triples: DataFrame, subject_part: str | None = None, limit: int = 50) -> DataFrame:
    """predicates of literals that read as numbers (NaN does not)."""
    rows = triples.where(~F.col("is_iri") & F.col("object").try_cast("double").isNotNull() & ~F.isnan(F.col("object").try_cast("double")))
    if subject_part:
        rows = rows.where(F.contains("subject", F.lit(subject_part)))
    return rows.select("predicate").distinct().orderBy("predicate").limit(limit)


def token_overlap(triples: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """subjects by their best triple: a point for each query word in the subject and one for each in the object."""
    points = reduce(lambda x, y: x + y, (F.contains(F.lower(c), F.lit(w)).cast("int") for w in query.lower().split() for c in ("subject", "object")), F.lit(0))
    scored = triples.withColumn("score", points).where("score > 0")
    best = Window.partitionBy("subject").orderBy(F.desc("score"), "predicate", "object")
    return scored.withColumn("rank", F.row_number().over(best)).where("rank = 1").orderBy(F.desc("score"), "subject").limit(top_k).select("subject", "predicate", "object", "score")


def vector_top_k(vectors: DataFrame, key: str, vector: str, query: list[float], top_k: int = 10) -> DataFrame:
    """The rows with the largest cosine to ``query``, ties to smaller keys."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    size = F.sqrt(dot(v, v)) * F.lit(sum(float(x) * float(x) for x in query) ** 0.5)
    return vectors.select(key, F.try_divide(dot(v, q), size).alias("cosine")).where("cosine is not null").orderBy(F.desc("cosine"), key).limit(top_k)
