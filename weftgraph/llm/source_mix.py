"""Mixing sources to target weights, to the word.

Each document gets a hash-random key. Documents are range-sorted by source and key, and distributed prefix sums of their sizes
(totals of the ranges, then sums within each range) say how many words of its source stand before each document. A source whose
target is k times its size and a rest r gives k whole epochs and, in the next one, the documents up to word r: the one
that holds word r gives the part up to it. So a source's words come to its target exactly, rounded down.

Targets: weights 1, 2, 3, 1, 2, 3, ... by the sources' order share the words of all sources; a target stops at CAP times its source,
and the excess is shared out again by weight until no target is above. Nothing is collected but a few totals; no task holds
a source, so a source may have any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, settle, table

CAP, WEIGHTS, SEED = 3, (1, 2, 3), "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column) -> Column:
    """60 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix_sums(df: DataFrame, value: str, order: list[Column], into: str) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over all rows before, in the total order ``order``. Rows are dealt to ranges; the
    ranges' totals (as many rows as there are partitions) are summed up first, then the rows within each range."""
    part = f"{into}_part"
    dealt = settle(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    upto = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(part).agg(F.sum(value).alias("own")).select(F.col(part).alias(f"{part}_of"), F.coalesce(F.sum("own").over(upto), F.lit(0)).alias(f"{part}_from"))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn(into, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(ranges, F.col(part) == F.col(f"{part}_of")).withColumn(into, F.col(into) + F.col(f"{part}_from")).drop(part, f"{part}_of", f"{part}_from")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``."""
    at, total = F.lit(False), sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = at
        held, weight, n = sources.agg(F.sum(F.when(capped, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.sum(capped.cast("int"))).first()
        if not weight or n == full:
            break
        # one more source at least stops at its cap in each round, or none does
        level, full = (total - held) / weight, n
        at = F.lit(level) * F.col("weight") > cap * F.col("source_size")
    return sources.withColumn("target", F.when(F.lit(level) * F.col("weight") > cap * F.col("source_size"), (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken.

    Null texts have size 0; documents of size 0 are taken with 0 words. Null sources are one source, the last. Repeated rows are
    rows of their own; which of two equal rows is cut makes no difference. An empty table gives none. Of ``docs`` only doc_id, text and
    source are read."""
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size")]
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _key(F.col("doc_id")).alias("key"), words(F.col("text")).alias("size")))
    ranked = prefix_sums(sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1)), "one", [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    found = targets(settle(ranked.withColumn("weight", weight).select("source", "weight", "source_size")))
    starts = prefix_sums(found, "source_size", [F.col("source").asc_nulls_last()], "start").select(F.col("source").alias("of"), "source_size", "target", "start")
    placed = prefix_sums(sized, "size", order, "before").join(starts, F.col("source").eqNullSafe(F.col("of")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor("target") - whole * F.col("source_size")
    last = F.least(F.greatest(rest - (F.col("before") - F.col("start")), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + last).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: taken / size, rounded. Rows that repeat a doc_id share
    evenly what is taken of them; texts without words are not taken."""
    plan = mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
    plan = plan.where("t > 0").select(F.col("doc_id").alias("mix_id"), F.round(F.col("t") / F.col("s")).cast("int").alias("mix_copies")).where("mix_copies > 0")
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = docs.alias("d").join(plan.alias("mix_plan"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("mix_plan.mix_id")))
    # a null text has no words; a repeated id may have one beside others
    return joined.where(words(F.col("d.text")) > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col("mix_plan.mix_copies"))).alias("mix_copy_number")).drop("mix_copy_number")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum({CAP} * source_size) OVER w - {CAP} * source_size AS held, sum(weight) OVER (ORDER BY {CAP} * source_size / weight DESC, source ROWS UNBOUNDED PRECEDING) AS open,
         sum(source_size) OVER () AS total
  FROM sources WINDOW w AS (ORDER BY {CAP} * source_size / weight, source DESC ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max(CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE)) AS l FROM ordered WHERE {CAP} * source_size >= weight * (CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE))),
aims AS (SELECT source, source_size, CASE WHEN coalesce(l, 0) * weight > {CAP} * source_size THEN CAST({CAP} * source_size AS DOUBLE) ELSE coalesce(l, 0) * weight END AS target FROM sources, level),
placed AS (SELECT s.doc_id, s.size, a.source_size, a.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM placed)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + least(greatest(CAST(floor(target) AS BIGINT) - whole * source_size - before, 0), size) AS BIGINT) AS taken
FROM epochs
"""
