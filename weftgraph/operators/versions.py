"""Snapshots of a graph, their differences and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["subject", "predicate", "object"]


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct triples of ``new`` that ``old`` lacks, whatever their datatypes; swap the two for those removed."""
    return new.select(*_KEY).distinct().join(old.select(*_KEY), _KEY, "left_anti")


def modified(old: DataFrame, new: DataFrame) -> DataFrame:
    """(subject, predicate) that both have with different sets of objects. Sets are compared by their
    size, the sum of their members' hashes and their least member, so no set is gathered."""
    sets = lambda df, name: df.select(*_KEY).distinct().groupBy("subject", "predicate").agg(F.count("*").alias(f"n_{name}"), F.sum(F.xxhash64("object").cast("decimal(38,0)")).alias(f"h_{name}"), F.min("object").alias(f"m_{name}"))
    both = sets(old, "old").join(sets(new, "new"), ["subject", "predicate"])
    return both.where("n_old <> n_new or h_old <> h_new or m_old <> m_new").select("subject", "predicate")


def unchanged_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """The compatible measure of change: ordered pairs of different unchanged triples of one subject, as one number."""
    both = old.select(*_KEY).distinct().join(new.select(*_KEY), _KEY, "left_semi")
    return both.groupBy("subject").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).cast("long").alias("modified"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free checksum of their content."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))
