"""Entity resolution between two tables, and the sameAs links it gives."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from .compile import COLUMNS, Table

#: Entities of a side that a cell of ``same_as`` has, about: a set of values that more have is cut into blocks.
CELL_ROWS = 2048


def _values(t: Table, column: str, side: str) -> DataFrame:
    return t.df.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{t.primary_key}`").alias(f"{side}_key"), F.col(f"`{column}`").cast("string").alias(f"{side}_value"))


def exact(a: Table, b: Table, columns: list[tuple[str, str]]) -> DataFrame:
    """(column, value) that both sides have, once each."""
    out = None
    for x, y in columns:
        both = _values(a, x, "a").select(F.col("a_value").alias("value")).distinct().join(_values(b, y, "b").select(F.col("b_value").alias("value")).distinct(), "value")
        own = both.select(F.lit(x).alias("column"), "value")
        out = own if out is None else out.unionByName(own)
    return out


def phonetic(a: Table, b: Table, column: tuple[str, str], soundex: bool = False) -> DataFrame:
    """Pairs of distinct values with the same sound: lower case, or Soundex."""
    code = F.soundex if soundex else F.lower
    left = _values(a, column[0], "a").select("a_value").distinct().withColumn("sound", code(F.col("a_value")))
    right = _values(b, column[1], "b").select("b_value").distinct().withColumn("sound", code(F.col("b_value")))
    return left.join(right, "sound")


def _numbered(low: Column) -> Column:
    """The characters of a text, numbered, so that a multiset is a set: the second a is a2."""
    chars = F.split(low, "")
    # sorted, equal characters stand together: a character's number is its distance from the first of them
    ranked = F.array_sort(chars)
    return F.transform(ranked, lambda c, i: F.concat(c, (i - F.array_position(ranked, c).cast("int") + 2).cast("string")))


def fuzzy(a: Table, b: Table, column: tuple[str, str], threshold: float = 0.85) -> DataFrame:
    """Pairs of distinct values, lower-cased, whose similarity ratio (difflib) is at least ``threshold``, and the ratio.

    A pair at ratio r shares at least r * (n + m) / 2 characters as a multiset, so its lengths are within a factor of r / (2 - r), and of
    each text's characters all but ceil(least overlap) - 1 suffice to meet (a prefix filter): those that the fewest texts of both sides
    have, by counted frequency. A text meets others by its rarest characters together with a band of lengths; bands are wide enough that
    partners are in the same or the next one. Then the multisets' overlap, counted exactly, cuts what is compared. No cross join,
    and no pair is lost."""
    ratio_ = threshold / (2 - threshold)

    def side(t: Table, c: str, s: str) -> DataFrame:
        v = _values(t, c, s).select(f"{s}_value").distinct().withColumn(f"{s}_low", F.lower(f"{s}_value")).where(F.length(f"{s}_low") > 0)
        return v.withColumns({f"{s}_n": F.length(f"{s}_low"), f"{s}_chars": _numbered(F.col(f"{s}_low"))})

    left, right = side(a, column[0], "a"), side(b, column[1], "b")
    both = left.select(F.explode("a_chars").alias("token")).unionAll(right.select(F.explode("b_chars").alias("token")))
    often = both.groupBy("token").agg(F.count("*").alias("often"))  # as many rows as there are characters and repetitions

    def rarest(df: DataFrame, s: str) -> DataFrame:
        tokens = df.dropDuplicates([f"{s}_low"]).select(f"{s}_low", f"{s}_n", F.explode(f"{s}_chars").alias("token")).join(often, "token")
        kept = (F.col(f"{s}_n") - F.ceil(F.lit(ratio_) * F.col(f"{s}_n") - 1e-9) + 1).cast("int")
        own = tokens.groupBy(f"{s}_low", f"{s}_n").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "token"))), F.lit(1), F.first(kept)).alias("rare"))
        return own.select(f"{s}_low", f"{s}_n", F.explode("rare.token").alias("token"))

    # bands grow by the factor that partners' lengths may differ by
    band = lambda n: F.floor(F.log(n.cast("double")) / F.lit(-math.log(ratio_)) + 1e-9).cast("int") if ratio_ < 1 else n
    lp = rarest(left, "a").withColumn("band", band(F.col("a_n")))
    near = F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1) if ratio_ < 1 else F.array("at")
    rp = rarest(right, "b").withColumn("at", band(F.col("b_n"))).withColumn("band", F.explode(near)).drop("at")
    met = lp.join(rp, ["token", "band"]).where(F.least("a_n", "b_n") * 2 >= F.lit(threshold) * (F.col("a_n") + F.col("b_n"))).select("a_low", "b_low").distinct()
    pairs = met.join(left, "a_low").join(right, "b_low")
    pairs = pairs.where(F.size(F.array_intersect("a_chars", "b_chars")) * 2 >= F.lit(threshold) * (F.col("a_n") + F.col("b_n")) - 1e-9)

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype=float)

    return pairs.withColumn("ratio", F.pandas_udf(ratio, "double")("a_low", "b_low")).where(F.col("ratio") >= threshold).select("a_value", "b_value", "ratio")


def same_as(a: Table, b: Table, column: tuple[str, str], matches: DataFrame, namespace: str) -> DataFrame:
    """sameAs triples between the entities whose values matched (a_value, b_value), by their keys.

    There may be far more pairs than entities, so a pair is neither shuffled nor made twice: every entity stands once, with the set of
    its values, sets meet once, and what makes pairs is the last join. Sets of many entities are cut into blocks, and each pair of
    blocks is a cell of its own; so a task's work is bounded, also where a few values hold all rows."""

    def dealt(t: Table, c: str, s: str) -> tuple[DataFrame, DataFrame]:
        """(iri, set, block) of every entity, and (value, set, blocks) of every set and each of its values."""
        own = _values(t, c, s).groupBy(terms.minted(namespace, t.entity, F.col(f"{s}_key")).alias(f"{s}_iri")).agg(F.array_sort(F.collect_set(f"{s}_value")).alias(f"{s}_set"))
        sets = own.groupBy(f"{s}_set").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(f"{s}_blocks"))
        hot = F.broadcast(sets.where(f"{s}_blocks > 1"))  # fewer than one in CELL_ROWS entities
        block = F.pmod(F.xxhash64(f"{s}_iri"), F.coalesce(F.col(f"{s}_blocks"), F.lit(1))).cast("int").alias(f"{s}_block")
        return own.join(hot, f"{s}_set", "left").select(f"{s}_iri", f"{s}_set", block), sets.withColumn(f"{s}_value", F.explode(f"{s}_set"))

    (left, left_sets), (right, right_sets) = dealt(a, column[0], "a"), dealt(b, column[1], "b")
    met = left_sets.join(matches.select("a_value", "b_value").distinct(), "a_value").join(right_sets, "b_value").select("a_set", "a_blocks", "b_set", "b_blocks").distinct()
    cells = met.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1))).withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1))).drop("a_blocks", "b_blocks")
    cell = ["a_set", "a_block", "b_set", "b_block"]
    # a given number of partitions, as AQE would merge them by their bytes before the join, and these are few
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.join(cells, ["a_set", "a_block"]).repartition(n, *cell).join(right.join(cells, ["b_set", "b_block"]).repartition(n, *cell), cell)
    none = F.lit(None).cast("string")
    out = pairs.select(F.col("a_iri").alias("subject"), F.lit(terms.SAME_AS).alias("predicate"), F.col("b_iri").alias("object"), F.lit(True).alias("is_iri"), none.alias("datatype"), none.alias("lang"), F.lit(a.name).alias("source_table"), F.lit("sameas").alias("kind"))
    return out.select(*COLUMNS)
