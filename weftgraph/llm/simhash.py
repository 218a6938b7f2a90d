"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two halves of 32 bits. Of two fingerprints at 3 or fewer differing bits, one half
differs in at most one bit. Over 31 bits of a half the codewords of the perfect Hamming code [31, 26] are the anchors:
every point lies within the covering radius 1 of exactly one anchor (its home), so two points that differ in one bit
both lie within radius plus threshold, 2, of either home. A fingerprint goes to its home and to those anchors within
distance 2 whose number is larger than its home's (about 8 of them), and a linked pair meets at the larger of its homes.

Equal fingerprints are one node, whatever the number of documents. A hot anchor is cut into a grid of cells of bounded
size. A cell compares its members in numpy and emits a spanning forest of its links, not all of its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import batches_as_lists, join_labels, settle, table, text_rows

#: Members of a cell: an anchor with more is cut into a grid.
CELL_ROWS = 1024


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, unsigned; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z only; blank and U+0009 to U+000D
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id long, fp long: the fingerprint's bits) of every row; whole texts, in Arrow batches."""

    def run(batches):
        for ids, texts in batches_as_lists(batches, "doc_id", "text"):
            fps = np.fromiter((fingerprint(t, size, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return text_rows(docs).mapInArrow(run, "doc_id long, fp long")


def _syndrome(x: Column) -> Column:
    """Of 31 bits in a Hamming code: 0 for a codeword, else the number (from 1) of the bit to flip."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    s = F.lit(0)
    for k, m in enumerate(masks):
        s = s + (F.bit_count(x.bitwiseAND(F.lit(m).cast("long"))) % 2) * (1 << k)
    return s.cast("int")


def anchors(fps: DataFrame) -> DataFrame:
    """(anchor long, fp long): each distinct fingerprint at its home and its visited anchors, for both halves."""
    flip = "shiftleft(1L, p - 1)"
    both = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    x = F.expr("shiftrightunsigned(fp, 32 * half) & 2147483647L")
    home = both.withColumn("x", x).withColumn("s", _syndrome(F.col("x"))).withColumn("home", F.expr("if(s = 0, x, x ^ shiftleft(1L, s - 1))"))
    visits = F.expr(f"filter(transform(filter(sequence(1, 31), p -> s <> 0 and p < (p ^ s) and (p ^ s) <> 0), p -> x ^ {flip} ^ shiftleft(1L, (p ^ s) - 1)), a -> a > home)")
    at = F.explode(F.concat(F.array("home"), visits)).alias("at")
    return home.select("half", "fp", at).select(F.expr("shiftleft(cast(half as bigint), 31) | at").alias("anchor"), "fp")


def _forest(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among a cell's fingerprints: each linked one with the first of its class."""
    linked = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= threshold
    label, n = np.arange(len(fp)), len(fp)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = label != np.arange(n)
    return fp[other], fp[label[other]]


def _cell_links(cell: np.ndarray, fp: np.ndarray, threshold: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal ``cell``: pairs of the small runs all at once, offset by offset, the others' forests."""
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    length = np.diff(np.r_[start, len(cell)])
    a, b = [], []
    few = np.repeat(length <= small, length)
    c, f = cell[few], fp[few]
    for step in range(1, small):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(f[same] ^ f[same + step]) <= threshold]
        a.append(f[near])
        b.append(f[near + step])
    for s, n in zip(start[length > small], length[length > small]):
        x, y = _forest(np.unique(fp[s : s + n]), threshold)
        a.append(x)
        b.append(y)
    return np.concatenate(a or [fp[:0]]), np.concatenate(b or [fp[:0]])


def links(fps: DataFrame, threshold: int = 3, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a long, b long) over distinct fingerprints ``fps``: links whose components are those of all pairs at
    ``threshold`` (at most 3) or fewer differing bits."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves of covering radius 1 prove thresholds of 0 to 3 only")
    at = anchors(fps)
    hot = settle(at.groupBy("anchor").count().where(F.col("count") > cell_rows).select("anchor", F.ceil(F.col("count") * 2 / cell_rows).cast("int").alias("parts")))
    if hot.isEmpty():
        cells = at.select(F.col("anchor").alias("cell"), "fp")
    else:
        own = F.expr("pmod(xxhash64(fp), parts)")
        grid = at.join(hot, "anchor", "left").withColumn("own", own).withColumn("other", F.expr("explode(if(parts is null, array(0), sequence(0, parts - 1)))"))
        cells = grid.select(F.expr("if(parts is null, anchor, xxhash64(anchor, least(own, other), greatest(own, other)))").alias("cell"), "fp")

    def run(batches):
        rest = (np.empty(0, np.int64), np.empty(0, np.uint64))
        for b in batches:
            cell = np.concatenate([rest[0], b.column(0).to_numpy()])
            fp = np.concatenate([rest[1], b.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last run may go on
            rest = cell[cut:], fp[cut:]
            yield _as_batch(*_cell_links(cell[:cut], fp[:cut], threshold))
        if len(rest[0]):
            yield _as_batch(*_cell_links(*rest, threshold))

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _as_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def near_duplicates(docs: DataFrame, threshold: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp long, component_id (the smallest doc_id reachable over links at
    ``threshold`` or fewer differing bits, itself included) and component_fp (a fingerprint that stands for the component).

    Null and empty texts and texts without words have fingerprint 0 and link like any other. A null doc_id takes part;
    it is nobody's component_id unless all of a component's ids are null (then null). Repeated rows give repeated
    rows. An empty table gives none. Columns other than doc_id and text are ignored."""
    own = settle(fingerprints(docs, size, seed))
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    label = connected_components(links(nodes.select("fp"), threshold))
    linked = settle(nodes.join(label, nodes.fp == label.node).select("fp", "component", "least_id"))
    of_component = settle(linked.groupBy("component").agg(F.min("least_id").alias("component_least"), F.count("*").alias("n")))
    merged = join_labels(linked, of_component, "component").select(F.col("fp").alias("merged_fp"), "component_least", "component")
    component_id = F.when(F.col("merged_fp").isNotNull(), F.col("component_least")).otherwise(F.col("least_id")).alias("component_id")
    least = nodes.join(merged, F.col("fp") == F.col("merged_fp"), "left").select("fp", component_id, F.coalesce("component", "fp").alias("component_fp"), "n")
    return join_labels(own, settle(least), "fp").select("doc_id", "fp", "component_id", "component_fp")


def representatives(docs: DataFrame, threshold: int = 3, size: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, with its columns, that stay if one row of each component stays: the one with the smallest doc_id
    (null is the largest) and, of several with this id, the one with the least fingerprint; of equal ones any.

    Rows are told by doc_id, so no text is shuffled but those whose id stays; where an id is null or repeats, by id
    and fingerprint, and only those rows are brought together to drop all but one."""
    found = settle(near_duplicates(docs, threshold, size, seed))
    last = F.lit(2**63 - 1)
    stays = found.groupBy("component_fp").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("i"), F.col("doc_id").alias("simhash_id"), F.col("fp").alias("simhash_of"))).alias("s")).select("s.*")
    unique = found.where("doc_id is not null").groupBy("doc_id").count().where("count = 1").select("doc_id")
    once = stays.join(unique, F.col("simhash_id") == F.col("doc_id"), "left_semi").select("simhash_id")
    more = settle(stays.join(unique, F.col("simhash_id") == F.col("doc_id"), "left_anti").select("simhash_id", "simhash_of"))
    key = F.col("doc_id").cast("long")
    single = docs.join(once, key == F.col("simhash_id"), "left_semi")
    if more.isEmpty():
        return single
    again = docs.join(more.select("simhash_id").distinct(), key.eqNullSafe(F.col("simhash_id")), "left_semi")
    kept = _with_fingerprint(again, size, seed).join(more, key.eqNullSafe(F.col("simhash_id")) & (F.col("simhash_fp") == F.col("simhash_of")), "left_semi")
    return single.unionByName(kept.dropDuplicates(["doc_id", "simhash_fp"]).drop("simhash_fp"))


def _with_fingerprint(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """``docs`` and its fingerprints, simhash_fp."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint((t or "").encode(), size, seed) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    return docs.withColumn("simhash_fp", fp(F.col("text")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
