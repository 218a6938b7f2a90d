"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the shared folder of ``spark.checkpoint.dir``. Where none is set, a local session (tests) gets a temporary one; on a
    cluster that is an error, since no folder of one machine would do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        chosen = spark.conf.get("spark.checkpoint.dir", None)
        if chosen is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(chosen or tempfile.mkdtemp(prefix="weftgraph-"))


#: A frame made while this is set gives the files of its shuffles back when its action ends (Spark 4.1; older versions ignore it).
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, release: bool = False) -> DataFrame:
    """Writes ``df`` once to the shared checkpoint folder and reads it from there: it is computed once,
    its lineage ends, and a lost executor costs only a re-read.

    release: nothing reads the shuffles that made it any more, so their files go at once, not when the driver's garbage is next collected."""
    ensure_checkpoint_dir(df.sparkSession)
    if not release:
        return df.checkpoint(eager=True)
    conf = df.sparkSession.conf
    before = conf.get(RELEASE, None)
    conf.set(RELEASE, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.unset(RELEASE) if before is None else conf.set(RELEASE, before)


#: A key is hot if it holds more than one in HOT_KEYS rows; so there are fewer hot keys than this, whatever the table's size.
HOT_KEYS = 10_000


def join_labels(rows: DataFrame, labels: DataFrame, key: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` with what ``labels`` says of their ``key`` (not null): one row for each key, and in ``n`` how many rows have it.

    Hot keys are broadcast, and their rows stay where they are; the others are shuffled, of which none then holds more than one in
    ``hot_keys`` rows. Both sides are read twice, so they should be settled."""
    total = labels.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > F.lit(total) / hot_keys
    hot, cold = F.broadcast(labels.where(is_hot).drop("n")), labels.where(~is_hot).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def utf8(text: Column) -> Column:
    """A text as its UTF-8 bytes; null becomes empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Only what an operator reads, whatever other columns there are: doc_id, the text's bytes, ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"), *more)


def batches_as_lists(batches: Iterable, *names: str, rows: int = 1000):
    """Arrow batches as tuples of Python lists of some rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)
