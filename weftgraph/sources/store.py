"""A graph in Parquet: the set of triples, one directory for each predicate, and snapshots of it."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compile as C
from ..operators import versions


def write(triples: DataFrame, path: str, partitions: int | None = None) -> None:
    """Dealt by predicate and subject, so that neither a common predicate makes one file nor each task opens all."""
    keyed = C.as_set(triples).withColumn("predicate_id", F.sha1("predicate"))
    dealt = keyed.repartition(*((partitions,) if partitions else ()), "predicate_id", F.pmod(F.xxhash64("subject"), F.lit(32)))
    dealt.sortWithinPartitions("predicate_id", "subject").write.mode("overwrite").partitionBy("predicate_id").parquet(path)


def read(spark: SparkSession, path: str, predicate: str | None = None) -> DataFrame:
    """The stored triples; of one predicate only its directory."""
    rows = spark.read.parquet(path)
    if predicate is not None:
        rows = rows.where(F.col("predicate_id") == F.sha1(F.lit(predicate).cast("binary")))
    return rows.select(*C.COLUMNS)


class Versions:
    """C20: snapshots by tag, and their history."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _history(self) -> DataFrame:
        return self.spark.read.json(f"{self.folder}/history")

    def snapshot(self, triples: DataFrame, tag: str, message: str = "") -> dict:
        """K12. The checksum does not depend on the order of triples."""
        path = f"{self.folder}/{tag}"
        triples.select(*C.COLUMNS).write.mode("errorifexists").parquet(path)
        mark = versions.fingerprint(self.spark.read.parquet(path)).first()
        entry = {"tag": tag, "message": message, "created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "triples": mark.rows, "checksum": f"{mark.xor & (2**64 - 1):016x}"}
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/history")
        return entry

    def list(self) -> list[dict]:
        return [r.asDict() for r in self._history().orderBy("created_at").collect()]

    def latest(self) -> dict | None:
        found = self._history().orderBy(F.desc("created_at")).limit(1).collect()
        return found[0].asDict() if found else None

    def checkout(self, tag: str) -> DataFrame:
        """KeyError without such a snapshot."""
        if not any(e["tag"] == tag for e in self.list()):
            raise KeyError(tag)
        return self.spark.read.parquet(f"{self.folder}/{tag}")

    def diff(self, old: str, new: str, samples: int = 10) -> dict:
        a, b = self.checkout(old), self.checkout(new)
        plus, minus, changed = versions.added(a, b), versions.added(b, a), versions.modified(a, b)
        show = lambda df: [" ".join(r) + " ." for r in df.orderBy(*df.columns).limit(samples).collect()]
        return {"added": plus.count(), "removed": minus.count(), "modified": changed.count(), "unchanged_pairs": versions.unchanged_pairs(a, b).first()[0], "added_samples": show(plus), "removed_samples": show(minus)}
