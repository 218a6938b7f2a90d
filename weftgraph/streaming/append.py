"""New rows of a growing table as triples. An extension: compiling is stateless, so no watermark is needed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import compile as C


def stream_triples(table: C.Table, namespace: str) -> DataFrame:
    """The triples of a streaming table (its df is a streaming DataFrame): data and types, by the batch operators."""
    return C.table_triples(table, namespace).unionByName(C.type_triples(table, namespace))


def append(table: C.Table, namespace: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts appending to Parquet; ``once`` takes what is there and ends. Each batch is written exactly once (a batch that is
    retried overwrites its own directory)."""

    def write(batch: DataFrame, number: int) -> None:
        stream_triples(replace(table, df=batch), namespace).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = table.df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
