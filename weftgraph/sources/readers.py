"""Reading tables: by format, by extension, or through a registered connector."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compile import COLUMNS

Connector = Callable[..., DataFrame]
_CONNECTORS: dict[str, Connector] = {}


def register(name: str, connector: Connector) -> None:
    """``connector(spark, source, **options)`` becomes a format of ``read_table``."""
    _CONNECTORS[name] = connector


def connectors() -> list[str]:
    return sorted(_CONNECTORS)


def _csv(spark, source, **options):
    return spark.read.options(**({"header": True, "inferSchema": True, "preferDate": True} | options)).csv(source)


for _name, _reader in {
    "parquet": lambda spark, source, **o: spark.read.options(**o).parquet(source),
    "csv": _csv,
    "tsv": lambda spark, source, **o: _csv(spark, source, **({"sep": "\t"} | o)),
    "json": lambda spark, source, **o: spark.read.options(**o).json(source, multiLine=True),
    "jsonl": lambda spark, source, **o: spark.read.options(**o).json(source),
    "orc": lambda spark, source, **o: spark.read.options(**o).orc(source),
    # these need their connector's jar on the class path
    "delta": lambda spark, source, version=None, **o: spark.read.format("delta").options(**o, **({} if version is None else {"versionAsOf": version})).load(source),
    "snowflake": lambda spark, source, **o: spark.read.format("snowflake").options(**o, **({"query": source} if " " in source else {"dbtable": source})).load(),
    "jdbc": lambda spark, source, **o: spark.read.format("jdbc").options(**o, **({"query": source} if " " in source else {"dbtable": source})).load(),
    "table": lambda spark, source, **o: spark.read.options(**o).table(source),
}.items():
    register(_name, _reader)

_EXTENSIONS = {"parquet": "parquet", "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "orc": "orc"}


def read_table(spark: SparkSession, source, format: str | None = None, **options) -> DataFrame:
    """A DataFrame as it is; a pandas frame or what has to_pandas (or toPandas); a path or any Hadoop URL. Files are split
    by Spark, so nothing is read in slices here."""
    if isinstance(source, DataFrame):
        return source
    if type(source).__module__.split(".")[0] == "pandas":
        return spark.createDataFrame(source)
    if hasattr(source, "to_pandas"):
        return spark.createDataFrame(source.to_pandas())
    if not isinstance(source, str) and not hasattr(source, "__fspath__"):
        raise TypeError(f"cannot read a {type(source).__name__}")
    source = str(source)
    format = format or _EXTENSIONS.get(source.rstrip("/").rpartition(".")[2].lower())
    if format not in _CONNECTORS:
        raise ValueError(f"no format {format!r} for {source}: {', '.join(connectors())}")
    return _CONNECTORS[format](spark, source, **options)


def looks_remote(source: str) -> bool:
    return bool(re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", source))


_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*$'


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Triples of an N-Triples file; one pattern a line. Comments and blank lines are skipped; any other line that is no triple
    is an error, or skipped, too, unless ``strict``."""
    fits, empty = F.rlike("value", F.lit(_LINE)), F.rlike("value", F.lit(r"^\s*(#.*)?$"))
    bad = F.raise_error(F.concat(F.lit("no triple: "), F.substring("value", 1, 200))).cast("boolean") if strict else F.lit(False)
    lines = spark.read.text(path).where(F.when(fits, True).when(empty, False).otherwise(bad))
    part = lambda i: F.regexp_extract("value", _LINE, i)
    iri = F.rlike("value", F.lit(r"^\s*<[^>]*>\s+<[^>]*>\s+<"))
    text = F.replace(part(4), F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    empty = lambda c: F.when(c != "", c)
    return lines.select(part(1).alias("subject"), part(2).alias("predicate"), F.when(iri, part(3)).otherwise(text).alias("object"), iri.alias("is_iri"), empty(part(5)).alias("datatype"), empty(part(6)).alias("lang"), F.lit("").alias("source_table"), F.lit("data").alias("kind")).select(*COLUMNS)
