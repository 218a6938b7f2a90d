"""Data checks as one aggregation a table and one anti join a relationship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compile import Relationship, Table


def duplicates(key: Column) -> Column:
    """A2: rows less distinct keys; null counts as one key."""
    return F.count("*") - F.count_distinct(key) - F.max(key.isNull().cast("int"))


def profile(df: DataFrame) -> DataFrame:
    """A1: (column, rows, nulls, null_rate) of each column, in one pass."""
    names = df.columns
    one = df.agg(F.count("*").alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)))
    return one.select("rows", F.explode(pairs).alias("p")).select("p.column", "rows", (F.col("rows") - F.col("p.n")).alias("nulls"), F.coalesce(1 - F.try_divide(F.col("p.n"), F.col("rows")), F.lit(0.0)).alias("null_rate"))


def orphans(source: DataFrame, column: str, target: DataFrame, to_column: str) -> DataFrame:
    """Distinct foreign keys, as text, that the target does not have."""
    values = source.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").cast("string").alias("value")).distinct()
    return values.join(target.select(F.col(f"`{to_column}`").cast("string").alias("value")), "value", "left_anti")


def check_table(table: Table, required: list[str] = (), configured: list[str] = ()) -> dict:
    """C2 for one table: errors and warnings with a path and message each, and the column profile. All from one aggregation."""
    errors, warnings, df, at = [], [], table.df, f"tables.{table.name}"
    have = set(df.columns)
    for c in configured:
        if c not in have:
            warnings.append({"path": f"{at}.columns.{c}", "message": f"configured column {c} is absent"})
    required = [c for c in required if c in have]
    if table.primary_key not in have:
        errors.append({"path": f"{at}.primary_key", "message": f"primary key column {table.primary_key} is absent"})
        key = None
    else:
        key = F.col(f"`{table.primary_key}`")
    aggs = [F.count("*").alias("rows"), *(F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns))]
    row = df.agg(*aggs, *([duplicates(key).alias("dup")] if key is not None else [])).first()
    nulls = {c: row["rows"] - row[f"n{i}"] for i, c in enumerate(df.columns)}
    if key is not None:
        if nulls[table.primary_key]:
            errors.append({"path": f"{at}.primary_key", "message": f"{nulls[table.primary_key]} rows have no primary key"})
        if row["dup"]:
            errors.append({"path": f"{at}.primary_key", "message": f"{row['dup']} duplicate primary key values"})
    for c in required:
        if nulls[c]:
            errors.append({"path": f"{at}.columns.{c}", "message": f"required column has {nulls[c]} nulls"})
    for c, n in nulls.items():
        if row["rows"] and n == row["rows"]:
            errors.append({"path": f"{at}.columns.{c}", "message": "column is all null"})
        elif 2 * n > row["rows"]:
            warnings.append({"path": f"{at}.columns.{c}", "message": "more than half of the column is null"})
    columns = {c: {"null_count": n, "null_rate": n / row["rows"] if row["rows"] else 0.0} for c, n in nulls.items()}
    return {"errors": errors, "warnings": warnings, "profile": {"row_count": row["rows"], "column_count": len(have), "columns": columns}}


def check_relationship(rel: Relationship, tables: dict[str, Table]) -> list[dict]:
    """C2 for one relationship: absent tables and columns, a target that is not unique, nulls of a required key, orphans."""
    at, errors = f"relationships.{rel.name}", []
    fail = lambda message: errors.append({"path": at, "message": message, "owner": rel.declared_by, "ticket": rel.ticket})
    for t in (rel.from_table, rel.to_table):
        if t not in tables:
            fail(f"unknown table {t}")
    if errors:
        return errors
    source, target = tables[rel.from_table].df, tables[rel.to_table].df
    if rel.from_column not in source.columns:
        fail(f"unknown column {rel.from_table}.{rel.from_column}")
    if rel.to_column not in target.columns:
        fail(f"unknown column {rel.to_table}.{rel.to_column}")
    if errors:
        return errors
    if rel.cardinality in ("many_to_one", "one_to_one") and target.agg(duplicates(F.col(f"`{rel.to_column}`"))).first()[0]:
        fail(f"{rel.to_table}.{rel.to_column} is not unique")
    if rel.required and (n := source.where(F.col(f"`{rel.from_column}`").isNull()).count()):
        fail(f"required foreign key has {n} nulls")
    lost = orphans(source, rel.from_column, target, rel.to_column)
    sample = [r.value for r in lost.orderBy("value").limit(10).collect()]
    if sample:
        fail(f"{lost.count()} orphan values, among them {', '.join(sample)}")
    return errors


def check_triples(triples: DataFrame) -> DataFrame:
    """Empty subjects and predicates, and distinct subjects."""
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.trim(c) == ""))
    return triples.agg(F.count("*").alias("triples"), empty("subject").alias("empty_subjects"), empty("predicate").alias("empty_predicates"), F.count_distinct("subject").alias("subjects"))
