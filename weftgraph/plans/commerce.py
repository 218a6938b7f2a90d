"""The commerce tables as a graph: what the registered queries ask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.compile import Relationship, Table
from .dataset import TableGraph

NAMESPACE = "https://data.example/commerce"

#: name: (entity, key, properties, links)
TABLES = {
    "region": ("Region", "r_regionkey", {"r_name": "schema:name"}, {}),
    "nation": ("Nation", "n_nationkey", {"n_name": "schema:name"}, {"n_regionkey": "Region"}),
    "customer": ("Customer", "c_custkey", {"c_mktsegment": f"{NAMESPACE}#segment", "c_acctbal": f"{NAMESPACE}#balance", "c_name": "schema:name"}, {"c_nationkey": "Nation"}),
    "supplier": ("Supplier", "s_suppkey", {"s_name": "schema:name"}, {"s_nationkey": "Nation"}),
    "part": ("Part", "p_partkey", {"p_brand": f"{NAMESPACE}#brand", "p_retailprice": "schema:price"}, {}),
    "orders": ("Order", "o_orderkey", {"o_totalprice": f"{NAMESPACE}#totalAmount", "o_orderpriority": f"{NAMESPACE}#priority"}, {"o_custkey": "Customer"}),
}
RELATIONSHIPS = [
    Relationship("in_region", "nation", "n_regionkey", "region", "r_regionkey", "ex:inRegion", "ex:hasNation"),
    Relationship("in_nation", "customer", "c_nationkey", "nation", "n_nationkey", "ex:inNation"),
    Relationship("based_in", "supplier", "s_nationkey", "nation", "n_nationkey", "ex:basedIn"),
    Relationship("placed_by", "orders", "o_custkey", "customer", "c_custkey", "ex:placedBy", "ex:placedOrder"),
]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> Table:
    entity, key, properties, links = TABLES[name]
    return Table(name, source(spark, sf_dir, name), entity, key, properties, links)


def graph(spark: SparkSession, sf_dir: str, *names: str) -> TableGraph:
    """The whole graph, or data and types of some tables without declared edges."""
    return TableGraph(spark, [table(spark, sf_dir, n) for n in names or TABLES], [] if names else RELATIONSHIPS, NAMESPACE)
