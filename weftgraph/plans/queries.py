"""Registered graph queries, each with the SQL that DuckDB runs on the same tables. Inventory identifiers stand in brackets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import compile as C
from ..operators import explore, mask, profile, resolve, validate, versions
from ..sources import export, rdf, readers, store
from . import build, commerce, config, meta, nl, policy, shared, sparql
from .commerce import NAMESPACE as NS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PREFIX = f"PREFIX ex: <{NS}#>\n"
S, X, R = terms.PREFIXES["schema"], terms.XSD, terms.RDF_TYPE


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def ask(name: str, text: str, sql: str | None) -> None:
    """A query in SPARQL over the commerce graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sparql.run(commerce.graph(spark, sf_dir), PREFIX + text)

    run.__name__, run.__doc__ = name, text
    query(sql)(run)


def triples(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Data and type triples of tables, without declared edges."""
    own = [commerce.table(spark, sf_dir, n) for n in names]
    return C.graph(own, [], NS, spark)


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.graph([commerce.table(spark, sf_dir, n) for n in commerce.TABLES], commerce.RELATIONSHIPS, NS, spark)


# --- SQL of the same triples -----------------------------------------------------------------------------------------
_PREDICATES = {("customer", "c_mktsegment"): f"{NS}#segment", ("customer", "c_acctbal"): f"{NS}#balance", ("part", "p_brand"): f"{NS}#brand", ("part", "p_retailprice"): f"{S}price", ("orders", "o_totalprice"): f"{NS}#totalAmount", ("orders", "o_orderpriority"): f"{NS}#priority"} | {(t, c): f"{S}name" for t, c in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"))}
_COLUMNS = {"region": ["r_name"], "nation": ["n_name", "n_regionkey"], "customer": ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_name", "s_nationkey", "s_acctbal"], "part": ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]}
_XSD = {"c_acctbal": "double", "s_acctbal": "double", "p_retailprice": "double", "o_totalprice": "double", "p_size": "int", "o_orderdate": "dateTime"}


def _text(c: str) -> str:
    return f"replace(CAST({c} AS VARCHAR), ' ', 'T')" if c == "o_orderdate" else f"CAST({c} AS VARCHAR)"


def _iri(table: str, key: str) -> str:
    return f"'{NS}/{commerce.TABLES[table][0]}/' || CAST({key} AS VARCHAR)"


def _data_sql(*tables: str, types: bool = False, edges: bool = False) -> str:
    """SELECT subject, predicate, object, is_iri, datatype, kind ... UNION ALL ..."""
    parts = []
    for t in tables:
        entity, key, _, links = commerce.TABLES[t]
        for c in _COLUMNS[t]:
            p = _PREDICATES.get((t, c), f"{NS}/{c}")
            o = f"'{NS}/{links[c]}/' || CAST({c} AS VARCHAR)" if c in links else _text(c)
            dt = "CAST(NULL AS VARCHAR)" if c in links else f"'{X}{_XSD.get(c, 'string')}'"
            parts.append(f"SELECT {_iri(t, key)} AS subject, '{p}' AS predicate, {o} AS object, {'true' if c in links else 'false'} AS is_iri, {dt} AS datatype, 'data' AS kind FROM {t} WHERE {c} IS NOT NULL")
        if types:
            parts.append(f"SELECT {_iri(t, key)}, '{R}', '{NS}#{entity}', true, NULL, 'type' FROM {t}")
    if edges:
        for r in commerce.RELATIONSHIPS:
            a, b = _iri(r.from_table, commerce.TABLES[r.from_table][1]), _iri(r.to_table, r.from_column)
            parts.append(f"SELECT {a}, '{NS}#{r.predicate[3:]}', {b}, true, NULL, 'edge' FROM {r.from_table}")
            if r.inverse_predicate:
                parts.append(f"SELECT {b}, '{NS}#{r.inverse_predicate[3:]}', {a}, true, NULL, 'edge' FROM {r.from_table}")
    return " UNION ALL ".join(parts)


_ALL = _data_sql(*commerce.TABLES, types=True, edges=True)
_SHORT = ["subject", "predicate", "object", "is_iri", "datatype", "kind"]


# --- compile -----------------------------------------------------------------------------------------------------------
@query(_data_sql("customer"))
def compile_customer_triples(spark, sf_dir):
    """[P1 P2 P4 P6 F1 S2]"""
    return C.table_triples(commerce.table(spark, sf_dir, "customer"), NS).select(*_SHORT)


@query(_data_sql("orders"))
def compile_order_triples(spark, sf_dir):
    """[P1 P4 P6] with timestamps and doubles."""
    return C.table_triples(commerce.table(spark, sf_dir, "orders"), NS).select(*_SHORT)


_PLACED = _iri("orders", "o_orderkey"), _iri("customer", "o_custkey")


def _edges(spark, sf_dir, predicate):
    tables = {n: commerce.table(spark, sf_dir, n) for n in ("orders", "customer")}
    return C.edge_triples(commerce.RELATIONSHIPS[3], tables, NS).where(F.col("predicate") == f"{NS}#{predicate}").select("subject", "predicate", "object")


@query(f"SELECT {_PLACED[0]} AS subject, '{NS}#placedBy' AS predicate, {_PLACED[1]} AS object FROM orders")
def compile_fk_edges(spark, sf_dir):
    """[P8]"""
    return _edges(spark, sf_dir, "placedBy")


@query(f"SELECT {_PLACED[1]} AS subject, '{NS}#placedOrder' AS predicate, {_PLACED[0]} AS object FROM orders")
def compile_inverse_edges(spark, sf_dir):
    """[P8]"""
    return _edges(spark, sf_dir, "placedOrder")


@query(f"SELECT '{NS}/Customer/' || c_custkey AS subject, '{NS}#livesNear' AS predicate, '{NS}/Nation/' || n_nationkey AS object FROM customer JOIN nation ON n_name = (SELECT max(n_name) FROM nation) AND c_nationkey = n_nationkey")
def compile_edge_by_name(spark, sf_dir):
    """[J5] the target column is not the key, so the key is looked up."""
    nation, customer = commerce.table(spark, sf_dir, "nation"), commerce.table(spark, sf_dir, "customer")
    top = nation.df.agg(F.max("n_name").alias("near"))
    near = customer.df.join(nation.df, F.col("c_nationkey") == F.col("n_nationkey")).join(top, F.col("n_name") == F.col("near")).select("c_custkey", "near")
    tables = {"nation": nation, "customer": C.Table("customer", near, "Customer", "c_custkey")}
    return C.edge_triples(C.Relationship("near", "customer", "near", "nation", "n_name", "ex:livesNear"), tables, NS).select("subject", "predicate", "object")


@query(f"SELECT {_iri('part', 'p_partkey')} AS subject, '{R}' AS predicate, '{NS}#Part' AS object, 'type' AS kind FROM part")
def compile_type_triples(spark, sf_dir):
    """[P7]"""
    return C.type_triples(commerce.table(spark, sf_dir, "part"), NS).select("subject", "predicate", "object", "kind")


@query(f"SELECT {_iri('part', 'p_partkey')} AS subject, '{NS}/words' AS predicate, unnest(string_split(p_type, ' ')) AS object, true AS is_iri FROM part")
def compile_list_column(spark, sf_dir):
    """[P5]"""
    df = commerce.source(spark, sf_dir, "part").select("p_partkey", F.split("p_type", " ").alias("words"))
    return C.table_triples(C.Table("part", df, "Part", "p_partkey"), NS).select("subject", "predicate", "object", "is_iri")


@query(f"SELECT {_iri('orders', 'o_orderkey')} AS subject, '{NS}/p' AS predicate, o_orderpriority AS object FROM orders WHERE o_orderpriority <> '5-LOW'")
def compile_with_nulls(spark, sf_dir):
    """[P1 F1] nulls make no triple."""
    df = commerce.source(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return C.table_triples(C.Table("orders", df, "Order", "o_orderkey"), NS).select("subject", "predicate", "object")


@query(f"SELECT '{NS}/Customer/' || left(sha256('{NS}/Customer/' || c_custkey), 16) AS iri FROM customer")
def iri_hash_strategy(spark, sf_dir):
    """[P2]"""
    return commerce.source(spark, sf_dir, "customer").select(terms.minted(NS, "Customer", F.col("c_custkey"), "hash").alias("iri"))


_UUID = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('{NS}/Customer/' || c_custkey))"


@query(f"""SELECT c_custkey, '{NS}/Customer/' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', CAST('0x' || h[17:17] AS INT) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS iri
FROM (SELECT c_custkey, {_UUID} AS h FROM customer)""")
def iri_uuid5_strategy(spark, sf_dir):
    """[P2] also tested against the library."""
    return commerce.source(spark, sf_dir, "customer").select("c_custkey", terms.minted(NS, "Customer", F.col("c_custkey"), "uuid5").alias("iri"))


@query(f"SELECT DISTINCT subject, predicate, object FROM ({_data_sql('nation', 'region', types=True)}) WHERE kind = 'type' OR predicate = '{S}name'")
def graph_as_set(spark, sf_dir):
    """[D5 X1 X5] bag to set."""
    bag = triples(spark, sf_dir, "nation", "region")
    return C.as_set(bag.unionByName(bag)).where((F.col("kind") == "type") | (F.col("predicate") == f"{S}name")).select("subject", "predicate", "object")


# --- measures ----------------------------------------------------------------------------------------------------------
@query(f"SELECT predicate, count(*) AS n FROM ({_ALL}) GROUP BY predicate")
def triple_counts_by_predicate(spark, sf_dir):
    """[A4 A8]"""
    return profile.predicate_counts([commerce.table(spark, sf_dir, n) for n in commerce.TABLES], commerce.RELATIONSHIPS, NS)


@query(" UNION ALL ".join(f"SELECT '{e}' AS class, count(*) AS n FROM {t}" for t, (e, *_) in commerce.TABLES.items()))
def class_distribution(spark, sf_dir):
    """[A7]"""
    return profile.class_distribution(whole(spark, sf_dir))


@query(f"""WITH g AS ({_ALL}), r AS (SELECT DISTINCT object FROM g WHERE is_iri AND predicate <> '{R}')
SELECT count(*) AS total_triples, count(DISTINCT subject) AS unique_subjects, count(DISTINCT predicate) AS unique_predicates, count(DISTINCT object) AS unique_objects,
count(DISTINCT CASE WHEN predicate = '{R}' THEN object END) AS entity_types, count(*) FILTER (is_iri AND predicate <> '{R}') AS relationship_edges, count(DISTINCT CASE WHEN NOT is_iri THEN predicate END) AS literal_columns,
(SELECT count(*) FROM (SELECT DISTINCT subject FROM g) WHERE subject NOT IN (SELECT object FROM r)) AS orphan_entities, (SELECT count(*) FROM r WHERE object NOT IN (SELECT subject FROM g)) AS broken_references FROM g""")
def graph_profile(spark, sf_dir):
    """[A4 A5 A6]"""
    return profile.profile(whole(spark, sf_dir))


@query("SELECT 'https://data.example/commerce/Customer/' || c_custkey AS iri FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'https://data.example/commerce/Order/' || o_orderkey FROM orders")
def diagnose_orphans(spark, sf_dir):
    """[A9]"""
    return profile.unreferenced(triples(spark, sf_dir, "customer", "orders"))


@query("SELECT DISTINCT 'https://data.example/commerce/Customer/' || o_custkey AS iri FROM orders WHERE o_custkey % 10 = 0")
def broken_references(spark, sf_dir):
    """[J10] some customers are taken out."""
    customer = commerce.table(spark, sf_dir, "customer")
    some = C.Table("customer", customer.df.where("c_custkey % 10 <> 0").drop("c_nationkey"), "Customer", "c_custkey")
    return profile.broken(C.graph([some, commerce.table(spark, sf_dir, "orders")], [], NS, spark))


@query(f"SELECT count(*) AS triples, CAST(0 AS BIGINT) AS empty_subjects, CAST(0 AS BIGINT) AS empty_predicates, count(DISTINCT subject) AS subjects FROM ({_ALL})")
def triple_sanity(spark, sf_dir):
    """[A11]"""
    return validate.check_triples(whole(spark, sf_dir))


# --- checks ------------------------------------------------------------------------------------------------------------
@query("SELECT count(*) - count(DISTINCT l_orderkey * 10 + l_linenumber) AS duplicates FROM lineitem")
def validate_pk_duplicates(spark, sf_dir):
    """[A2 A10]"""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return commerce.source(spark, sf_dir, "lineitem").agg(validate.duplicates(key).alias("duplicates"))


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def validate_fk_orphans(spark, sf_dir):
    """[J1 C2]"""
    return validate.orphans(commerce.source(spark, sf_dir, "orders"), "o_custkey", commerce.source(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey")


@query("SELECT 'o_orderkey' AS \"column\", count(*) AS rows, CAST(0 AS BIGINT) AS nulls, CAST(0 AS DOUBLE) AS null_rate FROM orders UNION ALL SELECT 'p', count(*), count(*) - count(nullif(o_orderpriority, '5-LOW')), 1 - count(nullif(o_orderpriority, '5-LOW')) / count(*) FROM orders")
def validate_nulls(spark, sf_dir):
    """[A1 A3 A10]"""
    return validate.profile(commerce.source(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")))


@query("SELECT count(DISTINCT c_mktsegment) AS segments, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_name) AS names FROM customer")
def column_analysis(spark, sf_dir):
    """[P9]"""
    found = {c["column"]: c["n_unique"] for c in C.column_analysis(commerce.table(spark, sf_dir, "customer"), NS)}
    return spark.createDataFrame([(found["c_mktsegment"], found["c_nationkey"], found["c_name"])], "segments long, nations long, names long")


# --- masks -------------------------------------------------------------------------------------------------------------
def _masked(name: str, strategy: str, sql: str, salt: str = "s") -> None:
    def run(spark, sf_dir):
        return mask.apply(commerce.source(spark, sf_dir, "customer").select("c_custkey", "c_name"), {"c_name": strategy}, salt)

    run.__name__, run.__doc__ = name, "[C4 C5 U2]"
    query(f"SELECT c_custkey, {sql} AS c_name FROM customer")(run)


_masked("mask_hash", "hash", "'sha256:' || sha256('s::' || c_name)")
_masked("mask_partial", "partial", "CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', greatest(1, length(c_name) - 4)) || right(c_name, 2) END")
_masked("mask_redact", "redact", "'[REDACTED]'")
_masked("pii_hash32", "hash32", "left(sha256('s:' || c_name), 32)")
_masked("pii_pseudonym", "pseudonymize", "CASE WHEN contains(c_name, '@') THEN 'user' || left(md5(c_name), 6) || '@example.com' WHEN regexp_full_match(replace(replace(c_name, '+', ''), '-', ''), '[0-9]+') THEN '+X-XXX-' || left(md5(c_name), 4) ELSE '[MASKED-' || left(md5(c_name), 8) || ']' END")


# --- SPARQL ------------------------------------------------------------------------------------------------------------
_C, _O, _N, _RG, _SU, _P = (f"'{NS}/{e}/' || {k}" for e, k in (("Customer", "c_custkey"), ("Order", "o_orderkey"), ("Nation", "n_nationkey"), ("Region", "r_regionkey"), ("Supplier", "s_suppkey"), ("Part", "p_partkey")))
FLAGSHIP = "SELECT ?seg (COUNT(DISTINCT ?o) AS ?n) WHERE { ?o a ex:Order ; ex:placedBy ?c . ?c ex:segment ?seg } GROUP BY ?seg"
_JOIN = "orders JOIN customer ON o_custkey = c_custkey"
ask("sparql_count_distinct", FLAGSHIP, f"SELECT c_mktsegment AS seg, CAST(count(DISTINCT o_orderkey) AS VARCHAR) AS n FROM {_JOIN} GROUP BY 1")
ask("bgp_one_hop", "SELECT ?o ?c WHERE { ?o ex:placedBy ?c }", f"SELECT {_O} AS o, {_PLACED[1]} AS c FROM orders")
ask("bgp_two_hop", "SELECT ?o ?n WHERE { ?o ex:placedBy ?c . ?c ex:inNation ?n }", f"SELECT {_O} AS o, '{NS}/Nation/' || c_nationkey AS n FROM {_JOIN}")
ask("bgp_three_hop", "SELECT ?name (COUNT(*) AS ?n) WHERE { ?o ex:placedBy ?c . ?c ex:inNation ?x . ?x ex:inRegion ?r . ?r schema:name ?name } GROUP BY ?name", f"SELECT r_name AS name, CAST(count(*) AS VARCHAR) AS n FROM {_JOIN} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
ask("bgp_star", "SELECT ?o ?s ?p WHERE { ?o a ex:Order ; ex:priority ?p ; ex:placedBy ?c . ?c a ex:Customer ; ex:segment ?s }", f"SELECT {_O} AS o, c_mktsegment AS s, o_orderpriority AS p FROM {_JOIN}")
ask("bgp_constant_object", 'SELECT ?c WHERE { ?c ex:segment "BUILDING" }', f"SELECT {_C} AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("sparql_filter_numeric", "SELECT ?o ?t WHERE { ?o ex:totalAmount ?t FILTER(?t > 100000 && xsd:decimal(?t) <= 250000.5) }", f"SELECT {_O} AS o, CAST(o_totalprice AS VARCHAR) AS t FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 250000.5")
ask("sparql_filter_string", 'SELECT ?c WHERE { ?c ex:segment ?s FILTER(CONTAINS(LCASE(STR(?s)), "build") || STRSTARTS(?s, "AUTO") || REGEX(?s, "^mach", "i")) }', f"SELECT {_C} AS c FROM customer WHERE c_mktsegment LIKE '%BUILD%' OR c_mktsegment LIKE 'AUTO%' OR c_mktsegment LIKE 'MACH%'")
ask("sparql_string_functions", 'SELECT ?c ?u ?n WHERE { ?c ex:segment ?s BIND(CONCAT(LCASE(SUBSTR(?s, 1, 3)), "-", REPLACE(?s, "[AEIOU]", "")) AS ?u) BIND(STRLEN(?s) AS ?n) FILTER(!STRENDS(?s, "Y") && ?s != "BUILDING") }', f"SELECT {_C} AS c, lower(left(c_mktsegment, 3)) || '-' || regexp_replace(c_mktsegment, '[AEIOU]', '', 'g') AS u, CAST(length(c_mktsegment) AS VARCHAR) AS n FROM customer WHERE NOT c_mktsegment LIKE '%Y' AND c_mktsegment <> 'BUILDING'")
ask("sparql_optional", 'SELECT ?c ?o WHERE { ?c a ex:Customer ; ex:segment "BUILDING" . OPTIONAL { ?o ex:placedBy ?c ; ex:priority "1-URGENT" } }', f"SELECT {_C} AS c, '{NS}/Order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' WHERE c_mktsegment = 'BUILDING'")
ask("sparql_optional_filter", "SELECT ?c ?o WHERE { ?c ex:balance ?b . OPTIONAL { ?o ex:placedBy ?c ; ex:totalAmount ?t FILTER(?t > ?b * 60) } }", f"SELECT {_C} AS c, '{NS}/Order/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 60")
ask("sparql_optional_join", 'SELECT ?c ?n WHERE { ?c ex:inNation ?x OPTIONAL { ?c ex:segment "BUILDING" . ?c ex:inNation ?n } OPTIONAL { ?c ex:inNation ?n } }', f"SELECT {_C} AS c, '{NS}/Nation/' || c_nationkey AS n FROM customer")
ask("sparql_union", 'SELECT ?x ?b WHERE { { ?x ex:basedIn ?n . ?n schema:name ?b } UNION { ?x ex:segment ?b FILTER(?b = "MACHINERY") } }', f"SELECT {_SU} AS x, n_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT {_C}, c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
ask("sparql_minus", 'SELECT ?c WHERE { ?c a ex:Customer MINUS { ?o ex:placedBy ?c ; ex:priority "1-URGENT" } }', f"SELECT {_C} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
ask("sparql_exists", "SELECT ?c WHERE { ?c a ex:Customer FILTER EXISTS { ?o ex:placedBy ?c ; ex:totalAmount ?t FILTER(?t > 300000) } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
ask("sparql_not_exists", "SELECT ?c WHERE { ?c a ex:Customer FILTER NOT EXISTS { ?o ex:placedBy ?c ; ex:totalAmount ?t FILTER(?t > 300000) } }", f"SELECT {_C} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
ask("sparql_exists_in_expression", 'SELECT ?c ?busy WHERE { ?c a ex:Customer ; ex:balance ?b FILTER(?b < 0 || EXISTS { ?o ex:placedBy ?c ; ex:totalAmount ?t FILTER(?t > 300000) }) BIND(IF(NOT EXISTS { ?p ex:placedBy ?c }, "no", "yes") AS ?busy) }', f"SELECT {_C} AS c, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'yes' ELSE 'no' END AS busy FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
ask("sparql_bind", "SELECT ?p ?half ?big WHERE { ?p schema:price ?r BIND(FLOOR(?r / 2) AS ?half) BIND(IF(?r > 1500, \"big\", \"small\") AS ?big) }", f"SELECT {_P} AS p, CAST(CAST(floor(p_retailprice / 2) AS BIGINT) AS VARCHAR) AS half, CASE WHEN p_retailprice > 1500 THEN 'big' ELSE 'small' END AS big FROM part")
ask("sparql_values", 'SELECT ?c ?s ?k WHERE { VALUES (?s ?k) { ("BUILDING" 1) ("MACHINERY" 2) } ?c ex:segment ?s }', f"SELECT {_C} AS c, c_mktsegment AS s, CASE WHEN c_mktsegment = 'BUILDING' THEN '1' ELSE '2' END AS k FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
ask("sparql_subselect", "SELECT ?name ?m WHERE { ?x schema:name ?name ; a ex:Nation . { SELECT ?x (MAX(?b) AS ?m) WHERE { ?c ex:inNation ?x ; ex:balance ?b } GROUP BY ?x } }", "SELECT n_name AS name, CAST(max(c_acctbal) AS VARCHAR) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
ask("sparql_group_having", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o ex:placedBy ?c } GROUP BY ?c HAVING (COUNT(?o) > 15)", f"SELECT {_PLACED[1]} AS c, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
ask("sparql_aggregates", "SELECT ?s (MIN(?b) AS ?low) (MAX(?b) AS ?high) (COUNT(?b) AS ?n) WHERE { ?c ex:segment ?s ; ex:balance ?b ; a ex:Customer } GROUP BY ?s", "SELECT c_mktsegment AS s, CAST(min(c_acctbal) AS VARCHAR) AS low, CAST(max(c_acctbal) AS VARCHAR) AS high, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 1")
ask("sparql_sum_avg", "SELECT ?s (SUM(FLOOR(?b)) AS ?total) (ROUND(AVG(FLOOR(?b))) AS ?mean) WHERE { ?c ex:segment ?s ; ex:balance ?b } GROUP BY ?s", "SELECT c_mktsegment AS s, CAST(CAST(sum(floor(c_acctbal)) AS BIGINT) AS VARCHAR) AS total, CAST(CAST(floor(avg(floor(c_acctbal)) + 0.5) AS BIGINT) AS VARCHAR) AS mean FROM customer GROUP BY 1")
ask("sparql_order_limit", "SELECT ?o ?t WHERE { ?o ex:totalAmount ?t } ORDER BY DESC(?t) ?o LIMIT 25 OFFSET 5", f"SELECT {_O} AS o, CAST(o_totalprice AS VARCHAR) AS t FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 25 OFFSET 5")
ask("sparql_distinct", "SELECT DISTINCT ?s ?p WHERE { ?o ex:placedBy ?c ; ex:priority ?p . ?c ex:segment ?s }", f"SELECT DISTINCT c_mktsegment AS s, o_orderpriority AS p FROM {_JOIN}")
ask("sparql_group_concat", 'SELECT ?r (GROUP_CONCAT(?name; SEPARATOR="|") AS ?names) WHERE { ?n ex:inRegion ?r ; schema:name ?name } GROUP BY ?r', f"SELECT '{NS}/Region/' || n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
ask("sparql_path_seq", "SELECT ?o ?r WHERE { ?o ex:placedBy/ex:inNation/ex:inRegion ?r }", f"SELECT {_O} AS o, '{NS}/Region/' || n_regionkey AS r FROM {_JOIN} JOIN nation ON c_nationkey = n_nationkey")
ask("sparql_path_inverse", "SELECT ?n ?c WHERE { ?n ^ex:inNation ?c ; schema:name \"NATION_1\" }", f"SELECT {_N} AS n, {_C} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_1'")
ask("sparql_path_alt", "SELECT ?x ?n WHERE { ?x ex:inNation|ex:basedIn ?n }", f"SELECT {_C} AS x, '{NS}/Nation/' || c_nationkey AS n FROM customer UNION ALL SELECT {_SU}, '{NS}/Nation/' || s_nationkey FROM supplier")
ask("sparql_path_plus", "SELECT ?a ?b WHERE { ?a (ex:inRegion|ex:hasNation)+ ?b }", f"WITH RECURSIVE e AS (SELECT {_N} AS a, '{NS}/Region/' || n_regionkey AS b FROM nation UNION SELECT '{NS}/Region/' || n_regionkey, {_N} FROM nation), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p")
_HOPS = f"e AS (SELECT {_N} AS a, '{NS}/Region/' || n_regionkey AS b FROM nation UNION SELECT '{NS}/Region/' || n_regionkey, {_N} FROM nation)"
ask("sparql_path_star", f"SELECT ?b WHERE {{ <{NS}/Nation/3> (ex:inRegion|ex:hasNation)* ?b }}", f"WITH RECURSIVE {_HOPS}, p AS (SELECT '{NS}/Nation/3' AS b UNION SELECT e.b FROM p JOIN e ON p.b = e.a) SELECT b FROM p")
ask("sparql_path_plus_to", f"SELECT ?a WHERE {{ ?a (ex:placedBy/ex:inNation/ex:inRegion)+ <{NS}/Region/1> }}", f"SELECT {_O} AS a FROM {_JOIN} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
ask("sparql_path_optional_step", f"SELECT ?b WHERE {{ <{NS}/Nation/3> ex:inRegion? ?b }}", f"SELECT '{NS}/Nation/3' AS b UNION SELECT '{NS}/Region/' || n_regionkey FROM nation WHERE n_nationkey = 3")
ask("sparql_variable_predicate", f"SELECT ?p ?o WHERE {{ <{NS}/Nation/3> ?p ?o }}", f"SELECT DISTINCT predicate AS p, object AS o FROM ({_ALL}) WHERE subject = '{NS}/Nation/3'")
ask("sparql_ask", 'ASK { ?c ex:segment "BUILDING" . ?o ex:placedBy ?c }', f"SELECT count(*) > 0 AS result FROM {_JOIN} WHERE c_mktsegment = 'BUILDING'")
ask("sparql_construct", "CONSTRUCT { ?c ex:buysIn ?n . ?n ex:soldTo ?c } WHERE { ?o ex:placedBy ?c . ?c ex:inNation ?n }", f"WITH p AS (SELECT DISTINCT {_C} AS c, '{NS}/Nation/' || c_nationkey AS n FROM {_JOIN}) SELECT c AS subject, '{NS}#buysIn' AS predicate, n AS object, true AS is_iri, '' AS datatype, '' AS lang FROM p UNION ALL SELECT n, '{NS}#soldTo', c, true, '', '' FROM p")
ask("sparql_describe", f"DESCRIBE ?r WHERE {{ ?r a ex:Region }}", f"SELECT DISTINCT subject, predicate, object, is_iri, coalesce(datatype, '') AS datatype, '' AS lang FROM ({_ALL}) WHERE subject LIKE '{NS}/Region/%'")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["sparql_count_distinct"](spark, sf_dir)


@query("SELECT CAST(count(DISTINCT c_custkey) AS VARCHAR) AS \"count\" FROM customer")
def plan_count_customers(spark, sf_dir):
    """[C10 C11 A12] a question through linker, planner and SPARQL."""
    return nl.answer(commerce.graph(spark, sf_dir), nl.Schema.of(commerce.TABLES, commerce.RELATIONSHIPS, NS), "how many customers are there")


@query(f"SELECT CAST(count(DISTINCT o_orderkey) AS VARCHAR) AS \"count\" FROM {_JOIN} JOIN nation ON c_nationkey = n_nationkey")
def plan_path_join(spark, sf_dir):
    """[C11 J7] the path from orders to nations is found over customers."""
    return nl.answer(commerce.graph(spark, sf_dir), nl.Schema.of(commerce.TABLES, commerce.RELATIONSHIPS, NS), "count order with a nation")


# --- exploration -------------------------------------------------------------------------------------------------------
@query(f"SELECT subject, split_part(min(predicate || chr(1) || object), chr(1), 1) AS predicate, split_part(min(predicate || chr(1) || object), chr(1), 2) AS object FROM ({_data_sql('nation', 'supplier', types=True)}) WHERE contains(lower(subject), 'tion_1') OR contains(lower(predicate), 'tion_1') OR contains(lower(object), 'tion_1') GROUP BY subject ORDER BY subject LIMIT 15")
def search_entities(spark, sf_dir):
    """[F2]"""
    return explore.search(triples(spark, sf_dir, "nation", "supplier"), "TION_1", limit=15)


@query(f"SELECT predicate, array_to_string(list_sort(list(object)), '|') AS objects FROM ({_data_sql('customer', types=True)}) WHERE subject = '{NS}/Customer/7' GROUP BY predicate")
def entity_facts(spark, sf_dir):
    """[F3]"""
    return explore.facts(commerce.graph(spark, sf_dir, "customer").with_subject(f"{NS}/Customer/7").source, f"{NS}/Customer/7").select("predicate", F.array_join("objects", "|").alias("objects"))


_NEAR = f"SELECT {_O} AS subject, '{NS}/o_custkey' AS predicate, {_PLACED[1]} AS object FROM orders"


@query(f"SELECT 1 AS hop, 'in' AS direction, subject, predicate, object FROM ({_NEAR}) WHERE object = '{NS}/Customer/7' UNION ALL SELECT 1, 'out', {_C}, '{NS}/c_nationkey', '{NS}/Nation/' || c_nationkey FROM customer WHERE c_custkey = 7")
def entity_neighbours(spark, sf_dir):
    """[F4]"""
    return explore.neighbours(commerce.graph(spark, sf_dir, "customer", "orders").around(f"{NS}/Customer/7").source, f"{NS}/Customer/7", limit=1000)


@query(f"""WITH e AS (SELECT {_N} AS s, '{NS}/Region/' || n_regionkey AS o FROM nation), h1 AS (SELECT 1 AS hop, 'out' AS direction, s AS subject, o AS object FROM e WHERE s = '{NS}/Nation/3'),
h2 AS (SELECT 2 AS hop, 'in' AS direction, s AS subject, o AS object FROM e WHERE o IN (SELECT object FROM h1) UNION ALL SELECT 2, 'in', s, o FROM e WHERE false)
SELECT hop, direction, subject, '{NS}/n_regionkey' AS predicate, object FROM h1 UNION ALL SELECT hop, direction, subject, '{NS}/n_regionkey', object FROM h2""")
def entity_two_hops(spark, sf_dir):
    """[F4 J8]"""
    return explore.neighbours(triples(spark, sf_dir, "nation", "region"), f"{NS}/Nation/3", depth=2, limit=1000)


@query(f"SELECT DISTINCT predicate FROM ({_data_sql('customer', 'part', 'orders')}) WHERE NOT is_iri AND TRY_CAST(object AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(object AS DOUBLE)) ORDER BY predicate LIMIT 50")
def numeric_properties(spark, sf_dir):
    """[F6]"""
    return explore.numeric_properties(triples(spark, sf_dir, "customer", "part", "orders"))


@query(f"""WITH g AS ({_data_sql('nation', 'part', types=True)}), s AS (SELECT *, {' + '.join(f"CAST(contains(lower({c}), '{w}') AS INT)" for w in ("nation", "an", "steel") for c in ("subject", "object"))} AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, predicate, object) AS rank FROM s WHERE score > 0) SELECT subject, predicate, object, score FROM r WHERE rank = 1 ORDER BY score DESC, subject LIMIT 20""")
def token_overlap_topk(spark, sf_dir):
    """[F7]"""
    return explore.token_overlap(triples(spark, sf_dir, "nation", "part"), "Nation an steel", 20)


@query("SELECT vec_id, CAST(round(c * 1000000) AS BIGINT) AS millionths FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    """[T7 C22]"""
    vectors = commerce.source(spark, sf_dir, "embeddings")
    return explore.vector_top_k(vectors, "vec_id", "embedding", vectors.where("vec_id = 0").first().embedding).select("vec_id", F.round(F.col("cosine") * 1000000).cast("long").alias("millionths"))


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of a few fixed rows."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


_D, _T, _V = terms.PREFIXES["dcat"], terms.PREFIXES["dcterms"], terms.PREFIXES["prov"]
_LINEAGE = [(f"{_V}{p}", n, of) for p, n, of in (("startedAtTime", 1, 1), ("wasAssociatedWith", 1, 1), ("used", len(commerce.TABLES), 1), ("atLocation", len(commerce.TABLES), len(commerce.TABLES)))]
_CATALOG = [(f"{NS}/catalog", R, f"{_D}Catalog", True, None), (f"{NS}/catalog", f"{_T}title", "commerce", False, f"{X}string"), (f"{NS}/catalog", f"{_T}issued", "then", False, f"{X}dateTime"), (f"{NS}/catalog", f"{_T}identifier", f"{NS}/catalog", False, f"{X}string")]
for _n in commerce.TABLES:
    _d = f"{NS}/dataset/{_n}"
    _CATALOG += [(f"{NS}/catalog", f"{_D}dataset", _d, True, None), (_d, R, f"{_D}Dataset", True, None), (_d, f"{_T}title", _n, False, f"{X}string"), (_d, f"{_T}identifier", _n, False, f"{X}string"), (_d, f"{_T}issued", "then", False, f"{X}dateTime")]
    _CATALOG += [(_d, f"{_D}distribution", f"{_d}/distribution", True, None), (f"{_d}/distribution", R, f"{_D}Distribution", True, None), (f"{_d}/distribution", f"{_D}accessURL", f"{_n}.parquet", False, f"{X}string"), (f"{_d}/distribution", f"{_D}mediaType", "application/parquet", False, f"{X}string")]


@query(_values("predicate, n, subjects", _LINEAGE))
def lineage_triples(spark, sf_dir):
    """[F5 P14] as counts by predicate: times and run ids differ from run to run."""
    return _by_predicate(explore.lineage(meta.provenance(spark, {n: f"{sf_dir}/{n}.parquet" for n in commerce.TABLES}, NS)))


@query(_values("subject, predicate, object, is_iri, datatype", _CATALOG))
def catalog_triples(spark, sf_dir):
    """[P12] without the times of issue, which differ from run to run."""
    made = meta.catalog(spark, {n: f"{n}.parquet" for n in commerce.TABLES}, NS, "commerce")
    return made.withColumn("object", F.when(F.col("predicate").endswith("issued"), "then").otherwise(F.col("object"))).select("subject", "predicate", "object", "is_iri", "datatype")


def _by_predicate(triples: DataFrame) -> DataFrame:
    return triples.groupBy("predicate").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


# --- resolution --------------------------------------------------------------------------------------------------------
def _sides(spark, sf_dir):
    a, b = commerce.table(spark, sf_dir, "customer"), commerce.table(spark, sf_dir, "supplier")
    nations = commerce.source(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    one = a.df.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("Firm "), F.col("c_custkey") % 97, F.lit(" "), "n_name").alias("label"))
    two = b.df.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("FIRM "), F.col("s_suppkey") % 97, F.lit(" "), F.initcap(F.lower("n_name"))).alias("label"))
    return C.Table("customer", one, "Customer", "c_custkey"), C.Table("supplier", two, "Supplier", "s_suppkey")


_SIDE_A = "(SELECT c_custkey, 'Firm ' || (c_custkey % 97) || ' ' || n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"SELECT DISTINCT 'c_nationkey' AS \"column\", CAST(c_nationkey AS VARCHAR) AS value FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def resolve_exact(spark, sf_dir):
    """[J2]"""
    a, b = commerce.table(spark, sf_dir, "customer"), commerce.table(spark, sf_dir, "supplier")
    return resolve.exact(a, b, [("c_nationkey", "s_nationkey")])


@query(f"SELECT DISTINCT lower(label) AS sound FROM {_SIDE_A} WHERE lower(label) IN (SELECT lower('firm ' || (s_suppkey % 97) || ' ' || n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey)")
def resolve_phonetic_lower(spark, sf_dir):
    """[J4]"""
    a, b = _sides(spark, sf_dir)
    return resolve.phonetic(a, b, ("label", "label")).select("sound").distinct()


@query()
def resolve_fuzzy(spark, sf_dir):
    """[J3] tested against all pairs."""
    a, b = _sides(spark, sf_dir)
    return resolve.fuzzy(a, b, ("label", "label"))


@query(f"SELECT DISTINCT {_C} AS subject, '{terms.SAME_AS}' AS predicate, {_SU} AS object FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING'")
def same_as_links(spark, sf_dir):
    """[C9]"""
    a, b = commerce.table(spark, sf_dir, "customer"), commerce.table(spark, sf_dir, "supplier")
    a = C.Table("customer", a.df.where("c_mktsegment = 'BUILDING'"), "Customer", "c_custkey")
    matches = resolve.exact(a, b, [("c_nationkey", "s_nationkey")]).select(F.col("value").alias("a_value"), F.col("value").alias("b_value"))
    return resolve.same_as(a, b, ("c_nationkey", "s_nationkey"), matches, NS).select("subject", "predicate", "object")


# --- versions ----------------------------------------------------------------------------------------------------------
def _old_new(spark, sf_dir):
    c = commerce.table(spark, sf_dir, "customer")
    make = lambda df: C.table_triples(C.Table("customer", df, "Customer", "c_custkey", c.properties), NS)
    return make(c.df.where("c_custkey % 7 <> 0")), make(c.df.where("c_custkey % 5 <> 0").withColumn("c_mktsegment", F.expr("if(c_custkey % 11 = 0, 'NEW', c_mktsegment)")))


_OLD = "SELECT * FROM customer WHERE c_custkey % 7 <> 0"
_NEW = "SELECT * REPLACE (CASE WHEN c_custkey % 11 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment) FROM customer WHERE c_custkey % 5 <> 0"


def _version_sql(rows: str) -> str:
    """All data triples of changed customers; the nation is a literal here, since the versions declare no link."""
    made = _data_sql("customer").replace(" FROM customer ", f" FROM ({rows}) ").replace(f"'{NS}/Nation/' || CAST(c_nationkey AS VARCHAR)", "CAST(c_nationkey AS VARCHAR)")
    return f"SELECT subject, predicate, object FROM ({made})"


@query(f"({_version_sql(_NEW)}) EXCEPT ({_version_sql(_OLD)})")
def snapshot_added(spark, sf_dir):
    """[X2 J9]"""
    return versions.added(*_old_new(spark, sf_dir))


@query(f"({_version_sql(_OLD)}) EXCEPT ({_version_sql(_NEW)})")
def snapshot_removed(spark, sf_dir):
    """[X2]"""
    old, new = _old_new(spark, sf_dir)
    return versions.added(new, old)


@query(f"SELECT {_C} AS subject, '{NS}#segment' AS predicate FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 = 0")
def snapshot_modified(spark, sf_dir):
    """[X3]"""
    return versions.modified(*_old_new(spark, sf_dir))


@query("SELECT CAST(coalesce(sum(CASE WHEN c_custkey % 11 = 0 THEN 3 * 2 ELSE 4 * 3 END), 0) AS BIGINT) AS modified FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")
def snapshot_unchanged_pairs(spark, sf_dir):
    """[X3]"""
    return versions.unchanged_pairs(*_old_new(spark, sf_dir))


@query("SELECT true AS same_after_shuffling, true AS other_after_a_change, true AS other_after_a_repeated_row, count(*) AS rows FROM customer")
def fingerprint(spark, sf_dir):
    """[I1] what it tells apart; xxhash64 itself is not in SQL."""
    customer = commerce.source(spark, sf_dir, "customer")
    mark = lambda df, name: versions.fingerprint(df).select(F.struct("*").alias(name))
    changed = customer.withColumn("c_name", F.when(F.col("c_custkey") == 7, "other").otherwise(F.col("c_name")))
    marks = mark(customer, "a").crossJoin(mark(customer.repartition(7), "b")).crossJoin(mark(changed, "c")).crossJoin(mark(customer.union(customer.where("c_custkey = 7")), "d"))  # one row each
    return marks.select((F.col("a") == F.col("b")).alias("same_after_shuffling"), (F.col("a") != F.col("c")).alias("other_after_a_change"), (F.col("a") != F.col("d")).alias("other_after_a_repeated_row"), F.col("a.rows").alias("rows"))


# --- exports -----------------------------------------------------------------------------------------------------------
@query(f"""SELECT '<' || subject || '> <' || predicate || '> ' || CASE WHEN is_iri THEN '<' || object || '>' ELSE '"' || replace(replace(object, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"^^<' || datatype || '>' END || ' .' AS value FROM ({_data_sql('nation', 'part', types=True)})""")
def export_ntriples(spark, sf_dir):
    """[K2 K5]"""
    return export.ntriples(triples(spark, sf_dir, "nation", "part"))


@query(f"SELECT '<{NS}/Region/' || r_regionkey || '> schema:name \"' || r_name || '\" .' || chr(10) AS value FROM region UNION ALL SELECT '<{NS}/Region/' || r_regionkey || '> rdf:type <{NS}#Region> .' || chr(10) FROM region")
def export_turtle(spark, sf_dir):
    """[K1 K5]"""
    return export.turtle(triples(spark, sf_dir, "region"))


@query(f"""SELECT '<rdf:Description rdf:about="{NS}/Region/' || r_regionkey || '"><p:name xmlns:p="{S}" rdf:datatype="{X}string">' || replace(r_name, '&', '&amp;') || '</p:name></rdf:Description>' AS value FROM region""")
def export_rdfxml(spark, sf_dir):
    """[K4 K6]"""
    return export.rdfxml(C.table_triples(commerce.table(spark, sf_dir, "region"), NS))


@query(f"""SELECT '{{"@id":"{NS}/Region/' || r_regionkey || '","{S}name":[{{"@value":"' || r_name || '","@type":"{X}string"}}]}}' AS value FROM region""")
def jsonld_nodes(spark, sf_dir):
    """[K3]"""
    return export.jsonld(C.table_triples(commerce.table(spark, sf_dir, "region"), NS))


# --- policies ----------------------------------------------------------------------------------------------------------
@query("SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'build') THEN '[REDACTED]' ELSE c_mktsegment END AS c_mktsegment, '[REDACTED]' AS c_name FROM customer")
def redacted_rows(spark, sf_dir):
    """[F13]"""
    return policy.redact(commerce.source(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name"), ["build", "c_name"])


@query("SELECT c_custkey, CASE WHEN contains(c_mktsegment, 'BUILD') THEN NULL WHEN contains(c_mktsegment, 'MACH') THEN '[MASKED]' ELSE c_mktsegment END AS c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100")
def role_masked_rows(spark, sf_dir):
    """[F14 T4]"""
    role = policy.Role(deny_properties=["BUILD", "c_name"], mask_properties=["MACH"], max_rows=100)
    return role.filter_rows(commerce.source(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name").orderBy("c_custkey"))


# --- readers, stores, packages -----------------------------------------------------------------------------------------------------
def _written(spark, sf_dir, name: str, format: str, **options) -> str:
    """A table written in another format to the shared folder."""
    path = f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}.{format}"
    commerce.source(spark, sf_dir, name).write.format({"tsv": "csv", "jsonl": "json"}.get(format, format)).options(**options).save(path)
    return path


def _reads(name: str, table: str, format: str, sql: str, doc: str, **options) -> None:
    def run(spark, sf_dir):
        return readers.read_table(spark, _written(spark, sf_dir, table, format, **options))

    run.__name__, run.__doc__ = name, doc
    query(sql)(run)


_reads("read_csv", "supplier", "csv", "SELECT CAST(s_suppkey AS INT) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier", "[S1 S3 S9]", header=True)
_reads("read_tsv", "nation", "tsv", "SELECT * FROM nation", "[S1 S3]", header=True, sep="\t")
_reads("read_jsonl", "customer", "jsonl", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer", "[S1 S4 S9]")
_reads("read_orc", "part", "orc", "SELECT * FROM part", "[S1 S10]")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_pandas(spark, sf_dir):
    """[S1 S8]"""
    return readers.read_table(spark, commerce.source(spark, sf_dir, "nation").toPandas())


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region")
def read_by_connector(spark, sf_dir):
    """[S10] a format of one's own."""
    readers.register("shouted", lambda spark, source, **o: spark.read.parquet(source).withColumn("r_name", F.upper("r_name")))
    return readers.read_table(spark, f"{sf_dir}/region.parquet", "shouted")


_REGION_NATION = _data_sql("nation", "region", types=True)


@query(f"SELECT DISTINCT subject, predicate, object, is_iri, datatype FROM ({_REGION_NATION})")
def ntriples_round_trip(spark, sf_dir):
    """[K2 K5 S12] written, and read back from text."""
    path = f"{shared.folder(spark)}/graph-{uuid.uuid4().hex}"
    export.write(triples(spark, sf_dir, "nation", "region"), path, "ntriples")
    return readers.read_ntriples(spark, path).select("subject", "predicate", "object", "is_iri", "datatype").distinct()


def _back(name: str, format: str, read) -> None:
    def run(spark, sf_dir):
        path = f"{shared.folder(spark)}/graph-{uuid.uuid4().hex}"
        export.write(triples(spark, sf_dir, "nation", "region"), path, format)
        return read(spark, path).select("subject", "predicate", "object", "is_iri", "datatype").distinct()

    run.__doc__ = f"[K1 K4 S12] {format} written, and read back file by file."
    query(f"SELECT DISTINCT subject, predicate, object, is_iri, datatype FROM ({_REGION_NATION})")(_named(run, name))


def _named(f, name: str):
    f.__name__ = name
    return f


_back("turtle_round_trip", "turtle", rdf.read_turtle)
_back("rdfxml_round_trip", "rdfxml", rdf.read_rdfxml)


@query(f"SELECT DISTINCT subject, predicate, object, is_iri, datatype FROM ({_data_sql('customer', 'nation', types=True)}) WHERE predicate IN ('{S}name', '{R}')")
def store_round_trip(spark, sf_dir):
    """[K11 D9] by predicate."""
    path = f"{shared.folder(spark)}/store-{uuid.uuid4().hex}"
    store.write(triples(spark, sf_dir, "customer", "nation"), path)
    return store.read(spark, path, f"{S}name").unionByName(store.read(spark, path, R)).select("subject", "predicate", "object", "is_iri", "datatype")


@query(f"""WITH o AS ({_version_sql(_OLD)}), n AS ({_version_sql(_NEW)}) SELECT (SELECT count(*) FROM (SELECT * FROM n EXCEPT SELECT * FROM o)) AS added, (SELECT count(*) FROM (SELECT * FROM o EXCEPT SELECT * FROM n)) AS removed,
(SELECT count(*) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 = 0) AS modified, 'new' AS latest, CAST(2 AS BIGINT) AS snapshots""")
def snapshot_history(spark, sf_dir):
    """[K12 S13 C20]"""
    kept = store.Versions(spark, f"{shared.folder(spark)}/versions-{uuid.uuid4().hex}")
    for tag, version in zip(("old", "new"), _old_new(spark, sf_dir)):
        kept.snapshot(version, tag)
    d = kept.diff("old", "new")
    return spark.createDataFrame([(d["added"], d["removed"], d["modified"], kept.latest()["tag"], len(kept.list()))], "added long, removed long, modified long, latest string, snapshots long")


@query(f"""SELECT '{{"@id":"{NS}/Region/' || r_regionkey || '","predicate":"{S}name","object":"' || r_name || '"}}' AS value FROM region""")
def jsonld_each(spark, sf_dir):
    """[K14]"""
    return export.jsonld_each(C.table_triples(commerce.table(spark, sf_dir, "region"), NS))


@query(_values("subject, predicate, object, is_iri, datatype", [(f"{NS}/a", f"{NS}#knows", f"{NS}/b", True, None), (f"{NS}/a", f"{NS}#age", "7", False, f"{X}integer")]))
def manual_triples(spark, sf_dir):
    """[P11]"""
    rows = [{"subject": f"{NS}/a", "predicate": f"{NS}#knows", "object": f"{NS}/b", "is_iri": True}, {"subject": f"{NS}/a", "predicate": f"{NS}#age", "object": "7", "datatype": f"{X}integer"}]
    return C.manual_triples(spark, rows).select("subject", "predicate", "object", "is_iri", "datatype")


def _config(sf_dir: str) -> dict:
    """The commerce tables as a configuration, in the form of a file."""
    return config.normalize({
        "project": {"name": "commerce", "namespace": NS, "strict": True},
        "tables": [{"name": n, "source": f"{sf_dir}/{n}.parquet", "entity": e, "primary_key": k, "columns": {c: {"property": q} for c, q in p.items()}} for n, (e, k, p, _) in commerce.TABLES.items() if n in ("region", "nation", "customer", "orders")],
        "relationships": [{"name": r.name, "from": {"table": r.from_table, "column": r.from_column}, "to": {"table": r.to_table, "column": r.to_column}, "predicate": r.predicate, "inverse_predicate": r.inverse_predicate} for r in commerce.RELATIONSHIPS if r.from_table != "supplier"],
    })


_BUILT = _data_sql("region", "nation", "customer", "orders", types=True) + "".join(
    f" UNION ALL SELECT {_iri(r.from_table, commerce.TABLES[r.from_table][1])}, '{NS}#{p[3:]}', {_iri(r.to_table, r.from_column)}, true, NULL, 'edge' FROM {r.from_table}"
    for r in commerce.RELATIONSHIPS if r.from_table != "supplier" for p in (r.predicate, r.inverse_predicate) if p
)


@query(f"SELECT predicate, kind, count(*) AS n FROM ({_BUILT}) GROUP BY ALL")
def build_package(spark, sf_dir):
    """[C1 C2 C3 K11 K13 S16] a whole build; what is in its store, without catalog and provenance."""
    out = f"{shared.local(spark)}/build-{uuid.uuid4().hex}"
    build.build(spark, _config(sf_dir) | {"outputs": {"files": ["graph.nt"]}}, out)
    return store.read(spark, f"{out}/store").where("kind in ('data', 'type', 'edge')").groupBy("predicate", "kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(count(*) - count(DISTINCT l_orderkey) > 0 AS BOOLEAN) AS duplicate_key, true AS orphans, true AS strange_mask, true AS bad_namespace FROM lineitem")
def validate_config(spark, sf_dir):
    """[C2 J1 A2 A10] all errors of a bad configuration at once."""
    raw = {
        "project": {"namespace": "commerce"},
        "tables": [{"name": "l", "source": f"{sf_dir}/lineitem.parquet", "entity": "L", "primary_key": "l_orderkey", "columns": {"l_tax": {"mask": "rot13"}}}, {"name": "n", "source": f"{sf_dir}/nation.parquet", "entity": "N", "primary_key": "n_nationkey"}],
        "relationships": [{"from": {"table": "l", "column": "l_partkey"}, "to": {"table": "n", "column": "n_nationkey"}, "predicate": "ex:p"}],
    }
    errors = build.check(spark, config.normalize(raw))["errors"]
    has = lambda *parts: any(all(p in f"{e['path']} {e['message']}".lower() for p in parts) for e in errors)
    return spark.createDataFrame([(has("l_orderkey") or has("unique") or has("duplicate"), has("l_l_partkey_to_n") or has("orphan"), has("rot13"), has("namespace"))], "duplicate_key boolean, orphans boolean, strange_mask boolean, bad_namespace boolean")


@query(_values("statement, n", [("Class", 4), ("DatatypeProperty", 7), ("ObjectProperty", 3), ("inverseOf", 2), ("NodeShape", 4)]))
def ontology_and_shapes(spark, sf_dir):
    """[P15 P16 C29] statements by kind."""
    text = meta.ontology(_config(sf_dir)) + meta.shapes(_config(sf_dir))
    kinds = ("Class", "DatatypeProperty", "ObjectProperty", "inverseOf", "NodeShape")
    return spark.createDataFrame([(k, sum(f"owl:{k} " in line or f"sh:{k} " in line for line in text.splitlines())) for k in kinds], "statement string, n int")


# --- questions, policies -----------------------------------------------------------------------------------------------------------
def _schema() -> nl.Schema:
    return nl.Schema.of(commerce.TABLES, commerce.RELATIONSHIPS, NS)


@query("SELECT CAST(count(DISTINCT p_partkey) AS VARCHAR) AS \"count\" FROM part WHERE p_retailprice > 1500")
def plan_numeric_filter(spark, sf_dir):
    """[F10 C11 C13]"""
    return nl.answer(commerce.graph(spark, sf_dir), _schema(), "how many part cost above 1500")


@query("SELECT CAST(count(DISTINCT o_orderkey) AS VARCHAR) AS \"count\" FROM orders JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'vip'")
def plan_value_filter(spark, sf_dir):
    """[F9 C11] a value that no customer has: zero is the answer."""
    return nl.answer(commerce.graph(spark, sf_dir), _schema(), "how many order by a vip customer")


@query("SELECT CAST(7 AS BIGINT) AS rows, true AS regions_only")
def plan_limit(spark, sf_dir):
    """[T3] which rows a limit keeps is open; how many and of what is not."""
    found = nl.answer(commerce.graph(spark, sf_dir), _schema(), "show region limit 7")
    return found.agg(F.count("*").alias("rows"), F.every(F.startswith("entity", F.lit(f"{NS}/Region/"))).alias("regions_only"))


@query(_values("question, entities, steps, percent", [("count order with a nation", "Order,Nation", 2, 90), ("show everything", "Region", 0, 50), ("open order above 5 from a region", "Order,Region", 3, 95)]))
def plan_confidence(spark, sf_dir):
    """[C10 C11 C12 J7]"""
    planner = nl.Planner(_schema())
    plans = [planner.plan(q) for q in ("count order with a nation", "show everything", "open order above 5 from a region")]
    return spark.createDataFrame([(p.question, ",".join(p.entities), len(p.relationships), round(100 * p.confidence)) for p in plans], "question string, entities string, steps int, percent int")


_TEXTS = [("SELECT ?s WHERE { ?s ?p ?o }", True, 500), ("SELECT ?s WHERE { ?s ?p ?o } LIMIT 3", True, 3), ("INSERT DATA { <a:b> <a:c> <a:d> }", False, None), ("SELECT ?s WHERE { SERVICE <http://x.example> { ?s ?p ?o } }", False, None), ("SELECT ?s WHERE { ?s <a:secret> ?o }", False, None), ("SELECT ?s WHERE { ?s ?p ?o } #" + "x" * 100, False, None), ("SELECT ?s WHERE {", False, None)]


@query(_values("query, valid, \"limit\"", _TEXTS))
def query_policy(spark, sf_dir):
    """[F11 F12 T1] what a query's text may be, and the limit it gets."""
    rules = policy.QueryPolicy(max_characters=100, denied_terms=["secret"])
    out = []
    for text, *_ in _TEXTS:
        parsed, errors = rules.check(text)
        out.append((text, not errors, parsed.limit if parsed else None))
    return spark.createDataFrame(out, 'query string, valid boolean, limit int')


@query(_values("entity, \"column\"", [("Customer", "c_mktsegment"), ("Customer", "c_acctbal"), ("Order", "o_orderpriority")]))
def role_schema(spark, sf_dir):
    """[F15 C19]"""
    role = policy.Policies.from_config({"policies": [{"role": "analyst", "allow_entities": ["Customer", "Order"], "deny_properties": ["schema:name", "total"]}]}).of("analyst")
    return spark.createDataFrame([(t["entity"], c) for t in role.filter_schema(_schema().tables) for c in t["columns"]], "entity string, column string")


@query(f"SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT '[MASKED]', count(*) FROM customer WHERE c_acctbal IS NOT NULL")
def role_masked_triples(spark, sf_dir):
    """[F14 C19] denied names are gone and masked balances masked before the query runs, under any variable."""
    role = policy.Role(deny_properties=["schema:name", "c_nationkey"], mask_properties=["balance"])
    return role.filter_triples(C.table_triples(commerce.table(spark, sf_dir, "customer"), NS)).groupBy(F.col("object").alias("v")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT c_mktsegment) AS tokens, count(*) AS rows, count(*) AS well_formed, count(DISTINCT c_mktsegment) AS pairs FROM customer")
def mask_tokenize(spark, sf_dir):
    """[C4] a random token for each value, the same wherever the value stands."""
    shared.folder(spark)
    both = commerce.source(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_mktsegment").alias("token"))
    made = mask.apply(both, {"token": "tokenize"})
    return made.agg(F.count_distinct("token").alias("tokens"), F.count("*").alias("rows"), F.count_if(F.rlike("token", F.lit("^TOK-[0-9a-f]{12}$"))).alias("well_formed"), F.count_distinct("token", "c_mktsegment").alias("pairs"))


_NAMES = [("c_name", "PERSON"), ("work_email", "EMAIL_ADDRESS"), ("ship_ip", "IP_ADDRESS"), ("home_phone", "PHONE_NUMBER"), ("zip", "LOCATION")]


@query(_values("\"column\", kind", _NAMES))
def detect_pii(spark, sf_dir):
    """[C5] ip is no part of description."""
    return spark.createDataFrame(list(mask.detect([n for n, _ in _NAMES] + ["description", "balance"]).items()), "column string, kind string")


ask("sparql_bound_coalesce_in", 'SELECT ?c ?v WHERE { ?c a ex:Customer ; ex:segment ?s OPTIONAL { ?o ex:placedBy ?c ; ex:priority "1-URGENT" } FILTER(?s IN ("BUILDING", "MACHINERY") && !BOUND(?o)) BIND(COALESCE(?o, "none") AS ?v) }', f"SELECT {_C} AS c, 'none' AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
ask("sparql_term_tests", "SELECT ?d (COUNT(*) AS ?n) WHERE { ?o ex:totalAmount ?t BIND(DATATYPE(?t) AS ?d) FILTER(isIRI(?o) && isLITERAL(?t) && LANG(?t) = \"\") } GROUP BY ?d", f"SELECT '{X}double' AS d, CAST(count(*) AS VARCHAR) AS n FROM orders")
ask("sparql_sample", "SELECT ?r (SAMPLE(?name) AS ?one) WHERE { ?n ex:inRegion ?r ; schema:name ?name } GROUP BY ?r", f"SELECT '{NS}/Region/' || n_regionkey AS r, min(n_name) AS one FROM nation GROUP BY n_regionkey")
ask("sparql_constant_subject", f"SELECT ?p ?o WHERE {{ <{NS}/Customer/7> ?p ?o }}", f"SELECT DISTINCT predicate AS p, object AS o FROM ({_ALL}) WHERE subject = '{NS}/Customer/7'")


# --- streaming ---------------------------------------------------------------------------------------------------------
@query(f"SELECT '{NS}/Event/' || event_id AS subject, '{NS}/event_type' AS predicate, event_type AS object FROM events UNION ALL SELECT '{NS}/Event/' || event_id, '{R}', '{NS}#Event' FROM events")
def stream_append_triples(spark, sf_dir):
    """[2.11, an extension] Structured Streaming through the batch operators."""
    from ..streaming import append

    folder = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = commerce.source(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", "event_type")
    append.append(C.Table("events", rows, "Event", "event_id", {"event_type": f"{NS}/event_type"}), NS, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("subject", "predicate", "object")
