"""A code graph over the supplied tables.

Regions and nations are modules, customers and suppliers classifiers, orders and supplied parts
callables. The derivation is one statement per relation, given tables by name, so the engine and a
checking database read the same graph.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"]

_PLACE = "(SELECT n_nationkey, r_regionkey, r_name, n_name, r_name || '.' || n_name AS q FROM {nation} JOIN {region} ON n_regionkey = r_regionkey)"
_SUPPLIED = "(SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem})"

BASE = f"""
SELECT 'module' AS node_type, r_name AS language, r_name AS qualified_name, r_name || '/mod.src' AS file_path,
       CAST(1 AS BIGINT) AS start_line, CAST(100 AS BIGINT) AS end_line,
       CAST(NULL AS STRING) AS parent_type, CAST(NULL AS STRING) AS parent_language, CAST(NULL AS STRING) AS parent_name FROM {{region}}
UNION ALL SELECT 'module', n_name, q, r_name || '/' || n_name || '/mod.src', CAST(1 AS BIGINT), CAST(100 AS BIGINT), 'module', r_name, r_name FROM {_PLACE} p
UNION ALL SELECT 'classifier', c_mktsegment, q || '.' || c_name, r_name || '/' || n_name || '/' || c_name || '.src',
       CAST(1 AS BIGINT), CAST(1000 AS BIGINT), 'module', n_name, q FROM {{customer}} JOIN {_PLACE} p ON c_nationkey = n_nationkey
UNION ALL SELECT 'classifier', n_name, q || '.' || s_name, r_name || '/' || n_name || '/' || s_name || '.src',
       CAST(1 AS BIGINT), CAST(1000 AS BIGINT), 'module', n_name, q FROM {{supplier}} JOIN {_PLACE} p ON s_nationkey = n_nationkey
UNION ALL SELECT 'callable', o_orderpriority, q || '.' || c_name || '.O' || CAST(o_orderkey AS STRING), r_name || '/' || n_name || '/' || c_name || '.src',
       CAST(o_orderkey % 900 + 2 AS BIGINT), CAST(o_orderkey % 900 + 2 + o_orderkey % 60 AS BIGINT), 'classifier', c_mktsegment, q || '.' || c_name
       FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {_PLACE} p ON c_nationkey = n_nationkey
UNION ALL SELECT 'callable', 'part', q || '.' || s_name || '.P' || CAST(l_partkey AS STRING), r_name || '/' || n_name || '/' || s_name || '.src',
       CAST(l_partkey % 900 + 2 AS BIGINT), CAST(l_partkey % 900 + 2 + l_partkey % 40 AS BIGINT), 'classifier', n_name, q || '.' || s_name
       FROM {_SUPPLIED} x JOIN {{supplier}} ON l_suppkey = s_suppkey JOIN {_PLACE} p ON s_nationkey = n_nationkey
"""

NODES = f"SELECT sha1(node_type || ':' || language || ':' || qualified_name) AS structural_id, node_type, language, qualified_name, file_path, start_line, end_line FROM ({BASE}) b"

CONTAINS = f"""SELECT sha1(parent_type || ':' || parent_language || ':' || parent_name) AS src, sha1(node_type || ':' || language || ':' || qualified_name) AS dst,
'LEXICALLY_CONTAINS' AS edge_type FROM ({BASE}) b WHERE parent_name IS NOT NULL"""

_MODULE = "sha1('module:' || {a}n_name || ':' || {a}q)"
IMPORTS = f"""SELECT DISTINCT {_MODULE.replace('{a}', 'a.')} AS src, {_MODULE.replace('{a}', 'b.')} AS dst, 'IMPORTS_DECLARED' AS edge_type
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN {_PLACE} a ON c_nationkey = a.n_nationkey JOIN {_PLACE} b ON s_nationkey = b.n_nationkey
WHERE c_nationkey <> s_nationkey AND a.r_regionkey = b.r_regionkey"""
#: A sparser import graph, with modules outside every cycle.
FEW_IMPORTS = IMPORTS.replace("a.r_regionkey = b.r_regionkey", "l_orderkey < 15")

_SUPPLIER = f"SELECT s_suppkey, sha1('classifier:' || n_name || ':' || q || '.' || s_name) AS id FROM {{supplier}} JOIN {_PLACE} p ON s_nationkey = n_nationkey"
EXTENDS = f"""SELECT a.id AS src, b.id AS dst, 'EXTENDS' AS edge_type FROM ({_SUPPLIER}) a JOIN ({_SUPPLIER}) b
ON b.s_suppkey = CASE a.s_suppkey % 3 WHEN 0 THEN a.s_suppkey + 1 WHEN 1 THEN a.s_suppkey - 1 ELSE a.s_suppkey END"""

CALLS = f"""SELECT DISTINCT sha1('callable:' || o_orderpriority || ':' || a.q || '.' || c_name || '.O' || CAST(o_orderkey AS STRING)) AS src,
sha1('callable:part:' || b.q || '.' || s_name || '.P' || CAST(l_partkey AS STRING)) AS dst, 'CALLS' AS edge_type
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN {_PLACE} a ON c_nationkey = a.n_nationkey JOIN {_PLACE} b ON s_nationkey = b.n_nationkey"""

STRUCTURE = f"{CONTAINS} UNION ALL {IMPORTS} UNION ALL {EXTENDS}"
RELATIONS = {"nodes": NODES, "contains": CONTAINS, "imports": IMPORTS, "few_imports": FEW_IMPORTS, "extends": EXTENDS, "calls": CALLS, "structure": STRUCTURE}


class Graph:
    """Relations of the graph and the plain tables, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._read = partial(self._table, sf_dir)

    def _table(self, sf_dir: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def _calls(self) -> DataFrame:
        """CALLS with repeated shipments taken out by their narrow keys, before the joins; the keys make the ids unique."""
        items = self._read("lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
        sql = CALLS.replace("SELECT DISTINCT sha1", "SELECT sha1", 1)
        return self.spark.sql(sql, lineitem=items, **{t: self._read(t) for t in TABLES if t != "lineitem" and "{" + t + "}" in sql})

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self._read(name)
        if name == "calls":
            return self._calls()
        if name in RELATIONS:
            sql = RELATIONS[name]
            return self.spark.sql(sql, **{t: self._read(t) for t in TABLES if "{" + t + "}" in sql})
        raise AttributeError(name)


def oracle(sql: str) -> str:
    """A statement for the checking database: @name stands for a relation of the graph."""
    for name in sorted(RELATIONS, key=len, reverse=True):
        sql = sql.replace(f"@{name}", "(" + RELATIONS[name].format(**{t: t for t in TABLES}) + ")")
    return sql
