"""Graphs, calls and texts made from relational tables, in SQL that any engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Graph
from .session import table

_NODE = "CAST('shop' AS {s}) AS project_id, {id} AS id, {path} AS file_path, {name} AS name, {qn} AS qualified_name, '{kind}' AS kind, {lang} AS language, CAST({line} AS INT) AS start_line, CAST({line} + 10 AS INT) AS end_line, {sig} AS signature, {doc} AS docstring, CAST({cx} AS INT) AS complexity, {exported} AS is_exported, {test} AS is_test, {entry} AS is_entry_point, CAST({conf} AS DOUBLE) AS extraction_confidence, 'main' AS branch"


def _node(**k: str) -> str:
    return _NODE.format(s="VARCHAR(20)", **k)


NODE_SQL = f"""
SELECT {_node(id="concat('r:', r_regionkey)", path="'region/all'", name="r_name", qn="concat('region.', r_name)", kind="Region", lang="'geo'", line="r_regionkey", sig="CAST(NULL AS VARCHAR(1))", doc="CAST(NULL AS VARCHAR(1))", cx="0", exported="true", test="false", entry="r_regionkey = 0", conf="1.0")} FROM {{region}}
UNION ALL SELECT {_node(id="concat('n:', n_nationkey)", path="concat('nation/', n_regionkey)", name="n_name", qn="concat('nation.', n_name)", kind="Nation", lang="'geo'", line="n_nationkey", sig="CAST(NULL AS VARCHAR(1))", doc="concat('Nation in region ', n_regionkey)", cx="n_nationkey", exported="true", test="false", entry="false", conf="0.9")} FROM {{nation}}
UNION ALL SELECT {_node(id="concat('c:', c_custkey)", path="concat('customer/', c_mktsegment)", name="c_name", qn="concat('customer.', c_name)", kind="Customer", lang="c_mktsegment", line="c_custkey", sig="concat('customer(', c_nationkey, ')')", doc="CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN NULL ELSE concat('Customer of nation ', c_nationkey) END", cx="c_custkey % 10", exported="c_acctbal > 0", test="c_custkey % 7 = 0", entry="false", conf="least(1.0, greatest(0.0, c_acctbal / 10000.0))")} FROM {{customer}}
UNION ALL SELECT {_node(id="concat('s:', s_suppkey)", path="concat('supplier/', s_nationkey)", name="s_name", qn="concat('supplier.', s_name)", kind="Supplier", lang="'supply'", line="s_suppkey", sig="concat('supplier(', s_nationkey, ')')", doc="''", cx="s_suppkey % 15", exported="s_acctbal > 0", test="false", entry="false", conf="0.8")} FROM {{supplier}}
UNION ALL SELECT {_node(id="concat('p:', p_partkey)", path="concat('part/', p_brand)", name="p_name", qn="concat('part.', p_partkey)", kind="Part", lang="p_brand", line="p_partkey", sig="concat('part(', p_size, ')')", doc="p_type", cx="p_size", exported="p_size > 25", test="false", entry="false", conf="least(1.0, p_retailprice / 2000.0)")} FROM {{part}}
UNION ALL SELECT {_node(id="concat('o:', o_orderkey)", path="concat('orders/', o_orderpriority)", name="concat('order_', o_orderkey)", qn="concat('orders.order_', o_orderkey)", kind="Order", lang="o_orderpriority", line="o_orderkey", sig="concat('order(', o_orderstatus, ')')", doc="CAST(NULL AS VARCHAR(1))", cx="o_orderkey % 10", exported="o_totalprice > 100000", test="o_orderkey % 11 = 0", entry="o_orderstatus = 'O'", conf="0.5 + (o_orderkey % 50) / 100.0")} FROM {{orders}}
"""
EDGE_SQL = """
SELECT 'shop' AS project_id, concat('o:', o_orderkey) AS from_id, concat('c:', o_custkey) AS to_id, 'CALLS' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM {orders}
UNION ALL SELECT 'shop', concat('c:', c_custkey), concat('n:', c_nationkey), 'CALLS', CAST(0.9 AS DOUBLE) FROM {customer}
UNION ALL SELECT 'shop', concat('s:', s_suppkey), concat('n:', s_nationkey), 'CALLS', CAST(0.8 AS DOUBLE) FROM {supplier}
UNION ALL SELECT 'shop', concat('n:', n_nationkey), concat('r:', n_regionkey), 'CALLS', CAST(0.7 AS DOUBLE) FROM {nation}
UNION ALL SELECT 'shop', concat('o:', l_orderkey), concat('p:', l_partkey), 'READS', max(1.0 - l_discount) FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'shop', concat('p:', l_partkey), concat('s:', l_suppkey), 'IMPORTS', max(1.0 - l_tax) FROM {lineitem} GROUP BY l_partkey, l_suppkey
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: SQL's common table expressions of the same graph.
GRAPH_CTE = "g_nodes AS ({}), g_edges AS ({})".format(*(s.format(**{t: t for t in TABLES}) for s in (NODE_SQL, EDGE_SQL)))

#: Steps of users from one kind of event to the next: a graph with cycles and self-edges.
STEPS_SQL = """
SELECT DISTINCT 'steps' AS project_id, concat(user_id, '/', event_type) AS from_id, concat(user_id, '/', nxt) AS to_id, 'CALLS' AS kind, CAST(1.0 AS DOUBLE) AS confidence
FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM {events}) x WHERE nxt IS NOT NULL
"""
STEPS_CTE = "steps AS ({})".format(STEPS_SQL.format(events="events"))

#: Calls of tools from events: a session is a user, a tool is an event type.
CALLS_SQL = """
SELECT event_id AS call_id, concat('u', user_id) AS session_id, event_type AS tool, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE '' END AS complexity_tier,
CAST(floor(value * 100) AS BIGINT) AS response_bytes, CAST(floor(value) AS BIGINT) AS tokens_used, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value * 3) AS BIGINT) END AS tokens_saved,
CASE WHEN event_type = 'error' THEN NULL ELSE floor(value * 50) / 100 END AS tokens_saved_pct, ts, props FROM {events}
"""
CALLS_CTE = "calls AS ({})".format(CALLS_SQL.format(events="events"))


def _tables(spark: SparkSession, d: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in names}


def entity_graph(spark: SparkSession, d: str) -> Graph:
    """Orders, customers, nations, regions, suppliers and parts with their references."""
    t = _tables(spark, d, TABLES)
    return Graph(spark.sql(NODE_SQL, **{k: v for k, v in t.items() if k != "lineitem"}), spark.sql(EDGE_SQL, **{k: v for k, v in t.items() if k not in ("region", "part")}), "shop")


def step_edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(STEPS_SQL, events=table(spark, d, "events"))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(CALLS_SQL, events=table(spark, d, "events"))
