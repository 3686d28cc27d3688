"""Queries of the engine by name, with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import orphans, skew
from ..session import table
from . import audit_queries, form_queries, graph_queries, resolve_queries, search_queries, source_queries, upkeep_queries

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_keys({"pending_edges": (table(spark, d, "pending_edges"), "to_name"), "blast_rows": (table(spark, d, "blast_rows"), "qualified_name")})


def p2_edges_per_name(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_key(table(spark, d, "pending_edges"), "to_name", "from_qn", "confidence")


def p2_callers_per_name(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_key(table(spark, d, "blast_rows"), "qualified_name", "id", "depth")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_edges(*(table(spark, d, t) for t in ("pending_edges", "symbols", "known_externals")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*(table(spark, d, t) for t in ("pending_edges", "symbols", "known_externals")))


P2_FOUND = """
SELECT 'pending_edges' AS table_name, to_name AS key_value FROM pending_edges WHERE to_name IS NOT NULL GROUP BY to_name
HAVING count(*) * 50 >= (SELECT count(*) FROM pending_edges)
UNION ALL
SELECT 'blast_rows', qualified_name FROM blast_rows WHERE qualified_name IS NOT NULL GROUP BY qualified_name
HAVING count(*) * 50 >= (SELECT count(*) FROM blast_rows)
"""
PER_KEY = """
SELECT {key} AS key_value, count(*) AS n_rows, count(DISTINCT {caller}) AS n_callers, round(avg({value}) + 1e-9, 6) AS mean_value, min({value}) AS min_value, max({value}) AS max_value
FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}
"""
_CLEAN = "regexp_replace(regexp_replace({0}, '^[\\s\"''`]+', ''), '([\\s\"''`]|\\([^()]*\\))+$', '')"
_ORPHANS = """
WITH in_force AS (SELECT project_id, name, qualified_name FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY indexed_at DESC, deleted_at IS NOT NULL DESC) AS k FROM symbols) WHERE k = 1 AND deleted_at IS NULL),
names AS (SELECT project_id, name AS n FROM in_force UNION SELECT project_id, qualified_name FROM in_force),
once AS (SELECT DISTINCT edge_id, project_id, from_qn, to_name, seen_at FROM pending_edges),
refs AS (
  SELECT edge_id, project_id, seen_at, 'from_qn' AS ref_field, {from_qn} AS n FROM once
  UNION ALL SELECT edge_id, project_id, seen_at, 'to_name', {to_name} FROM once),
orphans AS (SELECT r.* FROM refs r LEFT JOIN names USING (project_id, n) LEFT JOIN known_externals x ON x.ext_name = r.n AND ref_field = 'to_name'
  WHERE n <> '' AND names.n IS NULL AND ext_name IS NULL)
""".format(from_qn=_CLEAN.format("from_qn"), to_name=_CLEAN.format("to_name"))
P5_FOUND = _ORPHANS + "SELECT DISTINCT edge_id, ref_field FROM orphans"
P5_COUNTS = _ORPHANS + """SELECT 'pending_edges' AS table_name, ref_field, strftime(seen_at, '%Y-%m') AS month, count(*) AS n_orphans, count(DISTINCT (project_id, n)) AS n_keys FROM orphans GROUP BY ALL"""


def queries() -> dict[str, Query]:
    return graph_queries.queries() | audit_queries.queries() | resolve_queries.queries() | search_queries.queries() | source_queries.queries() | upkeep_queries.queries() | form_queries.queries() | {f.__name__: f for f in (p2_found, p2_edges_per_name, p2_callers_per_name, p5_found, p5_counts)}


def oracle_sql() -> dict[str, str]:
    return graph_queries.oracle_sql() | audit_queries.oracle_sql() | resolve_queries.oracle_sql() | search_queries.oracle_sql() | source_queries.oracle_sql() | upkeep_queries.oracle_sql() | form_queries.oracle_sql() | {
        "p2_found": P2_FOUND,
        "p5_found": P5_FOUND,
        "p5_counts": P5_COUNTS,
        "p2_edges_per_name": PER_KEY.format(table="pending_edges", key="to_name", caller="from_qn", value="confidence"),
        "p2_callers_per_name": PER_KEY.format(table="blast_rows", key="qualified_name", caller="id", value="depth"),
    }
