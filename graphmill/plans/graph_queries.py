"""Queries over the entity graph in the pattern language, each with SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import GRAPH_CTE, STEPS_CTE, entity_graph, step_edges
from ..catalog import Graph
from ..operators import traverse
from . import pattern

N = "project_id, id, file_path, name, qualified_name, kind, language, start_line, end_line, signature, docstring, complexity, is_exported, is_test, is_entry_point, extraction_confidence, branch"

#: name: (query, SQL after the graph's common table expressions, most rows)
PATTERNS: dict[str, tuple[str, str, int | None]] = {
    "node_scan_filter": ("MATCH (n:Order) WHERE n.complexity > 7 RETURN n.id, n.complexity ORDER BY n.start_line", "SELECT id AS \"n.id\", complexity AS \"n.complexity\" FROM g_nodes WHERE kind = 'Order' AND complexity > 7 ORDER BY start_line, id", None),
    "inline_props": ("MATCH (n:Customer {language: 'BUILDING', is_test: true}) RETURN n.name, n.qn ORDER BY n.name", "SELECT name AS \"n.name\", qualified_name AS \"n.qn\" FROM g_nodes WHERE kind = 'Customer' AND language = 'BUILDING' AND is_test ORDER BY name, id", None),
    "unknown_inline_prop": ("MATCH (n:Nation {nothing: 1}) RETURN n.name", "SELECT name AS \"n.name\" FROM g_nodes WHERE false", None),
    "eq_null_zero": ("MATCH (n:Customer) WHERE n.docstring = '' RETURN n.id ORDER BY n.id", "SELECT id AS \"n.id\" FROM g_nodes WHERE kind = 'Customer' AND (docstring IS NULL OR docstring = '') ORDER BY id", None),
    "neq_null": ("MATCH (n:Customer) WHERE n.docstring <> 'Customer of nation 3' RETURN COUNT(*) AS k", "SELECT count(*) AS k FROM g_nodes WHERE kind = 'Customer' AND (docstring IS NULL OR docstring <> 'Customer of nation 3')", None),
    "neq_empty": ("MATCH (n:Customer) WHERE n.docstring <> '' RETURN COUNT(*) AS k", "SELECT count(*) AS k FROM g_nodes WHERE kind = 'Customer' AND docstring IS NOT NULL AND docstring <> ''", None),
    "contains_ci": ("MATCH (n:Part) WHERE n.docstring CONTAINS 'O' RETURN n.id ORDER BY n.id", "SELECT id AS \"n.id\" FROM g_nodes WHERE kind = 'Part' AND contains(lower(docstring), 'o') ORDER BY id", None),
    "starts_with": ("MATCH (n:Customer) WHERE n.name STARTS WITH 'customer#00000001' RETURN n.name", "SELECT name AS \"n.name\" FROM g_nodes WHERE kind = 'Customer' AND starts_with(lower(name), 'customer#00000001') ORDER BY id", None),
    "ends_with": ("MATCH (n) WHERE n.name ENDS WITH '77' RETURN n.id ORDER BY n.id", "SELECT id AS \"n.id\" FROM g_nodes WHERE ends_with(lower(name), '77') ORDER BY id", None),
    "regex_match": ("MATCH (n:Order) WHERE n.name =~ '_[0-9]*5$' RETURN n.name ORDER BY n.name", "SELECT name AS \"n.name\" FROM g_nodes WHERE kind = 'Order' AND regexp_matches(name, '_[0-9]*5$') ORDER BY name, id", None),
    "in_list": ("MATCH (n) WHERE n.kind IN ['Region', 'Nation'] AND n.complexity IN [0, 3, 24] RETURN n.id, n.kind", "SELECT id AS \"n.id\", kind AS \"n.kind\" FROM g_nodes WHERE kind IN ('Region', 'Nation') AND complexity IN (0, 3, 24)", None),
    "is_null_or_empty": ("MATCH (n) WHERE n.docstring IS NULL RETURN n.kind, COUNT(*) AS k", "SELECT kind AS \"n.kind\", count(*) AS k FROM g_nodes WHERE docstring IS NULL OR docstring = '' GROUP BY kind", None),
    "is_not_null": ("MATCH (n) WHERE n.docstring IS NOT NULL RETURN n.kind, COUNT(*) AS k", "SELECT kind AS \"n.kind\", count(*) AS k FROM g_nodes WHERE docstring IS NOT NULL AND docstring <> '' GROUP BY kind", None),
    "not_paren_or": ("MATCH (n) WHERE NOT (n.kind = 'Order' OR n.kind = 'Part') AND n.is_exported = true RETURN n.kind, COUNT(*) AS k", "SELECT kind AS \"n.kind\", count(*) AS k FROM g_nodes WHERE NOT (kind = 'Order' OR kind = 'Part') AND is_exported GROUP BY kind", None),
    "bool_bare": ("MATCH (n:Order) WHERE n.is_entry_point RETURN n.language, COUNT(*) AS k", "SELECT language AS \"n.language\", count(*) AS k FROM g_nodes WHERE kind = 'Order' AND is_entry_point GROUP BY language", None),
    "text_order_compare": ("MATCH (n:Nation) WHERE n.name >= 'M' RETURN n.name", "SELECT name AS \"n.name\" FROM g_nodes WHERE kind = 'Nation' AND name >= 'M'", None),
    "column_compare": ("MATCH (n) WHERE n.end_line > n.complexity AND n.kind = 'Supplier' RETURN COUNT(*) AS k", "SELECT count(*) AS k FROM g_nodes WHERE end_line > complexity AND kind = 'Supplier'", None),
    "distinct_lang": ("MATCH (n) RETURN DISTINCT n.kind, n.language ORDER BY n.language", "SELECT DISTINCT kind AS \"n.kind\", language AS \"n.language\" FROM g_nodes", None),
    "order_limit_topk": ("MATCH (n) RETURN n.id, n.confidence AS c ORDER BY c DESC LIMIT 50", "SELECT id AS \"n.id\", extraction_confidence AS c FROM g_nodes ORDER BY c DESC, project_id, id LIMIT 50", 200),
    "order_hidden_key": ("MATCH (n:Part) RETURN n.name ORDER BY n.start_line DESC LIMIT 40", "SELECT name AS \"n.name\" FROM g_nodes WHERE kind = 'Part' ORDER BY start_line DESC, id LIMIT 40", 200),
    "count_star": ("MATCH (n) RETURN COUNT(*)", "SELECT count(*) AS \"COUNT(*)\" FROM g_nodes", None),
    "count_prop_nonnull": ("MATCH (n) RETURN n.kind, COUNT(n.docstring) AS docs", "SELECT kind AS \"n.kind\", count(docstring) AS docs FROM g_nodes GROUP BY kind", None),
    "count_distinct": ("MATCH (n) RETURN COUNT(DISTINCT n.language) AS langs", "SELECT count(DISTINCT language) AS langs FROM g_nodes", None),
    "sum_empty_zero": ("MATCH (n:Nothing) RETURN SUM(n.complexity) AS s, AVG(n.complexity) AS a, MIN(n.complexity) AS lo", "SELECT CAST(0.0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS lo", None),
    "avg_min_max_numeric": ("MATCH (n:Part) RETURN AVG(n.complexity) AS a, MIN(n.complexity) AS lo, MAX(n.complexity) AS hi, SUM(n.complexity) AS s, MAX(n.name) AS none", "SELECT avg(complexity) AS a, CAST(min(complexity) AS DOUBLE) AS lo, CAST(max(complexity) AS DOUBLE) AS hi, CAST(sum(complexity) AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS none FROM g_nodes WHERE kind = 'Part'", None),
    "group_by_agg_order": ("MATCH (n:Order) WHERE n.complexity > 3 RETURN n.language, COUNT(*) AS k ORDER BY k DESC", "SELECT language AS \"n.language\", count(*) AS k FROM g_nodes WHERE kind = 'Order' AND complexity > 3 GROUP BY language", None),
    "group_limit_default": ("MATCH (n) RETURN n.file_path, COUNT(*) AS k ORDER BY k DESC", "SELECT file_path AS \"n.file_path\", count(*) AS k FROM g_nodes GROUP BY file_path ORDER BY k DESC, file_path LIMIT 200", 200),
    "one_hop_join": ("MATCH (a:Order)-[:CALLS]->(b:Customer) WHERE b.language = 'BUILDING' AND a.complexity < 2 RETURN a.id, b.name ORDER BY a.id", "SELECT a.id AS \"a.id\", b.name AS \"b.name\" FROM g_edges e JOIN g_nodes a ON a.id = e.from_id JOIN g_nodes b ON b.id = e.to_id WHERE e.kind = 'CALLS' AND a.kind = 'Order' AND b.kind = 'Customer' AND b.language = 'BUILDING' AND a.complexity < 2 ORDER BY a.id, b.id", None),
    "one_hop_any_kind": ("MATCH (a)-[r]->(b) RETURN r.kind, COUNT(*) AS k", "SELECT kind AS \"r.kind\", count(*) AS k FROM g_edges GROUP BY kind", None),
    "edge_props_dedup_max": ("MATCH (a:Part)-[r:IMPORTS|READS]->(b) WHERE r.confidence >= 0.95 RETURN b.kind, COUNT(*) AS k, AVG(r.confidence) AS c", "SELECT b.kind AS \"b.kind\", count(*) AS k, avg(e.confidence) AS c FROM g_edges e JOIN g_nodes a ON a.id = e.from_id JOIN g_nodes b ON b.id = e.to_id WHERE a.kind = 'Part' AND e.kind IN ('IMPORTS', 'READS') AND e.confidence >= 0.95 GROUP BY b.kind", None),
    "join_group_count": ("MATCH (a:Customer)-[:CALLS]->(b:Nation) RETURN b.name, COUNT(a) AS customers, SUM(a.complexity) AS s ORDER BY customers DESC", "SELECT b.name AS \"b.name\", count(*) AS customers, CAST(sum(a.complexity) AS DOUBLE) AS s FROM g_edges e JOIN g_nodes a ON a.id = e.from_id JOIN g_nodes b ON b.id = e.to_id WHERE e.kind = 'CALLS' AND a.kind = 'Customer' AND b.kind = 'Nation' GROUP BY b.name", None),
}
_WALK = """, walk(start, id, depth) AS (SELECT from_id, to_id, 1 FROM {links} UNION SELECT w.start, l.to_id, w.depth + 1 FROM walk w JOIN {links} l ON l.from_id = w.id WHERE w.depth < {high})"""
_NORMAL = "links AS (SELECT DISTINCT from_id, to_id FROM g_edges WHERE kind = 'CALLS')"
_PATHS: dict[str, tuple[str, str, int]] = {
    "bfs_1_3": ("MATCH (a:Order)-[:CALLS*1..3]->(b) RETURN b.kind, COUNT(*) AS k", "SELECT b.kind AS \"b.kind\", count(*) AS k FROM (SELECT start, id, min(depth) AS depth FROM walk WHERE id <> start GROUP BY ALL) w JOIN g_nodes a ON a.id = w.start JOIN g_nodes b ON b.id = w.id WHERE a.kind = 'Order' GROUP BY b.kind", 3),
    "bfs_inbound": ("MATCH (a)-[:CALLS*1..2]->(b) WHERE b.id = 'n:3' RETURN a.id ORDER BY a.id", "SELECT a.id AS \"a.id\" FROM (SELECT DISTINCT start, id FROM walk WHERE id = 'n:3' AND id <> start) w JOIN g_nodes a ON a.id = w.start ORDER BY a.id", 2),
    "bfs_residual_where": ("MATCH (a:Customer)-[:CALLS*1..2]->(b) WHERE b.name CONTAINS 'A' AND a.is_test RETURN b.name, COUNT(*) AS k", "SELECT b.name AS \"b.name\", count(*) AS k FROM (SELECT DISTINCT start, id FROM walk WHERE id <> start) w JOIN g_nodes a ON a.id = w.start JOIN g_nodes b ON b.id = w.id WHERE a.kind = 'Customer' AND contains(b.name, 'A') AND a.is_test GROUP BY b.name", 2),
}


def _pattern(text: str, rows: int | None):
    def fn(spark: SparkSession, d: str) -> DataFrame:
        return pattern.run(entity_graph(spark, d), text, max_rows=rows).df

    return fn


def _starts(df: DataFrame) -> DataFrame:
    return df.select("project_id", F.col("from_id").alias("start")).distinct()


def bfs_2_3_walks(spark: SparkSession, d: str) -> DataFrame:
    """Walks of two to three steps in a graph with cycles."""
    e = step_edges(spark, d)
    return traverse.walks(e, _starts(e), ["CALLS"], 2, 3).select("start", "id", "depth")


def trace_both(spark: SparkSession, d: str) -> DataFrame:
    e = step_edges(spark, d)
    return traverse.trace(e, _starts(e), "both", None, 2).select("start", "id", "depth", "via")


def closure_d3(spark: SparkSession, d: str) -> DataFrame:
    return traverse.closure(step_edges(spark, d), 3).select("from_id", "to_id", "depth", "via_kind")


def trace_from_parts(spark: SparkSession, d: str) -> DataFrame:
    """What imports and reads reach from parts, with the least kind of the last edge."""
    g = entity_graph(spark, d)
    starts = g.nodes.where("kind = 'Part' and complexity > 40").select("project_id", F.col("id").alias("start"))
    found = traverse.trace(g.edges, starts, "outbound", ["IMPORTS", "CALLS"], 3)
    return traverse.hops(found, g.nodes).groupBy("risk", "via", "kind").agg(F.count(F.lit(1)).alias("k"))


def self_loop(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a node to itself in a graph that has some."""
    e = step_edges(spark, d)
    n = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().select(F.lit("steps").alias("project_id"), "id", F.col("id").alias("name"), F.substring_index("id", "/", -1).alias("kind"))
    return pattern.run(Graph(n, e, "steps"), "MATCH (a)-[:CALLS]->(a) RETURN a.id, a.kind", max_rows=None).df


def trace_by_closure(spark: SparkSession, d: str) -> DataFrame:
    """The inbound trace of errors, read off the closure."""
    e = step_edges(spark, d)
    starts = e.where("to_id like '%/error'").select("project_id", F.col("to_id").alias("start"))
    return traverse.trace_closed(traverse.closure(e, 3), starts, "callers", 2).select("start", "id", "depth", "via")


def queries() -> dict:
    out = {k: _pattern(text, rows) for k, (text, _, rows) in PATTERNS.items()}
    out |= {k: _pattern(text, None) for k, (text, _, _) in _PATHS.items()}
    return out | {f.__name__: f for f in (bfs_2_3_walks, trace_both, closure_d3, trace_from_parts, self_loop, trace_by_closure)}


def oracle_sql() -> dict[str, str]:
    out = {k: f"WITH {GRAPH_CTE} {sql}" for k, (_, sql, _) in PATTERNS.items()}
    out |= {k: f"WITH RECURSIVE {GRAPH_CTE}, {_NORMAL}{_WALK.format(links='links', high=high)} {sql}" for k, (_, sql, high) in _PATHS.items()}
    out["bfs_2_3_walks"] = f"WITH RECURSIVE {STEPS_CTE}{_WALK.format(links='steps', high=3)} SELECT start, id, min(depth) AS depth FROM walk WHERE depth >= 2 AND id <> start GROUP BY start, id"
    back = _WALK.format(links="turned", high=2).replace("walk", "back")
    out["trace_both"] = f"""WITH RECURSIVE {STEPS_CTE}, turned AS (SELECT to_id AS from_id, from_id AS to_id FROM steps){_WALK.format(links='steps', high=2)}{back}
      SELECT start, id, min(depth) AS depth, 'CALLS' AS via FROM (SELECT * FROM walk UNION ALL SELECT * FROM back WHERE start IN (SELECT from_id FROM steps)) WHERE id <> start GROUP BY start, id"""
    out["closure_d3"] = f"WITH RECURSIVE {STEPS_CTE}{_WALK.format(links='steps', high=3)} SELECT start AS from_id, id AS to_id, min(depth) AS depth, 'CALLS' AS via_kind FROM walk WHERE id <> start GROUP BY start, id"
    out["self_loop"] = f"WITH {STEPS_CTE} SELECT from_id AS \"a.id\", regexp_extract(from_id, '[^/]*$') AS \"a.kind\" FROM steps WHERE from_id = to_id"
    out["trace_by_closure"] = f"WITH RECURSIVE {STEPS_CTE}, turned AS (SELECT to_id AS from_id, from_id AS to_id FROM steps){_WALK.format(links='turned', high=2)} SELECT start, id, min(depth) AS depth, 'CALLS' AS via FROM walk WHERE id <> start AND start LIKE '%/error' GROUP BY start, id"
    out["trace_from_parts"] = f"""WITH RECURSIVE {GRAPH_CTE}, links AS (SELECT DISTINCT from_id, to_id, kind FROM g_edges WHERE kind IN ('IMPORTS', 'CALLS')),
      walk(start, id, depth, via) AS (SELECT from_id, to_id, 1, l.kind FROM links l JOIN g_nodes n ON n.id = from_id AND n.kind = 'Part' AND n.complexity > 40
        UNION SELECT w.start, l.to_id, w.depth + 1, l.kind FROM walk w JOIN links l ON l.from_id = w.id WHERE w.depth < 3),
      best AS (SELECT start, id, min(depth) AS depth, min(via) AS via FROM walk WHERE id <> start GROUP BY start, id)
      SELECT CASE depth WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, via, kind, count(*) AS k FROM best JOIN g_nodes USING (id) GROUP BY ALL"""
    return out
