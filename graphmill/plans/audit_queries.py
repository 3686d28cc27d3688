"""Queries of audits, telemetry, search, resolution and upkeep, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import CALLS_CTE, GRAPH_CTE, entity_graph, tool_calls
from ..functions import columns as C
from ..operators import audit, composite, resolve, store, telemetry, traverse
from ..session import table
from .register import Register
from .resolve_queries import IN_FORCE

_R = Register()


def _g(sql: str) -> str:
    return f"WITH {GRAPH_CTE}{sql}" if sql.lstrip().startswith(",") else f"WITH {GRAPH_CTE} {sql}"


def _c(sql: str) -> str:
    return f"WITH {CALLS_CTE}{sql}" if sql.lstrip().startswith(",") else f"WITH {CALLS_CTE} {sql}"


# ---------------------------------------------------------------- audits
@_R(_g("SELECT id, kind FROM g_nodes n WHERE kind IN ('Order', 'Customer', 'Part') AND NOT is_exported AND NOT is_entry_point AND NOT is_test AND extraction_confidence >= 0.6 AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.to_id = n.id)"))
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return audit.dead_code(g.nodes, g.edges, ("Order", "Customer", "Part"), 0.6).select("id", "kind")


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as methods, suppliers and every third order's priority as interfaces that declare some of them."""
    g = entity_graph(spark, d)
    urgent = F.col("language") == "1-URGENT"
    parent = F.when(F.col("kind") == "Order", F.when(urgent, F.lit("supplier.Supplier#000000001")).otherwise(F.lit("customer.none")))
    kind = F.when(F.col("kind") == "Order", "Method").when(F.col("kind") == "Supplier", "Interface").otherwise(F.col("kind"))
    return g.nodes.withColumn("parent", parent).withColumn("kind", kind), g.edges


@_R(_g("SELECT id FROM g_nodes n WHERE kind = 'Order' AND NOT is_exported AND NOT is_entry_point AND NOT is_test AND NOT EXISTS (SELECT 1 FROM g_edges e WHERE e.to_id = n.id) AND NOT (language = '1-URGENT' AND EXISTS (SELECT 1 FROM g_nodes i WHERE i.kind = 'Supplier' AND i.qualified_name = 'supplier.Supplier#000000001'))"))
def dead_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods that nothing refers to, without those that an interface declares."""
    n, e = _typed(spark, d)
    return audit.dead_code(n, e, ("Method",), interface_methods=audit.interface_carve_out(n)).select("id")


@_R(
    _g(
        """, near AS (SELECT to_id AS id, from_id FROM g_edges WHERE kind = 'CALLS'), far AS (SELECT id, from_id, 1 AS depth FROM near UNION SELECT a.id, b.from_id, 2 FROM near a JOIN near b ON b.id = a.from_id),
    best AS (SELECT id, from_id, min(depth) AS depth FROM far WHERE id <> from_id GROUP BY ALL)
    SELECT n.id, count(from_id) AS callers, CASE WHEN min(depth) = 1 THEN 'low' WHEN min(depth) > 1 THEN 'medium' ELSE 'high' END AS confidence FROM g_nodes n LEFT JOIN best USING (id) WHERE n.kind IN ('Customer', 'Region', 'Supplier') GROUP BY n.id"""
    )
)
def audit_unused(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    cand = g.nodes.where("kind in ('Customer', 'Region', 'Supplier')").select("project_id", "id")
    return audit.audit_unused(g.nodes, g.edges, cand).select("id", "callers", "confidence")


@_R(_g("SELECT id, name, in_degree FROM (SELECT to_id AS id, count(*) AS in_degree FROM g_edges GROUP BY 1) JOIN g_nodes USING (id) WHERE NOT is_test ORDER BY in_degree DESC, id LIMIT 25"))
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return audit.hotspots(g.nodes, g.edges, 25).select("id", "name", "in_degree")


@_R(_g("SELECT count(DISTINCT file_path) AS files, count(*) AS symbols, count(*) FILTER (WHERE is_exported) AS exported, count(*) FILTER (WHERE is_entry_point) AS entry_points, round(count(*) FILTER (WHERE is_test) / CAST(count(*) FILTER (WHERE NOT is_test) AS DOUBLE), 6) AS test_ratio FROM g_nodes WHERE starts_with(file_path, 'customer/')"))
def module_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.module_summary(entity_graph(spark, d).nodes, "customer/")


@_R(
    _g(
        """SELECT CASE WHEN starts_with(b.file_path, 'customer/') THEN 'in' ELSE 'out' END AS direction, e.from_id, a.name AS from_name, e.to_id, b.name AS to_name FROM g_edges e
    LEFT JOIN g_nodes a ON a.id = e.from_id LEFT JOIN g_nodes b ON b.id = e.to_id WHERE e.kind = 'CALLS' AND starts_with(coalesce(a.file_path, ''), 'customer/') <> starts_with(coalesce(b.file_path, ''), 'customer/')"""
    )
)
def module_boundary(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return audit.module_boundary(g.nodes, g.edges, "customer/").select("direction", "from_id", "from_name", "to_id", "to_name")


@_R(
    f"""WITH RECURSIVE {GRAPH_CTE}, links AS (SELECT DISTINCT to_id AS a, from_id AS b FROM g_edges WHERE kind = 'CALLS'),
    walk(start, id, depth) AS (SELECT a, b, 1 FROM links WHERE a IN ('r:1', 'n:5') UNION SELECT start, l.b, depth + 1 FROM walk w JOIN links l ON l.a = w.id WHERE depth < 3),
    pkg AS (SELECT *, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', -2) ELSE '' END AS p FROM g_nodes)
    SELECT n.id, min(w.depth) AS depth, min(CASE WHEN n.p <> t.p THEN 1 ELSE 0 END) = 1 AS cross_package FROM (SELECT start, id, min(depth) AS depth FROM walk WHERE id <> start GROUP BY ALL) w JOIN pkg n ON n.id = w.id JOIN pkg t ON t.id = w.start GROUP BY n.id"""
)
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return audit.blast_radius(g.nodes, g.edges, g.nodes.where("id in ('r:1', 'n:5')").select("project_id", "id"), 3).select("id", "depth", "cross_package")


@_R(_g("SELECT id, name FROM g_nodes WHERE file_path IN (SELECT file_path FROM g_nodes WHERE id IN ('c:7', 's:3')) AND id NOT IN ('c:7', 's:3') ORDER BY file_path, start_line, id LIMIT 100 OFFSET 10"))
def neighborhood(spark: SparkSession, d: str) -> DataFrame:
    n = entity_graph(spark, d).nodes
    return audit.neighborhood(n, n.where("id in ('c:7', 's:3')"), 100, 10).select("id", "name")


@_R(_g("SELECT DISTINCT b.file_path, a.file_path AS referrer FROM g_edges e JOIN g_nodes a ON a.id = e.from_id JOIN g_nodes b ON b.id = e.to_id WHERE starts_with(b.file_path, 'customer/') AND a.file_path <> b.file_path"))
def referrer_files(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return audit.referrer_files(g.nodes, g.edges, g.nodes.where("file_path like 'customer/%'")).select("file_path", "referrer")


@_R(_g("SELECT id AS old_id, concat('new/', id) AS new_id FROM g_nodes WHERE kind = 'Supplier'"))
def symbol_moves(spark: SparkSession, d: str) -> DataFrame:
    n = entity_graph(spark, d).nodes
    moved = n.withColumn("id", F.when(F.col("kind") == "Supplier", F.concat(F.lit("new/"), "id")).otherwise(F.col("id")))
    return audit.symbol_moves(n, moved).select("old_id", "new_id")


@_R(_g("SELECT 'node' AS what, kind, count(*) AS n FROM g_nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM g_edges GROUP BY kind"))
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return audit.graph_stats(g.nodes, g.edges)


@_R(_g("SELECT language, round(avg(extraction_confidence), 6) AS mean_confidence, count(*) AS n, CASE WHEN avg(extraction_confidence) >= 0.99 THEN 'AST' ELSE 'Regex' END AS parser FROM g_nodes GROUP BY language"))
def language_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.language_coverage(entity_graph(spark, d).nodes)


@_R(_g("SELECT kind, count(*) AS n, round(list_sort(list(extraction_confidence))[1 + 10 * (count(*) - 1) // 100], 6) AS p10, round(list_sort(list(extraction_confidence))[1 + 50 * (count(*) - 1) // 100], 6) AS p50 FROM g_nodes GROUP BY kind"))
def kind_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return audit.kind_percentiles(entity_graph(spark, d).nodes)


@_R(_g("SELECT b.bucket, count(n.id) AS n FROM (VALUES ('[0,.5)', 0.0, 0.5), ('[.5,.7)', 0.5, 0.7), ('[.7,.9)', 0.7, 0.9), ('[.9,1]', 0.9, 9.0)) b(bucket, lo, hi) LEFT JOIN g_nodes n ON extraction_confidence >= CAST(lo AS DOUBLE) AND extraction_confidence < CAST(hi AS DOUBLE) GROUP BY b.bucket"))
def confidence_hist(spark: SparkSession, d: str) -> DataFrame:
    return audit.confidence_histogram(entity_graph(spark, d).nodes)


_HUNKS = "SELECT 'shop' AS project_id, concat('customer/', c_mktsegment) AS file_path, CAST(c_custkey - 3 AS INT) AS first, CAST(c_custkey + c_custkey % 5 AS INT) AS last FROM {customer}"


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_HUNKS, customer=table(spark, d, "customer"))


@_R(_g(f", hunks AS ({_HUNKS.format(customer='customer')}) SELECT n.id, CAST(sum(least(end_line, last) - greatest(start_line, first) + 1) AS BIGINT) AS lines FROM (SELECT DISTINCT * FROM hunks) h JOIN g_nodes n ON n.file_path = h.file_path AND first <= end_line AND last >= start_line GROUP BY n.id"))
def changed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return audit.changed_nodes(entity_graph(spark, d).nodes, _hunks(spark, d)).select("id", "lines")


@_R(
    f"""WITH RECURSIVE {GRAPH_CTE}, links AS (SELECT DISTINCT to_id AS a, from_id AS b FROM g_edges WHERE kind = 'CALLS'),
    walk(start, id, depth) AS (SELECT a, b, 1 FROM links WHERE a IN (SELECT id FROM g_nodes WHERE kind IN ('Nation', 'Region')) UNION SELECT start, l.b, depth + 1 FROM walk w JOIN links l ON l.a = w.id WHERE depth < 3)
    SELECT id, count(DISTINCT start) AS overlap FROM walk JOIN g_nodes USING (id) WHERE is_test AND id <> start GROUP BY id"""
)
def tests_to_run(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return audit.tests_to_run(g.nodes, g.edges, g.nodes.where("kind in ('Nation', 'Region')")).select("id", "overlap")


@_R("SELECT file_path, CASE WHEN file_id % 7 = 0 THEN 'missing' WHEN file_id % 11 = 0 THEN 'drifted' WHEN file_id % 13 = 0 THEN 'unreadable' ELSE 'in-sync' END AS state FROM source_files")
def verify_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("file_id", F.concat("project_id", F.lit("|"), "file_path").alias("file_path"), F.col("file_hash").alias("hash"))
    found = f.where("file_id % 7 <> 0").withColumn("hash", F.when(F.col("file_id") % 11 == 0, "other").when(F.col("file_id") % 13 == 0, F.lit(None)).otherwise(F.col("hash")))
    return audit.verify_files(f, found).select(F.substring_index("file_path", "|", -1).alias("file_path"), "state")


_OVERVIEW = IN_FORCE + """, n AS (SELECT project_id, count(*) AS symbols, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE {fixture}) AS fixture_symbols FROM in_force GROUP BY 1), e AS (SELECT project_id, count(*) AS edges FROM (SELECT DISTINCT project_id, from_qn, to_name, kind FROM pending_edges WHERE from_qn <> '' AND to_name <> '') GROUP BY 1)""".format(fixture=f"regexp_matches(file_path, '{C.FIXTURE_PATH}')")


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Named references as edges between names, each once."""
    e = table(spark, d, "pending_edges").where("from_qn <> '' and to_name <> ''")
    return e.select("project_id", F.col("from_qn").alias("from_id"), F.col("to_name").alias("to_id"), "kind").distinct()


@_R(f"WITH {_OVERVIEW} SELECT project_id, coalesce(symbols, 0) AS symbols, coalesce(files, 0) AS files, coalesce(fixture_symbols, 0) AS fixture_symbols, coalesce(edges, 0) AS edges, round(CASE WHEN coalesce(symbols, 0) = 0 THEN 0.0 ELSE coalesce(edges, 0) / CAST(symbols AS DOUBLE) END, 6) AS edge_ratio, coalesce(symbols, 0) >= 1000 AND coalesce(edges, 0) < 0.001 * symbols AS ghost FROM projects LEFT JOIN n USING (project_id) LEFT JOIN e USING (project_id) WHERE coalesce(edges, 0) >= 5")
def project_overview(spark: SparkSession, d: str) -> DataFrame:
    n = resolve.nodes_in_force(table(spark, d, "symbols"))
    return composite.project_overview(table(spark, d, "projects"), n, _references(spark, d), min_edges=5)


_FAULTS = """SELECT DISTINCT project_id, file_path, 'bad range' AS reason FROM in_force WHERE end_line < start_line OR end_byte < start_byte
    UNION SELECT project_id, file_path, 'name collision' FROM in_force GROUP BY project_id, file_path, qualified_name, kind HAVING count(*) > 1
    UNION SELECT project_id, file_path, 'no symbols' FROM source_files f WHERE NOT EXISTS (SELECT 1 FROM in_force s WHERE s.project_id = f.project_id AND s.file_path = f.file_path)"""


@_R(f"WITH {IN_FORCE} {_FAULTS}")
def extraction_faults(spark: SparkSession, d: str) -> DataFrame:
    n = resolve.nodes_in_force(table(spark, d, "symbols"), "start_line", "end_line", "start_byte", "end_byte")
    return composite.extraction_faults(n, table(spark, d, "source_files"))


@_R(_g("SELECT kind, count(*) AS n, round(avg(extraction_confidence), 6) AS mean_confidence FROM g_nodes GROUP BY kind"))
def confidence_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return audit.confidence_by_kind(entity_graph(spark, d).nodes)


@_R(_g("SELECT language, count(*) AS symbols, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM g_nodes WHERE starts_with(file_path, 'part/') GROUP BY language"))
def module_shares(spark: SparkSession, d: str) -> DataFrame:
    return audit.module_shares(entity_graph(spark, d).nodes, "part/")


@_R(_g("SELECT id FROM g_nodes n WHERE kind <> 'Order' AND EXISTS (SELECT 1 FROM g_edges e WHERE e.from_id = n.id OR e.to_id = n.id)"))
def connected_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with an edge in either direction: a semi-join."""
    g = entity_graph(spark, d)
    return audit.connected(g.nodes.where("kind <> 'Order'"), g.edges).select("id")


@_R(f"WITH {IN_FORCE} SELECT project_id, id FROM in_force WHERE NOT is_test AND NOT {C.TEST_SQL.format('file_path')} AND NOT regexp_matches(file_path, '{C.FIXTURE_PATH}')")
def production_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in force without those of tests and fixtures."""
    n = resolve.nodes_in_force(table(spark, d, "symbols"), "is_test")
    return audit.without_tests(n).select("project_id", "id")


@_R(_g("SELECT to_id AS id, count(*) AS callers FROM g_edges WHERE kind = 'CALLS' GROUP BY to_id HAVING count(*) > 20"))
def many_callers(spark: SparkSession, d: str) -> DataFrame:
    """Groups filtered by their count."""
    e = entity_graph(spark, d).edges.where("kind = 'CALLS'")
    return e.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("callers")).where("callers > 20")


@_R(
    f"""WITH RECURSIVE {GRAPH_CTE}, links AS (SELECT DISTINCT to_id AS a, from_id AS b FROM g_edges WHERE kind = 'CALLS'), near AS (SELECT a, count(DISTINCT b) AS k FROM links WHERE a <> b GROUP BY a),
    walk(start, id, depth) AS (SELECT a, b, 1 FROM links WHERE a LIKE 'r:%' OR a LIKE 'n:%' OR a LIKE 'c:%' UNION SELECT start, l.b, depth + 1 FROM walk w JOIN links l ON l.a = w.id WHERE depth < 2)
    SELECT start, id, min(depth) AS depth FROM walk JOIN near ON near.a = start WHERE id <> start AND (k < 6 OR depth = 1) GROUP BY start, id"""
)
def adaptive_callers(spark: SparkSession, d: str) -> DataFrame:
    """Callers of regions, nations and customers, farther ones only of those with few."""
    g = entity_graph(spark, d)
    starts = g.nodes.where("kind in ('Region', 'Nation', 'Customer')").select("project_id", F.col("id").alias("start"))
    return traverse.adaptive_depth(g.edges, starts, "callers", ["CALLS"], 6, 2).select("start", "id", "depth")


@_R(_g("SELECT from_id, to_id, kind, confidence FROM g_edges WHERE to_id IN (SELECT id FROM g_nodes WHERE kind = 'Supplier' AND is_exported) AND kind IN ('IMPORTS', 'CALLS')"))
def edges_to(spark: SparkSession, d: str) -> DataFrame:
    """Edges by their end."""
    g = entity_graph(spark, d)
    return store.edges_of(g.edges, g.nodes.where("kind = 'Supplier' and is_exported"), True, ["IMPORTS", "CALLS"]).select("from_id", "to_id", "kind", "confidence")


@_R(_g("SELECT from_id, to_id, kind FROM g_edges WHERE from_id IN (SELECT id FROM g_nodes WHERE kind = 'Nation')"))
def edges_from(spark: SparkSession, d: str) -> DataFrame:
    """Edges by their start, of any kind."""
    g = entity_graph(spark, d)
    return store.edges_of(g.edges, g.nodes.where("kind = 'Nation'")).select("from_id", "to_id", "kind")


# ---------------------------------------------------------------- telemetry
_TALLY = "count(*) AS calls, CAST(coalesce(sum(tokens_saved), 0) AS BIGINT) AS saved, round(avg(tokens_saved), 4) AS mean_saved, round(avg(tokens_saved_pct), 4) AS mean_pct, round(avg(response_bytes), 4) AS mean_bytes"
_RECENT = "(SELECT * FROM calls WHERE ts >= (SELECT max(ts) FROM calls) - INTERVAL 7 DAYS)"


@_R(_c(f"SELECT tool, {_TALLY} FROM {_RECENT} GROUP BY tool ORDER BY calls DESC, tool LIMIT 20"))
def tool_tally(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tool_tally(tool_calls(spark, d))


@_R(_c(f"SELECT complexity_tier, {_TALLY} FROM {_RECENT} WHERE complexity_tier <> '' GROUP BY complexity_tier"))
def tier_tally(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tier_tally(tool_calls(spark, d))


@_R(_c("SELECT tool, min(response_bytes) AS least, round(avg(response_bytes), 4) AS mean, max(response_bytes) AS most, CAST(sum(response_bytes) AS BIGINT) AS total, count(*) AS calls FROM calls GROUP BY tool"))
def payload_dist(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.payload_distribution(tool_calls(spark, d))


@_R(_c("SELECT tool, round(max(response_bytes) / round(avg(response_bytes), 4), 4) AS ratio FROM calls GROUP BY tool HAVING max(response_bytes) >= 10000 AND round(max(response_bytes) / round(avg(response_bytes), 4), 4) >= 2 ORDER BY ratio DESC, tool LIMIT 3"))
def payload_outliers(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.payload_outliers(tool_calls(spark, d), 10000, 2.0).select("tool", "ratio")


@_R(_c("SELECT CAST(max(total) AS BIGINT) AS calls, round(-sum(n / total * log2(n / total)), 6) AS entropy, round(max(n / total), 6) AS top_share, max(total) >= 100 AND -sum(n / total * log2(n / total)) < 1 AND max(n / total) >= 0.8 AS one_sided FROM (SELECT tool, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS total FROM calls GROUP BY tool)"))
def tool_mix_entropy(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tool_mix(tool_calls(spark, d))


@_R(_c("SELECT count(DISTINCT session_id) AS sessions, count(*) AS calls, CAST(sum(tokens_used) AS BIGINT) AS tokens_used, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, CAST(sum(response_bytes) AS BIGINT) AS response_bytes FROM calls"))
def session_sums(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.session_sums(tool_calls(spark, d))


@_R("SELECT 'k' AS key, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events")
def map_merge_sum(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.map_sums(table(spark, d, "events"), "props")


_HOOKS = "SELECT event_id AS id, event_type AS tool_name, concat('u', user_id) AS session_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 'redirect' ELSE 'allow' END AS decision, CASE WHEN value > 50 THEN 1 WHEN value > 20 THEN 0 END AS took_recommendation FROM {events}"


@_R(f"WITH hooks AS ({_HOOKS.format(events='events')}) SELECT count(*) AS \"rows\", r AS redirected, t AS taken, r - t AS overridden, round(r * 100.0 / count(*), 4) AS redirect_pct, round(t * 100.0 / r, 4) AS taken_pct FROM hooks, (SELECT count(*) FILTER (WHERE decision = 'redirect') AS r, count(*) FILTER (WHERE decision = 'redirect' AND took_recommendation = 1) AS t FROM hooks) GROUP BY r, t")
def hook_conversion(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.hook_rates(spark.sql(_HOOKS, events=table(spark, d, "events")))


@_R(f"WITH hooks AS ({_HOOKS.format(events='events')}) SELECT tool_name, count(*) AS \"rows\", count(*) FILTER (WHERE decision = 'redirect') AS redirected, count(*) FILTER (WHERE decision = 'redirect' AND took_recommendation = 1) AS taken, count(*) FILTER (WHERE decision = 'redirect') - count(*) FILTER (WHERE decision = 'redirect' AND took_recommendation = 1) AS overridden, round(CASE WHEN count(*) FILTER (WHERE decision = 'redirect') = 0 THEN 0.0 ELSE count(*) FILTER (WHERE decision = 'redirect' AND took_recommendation = 1) * 100.0 / count(*) FILTER (WHERE decision = 'redirect') END, 4) AS taken_pct FROM hooks GROUP BY tool_name")
def hook_conversion_by_tool(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.hook_rates_by_tool(spark.sql(_HOOKS, events=table(spark, d, "events")))


@_R("SELECT error AS reason, count(*) AS n FROM python_responses WHERE error <> '' GROUP BY error")
def failures_by_reason(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.failures_by_reason(table(spark, d, "python_responses").withColumnRenamed("error", "reason"))


@_R("SELECT stat_id AS call_id, tool, max_ms AS ms, flushed_at AS ts FROM tool_latency_stats WHERE max_ms >= 5000 ORDER BY flushed_at DESC, stat_id DESC LIMIT 100")
def slow_calls(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest calls above a threshold."""
    t = table(spark, d, "tool_latency_stats").select(F.col("stat_id").alias("call_id"), "tool", F.col("max_ms").alias("ms"), F.col("flushed_at").alias("ts"))
    return telemetry.slow_calls(t, 5000)


@_R(
    _c(
        f""", hooks AS ({_HOOKS.format(events='events')} WHERE event_type = 'error')
    SELECT id, position, call_id, tool FROM (SELECT h.id, c.call_id, c.tool, row_number() OVER (PARTITION BY h.id ORDER BY c.ts, c.call_id) AS position FROM hooks h JOIN calls c ON c.session_id = h.session_id AND c.ts > h.ts) WHERE position <= 3"""
    )
)
def hook_next_calls(spark: SparkSession, d: str) -> DataFrame:
    hooks = spark.sql(_HOOKS + " WHERE event_type = 'error'", events=table(spark, d, "events"))
    return telemetry.next_calls(hooks, tool_calls(spark, d))


@_R(
    _g(
        """SELECT project_id, CAST(floor((SELECT sum(length(id) + length(name) + length(qualified_name) + length(coalesce(signature, '')) + length(coalesce(docstring, ''))) + count(*) * 64 FROM g_nodes) * 1.5 + (SELECT sum(length(from_id) + length(to_id)) + count(*) * 32 FROM g_edges)) AS BIGINT) AS bytes FROM g_nodes GROUP BY project_id"""
    )
)
def size_estimate(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return telemetry.size_estimate(g.nodes, g.edges)


@_R(
    """SELECT tool, CAST(sum(actual_tokens_avg) // count(*) AS BIGINT) AS mean_actual, CAST(sum(baseline_tokens_avg) // count(*) AS BIGINT) AS mean_baseline, list_sort(list(p50_ms) FILTER (WHERE p50_ms IS NOT NULL))[1 + count(p50_ms) // 2] AS p50,
    list_sort(list(p50_ms) FILTER (WHERE p50_ms IS NOT NULL))[1 + count(p50_ms) * 95 // 100] AS p95, round((sum(baseline_tokens_avg) // count(*) - sum(actual_tokens_avg) // count(*)) * 100.0 / (sum(baseline_tokens_avg) // count(*)), 4) AS saved_pct FROM savings_baseline GROUP BY tool"""
)
def bench_summary(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "savings_baseline")
    return telemetry.bench_summary(b.select("tool", F.col("p50_ms").alias("latency_ms"), F.col("actual_tokens_avg").alias("actual"), F.col("baseline_tokens_avg").alias("baseline")))


@_R(_c("SELECT key, threshold FROM (SELECT tool AS key, CASE WHEN sum(tokens_saved) >= 1000000 THEN 1000000 WHEN sum(tokens_saved) >= 100000 THEN 100000 WHEN sum(tokens_saved) >= 1000 THEN 1000 END AS threshold FROM calls GROUP BY tool) WHERE threshold IS NOT NULL AND NOT (key = 'view' AND threshold IN (1000, 100000))"))
def milestones(spark: SparkSession, d: str) -> DataFrame:
    totals = tool_calls(spark, d).groupBy(F.col("tool").alias("key")).agg(F.sum("tokens_saved").alias("total"))
    fired = spark.createDataFrame([("view", 1000), ("view", 100_000)], "key string, threshold bigint")
    return telemetry.milestones(totals, [1000, 100_000, 1_000_000], fired)


@_R("SELECT concat('tool_latency_', v, '{tool=\"', tool, '\"} ', x) AS line FROM (SELECT tool, unnest(['count', 'sum', 'max']) AS v, unnest([count(*), CAST(sum(total_ms) AS BIGINT), max(total_ms)]) AS x FROM tool_latency_stats GROUP BY tool)")
def prometheus_lines(spark: SparkSession, d: str) -> DataFrame:
    c = telemetry.counters(table(spark, d, "tool_latency_stats"), ["tool"], "total_ms")
    return telemetry.prometheus(c, "tool_latency", ["tool"], ["count", "sum", "max"])


# ---------------------------------------------------------------- upkeep
@_R("SELECT project_id, id, indexed_at, deleted_at, file_hash, start_line, complexity FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY indexed_at DESC, deleted_at DESC NULLS LAST, file_hash DESC NULLS LAST, start_line DESC, complexity DESC) AS k FROM symbols) WHERE k = 1")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").select("project_id", "id", "indexed_at", "deleted_at", "file_hash", "start_line", "complexity")
    return store.last_wins(s, ["project_id", "id"], ["indexed_at"])


@_R(f"WITH {GRAPH_CTE} SELECT from_id, to_id, kind, confidence FROM g_edges UNION ALL SELECT DISTINCT concat('o:', l_orderkey), concat('s:', l_suppkey), 'CALLS', CAST(0.1 AS DOUBLE) FROM lineitem")
def upsert_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Edges written again with another confidence keep the stored one; new ones come once."""
    e = entity_graph(spark, d).edges
    new = table(spark, d, "lineitem").select(F.lit("shop").alias("project_id"), F.concat(F.lit("o:"), "l_orderkey").alias("from_id"), F.concat(F.lit("s:"), "l_suppkey").alias("to_id"), F.lit("CALLS").alias("kind"))
    again = e.drop("confidence").unionByName(new).withColumn("confidence", F.lit(0.1))
    return store.upsert_edges(e, again).select("from_id", "to_id", "kind", "confidence")


@_R(_g("SELECT id FROM g_nodes WHERE NOT starts_with(file_path, 'customer/B')"))
def delete_files(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return store.delete_files(g.nodes, g.edges, g.nodes.where("file_path like 'customer/B%'"))[0].select("id")


@_R(_g("SELECT from_id, to_id, kind FROM g_edges WHERE from_id NOT IN (SELECT id FROM g_nodes WHERE starts_with(file_path, 'customer/B')) AND to_id NOT IN (SELECT id FROM g_nodes WHERE starts_with(file_path, 'customer/B'))"))
def delete_files_edges(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    return store.delete_files(g.nodes, g.edges, g.nodes.where("file_path like 'customer/B%'"))[1].select("from_id", "to_id", "kind")


@_R("SELECT file_id FROM source_files WHERE file_id % 5 = 0")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("file_id", "project_id", "file_path", "file_hash")
    return store.changed_files(f.withColumn("file_hash", F.when(F.col("file_id") % 5 == 0, "old").otherwise(F.col("file_hash"))), f).select("file_id")


@_R(f"WITH {IN_FORCE} SELECT project_id, file_path, count(*) AS symbols, max(file_hash) AS file_hash FROM in_force GROUP BY ALL")
def symbols_per_file(spark: SparkSession, d: str) -> DataFrame:
    return store.files_with_counts(resolve.nodes_in_force(table(spark, d, "symbols"), "file_hash"))


@_R(f"WITH {_OVERVIEW} SELECT project_id, coalesce(symbols, 0) AS symbol_count, coalesce(edges, 0) AS edge_count FROM projects LEFT JOIN n USING (project_id) LEFT JOIN e USING (project_id)")
def recount_projects(spark: SparkSession, d: str) -> DataFrame:
    n = resolve.nodes_in_force(table(spark, d, "symbols"))
    return store.recount(table(spark, d, "projects"), n, _references(spark, d)).select("project_id", "symbol_count", "edge_count")


@_R("SELECT project_id, reason, file_path, min(extracted_at) AS first_seen, max(extracted_at) AS last_seen, count(*) AS times FROM (SELECT *, error AS reason FROM python_responses) WHERE reason <> '' GROUP BY ALL")
def failure_upsert(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "python_responses").where("error <> ''").select("project_id", "file_path", F.col("error").alias("reason"), F.col("extracted_at").alias("first_seen"), F.col("extracted_at").alias("last_seen"), F.lit(1).cast("bigint").alias("times"))
    return store.upsert_failures(r.where("length(reason) % 2 = 0"), r.where("length(reason) % 2 = 1"))


# ---------------------------------------------------------------- scalar helpers
@_R("SELECT doc_id, CAST((octet_length(encode(text)) + 3) // 4 AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.token_estimate(F.col("text")).alias("tokens"))


@_R("SELECT file_id, CAST(1 + " + " + ".join(f"(length(content) - length(replace(content, '{w}', ''))) // {len(w)}" for w in C.COMPLEXITY_WORDS) + " AS INT) AS complexity FROM source_files")
def complexity_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", C.complexity(F.col("content")).alias("complexity"))


@_R("SELECT project_id, symbol_id, round(greatest(0, least(1, (base_extractor + kind_baseline) / 2 + coalesce(path_penalty, 0) + coalesce(ident_bonus, 0) + coalesce(generated_pen, 0))), 6) AS confidence FROM signals")
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "signals")
    return s.select("project_id", "symbol_id", F.round(C.confidence(*(F.col(c) for c in ("base_extractor", "kind_baseline", "path_penalty", "ident_bonus", "generated_pen"))), 6).alias("confidence"))


@_R("SELECT file_path, CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', -2) ELSE '' END AS package FROM source_files")
def package_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_path", C.package_of(F.col("file_path")).alias("package"))


@_R("SELECT captured_at_tag AS tag, count(*) AS n FROM savings_baseline GROUP BY 1 ORDER BY list_transform(string_split(ltrim(captured_at_tag, 'v'), '.'), lambda x: CAST(x AS INT)) DESC LIMIT 10")
def newest_versions(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "savings_baseline").groupBy(F.col("captured_at_tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return b.orderBy(C.version_key(F.col("tag")).desc()).limit(10)


queries, oracle_sql = _R.queries, _R.oracle_sql
