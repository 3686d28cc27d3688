"""Lookups, clean-up and merges of the store, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import GRAPH_CTE, entity_graph, tool_calls
from ..operators import composite, resolve, store
from ..session import table
from .register import Register
from .resolve_queries import IN_FORCE

_R = Register()


def _g(sql: str) -> str:
    return f"WITH {GRAPH_CTE} {sql}"


def _nodes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return resolve.nodes_in_force(table(spark, d, "symbols"), *more)


@_R(f"WITH {IN_FORCE} SELECT DISTINCT s.project_id, s.id, s.kind FROM in_force s JOIN audit_candidates a ON a.project_id = s.project_id AND a.symbol_id = s.id")
def lookup_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of many ids at once."""
    wanted = table(spark, d, "audit_candidates").select("project_id", F.col("symbol_id").alias("id"))
    return store.lookup(_nodes(spark, d), wanted).select("project_id", "id", "kind")


@_R(f"WITH {IN_FORCE} SELECT s.project_id, s.id FROM in_force s WHERE EXISTS (SELECT 1 FROM blast_rows b WHERE b.project_id = s.project_id AND b.name = s.name)")
def lookup_by_name(spark: SparkSession, d: str) -> DataFrame:
    return store.lookup(_nodes(spark, d), table(spark, d, "blast_rows"), "name").select("project_id", "id")


@_R(f"WITH {IN_FORCE} SELECT s.project_id, s.id FROM in_force s WHERE EXISTS (SELECT 1 FROM python_responses b WHERE b.error <> '' AND b.project_id = s.project_id AND b.file_path = s.file_path)")
def lookup_by_file(spark: SparkSession, d: str) -> DataFrame:
    return store.lookup(_nodes(spark, d), table(spark, d, "python_responses").where("error <> ''"), "file_path").select("project_id", "id")


@_R(f"WITH {IN_FORCE} SELECT project_id, qualified_name, array_to_string(list_sort(list(id)), '|') AS ids FROM in_force GROUP BY ALL")
def grouped_by_name(spark: SparkSession, d: str) -> DataFrame:
    return store.grouped_by_name(_nodes(spark, d)).select("project_id", "qualified_name", F.array_join("ids", "|").alias("ids"))


@_R(_g("SELECT n.id, count(e.to_id) AS callees, min(e.to_id) AS first FROM g_nodes n LEFT JOIN g_edges e ON e.from_id = n.id AND e.kind = 'CALLS' WHERE n.kind IN ('Customer', 'Supplier', 'Nation') GROUP BY n.id"))
def symbol_context(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with what they call directly."""
    g = entity_graph(spark, d)
    n = g.nodes.where("kind in ('Customer', 'Supplier', 'Nation')")
    called = store.edges_of(g.edges, n, kinds=["CALLS"]).groupBy("project_id", F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("callees"), F.min("to_id").alias("first"))
    return n.join(called, ["project_id", "id"], "left").select("id", F.coalesce("callees", F.lit(0)).alias("callees"), "first")


@_R("SELECT project_id, file_path, file_hash FROM source_files WHERE file_hash IS NOT NULL")
def files_with_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("file_hash is not null").select("project_id", "file_path", "file_hash")


@_R(f"WITH {IN_FORCE} SELECT file_id FROM source_files f WHERE NOT EXISTS (SELECT 1 FROM in_force s WHERE s.project_id = f.project_id AND s.file_path = f.file_path AND s.language IN ('Go', 'JavaScript'))")
def cleared_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Files that keep their hash when two languages are to be read again."""
    return store.clear_hashes(table(spark, d, "source_files"), _nodes(spark, d), ["Go", "JavaScript"]).select("file_id")


@_R("SELECT project_id FROM projects p WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.project_id = p.project_id) AND NOT EXISTS (SELECT 1 FROM blast_rows e WHERE e.project_id = p.project_id)")
def empty_projects(spark: SparkSession, d: str) -> DataFrame:
    return store.empty_projects(table(spark, d, "projects"), table(spark, d, "symbols"), table(spark, d, "blast_rows")).select("project_id")


@_R("SELECT project_id FROM projects WHERE '/srv/repos' = rtrim(root_path, '/') OR starts_with((SELECT max(root_path) FROM projects) || '/src/a.py', rtrim(root_path, '/') || '/')")
def projects_containing(spark: SparkSession, d: str) -> DataFrame:
    """Projects that a path lies in."""
    p = table(spark, d, "projects")
    path = p.agg(F.max("root_path")).first()[0] + "/src/a.py"
    return store.projects_containing(p, path).select("project_id")


@_R("SELECT project_id, file_path, max(extracted_at) AS last_seen FROM python_responses r WHERE error <> '' AND extracted_at >= (SELECT added_at FROM projects p WHERE p.project_id = r.project_id) GROUP BY ALL")
def pruned_failures(spark: SparkSession, d: str) -> DataFrame:
    """Failures that are not older than their project's entry."""
    f = table(spark, d, "python_responses").where("error <> ''").select("project_id", "file_path", F.col("extracted_at").alias("last_seen"))
    p = table(spark, d, "projects").select("project_id", F.col("added_at").alias("indexed_at"))
    return store.prune_failures(f, p).groupBy("project_id", "file_path").agg(F.max("last_seen").alias("last_seen"))


@_R("SELECT file_id, extracted_at FROM python_responses WHERE error <> '' AND extracted_at >= (SELECT max(extracted_at) FROM python_responses) - INTERVAL 60 DAYS ORDER BY extracted_at DESC, file_id DESC LIMIT 50")
def recent_failures(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest failures of all projects after a cutoff."""
    r = table(spark, d, "python_responses")
    late = F.col("extracted_at") >= r.agg(F.max("extracted_at")).scalar() - F.expr("INTERVAL 60 DAYS")
    return store.newest(r.where("error <> ''"), "extracted_at", 50, late, "file_id").select("file_id", "extracted_at")


@_R("SELECT event_id AS call_id, ts FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_calls(spark: SparkSession, d: str) -> DataFrame:
    """The hundred newest calls of one session."""
    c = tool_calls(spark, d)
    first = table(spark, d, "events").agg(F.concat(F.lit("u"), F.min("user_id"))).scalar()
    return store.newest(c, "ts", 100, F.col("session_id") == first, "call_id").select("call_id", "ts")


@_R(_g("SELECT from_id, to_id, kind FROM g_edges WHERE NOT (kind = 'CALLS' AND from_id IN (SELECT id FROM g_nodes WHERE starts_with(file_path, 'customer/')))"))
def scoped_edge_delete(spark: SparkSession, d: str) -> DataFrame:
    g = entity_graph(spark, d)
    files = g.nodes.where("file_path like 'customer/%'").select("project_id", "file_path").distinct()
    return store.scoped_edge_delete(g.edges.withColumn("source", F.lit("resolve_pass")), "CALLS", "resolve_pass", files, g.nodes).select("from_id", "to_id", "kind")


@_R("SELECT count(*) AS n, count(DISTINCT id) AS ids, min(project_id) AS least FROM (SELECT project_id, id FROM symbols WHERE project_id NOT IN ((SELECT min(project_id) FROM symbols), (SELECT max(project_id) FROM symbols)) GROUP BY ALL UNION ALL SELECT DISTINCT (SELECT min(project_id) FROM symbols), id FROM symbols WHERE project_id IN ((SELECT min(project_id) FROM symbols), (SELECT max(project_id) FROM symbols)))")
def merged_projects(spark: SparkSession, d: str) -> DataFrame:
    """Symbols after the last project was merged into the first."""
    s = table(spark, d, "symbols").select("project_id", "id").distinct()
    low, high = s.agg(F.min("project_id"), F.max("project_id")).first()
    m = store.merge_projects(s, ["project_id", "id"], low, [high])
    return m.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("project_id").alias("least"))


@_R("SELECT p.project_id, w.project_id AS winner FROM projects p JOIN (SELECT regexp_replace(root_path, '[0-9]+$', '') AS place, arg_min(project_id, (added_at, project_id)) AS project_id, count(*) AS k FROM projects GROUP BY 1) w ON w.place = regexp_replace(p.root_path, '[0-9]+$', '') WHERE k > 1")
def same_place(spark: SparkSession, d: str) -> DataFrame:
    """Projects at one place, here roots that differ by a number and are written in two ways."""
    p = table(spark, d, "projects")
    stem = F.regexp_replace("root_path", "[0-9]+$", "")
    odd = F.when(F.length("project_id") % 2 == 1, F.concat(F.replace(stem, F.lit("/"), F.lit("//")), F.lit("/"))).otherwise(stem)
    return store.same_place(p.withColumn("root_path", odd)).select("project_id", "winner")


@_R(f"WITH {IN_FORCE} SELECT DISTINCT f.project_id, f.file_path FROM (SELECT DISTINCT project_id, file_path FROM in_force) f WHERE NOT EXISTS (SELECT 1 FROM source_files s WHERE s.project_id = f.project_id AND s.file_path = f.file_path AND s.branch = 'main')")
def vanished_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with symbols that the main branch no longer has."""
    return store.vanished_files(_nodes(spark, d), table(spark, d, "source_files").where("branch = 'main'"))


@_R(f"WITH {IN_FORCE} SELECT project_id, id, 'field' AS field_name FROM in_force WHERE kind = 'Class' AND NOT starts_with(file_path, 'src/')")
def cascaded_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of classes after the files below src/ were deleted."""
    n = _nodes(spark, d)
    fields = n.where("kind = 'Class'").select("project_id", F.col("id").alias("struct_id"), F.lit("field").alias("field_name"))
    return store.delete_children(fields, "struct_id", n, n.where("file_path like 'src/%'")).select("project_id", F.col("struct_id").alias("id"), "field_name")


@_R("SELECT project_id, project_name FROM projects ORDER BY project_name, project_id LIMIT 25 OFFSET 50")
def page_of_projects(spark: SparkSession, d: str) -> DataFrame:
    return composite.pages(table(spark, d, "projects").select("project_id", "project_name"), ["project_name", "project_id"], 25, 50)[0]


@_R("SELECT CASE WHEN project_name = (SELECT min(project_name) FROM projects) THEN 'new' ELSE root_path END AS text, project_name AS key FROM (SELECT project_name, min(root_path) AS root_path FROM projects GROUP BY 1) WHERE project_name <> (SELECT max(project_name) FROM projects)")
def decision_records(spark: SparkSession, d: str) -> DataFrame:
    """Records by key, one set anew and one removed."""
    r = table(spark, d, "projects").groupBy(F.col("project_name").alias("key")).agg(F.min("root_path").alias("text"))
    low, high = r.agg(F.min("key"), F.max("key")).first()
    return store.put_record(store.put_record(r, low, "new"), high, None)


@_R(f"WITH {IN_FORCE}, now AS (SELECT *, end_line - CASE WHEN language = 'Go' THEN 12 ELSE 0 END AS last, CASE WHEN language = 'Python' THEN 'same' ELSE qualified_name END AS qn FROM in_force) SELECT DISTINCT project_id, file_path, 'bad range' AS reason FROM now WHERE last < start_line OR end_byte < start_byte UNION SELECT project_id, file_path, 'name collision' FROM now GROUP BY project_id, file_path, qn, kind HAVING count(*) > 1")
def planted_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults of rows that were made wrong: Go's symbols twelve lines too short, Python's all of one name."""
    n = _nodes(spark, d, "start_line", "end_line", "start_byte", "end_byte")
    wrong = n.withColumn("end_line", F.col("end_line") - F.when(F.col("language") == "Go", 12).otherwise(0)).withColumn("qualified_name", F.when(F.col("language") == "Python", "same").otherwise(F.col("qualified_name")))
    return composite.extraction_faults(wrong)


queries, oracle_sql = _R.queries, _R.oracle_sql
