"""Queries of results' forms: fields, snippets, events, and the extractors as a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import GRAPH_CTE, entity_graph
from ..extract.udtf import register_extract
from ..functions import columns as C
from ..operators import composite
from ..session import table
from .register import Register
from .resolve_queries import IN_FORCE

_R = Register()


@_R(f"WITH {GRAPH_CTE} SELECT kind, id, complexity FROM g_nodes WHERE kind <> 'Order'")
def projected_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that were asked for by name; unknown ones are left out."""
    return composite.fields(entity_graph(spark, d).nodes.where("kind <> 'Order'"), "kind, id,complexity , nothing")[0]


@_R("SELECT doc_id, regexp_replace(substr(text, greatest(strpos(lower(text), 'schema') - 60, 1), 126), '\\s+', ' ', 'g') AS snippet FROM documents WHERE contains(lower(text), 'schema') AND NOT regexp_matches(text, '[^\\x00-\\x7f]')")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    """What stands around a word in the documents of plain letters."""
    t = table(spark, d, "documents").where("contains(lower(text), 'schema')").where(~F.col("text").rlike(r"[^\x00-\x7f]"))
    return t.select("doc_id", C.snippet(F.col("text"), "schema", 60).alias("snippet"))


@_R(f"WITH {IN_FORCE} SELECT project_id, id, CASE WHEN length(split_part(signature, chr(10), 1)) > 40 THEN concat(substr(split_part(signature, chr(10), 1), 1, 39), '…') ELSE split_part(signature, chr(10), 1) END AS head FROM in_force WHERE signature IS NOT NULL")
def signature_heads(spark: SparkSession, d: str) -> DataFrame:
    """Signatures in compact form."""
    from ..operators.resolve import nodes_in_force

    n = nodes_in_force(table(spark, d, "symbols"), "signature").where("signature is not null")
    return n.select("project_id", "id", C.compact(F.col("signature"), 40).alias("head"))


@_R("SELECT run_id AS id, concat('id: ', run_id, chr(10), 'event: bench', chr(10), 'data: {\"tool\":\"', tool, '\",\"samples\":', samples, '}', chr(10), chr(10)) AS text FROM savings_baseline")
def event_lines(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "savings_baseline")
    return composite.event_lines(b.select(F.col("run_id").alias("id"), F.lit("bench").alias("event"), F.struct("tool", "samples").alias("data")))


@_R("SELECT a.project_id, b.project_id AS outer_id FROM (SELECT project_id, concat(root_path, CASE WHEN length(project_id) % 2 = 0 THEN '' ELSE '/sub/' || project_name END) AS r FROM projects UNION ALL SELECT 'x', root_path || '/sub' FROM projects) a JOIN (SELECT project_id, concat(root_path, CASE WHEN length(project_id) % 2 = 0 THEN '' ELSE '/sub/' || project_name END) AS r FROM projects UNION ALL SELECT 'x', root_path || '/sub' FROM projects) b ON starts_with(a.r, b.r || '/')")
def nested_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects that lie in others, here made by a folder for half of them."""
    p = table(spark, d, "projects")
    moved = F.when(F.length("project_id") % 2 == 0, F.col("root_path")).otherwise(F.concat("root_path", F.lit("/sub/"), "project_name"))
    both = p.select("project_id", moved.alias("root_path")).unionAll(p.select(F.lit("x"), F.concat("root_path", F.lit("/sub"))))
    return composite.nested_projects(both)


@_R("SELECT CAST(file_id AS VARCHAR) AS key, '+' AS sign, CAST(n_lines + 1 AS INTEGER) AS line, 'one more' AS text FROM (SELECT file_id, length(content) - length(replace(content, chr(10), '')) + 1 AS n_lines FROM source_files WHERE content <> '' AND project_id < 'prj_c')")
def line_changes(spark: SparkSession, d: str) -> DataFrame:
    """What a second reading of the files of some projects gained: one line at the end."""
    f = table(spark, d, "source_files").where("content <> '' and project_id < 'prj_c'")
    return composite.line_changes(f.select(F.col("file_id").cast("string").alias("key"), F.col("content").alias("before"), F.concat("content", F.lit("\none more")).alias("after")))


@_R("SELECT file_id, CASE WHEN json_valid(content) THEN 0 ELSE 1 END AS failures FROM source_files WHERE file_path LIKE '%.json' AND NOT regexp_matches(content, '(?i)NaN|Infinity') AND content IS NOT NULL AND content <> ''")
def extract_failures(spark: SparkSession, d: str) -> DataFrame:
    """JSON files by whether the table function of the extractors reports a failure."""
    register_extract(spark)
    f = table(spark, d, "source_files").where("file_path like '%.json' and content <> ''").where(~F.col("content").rlike("(?i)NaN|Infinity"))
    return spark.sql("SELECT file_id, CAST(count_if(x.what = 'failure') AS INT) AS failures FROM {f}, LATERAL extract_source(file_path, content) AS x GROUP BY file_id", f=f)


queries, oracle_sql = _R.queries, _R.oracle_sql
