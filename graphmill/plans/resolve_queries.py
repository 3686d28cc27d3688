"""Queries that bind references of the indexed tables to symbols, with SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit, composite, resolve
from ..session import table, written
from .register import Register

_R = Register()
_BARE = "nullif(regexp_replace(regexp_replace({0}, '^[\\s\"''`]+', ''), '([\\s\"''`]|\\([^()]*\\))+$', ''), '')"
_FIXTURE = f"regexp_matches(file_path, '{C.FIXTURE_PATH}')"
_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
_LIST = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
IN_FORCE = """in_force AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY indexed_at DESC, deleted_at IS NOT NULL DESC, file_path DESC, name DESC, qualified_name DESC, kind DESC, language DESC, parent DESC) AS k FROM symbols) WHERE k = 1 AND deleted_at IS NULL)"""
_CODE = f"kind NOT IN {_LIST(resolve.NOT_CODE)}"
#: a Python name with leading dots as seen from its file
_ABSOLUTE = """CASE WHEN regexp_matches(from_file, '(?i)\\.pyw?i?$') AND starts_with(to_name, '.') THEN
  CASE WHEN len(string_split(from_file, '/')) - length(regexp_extract(to_name, '^\\.+')) >= 0 THEN nullif(concat_ws('.', nullif(array_to_string(string_split(from_file, '/')[1:len(string_split(from_file, '/')) - length(regexp_extract(to_name, '^\\.+'))], '.'), ''), nullif(ltrim(to_name, '.'), '')), '') END ELSE to_name END"""
_BASE = f"""{IN_FORCE},
refs AS (SELECT project_id, from_file, kind, {_BARE.format('from_qn')} AS from_qn, {_BARE.format('to_name')} AS to_name, max(confidence) AS confidence, max(receiver_type) AS receiver_type, max(base_type) AS base_type FROM pending_edges GROUP BY 1, 2, 3, 4, 5),
t_any AS (SELECT project_id, qualified_name AS n, min(id) AS id, arg_min(language, id) AS lang, arg_min(kind, id) AS kind FROM in_force GROUP BY ALL),
t_file AS (SELECT project_id, file_path, qualified_name AS n, min(id) AS id, arg_min(language, id) AS lang FROM in_force GROUP BY ALL),
t_qn AS (SELECT project_id, qualified_name AS n, min(id) AS id FROM in_force WHERE {_CODE} GROUP BY ALL),
t_name AS (SELECT project_id, name AS n, arg_min(id, ({_FIXTURE}, id)) AS id FROM in_force WHERE {_CODE} AND kind <> 'Method' GROUP BY ALL),
t_method AS (SELECT project_id, name AS n, arg_min(id, ({_FIXTURE}, id)) AS id FROM in_force WHERE kind = 'Method' GROUP BY ALL HAVING CASE WHEN count(*) FILTER (WHERE NOT {_FIXTURE}) > 0 THEN count(*) FILTER (WHERE NOT {_FIXTURE}) ELSE count(*) END = 1),
classes AS (SELECT project_id, name, arg_min(qualified_name, id) AS qn FROM in_force WHERE kind IN ('Class', 'Interface') GROUP BY ALL),
t_member AS (SELECT c.project_id, concat(c.name, '.', regexp_extract(n.qualified_name, '[^.]*$')) AS n, min(n.id) AS id FROM classes c JOIN in_force n ON n.project_id = c.project_id AND regexp_replace(n.qualified_name, '\\.[^.]*$', '') = c.qn WHERE {_CODE} GROUP BY ALL),
valued AS (SELECT *, {_DIR.format('file_path')} AS folder, CASE kind WHEN 'Variable' THEN 0 WHEN 'Function' THEN 1 ELSE 2 END AS r FROM in_force WHERE kind IN ('Variable', 'Function', 'Method')),
t_value AS (SELECT project_id, language, folder, name AS n, arg_min(id, ({_FIXTURE}, r, id)) AS id, arg_min(kind, ({_FIXTURE}, r, id)) AS kind FROM valued GROUP BY ALL),
t_value_any AS (SELECT project_id, name AS n, arg_min(id, ({_FIXTURE}, r, id)) AS id, arg_min(language, ({_FIXTURE}, r, id)) AS lang FROM valued GROUP BY ALL),
src AS (SELECT r.*, coalesce(f.id, a.id, n.id) AS from_id FROM refs r LEFT JOIN t_file f ON f.project_id = r.project_id AND f.file_path = r.from_file AND f.n = r.from_qn LEFT JOIN t_any a ON a.project_id = r.project_id AND a.n = r.from_qn
  LEFT JOIN t_name n ON n.project_id = r.project_id AND n.n = r.from_qn AND NOT contains(r.from_qn, '.') WHERE to_name IS NOT NULL)
"""
_CALLS = f"""{_BASE},
named AS (SELECT * EXCLUDE (to_name), {_ABSOLUTE} AS to_name, regexp_matches(from_file, '(?i)\\.pyw?i?$') AS py, CASE WHEN contains(to_name, '.') THEN ltrim(receiver_type, '*') END AS recv, regexp_replace(replace(from_file, '/', '.'), '\\.\\w+$', '') AS module FROM src WHERE kind = 'CALLS'),
parts AS (SELECT *, regexp_extract(to_name, '[^.]*$') AS last, len(string_split(to_name, '.')) AS k, split_part(to_name, '.', 1) AS first, regexp_replace(to_name, '\\.[^.]*$', '') AS before, recv IS NOT NULL AND recv <> '' AND NOT contains(recv, '.') AND split_part(to_name, '.', 1) NOT IN {_LIST(resolve.STANDARD)} AS plain FROM named),
bound AS (SELECT p.project_id, from_id, coalesce(q.id, q2.id, b.id, m1.id, m2.id, c.id, o.id) AS to_id, confidence,
    CASE WHEN q.id IS NOT NULL OR q2.id IS NOT NULL THEN '1 qualified name' WHEN b.id IS NOT NULL THEN '2 bare name' WHEN m1.id IS NOT NULL OR m2.id IS NOT NULL THEN '3 receiver type' WHEN c.id IS NOT NULL THEN '4 class member' ELSE '5 only method' END AS way
  FROM parts p LEFT JOIN t_qn q ON q.project_id = p.project_id AND q.n = p.to_name LEFT JOIN t_qn q2 ON q2.project_id = p.project_id AND py AND q2.n = concat('src.', p.to_name) AND NOT starts_with(p.to_name, 'src.')
  LEFT JOIN t_name b ON b.project_id = p.project_id AND k = 1 AND b.n = p.to_name
  LEFT JOIN t_qn m1 ON m1.project_id = p.project_id AND plain AND k = 2 AND m1.n = concat_ws('.', module, recv, last) LEFT JOIN t_qn m2 ON m2.project_id = p.project_id AND plain AND k = 2 AND m2.n = concat_ws('.', split_part(from_qn, '.', 1), recv, last)
  LEFT JOIN t_member c ON c.project_id = p.project_id AND k = 2 AND recv <> '' AND regexp_matches(from_file, '(?i)\\.(?:[mc]?js|jsx|tsx?)$') AND c.n = concat_ws('.', recv, last)
  LEFT JOIN t_method o ON o.project_id = p.project_id AND k > 1 AND last <> '' AND before NOT IN {_LIST(resolve.STANDARD)} AND last NOT IN {_LIST(resolve.COMMON_METHODS)} AND o.n = last),
calls AS (SELECT project_id, from_id, to_id, max(confidence) AS confidence, min(way) AS way FROM bound WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND from_id <> to_id GROUP BY 1, 2, 3)
"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return written(resolve.nodes_in_force(table(spark, d, "symbols")))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pending_edges")


@_R(f"WITH {_CALLS} SELECT * FROM calls")
def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_calls(_pending(spark, d), _nodes(spark, d)).select("project_id", "from_id", "to_id", "confidence", "way")


_IMPORTS = f"""{_BASE},
wanted AS (SELECT * EXCLUDE (to_name), {_ABSOLUTE} AS n, regexp_matches(from_file, '(?i)\\.pyw?i?$') AS py FROM src WHERE kind = 'IMPORTS'),
met AS (SELECT w.*, coalesce(a.id, a2.id) AS to_id FROM wanted w LEFT JOIN t_any a ON a.project_id = w.project_id AND a.n = w.n LEFT JOIN t_any a2 ON a2.project_id = w.project_id AND py AND a2.n = concat('src.', w.n) AND NOT starts_with(w.n, 'src.') WHERE w.n IS NOT NULL)
"""


@_R(f"WITH {_IMPORTS} SELECT DISTINCT project_id, concat('@external/', n, '::', n, '#Module') AS id FROM met WHERE to_id IS NULL")
def external_modules(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_imports(_pending(spark, d), _nodes(spark, d))[1].select("project_id", "id")


@_R(f"WITH {_IMPORTS} SELECT project_id, from_id, coalesce(to_id, concat('@external/', n, '::', n, '#Module')) AS to_id, max(confidence) AS confidence FROM met WHERE from_id IS NOT NULL AND from_id <> coalesce(to_id, '') GROUP BY 1, 2, 3")
def resolve_imports(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_imports(_pending(spark, d), _nodes(spark, d))[0].select("project_id", "from_id", "to_id", "confidence")


@_R(
    f"""WITH {_BASE},
reads AS (SELECT r.*, coalesce(f.id, a.id, v.id) AS from_id, CASE WHEN f.id IS NOT NULL THEN f.lang WHEN a.id IS NOT NULL THEN a.lang ELSE v.lang END AS lang, {_DIR.format('from_file')} AS folder FROM refs r LEFT JOIN t_file f ON f.project_id = r.project_id AND f.file_path = r.from_file AND f.n = r.from_qn LEFT JOIN t_any a ON a.project_id = r.project_id AND a.n = r.from_qn
  LEFT JOIN t_value_any v ON v.project_id = r.project_id AND v.n = r.from_qn AND NOT contains(r.from_qn, '.') WHERE r.kind IN ('READS', 'WRITES') AND to_name IS NOT NULL),
met AS (SELECT r.project_id, r.kind, r.confidence, from_id, CASE WHEN a.lang = r.lang THEN a.id ELSE v.id END AS to_id, CASE WHEN a.lang = r.lang THEN a.kind ELSE v.kind END AS to_kind, regexp_extract(to_name, '[^.]*$') AS last
  FROM reads r LEFT JOIN t_any a ON a.project_id = r.project_id AND a.n = r.to_name LEFT JOIN t_value v ON v.project_id = r.project_id AND v.language = r.lang AND v.folder = r.folder AND v.n = r.to_name AND NOT contains(r.to_name, '.')),
kept AS (SELECT *, to_kind <> 'Variable' AS call FROM met WHERE from_id IS NOT NULL AND from_id <> to_id AND (to_kind = 'Variable' OR (to_kind IN ('Function', 'Method') AND last NOT IN {_LIST(resolve.COMMON_METHODS)})))
SELECT project_id, from_id, to_id, CASE WHEN call THEN 'CALLS' ELSE kind END AS kind, max(CASE WHEN call THEN CAST(0.4 AS DOUBLE) ELSE confidence END) AS confidence, CASE WHEN call THEN 'binding_pass' ELSE 'resolve_pass' END AS source FROM kept GROUP BY 1, 2, 3, 4, 6"""
)
def resolve_reads(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_reads(_pending(spark, d), _nodes(spark, d)).select("project_id", "from_id", "to_id", "kind", "confidence", "source")


@_R(
    f"""WITH {_BASE}, settings AS (SELECT project_id, name AS n, min(id) AS id FROM in_force WHERE kind = 'Function' AND NOT is_exported GROUP BY ALL), modules AS (SELECT project_id, qualified_name AS n, min(id) AS id FROM in_force WHERE kind = 'Module' GROUP BY ALL), first AS (SELECT project_id, file_path, min(id) AS id FROM in_force GROUP BY ALL)
SELECT DISTINCT r.project_id, coalesce(m.id, i.id, concat(from_file, '::', coalesce(from_qn, regexp_replace(regexp_extract(from_file, '[^/]*$'), '\\.[^.]*$', '')), '#Module')) AS from_id, s.id AS to_id
FROM refs r JOIN settings s ON s.project_id = r.project_id AND s.n = r.to_name LEFT JOIN modules m ON m.project_id = r.project_id AND m.n = r.from_qn LEFT JOIN first i ON i.project_id = r.project_id AND i.file_path = r.from_file WHERE r.kind = 'REFERENCES' AND coalesce(m.id, i.id, '') <> s.id"""
)
def resolve_settings(spark: SparkSession, d: str) -> DataFrame:
    """References as uses of variables, with functions that aren't exported as the settings of a variable file."""
    n = written(resolve.nodes_in_force(table(spark, d, "symbols"), "is_exported"))
    setting = (F.col("kind") == "Function") & ~F.col("is_exported")
    n = n.withColumn("settings_file", F.when(setting, F.concat(F.lit("vars/"), "file_path", F.lit(".yml")))).withColumn("kind", F.when(setting, "Setting").otherwise(F.col("kind")))
    # the least node of a file is looked up by the file that refers; settings keep a second row under their own path
    both = n.drop("settings_file", "is_exported").where("kind <> 'Setting'").unionByName(n.where("kind = 'Setting'").withColumn("file_path", F.col("settings_file")).drop("settings_file", "is_exported")).unionByName(n.where("kind = 'Setting'").drop("settings_file", "is_exported").withColumn("kind", F.lit("Local")))
    e = _pending(spark, d).where("kind = 'REFERENCES'").withColumn("kind", F.lit("USES_VAR"))
    return resolve.resolve_settings(e, both)[0].select("project_id", "from_id", "to_id")


@_R(f"""WITH {_CALLS}, changed AS (SELECT project_id, file_path FROM source_files WHERE branch <> 'main'), near AS (SELECT DISTINCT b.project_id, a.file_path FROM calls c JOIN in_force a ON a.project_id = c.project_id AND a.id = c.from_id JOIN in_force b ON b.project_id = c.project_id AND b.id = c.to_id JOIN changed ch ON ch.project_id = b.project_id AND ch.file_path = b.file_path WHERE a.file_path <> b.file_path)
SELECT DISTINCT edge_id FROM pending_edges e WHERE EXISTS (SELECT 1 FROM (SELECT * FROM changed UNION SELECT * FROM near) f WHERE f.project_id = e.project_id AND f.file_path = e.from_file)""")
def incremental_scope(spark: SparkSession, d: str) -> DataFrame:
    """The references to resolve again after files of other branches changed: those of these files and of files that call into them."""
    n, e = _nodes(spark, d), _pending(spark, d)
    changed = table(spark, d, "source_files").where("branch <> 'main'").select("project_id", "file_path")
    near = audit.referrer_files(n, resolve.resolve_calls(e, n), changed)
    return resolve.scope(e, changed, near, threshold=1_000_000).select("edge_id").distinct()


@_R(f"""WITH {_CALLS}, inside AS (SELECT project_id, id FROM in_force WHERE starts_with(file_path, 'src/'))
SELECT c.project_id, from_id, to_id, confidence, CASE WHEN i.id IS NULL THEN 'old' ELSE 'new' END AS age FROM calls c LEFT JOIN inside i ON i.project_id = c.project_id AND i.id = c.from_id""")
def scoped_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Edges after the calls of the files below src/ were resolved again: theirs are new, the others are kept."""
    n = _nodes(spark, d)
    e = written(resolve.resolve_calls(_pending(spark, d), n))
    files = n.where("file_path like 'src/%'").select("project_id", "file_path").distinct()
    inside = n.where("file_path like 'src/%'").select("project_id", F.col("id").alias("from_id"))
    fresh = e.join(inside, ["project_id", "from_id"], "left_semi").withColumn("age", F.lit("new"))
    return resolve.replace_scoped(e.withColumn("age", F.lit("old")), fresh, n, ["CALLS"], files).select("project_id", "from_id", "to_id", "confidence", "age")


_WORDS = "regexp_extract_all(text, '\\b([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)*)\\b')"


@_R(
    f"""WITH {_CALLS}, failures AS (SELECT audit_id AS failure_id, project_id, concat('panic: at ', qualified_name, ' (', file_path, ':', start_line, ')') AS text FROM audit_candidates),
words AS (SELECT failure_id, project_id, unnest({_WORDS}) AS w FROM failures),
names AS (SELECT DISTINCT failure_id, project_id, name FROM (SELECT failure_id, project_id, w AS name FROM words UNION ALL SELECT failure_id, project_id, regexp_extract(w, '[^.]*$') FROM words WHERE contains(w, '.')) WHERE lower(name) NOT IN {_LIST(sorted(composite.NOISE))} AND length(name) >= 3),
keys AS (SELECT project_id, id, name FROM in_force WHERE kind IN ('Function', 'Method') UNION SELECT project_id, id, qualified_name FROM in_force WHERE kind IN ('Function', 'Method')),
hit AS (SELECT failure_id, project_id, id, count(*) AS frames FROM names JOIN keys USING (project_id, name) GROUP BY ALL),
fan AS (SELECT project_id, to_id AS id, count(*) AS callers FROM calls GROUP BY ALL),
scored AS (SELECT h.failure_id, h.project_id, h.id, frames, coalesce(callers, 0) AS callers, round(least(1.0, 0.45 + CASE WHEN frames > 1 THEN 0.1 ELSE 0 END + CASE WHEN h.failure_id IN (SELECT failure_id FROM failures f WHERE contains(f.text, concat('(', n.file_path, ':')) AND f.failure_id = h.failure_id AND f.project_id = h.project_id AND regexp_matches(n.file_path, '\\.\\w+$')) THEN 0.2 ELSE 0 END
  + CASE WHEN c.file_path IS NOT NULL THEN 0.2 ELSE 0 END + least(coalesce(callers, 0) / 20.0, 1.0) * 0.05), 6) AS score
  FROM hit h JOIN in_force n USING (project_id, id) LEFT JOIN fan USING (project_id, id) LEFT JOIN (SELECT DISTINCT project_id, file_path FROM source_files WHERE branch <> 'main') c ON c.project_id = h.project_id AND c.file_path = n.file_path)
SELECT failure_id, id, callers, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY failure_id ORDER BY score DESC, frames DESC, project_id, id) AS rank FROM scored) WHERE rank <= 5"""
)
def failure_suspects(spark: SparkSession, d: str) -> DataFrame:
    """Suspects of error texts that name audited symbols and their places."""
    a = table(spark, d, "audit_candidates")
    failures = a.select(F.col("audit_id").alias("failure_id"), "project_id", F.concat(F.lit("panic: at "), "qualified_name", F.lit(" ("), "file_path", F.lit(":"), "start_line", F.lit(")")).alias("text"))
    n = _nodes(spark, d)
    e = written(resolve.resolve_calls(_pending(spark, d), n))
    changed = table(spark, d, "source_files").where("branch <> 'main'").select("project_id", "file_path")
    return composite.suspects(failures, n, e, changed, 5).select("failure_id", "id", "callers", "score", "rank")


@_R(f"WITH {_CALLS}, starts AS (SELECT DISTINCT project_id, name FROM audit_candidates) SELECT n.project_id, n.name, arg_min(id, ({_FIXTURE}, {C.TEST_SQL.format('file_path')}, CASE kind WHEN 'Function' THEN 0 WHEN 'Method' THEN 1 WHEN 'Class' THEN 2 WHEN 'Module' THEN 9 ELSE 5 END, id)) AS id FROM in_force n JOIN starts USING (project_id, name) GROUP BY 1, 2")
def trace_starts(spark: SparkSession, d: str) -> DataFrame:
    """The node that each audited name stands for."""
    return resolve.trace_start(_nodes(spark, d), table(spark, d, "audit_candidates")).select("project_id", "name", "id")


queries, oracle_sql = _R.queries, _R.oracle_sql
