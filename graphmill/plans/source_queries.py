"""Queries of file sources and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import extract_files
from ..functions import columns as C
from ..operators.composite import parity
from ..operators.resolve import nodes_in_force
from ..session import table
from ..sources import files as S
from ..sources.languages import language_of
from .register import Register
from .resolve_queries import IN_FORCE


_R = Register()
_MODULE = "regexp_replace(replace(file_path, '/', '.'), '\\.\\w+$', '')"
_IN_MODULE = f"(qualified_name = {_MODULE} OR starts_with(qualified_name, {_MODULE} || '.'))"


@_R(f"WITH {IN_FORCE} SELECT project_id, file_path, kind, qualified_name, start_line FROM in_force WHERE {_IN_MODULE}")
def extract_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols extracted from the source files that the index has too, where names begin with the file's module.

    The table also has symbols of files as they were earlier; those that the
    files no longer have are missing here and in nobody's favour.
    """
    mine = extract_files(table(spark, d, "source_files")).where("what = 'symbol'")
    key = ["project_id", "file_path", "kind", "qualified_name", "start_line"]
    return mine.join(nodes_in_force(table(spark, d, "symbols"), "start_line").select(*key), key, "left_semi").select(*key)


@_R("""WITH last AS (SELECT project_id, file_path, arg_max(n_symbols, (extracted_at, attempt, n_symbols)) AS expected FROM python_responses GROUP BY ALL), """ + IN_FORCE + """, stored AS (SELECT project_id, file_path, count(*) AS stored FROM in_force WHERE language = 'Python' GROUP BY ALL)
SELECT coalesce(l.project_id, s.project_id) AS project_id, coalesce(l.file_path, s.file_path) AS file_path, coalesce(expected, 0) AS expected, coalesce(stored, 0) AS stored FROM last l FULL JOIN stored s USING (project_id, file_path) WHERE coalesce(expected, 0) <> coalesce(stored, 0)""")
def parity_check(spark: SparkSession, d: str) -> DataFrame:
    """Files whose number of stored symbols isn't what the last answer of the extractor says."""
    r = table(spark, d, "python_responses")
    last = r.groupBy("project_id", "file_path").agg(F.max_by("n_symbols", F.struct("extracted_at", "attempt", "n_symbols")).alias("expected"))
    stored = nodes_in_force(table(spark, d, "symbols")).where("language = 'Python'").groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("stored"))
    return parity(last, stored)


@_R(f"SELECT file_id FROM source_files WHERE regexp_matches(file_path, '{S.IN_SKIP_DIR}') OR regexp_matches(lower(regexp_extract(file_path, '[^/]*$')), '{S.MINIFIED}') OR n_bytes > {S.MOST_BYTES} OR lower(regexp_extract(file_path, '[^/]*$')) IN ({', '.join(repr(x) for x in S.LOCK_FILES)})")
def skip_rules(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return f.where(S.skipped(F.col("file_path"), F.col("n_bytes"))).select("file_id")


@_R("SELECT file_id FROM source_files WHERE regexp_matches(file_path, '(?:^|/)[^/]*_[a-m][^/]*\\.go$') AND NOT regexp_matches(file_path, '_test\\.go$') OR (starts_with(file_path, 'tools/') AND NOT regexp_matches(file_path, '^tools/(?:.*/)?[^/]*\\.py$'))")
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that two ignore files leave out, one at the root and one of a directory."""
    f = table(spark, d, "source_files")
    rules = spark.createDataFrame([("", "# two rules\n*_[a-m]*.go\n!*_test.go\n/tools/**\n"), ("tools", "!*.py\n")], "dir string, content string")
    return f.join(S.ignored(f.select("file_path").distinct(), rules), "file_path", "left_semi").select("file_id")


@_R("""SELECT CASE WHEN regexp_matches(file_path, '\\.(?i:py|pyi|pyw)$') THEN 'Python' WHEN regexp_matches(file_path, '\\.(?i:go)$') THEN 'Go' WHEN regexp_matches(file_path, '\\.(?i:[mc]?jsx?)$') THEN 'JavaScript' WHEN regexp_matches(file_path, '\\.(?i:json)$') THEN 'JSON'
  WHEN regexp_matches(content, '^#![^\\n]*python') THEN 'Python' ELSE 'Unknown' END AS detected, count(*) AS n FROM source_files GROUP BY 1""")
def detected_languages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files")
    return f.groupBy(language_of(F.col("file_path"), F.col("content")).alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@_R(f"WITH {IN_FORCE} SELECT s.project_id, s.id, md5(decode(encode(content)[start_byte + 1 : end_byte])) AS code_md5 FROM in_force s JOIN source_files f ON f.project_id = s.project_id AND f.file_path = s.file_path WHERE end_byte <= octet_length(encode(content))")
def symbol_source(spark: SparkSession, d: str) -> DataFrame:
    """The code of each symbol in force by its byte range, as a hash; ranges beyond the file, which changed, are left out."""
    now = nodes_in_force(table(spark, d, "symbols"), "start_byte", "end_byte").select("project_id", "id", "file_path", "start_byte", "end_byte")
    f = table(spark, d, "source_files").select("project_id", "file_path", "content")
    code = C.line_range_text(F.col("content"), F.col("start_byte"), F.col("end_byte"))
    return now.join(f, ["project_id", "file_path"]).where(F.col("end_byte") <= F.octet_length("content")).select("project_id", "id", F.md5(code).alias("code_md5"))


@_R("SELECT project_id, symbol_id, kind_baseline, path_penalty, ident_bonus, generated_pen FROM signals WHERE path_penalty IS NOT NULL AND ident_bonus IS NOT NULL AND generated_pen IS NOT NULL AND NOT (symbol_id LIKE '%#Module' AND regexp_matches(file_path, '[^/]*\\.[^/]*\\.[^/]*$'))")
def confidence_signals(spark: SparkSession, d: str) -> DataFrame:
    """The components of confidence, made from kind, path, name and the head of the file; those that the index has.

    Modules with a dot in their name are left out: the table takes them for identifiers.
    """
    n = nodes_in_force(table(spark, d, "symbols")).select("project_id", F.col("id").alias("symbol_id"), "kind", "file_path", "name")
    f = table(spark, d, "source_files").select("project_id", "file_path", C.generated_penalty(F.col("content")).alias("generated_pen"))
    there = table(spark, d, "signals").where("path_penalty is not null and ident_bonus is not null and generated_pen is not null and not (symbol_id like '%#Module' and file_path rlike '[^/]*[.][^/]*[.][^/]*$')")
    made = n.join(f, ["project_id", "file_path"]).select("project_id", "symbol_id", C.kind_baseline(F.col("kind"), F.lit(0.9)).alias("kind_baseline"), C.path_penalty(F.col("file_path")).alias("path_penalty"), C.identifier_bonus(F.col("name")).alias("ident_bonus"), "generated_pen")
    return made.join(there.select("project_id", "symbol_id"), ["project_id", "symbol_id"], "left_semi")


queries, oracle_sql = _R.queries, _R.oracle_sql
