"""Source files that do not parse.

Each file is checked as a whole by the packrat grammars of ``syntax``: its full
token string must be consumed.  The result per file gives the furthest failure
and what it looks like; rates are counted per project and language.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import map_rows
from . import syntax

#: Spellings of the languages in the tables, in small letters.
SPELLINGS = {"py": "Python", "python": "Python", "python3": "Python", "js": "JavaScript", "javascript": "JavaScript", "node": "JavaScript", "ecmascript": "JavaScript", "mjs": "JavaScript", "go": "Go", "golang": "Go", "json": "JSON"}
_NAMES = {"python": "Python", "go": "Go", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "json": "JSON"}

VERDICTS = "file_id long, project_id string, language string, valid boolean, failed_at int, failed_line int, cause string"


def language_name(spelling: Column) -> Column:
    """A language column brought to one spelling; unknown and null become null."""
    names = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return names[F.lower(F.trim(spelling))]


def _verdict(file_id: int, project_id: str, path: str | None, text: str | None) -> Iterator[tuple]:
    kind = syntax.kind_of(path, text or "")
    if kind is None or text is None:
        yield file_id, project_id, _NAMES.get(kind or ""), None, None, None, None
        return
    try:
        valid, at, cause = syntax.check(kind, text)
    except RecursionError:
        yield file_id, project_id, _NAMES[kind], None, None, None, "not decided"
        return
    yield file_id, project_id, _NAMES[kind], valid, None if valid else at, None if valid else syntax.line_of(text, at), cause or None


def syntax_flags(files: DataFrame) -> DataFrame:
    """One row per row of files (file_id, project_id, file_path, content): VERDICTS.

    ``valid`` is null where no language is known, the content is null or the
    check couldn't decide (an expression of tens of thousands of nested
    operators; brackets may nest to any depth); an empty Python or JavaScript file is valid, an empty Go or JSON file isn't.
    Repeated rows give repeated verdicts; other columns are ignored.
    ``failed_at`` counts characters.
    """
    return map_rows(files.select("file_id", "project_id", "file_path", "content"), _verdict, VERDICTS)


def invalid_files(files: DataFrame) -> DataFrame:
    """file_id of each file that isn't valid."""
    flags = map_rows(files.select("file_id", "project_id", "file_path", "content"), lambda *x: [(v[0],) for v in _verdict(*x) if v[3] is False], "file_id long")
    return flags.dropDuplicates(["file_id"])


def invalid_rates(files: DataFrame, responses: DataFrame, audits: DataFrame) -> DataFrame:
    """Rates per project and language: files, invalid ones, those reported by the extractor, audited symbols.

    A file counts as reported if the last attempt for it names an error of the
    source.  audits' languages are brought to the same names; groups that occur
    on one side only have zeros on the other.
    """
    flags = syntax_flags(files).where(F.col("language").isNotNull())
    last = responses.groupBy("file_id").agg(F.max_by(F.coalesce("error", F.lit("")), F.struct("extracted_at", "attempt")).alias("error"))
    reported = last.where(F.col("error").rlike("(?i)line \\d+|syntax|indent|never closed|unterminated|unexpected"))
    got = (
        flags.join(reported.select("file_id", F.lit(1).alias("reported")), "file_id", "left")
        .groupBy("project_id", "language")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if(~F.col("valid")).alias("invalid_files"),
            F.count_if(~F.col("valid") & F.col("reported").isNotNull()).alias("invalid_reported"),
            F.count_if(F.col("cause") == "merge conflict").alias("conflicts"),
        )
    )
    audited = audits.withColumn("language", language_name(F.col("language"))).where("language is not null").groupBy("project_id", "language").agg(F.count_distinct("audit_id").alias("audited"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return got.join(audited, ["project_id", "language"], "full").select(
        "project_id", "language", *(zero(c) for c in ("files", "invalid_files", "invalid_reported", "conflicts", "audited")), F.round(F.try_divide(F.col("invalid_files"), F.col("files")), 6).alias("invalid_rate")
    )
