"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.mapping import spread
from ..session import table
from . import encode, handwritten, invalid, mixture, pairs, percentiles, reading

Query = Callable[[SparkSession, str], DataFrame]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "source_files").select("file_id", "project_id", "file_path", "content"), "file_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source"), "doc_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.code_pairs(_files(spark, d), table(spark, d, "symbols"), code=False)


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.code_pairs(_files(spark, d), table(spark, d, "symbols"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid.invalid_files(_files(spark, d))


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return invalid.syntax_flags(_files(spark, d))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid.invalid_rates(_files(spark, d), table(spark, d, "python_responses"), table(spark, d, "audit_candidates"))


def _latency_state(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.value_counts(percentiles.plausible_latencies(table(spark, d, "tool_latency_stats")), ["tool", "server_id", "day"], "max_ms")


def p4_latency(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of max_ms per tool, server and day."""
    return percentiles.percentiles(_latency_state(spark, d), ["tool", "server_id", "day"])


def p4_latency_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of max_ms per tool, from the states of all servers and days put together."""
    return percentiles.percentiles(percentiles.coarser(_latency_state(spark, d), ["tool"]), ["tool"])


def p4_states(spark: SparkSession, d: str) -> DataFrame:
    """The mergeable states themselves, with values rounded to three digits: an error of at most 0.5 percent."""
    return percentiles.value_counts(percentiles.plausible_latencies(table(spark, d, "tool_latency_stats")), ["tool", "server_id", "day"], "max_ms", digits=3)


def p4_savings(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of p95_ms per tool."""
    return percentiles.percentiles(percentiles.value_counts(table(spark, d, "savings_baseline"), ["tool"], "p95_ms"), ["tool"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_files(spark, d)).select("file_id")


def p6_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_files(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(_documents(spark, d))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(_documents(spark, d), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixture.report(mixture.mixture(_documents(spark, d), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).where("level = 4").select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_documents(spark, d), table(spark, d, "reading_labels"))


_USABLE = """
usable AS (SELECT tool, server_id, strftime(flushed_at, '%Y-%m-%d') AS day, CAST(max_ms AS DOUBLE) AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY stat_id ORDER BY ingested_at DESC, flushed_at DESC, server_id DESC, tool DESC, total_ms DESC, max_ms DESC) AS k FROM tool_latency_stats)
  WHERE k = 1 AND max_ms >= 0 AND max_ms <= total_ms)
"""
_PICK = """
, counted AS (SELECT {groups}, v, count(*) AS c FROM {source} GROUP BY ALL),
running AS (SELECT *, sum(c) OVER (PARTITION BY {groups} ORDER BY v) AS up_to, sum(c) OVER (PARTITION BY {groups}) AS n FROM counted)
SELECT {groups}, CAST(max(n) AS BIGINT) AS n, {columns} FROM running GROUP BY {groups}
"""
_COLUMNS = ", ".join(f"min(v) FILTER (WHERE up_to >= greatest(1, ({k} * n + 999) // 1000)) AS {c}" for c, k in percentiles.TARGETS.items())


def queries() -> dict[str, Query]:
    found = (p1_found, p1_pairs, p3_found, p3_files, p3_rates, p4_latency, p4_latency_merged, p4_states, p4_savings, p6_found, p6_reasons, p7_ids, p8_mixture, p8_report, p9_found, p9_levels)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    savings = "WITH usable AS (SELECT tool, p95_ms AS v FROM savings_baseline WHERE p95_ms IS NOT NULL AND NOT isnan(p95_ms))"
    return {
        "p4_latency": "WITH " + _USABLE + _PICK.format(groups="tool, server_id, day", source="usable", columns=_COLUMNS),
        "p4_latency_merged": "WITH " + _USABLE + _PICK.format(groups="tool", source="usable", columns=_COLUMNS),
        "p4_states": "WITH " + _USABLE + """SELECT tool, server_id, day, CASE WHEN v = 0 THEN 0.0 ELSE round(v * pow(10.0, 2 - floor(log10(abs(v))))) / pow(10.0, 2 - floor(log10(abs(v)))) END AS value, count(*) AS n FROM usable GROUP BY ALL""",
        "p4_savings": savings + _PICK.format(groups="tool", source="usable", columns=_COLUMNS),
    }
