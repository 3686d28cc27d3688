"""Aggregates over logs of calls, hooks, sessions and failures.

Windows end at the last call of the data, never at the clock's time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running_sum


def recent(calls: DataFrame, days: int | None = 7, ts: str = "ts") -> DataFrame:
    """Calls of the last days of the data; all if days is None."""
    if days is None:
        return calls
    last = calls.agg(F.max(ts)).scalar()
    return calls.where(F.col(ts) >= last - F.expr(f"INTERVAL {days} DAYS"))


def _tally(calls: DataFrame, key: str) -> DataFrame:
    return calls.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"),
        F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("saved"),
        F.round(F.avg("tokens_saved"), 4).alias("mean_saved"),
        F.round(F.avg("tokens_saved_pct"), 4).alias("mean_pct"),
        F.round(F.avg("response_bytes"), 4).alias("mean_bytes"),
    )


def tool_tally(calls: DataFrame, days: int | None = 7, k: int = 20) -> DataFrame:
    """Per tool: calls, tokens saved, mean share saved and mean bytes; the k most used."""
    return _tally(recent(calls, days), "tool").orderBy(F.desc("calls"), "tool").limit(k)


def tier_tally(calls: DataFrame, days: int | None = 7) -> DataFrame:
    """The same per complexity tier; null and empty tiers are left out."""
    return _tally(recent(calls, days).where("complexity_tier <> ''"), "complexity_tier")


def payload_distribution(calls: DataFrame) -> DataFrame:
    """Per tool: least, mean, largest and total bytes of responses."""
    b = F.col("response_bytes")
    return calls.where(b.isNotNull()).groupBy("tool").agg(F.min(b).alias("least"), F.round(F.avg(b), 4).alias("mean"), F.max(b).alias("most"), F.sum(b).alias("total"), F.count(F.lit(1)).alias("calls"))


def payload_outliers(calls: DataFrame, least: int = 100 * 1024, ratio: float = 10.0, k: int = 3) -> DataFrame:
    """Tools whose largest response is large and far above their mean, the k most extreme."""
    d = payload_distribution(calls).withColumn("ratio", F.round(F.try_divide("most", "mean"), 4))
    return d.where((F.col("most") >= least) & (F.col("ratio") >= ratio)).orderBy(F.desc("ratio"), "tool").limit(k)


def tool_mix(calls: DataFrame) -> DataFrame:
    """Calls, Shannon entropy in bits and share of the most used tool, with the advice it gives: one row."""
    n = calls.groupBy("tool").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("total")
    out = n.withColumn("total", n.agg(F.sum("n")).scalar()).agg(F.coalesce(F.max("total"), F.lit(0)).alias("calls"), F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"), F.round(F.max(p), 6).alias("top_share"))
    return out.select("calls", "entropy", "top_share", ((F.col("calls") >= 100) & (F.col("entropy") < 1.0) & (F.col("top_share") >= 0.8)).alias("one_sided"))


def session_sums(calls: DataFrame) -> DataFrame:
    """All-time sums: one row, zeros without calls."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return calls.agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("calls"), z("tokens_used"), z("tokens_saved"), z("response_bytes"))


def map_sums(df: DataFrame, column: str) -> DataFrame:
    """(key, total): sums by key of a column of JSON objects of numbers; rows that aren't objects count nothing."""
    return df.select(F.explode(F.from_json(column, "map<string,bigint>")).alias("key", "v")).groupBy("key").agg(F.sum("v").alias("total"))


def hook_rates(hooks: DataFrame) -> DataFrame:
    """Of hook rows (decision, took_recommendation): redirects, taken and overridden, with percentages."""
    redirected = F.col("decision") == "redirect"
    taken = redirected & (F.coalesce(F.col("took_recommendation"), F.lit(0)) == 1)
    n, r, t = F.count(F.lit(1)), F.count_if(redirected), F.count_if(taken)
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0)), 4)
    return hooks.agg(n.alias("rows"), r.alias("redirected"), t.alias("taken"), (r - t).alias("overridden"), pct(r, n).alias("redirect_pct"), pct(t, r).alias("taken_pct"))


def hook_rates_by_tool(hooks: DataFrame) -> DataFrame:
    """The same per tool (tool_name)."""
    redirected = F.col("decision") == "redirect"
    taken = redirected & (F.coalesce(F.col("took_recommendation"), F.lit(0)) == 1)
    r, t = F.count_if(redirected), F.count_if(taken)
    return hooks.groupBy("tool_name").agg(F.count(F.lit(1)).alias("rows"), r.alias("redirected"), t.alias("taken"), (r - t).alias("overridden"), F.round(F.coalesce(F.try_divide(t * 100.0, r), F.lit(0.0)), 4).alias("taken_pct"))


def failures_by_reason(failures: DataFrame) -> DataFrame:
    """(reason, n); null and empty reasons aren't failures."""
    return failures.where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def slow_calls(calls: DataFrame, threshold: int, k: int = 100) -> DataFrame:
    """The k newest calls (call_id, tool, ms, ts) that took at least the threshold."""
    return calls.where(F.col("ms") >= threshold).orderBy(F.desc("ts"), F.desc("call_id")).limit(k)


def next_calls(hooks: DataFrame, calls: DataFrame, k: int = 3) -> DataFrame:
    """For each hook row the next k calls of its session: id, position, call_id, tool.

    Hooks and calls are merged by session and time, and calls are numbered by a
    running sum that splits long sessions over tasks; a hook then needs the
    calls with the next k numbers.
    """
    h = hooks.select("session_id", "ts", F.lit(0).alias("side"), F.col("id").alias("key"), F.lit(None).cast("string").alias("tool"), F.lit(0).alias("one"))
    c = calls.select("session_id", "ts", F.lit(-1).alias("side"), F.col("call_id").alias("key"), "tool", F.lit(1).alias("one"))
    # at equal times calls stand before hooks, as a call must be later than its hook
    merged = running_sum(h.unionByName(c), ["session_id"], ["ts", "side", "key"], "one", "seen")
    hook_rows = merged.where("side = 0").select("session_id", F.col("key").alias("id"), "seen")
    call_rows = merged.where("side = -1").select("session_id", F.col("seen").alias("at"), F.col("key").alias("call_id"), "tool")
    wanted = hook_rows.select("session_id", "id", F.posexplode(F.sequence(F.col("seen") + 1, F.col("seen") + k)).alias("position", "at"))
    return wanted.join(call_rows, ["session_id", "at"]).select("id", (F.col("position") + 1).alias("position"), "call_id", "tool")


def size_estimate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, bytes): estimated size on disk of a project's rows; also of projects that have edges only."""
    t = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    n = nodes.groupBy("project_id").agg((F.sum(t("id") + t("name") + t("qualified_name") + t("signature") + t("docstring")) + F.count(F.lit(1)) * 64).alias("a"))
    e = edges.groupBy("project_id").agg((F.sum(t("from_id") + t("to_id")) + F.count(F.lit(1)) * 32).alias("b"))
    return n.join(e, "project_id", "full").select("project_id", F.floor(F.coalesce("a", F.lit(0)) * 1.5 + F.coalesce("b", F.lit(0))).cast("bigint").alias("bytes"))


def bench_summary(runs: DataFrame) -> DataFrame:
    """Per tool of (tool, latency_ms, actual, baseline): p50 at index n / 2, p95 at n * 95 / 100, whole means, share saved.

    Counts of equal latencies stand for the sorted list.
    """
    c = runs.where("latency_ms is not null").groupBy("tool", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    cum = c.withColumn("up_to", F.sum("c").over(Window.partitionBy("tool").orderBy("latency_ms"))).withColumn("n", F.sum("c").over(Window.partitionBy("tool")))
    at = lambda i: F.min(F.when(F.col("up_to") > F.expr(i), F.col("latency_ms")))
    lat = cum.groupBy("tool").agg(at("n div 2").alias("p50"), at("n * 95 div 100").alias("p95"))
    means = runs.groupBy("tool").agg(F.expr("sum(actual) div count(*)").alias("mean_actual"), F.expr("sum(baseline) div count(*)").alias("mean_baseline"))
    return means.join(lat, "tool", "left").withColumn("saved_pct", F.round(F.coalesce(F.try_divide((F.col("mean_baseline") - F.col("mean_actual")) * 100.0, "mean_baseline"), F.lit(0.0)), 4))


def milestones(totals: DataFrame, thresholds: list[int], fired: DataFrame) -> DataFrame:
    """(key, threshold): the highest threshold that each total (key, total) reached, unless it has fired before."""
    reached = F.lit(None).cast("bigint")
    for t in sorted(thresholds):
        reached = F.when(F.col("total") >= t, F.lit(t)).otherwise(reached)
    return totals.select("key", reached.cast("bigint").alias("threshold")).where("threshold is not null").join(fired.select("key", "threshold"), ["key", "threshold"], "left_anti")


def counters(calls: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Count, sum and largest value by labels."""
    return calls.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), F.max(value).alias("max"))


def prometheus(df: DataFrame, name: str, labels: list[str], values: list[str]) -> DataFrame:
    """Lines of the text exposition format, one per row and value."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '(["\\\\])', "\\\\$1"), F.lit('"')) for c in labels))
    rows = F.array(*(F.concat(F.lit(f"{name}_{v}{{"), pairs, F.lit("} "), F.col(v).cast("string")) for v in values))
    return df.select(F.explode(rows).alias("line"))
