"""Analyses put together from search, traces and audits, for many inputs at once."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_fixture, is_test_file
from ..sources.languages import EXTENSIONS
from . import audit, search, traverse
from .mapping import map_rows

#: Words that error texts are made of and that name no function of a project, in small letters.
NOISE = frozenset(
    "aborted argument assert assertion at call called caused cause column crash critical debug during error errors exception exit failed failure false fatal file frame from goroutine in index info init invalid key line list main memory message "
    "missing module most name native new nil none null object of on panic raise recent root runtime signal source stack state status string system thread throw thrown traceback true type undefined unexpected unknown value warning with".split()
)
#: Shares of a suspect's score: named, named often, its file named, changed lately, and callers (full from 20).
WEIGHTS = {"named": 0.45, "often": 0.10, "file": 0.20, "changed": 0.20, "callers": 0.05}
FULL_CALLERS = 20
#: A path with the extension of a known language before a line number, and one in quotes after the word File.
_PLACE = r"([\w./\\-]*\.(?:" + "|".join(sorted(EXTENSIONS, key=len, reverse=True)) + r")):\d+"
_NAMED = r"\bFile\s+[\"']([^\"'\n]+)[\"']"


def frames(failures: DataFrame) -> DataFrame:
    """(failure_id, project_id, name, times): names in error texts, dotted ones also by their last part."""
    words = F.regexp_extract_all("text", F.lit(r"\b([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\b"), 1)
    one = failures.select("failure_id", "project_id", F.explode(words).alias("w"))
    both = one.select("failure_id", "project_id", F.explode(F.array_distinct(F.array("w", F.substring_index("w", ".", -1)))).alias("name"))
    return both.where(~F.lower("name").isin(*sorted(NOISE)) & (F.length("name") >= 3)).groupBy("failure_id", "project_id", "name").agg(F.count(F.lit(1)).alias("times"))


def trace_files(failures: DataFrame) -> DataFrame:
    """(failure_id, project_id, file_path): files that error texts name, with forward slashes."""
    found = F.array_union(F.regexp_extract_all("text", F.lit(_PLACE), 1), F.regexp_extract_all("text", F.lit(_NAMED), 1))
    return failures.select("failure_id", "project_id", F.explode(found).alias("f")).select("failure_id", "project_id", F.replace("f", F.lit("\\"), F.lit("/")).alias("file_path")).distinct()


def suspects(failures: DataFrame, nodes: DataFrame, edges: DataFrame, changed: DataFrame, k: int = 10) -> DataFrame:
    """The k likeliest causes of each failure (failure_id, project_id, text) among functions and methods.

    changed: project_id, file_path of files changed lately.  A text that is null
    or names nothing has no suspects.
    """
    code = nodes.where(F.col("kind").isin("Function", "Method")).select("project_id", "id", "name", "qualified_name", "file_path")
    keys = code.select("project_id", "id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("name"))
    named = frames(failures).join(keys, ["project_id", "name"]).groupBy("failure_id", "project_id", "id").agg(F.count(F.lit(1)).alias("frames"))
    fan_in = edges.where("kind = 'CALLS'").groupBy("project_id", F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    flag = lambda df, c: df.select("project_id", "file_path", *(["failure_id"] if "failure_id" in df.columns else []), F.lit(True).alias(c)).distinct()
    rows = named.join(code, ["project_id", "id"]).join(fan_in, ["project_id", "id"], "left").join(flag(changed, "changed"), ["project_id", "file_path"], "left").join(flag(trace_files(failures), "in_trace"), ["failure_id", "project_id", "file_path"], "left")
    add = lambda c, w: F.when(c, WEIGHTS[w]).otherwise(0.0)
    callers = F.coalesce("callers", F.lit(0))
    score = add(F.col("frames") > 0, "named") + add(F.col("frames") > 1, "often") + add(F.col("in_trace"), "file") + add(F.col("changed"), "changed") + F.least(callers / FULL_CALLERS, F.lit(1.0)) * WEIGHTS["callers"]
    scored = rows.select("failure_id", "project_id", "id", "file_path", "frames", callers.alias("callers"), F.round(F.least(score, F.lit(1.0)), 6).alias("score"))
    w = Window.partitionBy("failure_id").orderBy(F.desc("score"), F.desc("frames"), "project_id", "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def context_for_task(nodes: DataFrame, edges: DataFrame, index: search.Index, task: str, seeds: int = 5, depth: int = 1, kinds: tuple[str, ...] = ("Function", "Method", "Class")) -> DataFrame:
    """(id, role, depth): the nodes of some kinds that a task's words find, their callers and callees, and their neighbours in the file.

    index: search.node_index(nodes).  Seeds are 1 to 10.
    """
    got, _ = search.search_with_fallback(index, task, "code", min(max(seeds, 1), 10), F.col("kind").isin(*kinds))
    found = nodes.join(F.broadcast(got.select("project_id", "id")), ["project_id", "id"]).select("project_id", "id", "file_path")  # at most ten rows
    start = found.select("project_id", F.col("id").alias("start"))
    part = lambda df, role: df.select("id", F.lit(role).alias("role"), "depth")
    near = nodes.join(found.select("project_id", "file_path").distinct(), ["project_id", "file_path"]).select("id", F.lit(0).alias("depth"))
    all_parts = part(found.withColumn("depth", F.lit(0)), "1 seed").unionByName(part(traverse.trace(edges, start, "inbound", None, depth), "2 caller")).unionByName(part(traverse.trace(edges, start, "outbound", None, depth), "3 callee")).unionByName(part(near, "4 sibling"))
    return all_parts.groupBy("id").agg(F.min(F.struct("role", "depth")).alias("r")).select("id", F.substring("r.role", 3, 20).alias("role"), "r.depth")


def project_overview(projects: DataFrame, nodes: DataFrame, edges: DataFrame, min_edges: int = 0) -> DataFrame:
    """Projects with counts, edges per node, and whether they look unindexed: many nodes and hardly an edge."""
    n = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("file_path").alias("files"), F.count_if(is_fixture(F.col("file_path"))).alias("fixture_symbols"))
    e = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = projects.join(n, "project_id", "left").join(e, "project_id", "left").select("project_id", z("symbols"), z("files"), z("fixture_symbols"), z("edges"))
    ratio = F.coalesce(F.try_divide("edges", "symbols"), F.lit(0.0))
    return out.where(F.col("edges") >= min_edges).select("*", F.round(ratio, 6).alias("edge_ratio"), ((F.col("symbols") >= 1000) & (ratio < 0.001)).alias("ghost"))


def extraction_faults(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(project_id, file_path, reason) of files whose rows can't be right: crossed ranges, equal names and kinds, or no symbol.

    nodes: the symbols in force, each once.  With files (project_id, file_path)
    those without any node are reported.
    """
    crossed = nodes.where("end_line < start_line or end_byte < start_byte").select("project_id", "file_path", F.lit("bad range").alias("reason"))
    twice = nodes.groupBy("project_id", "file_path", "qualified_name", "kind").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("project_id", "file_path", F.lit("name collision").alias("reason"))
    out = crossed.unionByName(twice)
    if files is not None:
        out = out.unionByName(files.select("project_id", "file_path").join(nodes.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti").withColumn("reason", F.lit("no symbols")))
    return out.distinct()


def plan_change(nodes: DataFrame, edges: DataFrame, index: search.Index, target: str, depth: int = 4, decisions: DataFrame | None = None, most: int = 50) -> tuple[DataFrame, list[str]]:
    """Callers that a change of a target touches, nearest first, with a flag for tests, and warnings.

    The target is a node's id, a file's path, or words that find up to three
    functions or methods.  decisions (key, text): decision records that mention a
    word of a target's name come as rows of the role 'decision'.
    """
    if "::" in target:
        found = nodes.where(F.col("id") == target)
    elif "/" in target:
        found = nodes.where(F.col("file_path") == target)
    else:
        got, _ = search.search_with_fallback(index, target, "code", 3, F.col("kind").isin("Function", "Method"))
        found = nodes.join(F.broadcast(got.select("project_id", "id")), ["project_id", "id"])  # three rows
    near = audit.blast_radius(nodes, edges, found.select("project_id", "id"), depth)
    test = F.coalesce(F.col("is_test"), F.lit(False)) | F.coalesce(is_test_file(F.col("file_path")), F.lit(False))
    rows = near.select(F.when(test, "test").when(F.col("depth") == 1, "direct").otherwise("indirect").alias("role"), "id", "depth", "cross_package")
    warnings = []
    if rows.limit(15).count() > 14:
        warnings.append("more than 14 callers are touched; split the change")
    if decisions is not None:
        words = found.select(F.lower("name").alias("name")).where("length(name) >= 3").distinct()
        named = decisions.join(F.broadcast(words), F.contains(F.lower("text"), F.col("name")), "left_semi")  # names of one target
        rows = rows.unionByName(named.select(F.lit("decision").alias("role"), F.col("key").alias("id"), F.lit(0).alias("depth"), F.lit(False).alias("cross_package")))
    return rows.orderBy("depth", "role", "id").limit(most), warnings


def pages(df: DataFrame, order: list[str], limit: int = 50, offset: int = 0, most: int = 500) -> tuple[DataFrame, dict]:
    """A page of rows in a total order, with the total, whether more follow, and warnings about values that were out of range."""
    warnings = [f"{n} was {v} and is read as {w}" for n, v, w in (("limit", limit, min(max(limit, 1), most)), ("offset", offset, max(offset, 0))) if v != w]
    limit, offset = min(max(limit, 1), most), max(offset, 0)
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit), {"total": total, "has_more": offset + limit < total, "warnings": warnings}


def parity(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(project_id, file_path, expected, stored) of files whose counts differ; a file on one side only counts 0 on the other."""
    both = expected.join(stored, ["project_id", "file_path"], "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return both.select("project_id", "file_path", z("expected"), z("stored")).where("expected <> stored")


def fields(df: DataFrame, wanted: str | None) -> tuple[DataFrame, list[str]]:
    """The columns named in a list "a, b", in its order, and a warning for each that isn't there; all if none is."""
    names = [x.strip() for x in (wanted or "").split(",") if x.strip()]
    there = [x for x in dict.fromkeys(names) if x in df.columns]
    warnings = [f"unknown field {x!r}" for x in dict.fromkeys(names) if x not in df.columns]
    return (df.select(*there) if there else df), warnings


def nested_projects(projects: DataFrame) -> DataFrame:
    """(project_id, outer_id) of projects whose root lies below the root of another; the paths above a root are its keys, so no pairs are tried."""
    root = F.regexp_replace("root_path", "/+$", "")
    roots = projects.select("project_id", root.alias("root"))
    parts = F.split("root", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("outer_root")
    inner = roots.where(F.contains("root", F.lit("/"))).select("project_id", "root", above).where("outer_root <> root and outer_root <> ''")
    outer = roots.select(F.col("project_id").alias("outer_id"), F.col("root").alias("outer_root"))
    return inner.join(outer, "outer_root").select("project_id", "outer_id")


def line_changes(pairs: DataFrame) -> DataFrame:
    """(key, sign, line, text) of the lines that a second reading of a text lost (-) or gained (+); pairs: key, before, after.

    Equal texts give no row; null counts as empty.
    """

    def fn(key: str, before: str | None, after: str | None) -> list[tuple]:
        if before == after:
            return []
        a, b = (before or "").split("\n") if before else [], (after or "").split("\n") if after else []
        out = []
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag != "equal":
                out += [(key, "-", n + 1, a[n]) for n in range(i, j)] + [(key, "+", n + 1, b[n]) for n in range(k, m)]
        return out

    return map_rows(pairs.select("key", "before", "after"), fn, "key string, sign string, line int, text string")


def event_lines(events: DataFrame) -> DataFrame:
    """Server-sent events, one text per row of (id, event, data): the data's columns as JSON."""
    return events.select("id", F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\nevent: "), "event", F.lit("\ndata: "), F.to_json("data"), F.lit("\n\n")).alias("text"))
