"""Audits of a graph: what is unused, central, near, changed or suspect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_fixture, is_test_file, package_of
from . import traverse

KEY = ["project_id", "id"]


def _inbound(edges: DataFrame) -> DataFrame:
    return edges.select("project_id", F.col("to_id").alias("id")).distinct()


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("Function", "Method", "Class"), min_confidence: float = 0.0, interface_methods: DataFrame | None = None) -> DataFrame:
    """Nodes that nothing refers to: not exported, no entry, no test, no inbound edge of any kind.

    Methods named in interface_methods (project_id, name) are kept out, as are
    Go's init functions.  Nodes with null flags count as not flagged.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = nodes.where(F.col("kind").isin(*kinds) & ~flag("is_exported") & ~flag("is_entry_point") & ~flag("is_test") & (F.col("extraction_confidence") >= min_confidence))
    out = out.where(~((F.col("name") == "init") & (F.col("language") == "Go"))).join(_inbound(edges), KEY, "left_anti")
    if interface_methods is not None:
        declared = interface_methods.select("project_id", "name", F.lit("Method").alias("kind")).distinct()
        out = out.join(declared, ["project_id", "name", "kind"], "left_anti")
    return out


def audit_unused(nodes: DataFrame, edges: DataFrame, candidates: DataFrame, depth: int = 2) -> DataFrame:
    """Candidates with how sure it is that they are unused: low with a direct caller, medium with a farther one, else high."""
    starts = candidates.select("project_id", F.col("id").alias("start"))
    found = traverse.trace(edges, starts, "inbound", ["CALLS"], depth)
    near = found.groupBy("project_id", F.col("start").alias("id")).agg(F.count(F.lit(1)).alias("callers"), F.min("depth").alias("nearest"))
    sure = F.when(F.col("nearest") == 1, "low").when(F.col("nearest") > 1, "medium").otherwise("high")
    return candidates.join(near, KEY, "left").select(*(candidates[c] for c in candidates.columns), F.coalesce("callers", F.lit(0)).alias("callers"), sure.alias("confidence"))


def hotspots(nodes: DataFrame, edges: DataFrame, k: int = 20, tests: bool = False) -> DataFrame:
    """The k nodes with most inbound edges, ties by id; tests are left out unless asked for."""
    n = nodes if tests else nodes.where(~F.coalesce(F.col("is_test"), F.lit(False)) & ~F.coalesce(is_test_file(F.col("file_path")), F.lit(False)))
    degree = edges.groupBy("project_id", F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return n.select("project_id", "id", "name", "kind").join(degree, KEY).orderBy(F.desc("in_degree"), "project_id", "id").limit(k)


def module_summary(nodes: DataFrame, prefix: str) -> DataFrame:
    """Counts of the nodes below a path prefix: one row, zeros where nothing is there."""
    n = nodes.where(F.startswith(F.col("file_path"), F.lit(prefix)))
    return n.agg(
        F.count_distinct("file_path").alias("files"),
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(F.col("is_exported")).alias("exported"),
        F.count_if(F.col("is_entry_point")).alias("entry_points"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("is_test")), F.count_if(~F.col("is_test"))), F.lit(0.0)), 6).alias("test_ratio"),
    )


def module_boundary(nodes: DataFrame, edges: DataFrame, prefix: str, kinds: tuple[str, ...] = ("CALLS",)) -> DataFrame:
    """Edges across a path prefix: direction in or out, both names; an end that is unknown counts as outside."""
    e = edges.where(F.col("kind").isin(*kinds))
    inside = lambda c: F.coalesce(F.startswith(F.col(c), F.lit(prefix)), F.lit(False))
    side = lambda p: nodes.select("project_id", F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("file_path").alias(f"{p}_file"))
    joined = e.join(side("from"), ["project_id", "from_id"], "left").join(side("to"), ["project_id", "to_id"], "left")
    crossing = joined.where(inside("from_file") != inside("to_file"))
    return crossing.select("project_id", F.when(inside("to_file"), "in").otherwise("out").alias("direction"), "from_id", "from_name", "to_id", "to_name", "kind")


def blast_radius(nodes: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 4) -> DataFrame:
    """Callers of the targets (project_id, id) at their least depth, with what a plan needs to know of each.

    cross_package: the last directory differs from that of every target reached.
    """
    starts = targets.select("project_id", F.col("id").alias("start"))
    found = traverse.trace(edges, starts, "inbound", ["CALLS"], min(max(depth, 1), 4))
    n = nodes.select("project_id", "id", "name", "kind", "file_path", "is_test")
    of = nodes.select("project_id", F.col("id").alias("start"), package_of(F.col("file_path")).alias("target_package"))
    rows = found.join(n, KEY).join(of, ["project_id", "start"])
    return (
        rows.groupBy("project_id", "id", "name", "kind", "file_path", "is_test")
        .agg(F.min("depth").alias("depth"), F.min("via").alias("via_kind"), F.min((package_of(F.col("file_path")) != F.col("target_package")).cast("int")).alias("far"))
        .select("project_id", "id", "name", "kind", "file_path", "is_test", "depth", "via_kind", (F.col("far") == 1).alias("cross_package"), traverse.risk(F.col("depth")).alias("risk"))
    )


def neighborhood(nodes: DataFrame, targets: DataFrame, limit: int = 50, offset: int = 0, include_self: bool = False) -> DataFrame:
    """Nodes in the files of the targets, by file and line; limit is at most 500."""
    here = targets.select("project_id", "id", "file_path")
    files = here.select("project_id", "file_path").distinct()
    out = nodes.join(files, ["project_id", "file_path"])
    if not include_self:
        out = out.join(here.select("project_id", "id"), KEY, "left_anti")
    return out.orderBy("project_id", "file_path", "start_line", "id").offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def referrer_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, file_path, referrer): files with an edge into each of the files (project_id, file_path)."""
    to = nodes.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"]).select("project_id", F.col("id").alias("to_id"), "file_path")
    frm = nodes.select("project_id", F.col("id").alias("from_id"), F.col("file_path").alias("referrer"))
    return edges.select("project_id", "from_id", "to_id").join(to, ["project_id", "to_id"]).join(frm, ["project_id", "from_id"]).where("referrer <> file_path").select("project_id", "file_path", "referrer").distinct()


def symbol_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, old_id, new_id): nodes with the same qualified name and kind whose id changed, the least new id each."""
    gone = old.select("project_id", "qualified_name", "kind", F.col("id").alias("old_id")).join(new.select("project_id", F.col("id").alias("old_id")), ["project_id", "old_id"], "left_anti")
    fresh = new.select("project_id", "qualified_name", "kind", F.col("id").alias("new_id"))
    least = fresh.groupBy("project_id", "qualified_name", "kind").agg(F.min("new_id").alias("new_id"))  # an id that is gone isn't among the new ones
    return gone.join(least, ["project_id", "qualified_name", "kind"]).select("project_id", "old_id", "new_id")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes and edges by kind."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("what"), "kind", "n").unionAll(edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def language_coverage(nodes: DataFrame) -> DataFrame:
    """Per language: mean confidence, count, and whether a parser or patterns read it."""
    out = nodes.groupBy("language").agg(F.avg("extraction_confidence").alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select("language", F.round("mean", 6).alias("mean_confidence"), "n", F.when(F.col("mean") >= 0.99, "AST").otherwise("Regex").alias("parser"))


def kind_percentiles(nodes: DataFrame) -> DataFrame:
    """Per kind: count and the 10th and 50th percentile of confidence, at index p * (n - 1) / 100 of the sorted values.

    Works on counts of values rounded to six digits, of which a kind has a million
    at most, as confidence lies between 0 and 1.
    """
    from pyspark.sql import Window

    v = F.col("extraction_confidence")
    counts = nodes.where(v.isNotNull()).groupBy("kind", F.round(v, 6).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("kind").orderBy("v")
    cum = counts.withColumn("up_to", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("kind")))
    at = lambda p: F.min(F.when(F.col("up_to") > F.expr(f"({p} * (n - 1)) div 100"), F.col("v")))
    return cum.groupBy("kind").agg(F.max("n").alias("n"), F.round(at(10), 6).alias("p10"), F.round(at(50), 6).alias("p50"))


BUCKETS = ((0.0, 0.5, "[0,.5)"), (0.5, 0.7, "[.5,.7)"), (0.7, 0.9, "[.7,.9)"), (0.9, 9.0, "[.9,1]"))


def bucket(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in BUCKETS:
        out = F.when((c >= low) & (c < high), name).otherwise(out)
    return out


def confidence_histogram(nodes: DataFrame) -> DataFrame:
    """(bucket, n) of confidence; all four buckets, also empty ones."""
    names = nodes.sparkSession.createDataFrame([(b[2],) for b in BUCKETS], "bucket string")
    got = nodes.groupBy(bucket(F.col("extraction_confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def changed_nodes(nodes: DataFrame, hunks: DataFrame, width: int = 64) -> DataFrame:
    """Nodes whose lines overlap a hunk (project_id, file_path, first, last), with the lines that overlap.

    A range join made of an equality on buckets of lines: both sides are listed
    under every bucket that they touch, and each pair counts once.
    """
    cells = lambda a, b: F.explode(F.sequence((F.col(a) / width).cast("int"), (F.col(b) / width).cast("int")))
    n = nodes.where("end_line >= start_line").select("project_id", "file_path", "id", "is_test", "start_line", "end_line", cells("start_line", "end_line").alias("cell"))
    h = hunks.where("last >= first").select("project_id", "file_path", "first", "last", cells("first", "last").alias("cell"))
    pairs = n.join(h, ["project_id", "file_path", "cell"]).where("first <= end_line and last >= start_line").select("project_id", "id", "is_test", "start_line", "end_line", "first", "last").distinct()
    return pairs.groupBy("project_id", "id", "is_test").agg(F.sum(F.least("end_line", "last") - F.greatest("start_line", "first") + 1).alias("lines"))


def tests_to_run(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """Tests that reach changed nodes, those that reach most first, then by id."""
    found = traverse.trace(edges, changed.select("project_id", F.col("id").alias("start")), "inbound", ["CALLS"], depth)
    tests = nodes.where("is_test").select("project_id", "id", "name")
    return found.join(tests, KEY).groupBy("project_id", "id", "name").agg(F.count_distinct("start").alias("overlap")).orderBy(F.desc("overlap"), "project_id", "id")


def verify_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(file_path, state): in-sync, drifted, missing or new, from the hashes stored and found; a null hash is unreadable."""
    s, f = stored.select("file_path", F.col("hash").alias("a"), F.lit(1).alias("s")), found.select("file_path", F.col("hash").alias("b"), F.lit(1).alias("f"))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("s").isNull(), "new").when(F.col("b").isNull(), "unreadable").when(F.col("a").eqNullSafe(F.col("b")), "in-sync").otherwise("drifted")
    return s.join(f, "file_path", "full").select("file_path", state.alias("state"))


def interface_carve_out(nodes: DataFrame) -> DataFrame:
    """(project_id, name) of methods declared by interfaces: those whose parent is the qualified name of an Interface."""
    owners = nodes.where("kind = 'Interface'").select("project_id", F.col("qualified_name").alias("parent")).distinct()
    return nodes.where("kind = 'Method'").join(owners, ["project_id", "parent"], "left_semi").select("project_id", "name").distinct()


def without_tests(df: DataFrame, tests: bool = False, fixtures: bool = False) -> DataFrame:
    """Rows (file_path and perhaps is_test) without tests and fixtures, unless they are asked for."""
    out = df if fixtures else drop_fixtures(df)
    if tests or "file_path" not in df.columns:
        return out
    flag = F.coalesce(F.col("is_test"), F.lit(False)) if "is_test" in df.columns else F.lit(False)
    return out.where(~flag & ~F.coalesce(is_test_file(F.col("file_path")), F.lit(False)))


def module_shares(nodes: DataFrame, prefix: str) -> DataFrame:
    """(language, symbols, share) of the nodes below a path prefix."""
    n = nodes.where(F.startswith(F.col("file_path"), F.lit(prefix))).groupBy("language").agg(F.count(F.lit(1)).alias("symbols"))
    return n.select("language", "symbols", F.round(F.col("symbols") / n.agg(F.sum("symbols")).scalar(), 6).alias("share"))


def confidence_by_kind(nodes: DataFrame) -> DataFrame:
    """(kind, n, mean_confidence)."""
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("extraction_confidence"), 6).alias("mean_confidence"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have an edge in either direction."""
    ends = edges.select("project_id", F.explode(F.array("from_id", "to_id")).alias("id"))
    return nodes.join(ends, KEY, "left_semi")


def drop_fixtures(df: DataFrame) -> DataFrame:
    """Rows without those of fixture paths; unchanged if there is no file_path."""
    return df.where(~F.coalesce(is_fixture(F.col("file_path")), F.lit(False))) if "file_path" in df.columns else df
