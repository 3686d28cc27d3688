"""Reachability over edges, one level at a time.

Each level is a join of the frontier with the edges and is written to the
cluster's shared folder, so plans stay short and a lost executor costs one
level.  Frontiers are deduplicated per level, which keeps cyclic graphs finite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_fixture, is_test_file
from ..session import checkpointed

CALL_KINDS = ["CALLS", "HTTP_CALLS", "ASYNC_CALLS"]
#: Other words for the two directions.
DIRECTIONS = {
    **dict.fromkeys("inbound in incoming up upstream reverse caller callers".split(), "inbound"),
    **dict.fromkeys("outbound out outgoing down downstream forward callee callees".split(), "outbound"),
    "both": "both",
}


def _links(edges: DataFrame, kinds: list[str] | None, inward: bool) -> DataFrame:
    """(project_id, a, b, kind) of the edges to follow from a to b, each once."""
    e = edges if not kinds else edges.where(F.col("kind").isin(kinds))
    a, b = ("to_id", "from_id") if inward else ("from_id", "to_id")
    return e.select("project_id", F.col(a).alias("a"), F.col(b).alias("b"), "kind").distinct()


def walks(edges: DataFrame, starts: DataFrame, kinds: list[str], low: int, high: int, inward: bool = False) -> DataFrame:
    """(project_id, start, id, depth): nodes at the end of walks of low to high edges from each start.

    depth is the shortest such walk's length; walks may repeat nodes and pass
    through their start, which itself is never a result.  starts: project_id,
    start.  Inward walks go against the edges.
    """
    links = _links(edges, kinds, inward).select("project_id", "a", "b").distinct()
    links = checkpointed(links) if high > 1 else links
    level = starts.distinct().select("project_id", "start", F.col("start").alias("id"))
    found = None
    for depth in range(1, high + 1):
        step = level.join(links.withColumnRenamed("a", "id"), ["project_id", "id"]).select("project_id", "start", F.col("b").alias("id")).distinct()
        if low == 1 and found is not None:
            # with low = 1 a node is only followed from its first level
            step = step.join(found.select("project_id", "start", "id"), ["project_id", "start", "id"], "left_anti").where(F.col("id") != F.col("start"))
        level = checkpointed(step) if depth < high or high > 1 else step
        if depth >= low:
            here = level.withColumn("depth", F.lit(depth))
            found = here if found is None else found.unionByName(here)
        if depth < high and level.isEmpty():
            break
    if found is None:
        return level.withColumn("depth", F.lit(0)).where(F.lit(False))
    return found.where(F.col("id") != F.col("start")).groupBy("project_id", "start", "id").agg(F.min("depth").alias("depth"))


def trace(edges: DataFrame, starts: DataFrame, direction: str = "outbound", kinds: list[str] | None = None, depth: int = 3) -> DataFrame:
    """(project_id, start, id, depth, via) of the nodes within depth edges of each start.

    via is the least kind of a walk's last edge over all walks of at most depth
    edges.  Of both directions the nearer one counts, outbound on a tie.  A depth
    outside 1 to 5 is read as 3.
    """
    direction = DIRECTIONS.get(direction.lower(), direction)
    if direction not in ("inbound", "outbound", "both"):
        raise ValueError(f"unknown direction {direction!r}")
    depth = depth if 1 <= depth <= 5 else 3
    if direction == "both":
        sides = [trace(edges, starts, d, kinds, depth).withColumn("side", F.lit(k)) for k, d in enumerate(("outbound", "inbound"))]
        both = sides[0].unionByName(sides[1])
        best = both.groupBy("project_id", "start", "id").agg(F.min(F.struct("depth", "side", "via")).alias("b"))
        return best.select("project_id", "start", "id", "b.depth", "b.via")
    links = checkpointed(_links(edges, kinds or CALL_KINDS, direction == "inbound"))
    level = starts.distinct().select("project_id", "start", F.col("start").alias("id"))
    found = None
    for k in range(1, depth + 1):
        step = level.join(links.withColumnRenamed("a", "id"), ["project_id", "id"]).groupBy("project_id", "start", F.col("b").alias("id")).agg(F.min("kind").alias("via"))
        level = checkpointed(step)
        here = level.withColumn("depth", F.lit(k))
        found = here if found is None else found.unionByName(here)
        if level.isEmpty():
            break
    return found.where(F.col("id") != F.col("start")).groupBy("project_id", "start", "id").agg(F.min("depth").alias("depth"), F.min("via").alias("via"))


def closure(edges: DataFrame, depth: int = 3, kinds: list[str] | None = None) -> DataFrame:
    """(project_id, from_id, to_id, depth, via_kind): all pairs within depth edges (8 at most), nearest first.

    via_kind is the least kind of the last edge of a shortest walk.
    """
    depth = min(max(depth, 1), 8)
    links = checkpointed(_links(edges, kinds or CALL_KINDS, False))
    level = links.groupBy("project_id", F.col("a").alias("from_id"), F.col("b").alias("to_id")).agg(F.min("kind").alias("via_kind")).where("from_id <> to_id")
    found = checkpointed(level.withColumn("depth", F.lit(1)))
    level = found
    for k in range(2, depth + 1):
        step = (
            level.join(links.withColumnRenamed("a", "to_id"), ["project_id", "to_id"])
            .groupBy("project_id", "from_id", F.col("b").alias("to_id"))
            .agg(F.min("kind").alias("via_kind"))
            .where("from_id <> to_id")
            .join(found.select("project_id", "from_id", "to_id"), ["project_id", "from_id", "to_id"], "left_anti")
        )
        level = checkpointed(step.withColumn("depth", F.lit(k)))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select("project_id", "from_id", "to_id", "depth", "via_kind")


def trace_closed(closed: DataFrame, starts: DataFrame, direction: str = "outbound", depth: int = 3) -> DataFrame:
    """The trace of each start read off a closure: (project_id, start, id, depth, via)."""
    a, b = ("to_id", "from_id") if DIRECTIONS.get(direction.lower(), direction) == "inbound" else ("from_id", "to_id")
    return closed.where(F.col("depth") <= depth).join(starts.select("project_id", F.col("start").alias(a)).distinct(), ["project_id", a], "left_semi").select("project_id", F.col(a).alias("start"), F.col(b).alias("id"), "depth", F.col("via_kind").alias("via"))


def risk(depth):
    """Risk label of a hop by its depth."""
    return F.when(depth == 1, "CRITICAL").when(depth == 2, "HIGH").when(depth == 3, "MEDIUM").otherwise("LOW")


def hops(found: DataFrame, nodes: DataFrame, tests: bool = False, fixtures: bool = False) -> DataFrame:
    """Traced nodes with their names and risk; those of tests and fixtures are left out unless asked for."""
    n = nodes.select("project_id", "id", "name", "kind", "file_path", *(["is_test"] if "is_test" in nodes.columns else []))
    flag = lambda c: F.coalesce(c, F.lit(False))
    if not tests:
        n = n.where(~flag(is_test_file(F.col("file_path"))) & ~(flag(F.col("is_test")) if "is_test" in n.columns else F.lit(False)))
    if not fixtures:
        n = n.where(~flag(is_fixture(F.col("file_path"))))
    return found.join(n.drop("is_test"), ["project_id", "id"]).withColumn("risk", risk(F.col("depth")))


def adaptive_depth(edges: DataFrame, starts: DataFrame, direction: str = "inbound", kinds: list[str] | None = None, wide: int = 5, deep: int = 3) -> DataFrame:
    """Trace to depth 1 where a start has `wide` or more neighbours, otherwise to `deep`."""
    near = trace(edges, starts, direction, kinds, 1)
    many = near.groupBy("project_id", "start").agg(F.count(F.lit(1)).alias("near")).where(F.col("near") >= wide)
    few = starts.select("project_id", "start").distinct().join(many, ["project_id", "start"], "left_anti")
    return near.join(many, ["project_id", "start"], "left_semi").unionByName(trace(edges, few, direction, kinds, deep))
