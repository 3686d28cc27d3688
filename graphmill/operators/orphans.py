"""References to records that don't exist, per table, field and month.

Parent keys and child keys go into one long table of (project, key) with a tag;
groups without a parent are orphans.  Children are counted per key before they
are shuffled, so no key is large.  To get the edges themselves, the few keys
that have many rows (at most 1 / HOT a field) meet them by broadcast, and all
others by a shuffle in which every key is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import keyed_join

#: Share of all references from which a key counts as hot; so at most 1 / HOT hot keys.
HOT = 0.002
FIELDS = ("from_qn", "to_name")


def bare_name(c: Column) -> Column:
    """A name without the blanks, quotes and call brackets around it; null where nothing is left."""
    left = F.regexp_replace(c, r"^[\s\p{Z}\"'`“”‘’]+", "")
    both = F.regexp_replace(left, r"(?:[\s\p{Z}\"'`“”‘’]|\([^()]*\))+$", "")
    # most names have nothing around them, which two characters tell
    bare = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1)).rlike(r"^\w\w$")
    return F.when(bare, c).otherwise(F.nullif(both, F.lit("")))


def references(edges: DataFrame, *keep: str) -> DataFrame:
    """Long form of the named references: the kept columns, project_id, ref_field, key.

    Null, empty and blank names refer to nothing and give no row.
    """
    fields = F.array(*(F.struct(F.lit(f).alias("ref_field"), bare_name(F.col(f)).alias("key")) for f in FIELDS))
    return edges.select(*keep, "project_id", F.explode(fields).alias("r")).select(*keep, "project_id", "r.ref_field", "r.key").where("key is not null")


def parent_keys(symbols: DataFrame) -> DataFrame:
    """(project_id, key): names and qualified names of the symbols in force at the end of the data."""
    last = F.max(F.struct("indexed_at", F.col("deleted_at").isNotNull().alias("gone"), "name", "qualified_name")).alias("v")
    there = symbols.groupBy("project_id", "id").agg(last).where(~F.col("v.gone"))
    return there.select("project_id", F.explode(F.array_distinct(F.array("v.name", "v.qualified_name"))).alias("key")).where("key is not null")


def orphan_keys(counted: DataFrame, symbols: DataFrame, externals: DataFrame, *detail: str) -> DataFrame:
    """Groups of (project_id, key) that have children and no parent, with one row per ref_field and detail.

    counted: project_id, key, ref_field, the detail columns and n.  An external
    name is a parent of to_name in every project.
    """
    fields = ["ref_field", *detail, "n"]
    children = counted.select("project_id", "key", F.struct(*fields).alias("child"))
    child_type = children.schema["child"].dataType
    parents = parent_keys(symbols).select("project_id", "key", F.lit(None).cast(child_type).alias("child"))
    tagged = parents.unionAll(children)
    # a key has at most two fields times the detail's values (months), each counted before
    groups = tagged.groupBy("project_id", "key").agg(F.max(F.col("child").isNull()).alias("has_parent"), F.collect_list("child").alias("children"))
    orphans = groups.where(~F.col("has_parent")).select("project_id", "key", F.explode("children").alias("c")).select("project_id", "key", *(f"c.{f}" for f in fields))
    named = externals.select(F.col("ext_name").alias("key"), F.lit("to_name").alias("ref_field")).where("key is not null").distinct()
    return orphans.join(named, ["key", "ref_field"], "left_anti")


def orphan_edges(edges: DataFrame, symbols: DataFrame, externals: DataFrame) -> DataFrame:
    """(edge_id, ref_field) of each reference without a target, once per distinct edge and field.

    A repeated row gives no further case; letter case counts; edges of projects
    that have no symbol are orphans.
    """
    refs = references(edges, "edge_id")
    total = edges.count()  # from the files' footers
    counted = refs.groupBy("project_id", "key", "ref_field").agg(F.count(F.lit(1)).alias("n"))
    orphans = orphan_keys(counted, symbols, externals)
    return keyed_join(refs, orphans, ["project_id", "key", "ref_field"], total=total, hot=HOT).select("edge_id", "ref_field").dropDuplicates()


def orphan_counts(edges: DataFrame, symbols: DataFrame, externals: DataFrame) -> DataFrame:
    """Orphan references per table, field and calendar month of seen_at, each distinct edge counted once.

    An edge without seen_at counts under a null month; one whose rows disagree
    counts in its earliest.
    """
    once = edges.groupBy("edge_id").agg(F.min(F.struct("seen_at", "project_id", "from_qn", "to_name")).alias("e")).select("e.*")
    refs = references(once, "seen_at").withColumn("month", F.date_format("seen_at", "yyyy-MM"))
    counted = refs.groupBy("project_id", "key", "ref_field", "month").agg(F.count(F.lit(1)).alias("n"))
    orphans = orphan_keys(counted, symbols, externals, "month")
    return orphans.groupBy(F.lit("pending_edges").alias("table_name"), "ref_field", "month").agg(F.sum("n").alias("n_orphans"), F.count_distinct(F.struct("project_id", "key")).alias("n_keys"))
