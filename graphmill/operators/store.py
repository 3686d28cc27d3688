"""Keeping the tables: upserts, cascades, merges and clean-up, as new versions of DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_KEY = ["project_id", "id"]
EDGE_KEY = ["project_id", "from_id", "to_id", "kind"]


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the largest order columns; null keys are keys."""
    rest = [c for c in df.columns if c not in key]
    # order columns first, then the others, so that ties give the same row on every run
    picked = F.max(F.struct(*order, *(c for c in rest if c not in order and not df.schema[c].dataType.typeName() == "map"))).alias("__v")
    if any(df.schema[c].dataType.typeName() == "map" for c in rest):
        w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
        return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    got = df.groupBy(*key).agg(picked)
    return got.select(*(F.col(c) if c in key else F.col(f"__v.{c}").alias(c) for c in df.columns))


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both; of equal keys the new one."""
    both = stored.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, NODE_KEY, ["__seq"]).drop("__seq")


def upsert_edges(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both; of equal keys the stored one, and one of several new ones."""
    fresh = new.dropDuplicates(EDGE_KEY).join(stored.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def delete_children(children: DataFrame, owner: str, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Rows that belong to a node (its id in the column owner), such as struct fields and interface methods, without those of files' nodes."""
    gone = nodes.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_semi").select("project_id", F.col("id").alias(owner))
    return children.join(gone, ["project_id", owner], "left_anti").select(*children.columns)


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of files (project_id, file_path); an edge goes with either end, within its project."""
    gone = nodes.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_semi").select("project_id", "id")
    kept = nodes.join(files.select("project_id", "file_path").distinct(), ["project_id", "file_path"], "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "from_id"), ["project_id", "from_id"], "left_anti").join(gone.withColumnRenamed("id", "to_id"), ["project_id", "to_id"], "left_anti")
    return kept, e.select(*edges.columns)


def changed_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Files found (project_id, file_path, file_hash) that are new or have another hash."""
    return found.join(stored.select("project_id", "file_path", "file_hash").distinct(), ["project_id", "file_path", "file_hash"], "left_anti")


def vanished_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    return stored.select("project_id", "file_path").distinct().join(found.select("project_id", "file_path"), ["project_id", "file_path"], "left_anti")


def commit(df: DataFrame, folder: str) -> str:
    """Writes a new version of a table beside the old ones, makes it the current one and returns its path.

    The name of the version is written last, in a file of its own that sorts
    behind all earlier ones, so readers see the old table or the new one.
    """
    spark = df.sparkSession
    folder = folder.rstrip("/")
    path = f"{folder}/v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    fs, root = _files(spark, folder)
    number = max([-1, *_versions(fs, root)]) + 1
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current-{number:012d}"), False)
    out.write(bytearray(path.encode()))
    out.close()
    return path


def _files(spark, folder: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _versions(fs, root) -> list[int]:
    return [int(x.getPath().getName()[8:]) for x in fs.listStatus(root) if x.getPath().getName().startswith("current-")]


def committed(spark, folder: str) -> DataFrame:
    """The current version of a table that commit() wrote."""
    folder = folder.rstrip("/")
    fs, root = _files(spark, folder)
    path = spark.read.text(f"{folder}/current-{max(_versions(fs, root)):012d}").first()[0]
    return spark.read.parquet(path)


def put_record(records: DataFrame, key: str, text: str | None) -> DataFrame:
    """Decision records (key, text) with one set, or removed if its text is null."""
    rest = records.where(F.col("key") != key)
    return rest if text is None else rest.unionByName(records.sparkSession.createDataFrame([(key, text)], "key string, text string"))


def lookup(nodes: DataFrame, wanted: DataFrame, by: str = "id") -> DataFrame:
    """Nodes whose column `by` is among the wanted values (project_id, by); broadcast where Spark finds them few."""
    return nodes.join(wanted.select("project_id", by).distinct(), ["project_id", by], "left_semi")


def grouped_by_name(nodes: DataFrame) -> DataFrame:
    """(project_id, qualified_name, ids): the ids of each qualified name, in order, for many lookups at once."""
    return nodes.groupBy("project_id", "qualified_name").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def edges_of(edges: DataFrame, ends: DataFrame, inbound: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """Edges that start, or end if inbound, at one of the nodes (project_id, id)."""
    side = "to_id" if inbound else "from_id"
    e = edges if not kinds else edges.where(F.col("kind").isin(kinds))
    return e.join(ends.select("project_id", F.col("id").alias(side)).distinct(), ["project_id", side], "left_semi").select(*edges.columns)


def files_with_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project_id", "file_path").agg(F.count(F.lit(1)).alias("symbols"), F.max("file_hash").alias("file_hash"))


def clear_hashes(files: DataFrame, nodes: DataFrame, languages: list[str]) -> DataFrame:
    """Files without those that have a node in one of the languages, so that they are read again."""
    hit = nodes.where(F.col("language").isin(languages)).select("project_id", "file_path").distinct()
    return files.join(hit, ["project_id", "file_path"], "left_anti")


def empty_projects(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Projects with neither nodes nor edges."""
    return projects.join(nodes.select("project_id").distinct(), "project_id", "left_anti").join(edges.select("project_id").distinct(), "project_id", "left_anti")


def same_place(projects: DataFrame) -> DataFrame:
    """(project_id, winner) of projects whose root is the same path but for case of drive, slashes and dots; the winner was added first."""
    root = F.regexp_replace(F.regexp_replace(F.replace("root_path", F.lit("\\"), F.lit("/")), r"/(?:\./)+|/{2,}", "/"), r"(?<=.)/$", "")
    place = F.regexp_replace(root, r"^[A-Z]:", F.lower(F.substring(root, 1, 2)))
    best = projects.groupBy(place.alias("place")).agg(F.min(F.struct("added_at", "project_id")).alias("w"), F.count(F.lit(1)).alias("k"))
    return projects.select("project_id", place.alias("place")).join(best.where("k > 1"), "place").select("project_id", F.col("w.project_id").alias("winner"))


def merge_projects(df: DataFrame, key: list[str], winner: str, losers: list[str]) -> DataFrame:
    """Rows of the losers moved to the winner unless it has their key; other projects stay."""
    rest = [c for c in key if c != "project_id"]
    mine = df.where(F.col("project_id") == winner)
    theirs = df.where(F.col("project_id").isin(losers))
    # of several losers with a key the first in name, then the least of the other columns
    one = theirs.groupBy(*rest).agg(F.min(F.struct("project_id", *(c for c in df.columns if c not in key))).alias("v"))
    moved = one.join(mine.select(*rest), rest, "left_anti").select(*(F.lit(winner).alias(c) if c == "project_id" else F.col(c) if c in rest else F.col(f"v.{c}").alias(c) for c in df.columns))
    return df.where(~F.col("project_id").isin(losers)).unionByName(moved)


def upsert_failures(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (project_id, file_path, reason): first seen kept, last seen moved on, times counted."""
    both = stored.unionByName(new)
    return both.groupBy("project_id", "file_path", "reason").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times").alias("times"))


def prune_failures(failures: DataFrame, projects: DataFrame) -> DataFrame:
    """Failures not older than their project's last index run; those of unknown projects stay."""
    p = projects.select("project_id", F.col("indexed_at").alias("__at"))
    return failures.join(p, "project_id", "left").where(F.col("__at").isNull() | (F.col("last_seen") >= F.col("__at"))).drop("__at")


def newest(df: DataFrame, ts: str, k: int, where: Column | None = None, tie: str | None = None) -> DataFrame:
    """The k newest rows."""
    out = df if where is None else df.where(where)
    return out.orderBy(F.desc(ts), *([F.desc(tie)] if tie else [])).limit(k)


def scoped_edge_delete(edges: DataFrame, kind: str, source: str, from_files: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Edges without those of a kind and source; with from_files only those that start in these files."""
    hit = edges.where((F.col("kind") == kind) & (F.col("source") == source))
    if from_files is not None:
        ids = nodes.join(from_files, ["project_id", "file_path"], "left_semi").select("project_id", F.col("id").alias("from_id"))
        hit = hit.join(ids, ["project_id", "from_id"], "left_semi")
    return edges.join(hit.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def projects_containing(projects: DataFrame, path: str) -> DataFrame:
    """Projects whose root is the path or a directory above it, the deepest first."""
    p = F.lit(path.rstrip("/"))
    root = F.rtrim(F.col("root_path"), F.lit("/"))
    return projects.where((p == root) | F.startswith(p, F.concat(root, F.lit("/")))).orderBy(F.desc(F.length("root_path")))


def recount(projects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Projects with the numbers of their nodes and edges."""
    n = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("symbol_count"))
    e = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("edge_count"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return projects.join(n, "project_id", "left").join(e, "project_id", "left").select(*(projects[c] for c in projects.columns), z("symbol_count"), z("edge_count"))
