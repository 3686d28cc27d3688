"""Files and differences as tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import map_rows
from ..session import written

#: Directories that are never walked, besides those that begin with a dot.
SKIP_DIRS = "__pycache__ build coverage dist env node_modules target vendor venv".split()
#: Files that hold no source, in small letters: locks, checksums and loaders that package managers write.
LOCK_FILES = (
    "bun.lock bun.lockb cargo.lock cartfile.resolved composer.lock flake.lock gemfile.lock go.sum mix.lock npm-shrinkwrap.json package-lock.json package.resolved pdm.lock pipfile.lock pnpm-lock.yaml podfile.lock poetry.lock pubspec.lock uv.lock yarn.lock"
    " .pnp.cjs .pnp.js .pnp.data.json .pnp.loader.mjs"
).split()
#: Ends of names of minified files and source maps, in small letters.
MINIFIED = r"\.min\.(?:[mc]?js|jsx|tsx?|css)$|\.map$"
MOST_BYTES = 2 * 1024 * 1024
IN_SKIP_DIR = r"(?:^|/)(?:" + "|".join(SKIP_DIRS) + r"|\.[^/]+)/"


def skipped(path: Column, length: Column | None = None) -> Column:
    """Is a file left out: in a skipped directory, a lock file, minified, a source map, or too long?  Names in any letter case."""
    base = F.lower(F.substring_index(path, "/", -1))
    out = path.rlike(IN_SKIP_DIR) | base.isin(*LOCK_FILES) | base.rlike(MINIFIED)
    return out if length is None else out | (length > MOST_BYTES)


def ignore_rules(text: str | None) -> list[tuple[int, bool, str]]:
    """(order, keeps, regular expression) of the patterns of an ignore file, for paths below its directory."""
    out = []
    for k, row in enumerate((text or "").split("\n")):
        p = row.rstrip("\r").rstrip()
        if not p or p.startswith("#"):
            continue
        keeps, p = p.startswith("!"), p.lstrip("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        rx = ""
        for m in re.finditer(r"\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^\]]*\]|\\\\.|.", p):
            t = m[0]
            rx += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or (t.replace("[!", "[^") if t[0] == "[" and len(t) > 1 else re.escape(t[-1]))
        out.append((k, keeps, f"^{'' if anchored else '(?:.*/)?'}{rx}{'/' if folder else '(?:/|$)'}"))
    return out


def ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_path) of files that ignore files (dir, content) leave out: the last pattern that fits decides, nearer files later."""
    made = map_rows(rules.select("dir", "content"), lambda d, t: [(d, *r) for r in ignore_rules(t)], "dir string, rank int, keeps boolean, pattern string")
    # a path meets the patterns of the directories above it
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asked = files.select("file_path", F.explode(above).alias("dir")).withColumn("rest", F.when(F.col("dir") == "", F.col("file_path")).otherwise(F.expr("substring(file_path, length(dir) + 2)")))
    hit = asked.join(made, "dir").where(F.regexp(F.col("rest"), F.col("pattern")))
    last = hit.groupBy("file_path").agg(F.max(F.struct(F.length("dir").alias("a"), "rank", "keeps")).alias("v"))
    return last.where(~F.col("v.keeps")).select("file_path")


_LISTED = "dir string, file_path string, folder boolean, n_bytes long, modified_at timestamp"


def _open(root: str):
    """The file system of a root and the root's path in it; in any task that reaches it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def _list(root: str, rel: str) -> Iterator[tuple]:
    """What a directory below a root holds; links and skipped directories are left out."""
    from pyarrow import fs

    system, base = _open(root)
    for x in system.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base)):
        folder = x.type == fs.FileType.Directory
        if isinstance(system, fs.LocalFileSystem) and os.path.islink(x.path):
            continue
        if folder and (x.base_name in SKIP_DIRS or x.base_name.startswith(".")):
            continue
        yield rel, f"{rel}/{x.base_name}" if rel else x.base_name, folder, None if folder else x.size, None if folder else x.mtime.replace(tzinfo=None)


def _read(root: str, rel: str) -> str:
    system, base = _open(root)
    with system.open_input_stream(f"{base}/{rel}") as f:
        return f.read().decode("utf-8", "replace")


def walk(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """project_id, file_path, content, n_bytes, file_hash, modified_at of the files below a root that all tasks reach.

    Directories are listed level by level in the tasks, so skipped ones are never
    entered; links aren't followed.  Names are filtered, also by ignore files,
    before contents are read.  Contents that aren't UTF-8 come with replacement
    characters.
    """
    level = spark.createDataFrame([("",)], "file_path string")
    listed = None
    while True:
        here = written(map_rows(level.select("file_path"), lambda rel: _list(root, rel), _LISTED))
        listed = here if listed is None else listed.unionByName(here)
        level = here.where("folder").select("file_path").repartition(F.col("file_path"))
        if level.isEmpty():
            break
    named = listed.where("not folder")
    rules = map_rows(named.where(F.substring_index("file_path", "/", -1) == ".gitignore").select("dir", "file_path"), lambda d, rel: [(d, _read(root, rel))], "dir string, content string")
    files = named.where(~skipped(F.col("file_path"), F.col("n_bytes")) & (F.substring_index("file_path", "/", -1) != ".gitignore"))
    left = files.join(ignored(files.select("file_path"), rules), "file_path", "left_anti").select("file_path", "n_bytes", "modified_at").repartition(F.col("file_path"))
    got = map_rows(left, lambda rel, n, at: [(project_id, rel, _read(root, rel), n, at)], "project_id string, file_path string, content string, n_bytes long, modified_at timestamp", batch=32)
    return got.select("project_id", "file_path", "content", "n_bytes", F.lower(F.hex(F.xxhash64("content"))).alias("file_hash"), "modified_at")


def hunks(diff: DataFrame, column: str = "value") -> DataFrame:
    """(diff_id, file_path, first, last) of new lines from unified diffs (diff_id, text); a pure deletion marks the line it stands at."""
    rows = diff.select("diff_id", F.posexplode(F.split(column, "\n")).alias("n", "row"))
    from pyspark.sql import Window

    w = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    name = F.when(F.col("row").rlike(r"^\+\+\+ "), F.regexp_extract("row", r"^\+\+\+ (?:b/)?(.*?)(?:\t.*)?$", 1))
    at = F.when(F.col("row").rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), F.col("row"))
    marked = rows.withColumn("file_path", F.last(name, ignorenulls=True).over(w)).withColumn("at", at).where("at is not null and file_path is not null and file_path <> '/dev/null'")
    first = F.regexp_extract("at", r"\+(\d+)", 1).cast("int")
    size = F.coalesce(F.nullif(F.regexp_extract("at", r"\+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return marked.select("diff_id", "file_path", first.alias("first"), (first + F.greatest(size, F.lit(1)) - 1).alias("last"))


def to_json(df: DataFrame, warnings: list[str]) -> dict:
    """A small result as columns, rows, total and warnings; for results that have been limited."""
    rows = [list(r) for r in df.collect()]
    return {"columns": df.columns, "rows": rows, "total": len(rows), "warnings": warnings}
