"""Incremental indexing and running tallies with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..extract import extract_files

#: Files as they are seen: seen_at orders the records of a file, and a null content says that the file has gone.
FILES = T.StructType([*(T.StructField(n, T.StringType()) for n in ("project_id", "file_path", "content", "file_hash")), T.StructField("seen_at", T.LongType())])
_KEY = ["project_id", "file_path"]
_STATE = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("seen_at", T.LongType()), T.StructField("gone", T.BooleanType()), T.StructField("batch", T.LongType())])


def latest(records: DataFrame) -> DataFrame:
    """The last record of each file by seen_at, missing ones first; of equal ones the largest hash, then the largest content."""
    order = F.struct(F.coalesce("seen_at", F.lit(-1)).alias("s"), F.coalesce("file_hash", F.lit("")).alias("h"), F.col("content").isNotNull().alias("c"), "content", "file_hash", "seen_at")
    return records.where("file_path is not null").groupBy(*_KEY).agg(F.max(order).alias("v")).select(*_KEY, "v.content", "v.file_hash", "v.seen_at")


def incremental_index(spark: SparkSession, source: str, target: str, checkpoint: str, on_batch: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Reads file records that arrive as JSON under source and adds what changed to tables under target.

    A batch takes the last record of each file and leaves out those that are
    older than what is known or have the hash that is known; a record without
    content removes the file.  Symbols and references go under the batch's
    number.  What is known is the state that the batch before left, never the
    batch's own, so a repeated batch writes the same again.  See current().
    """

    def batch(df: DataFrame, number: int) -> None:
        s = df.sparkSession
        last = latest(df)
        before = known(s, target, number)
        old = before.select(*_KEY, F.col("file_hash").alias("__hash"), F.col("seen_at").alias("__seen"), F.col("gone").alias("__gone"))
        met = last.join(old, _KEY, "left")
        late = F.coalesce(F.col("seen_at") < F.col("__seen"), F.lit(False))
        same = F.col("content").isNotNull() & F.col("file_hash").eqNullSafe(F.col("__hash")) & ~F.coalesce("__gone", F.lit(True))
        fresh = met.where(~late & ~same).select(*_KEY, "content", "file_hash", "seen_at")
        extract_files(fresh).write.mode("overwrite").parquet(f"{target}/extracted/batch={number}")
        now = fresh.select(*_KEY, "file_hash", "seen_at", F.col("content").isNull().alias("gone"), F.lit(number).cast("long").alias("batch"))
        kept = before.join(now.select(*_KEY), _KEY, "left_anti")
        kept.unionByName(now).write.mode("overwrite").parquet(f"{target}/files/after={number}")
        if on_batch:
            on_batch(number, fresh)

    stream = spark.readStream.schema(FILES).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _states(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the batches whose state was written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/files")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = lambda x: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
    return sorted(int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(path) if x.getPath().getName().startswith("after=") and done(x))


def known(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The state of all files (_STATE) after the last batch, or after the last one before a number."""
    numbers = [n for n in _states(spark, target) if before is None or n < before]
    if not numbers:
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).parquet(f"{target}/files/after={numbers[-1]}")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The extracted rows of each file's newest batch, without files that have gone."""
    rows = spark.read.option("basePath", f"{target}/extracted").parquet(f"{target}/extracted")
    return rows.join(known(spark, target).where("not gone").select(*_KEY, "batch"), [*_KEY, "batch"], "left_semi")


def tally_stream(calls: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Calls and values per tool and window of a stream (ts, tool, value), late rows included up to a limit."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window), "tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "tool", "calls", "value")
