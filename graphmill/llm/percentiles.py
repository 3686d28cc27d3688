"""Percentiles of very large numeric columns from cumulative frequencies.

A group's state is its table of distinct values with their numbers of rows.
States of days or partitions are put together by adding the numbers, and any
percentile comes out of the sum: the first value whose cumulative frequency
reaches the target rank ceil(p * n).  With ``digits`` values are first rounded to
so many significant digits, which bounds a state's size and the relative error
(half a unit of the last digit); without it results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpointed

#: Percentiles in thousandths, and the names of their columns.
TARGETS = {"p50": 500, "p90": 900, "p95": 950, "p99": 990}


def significant(value: Column, digits: int) -> Column:
    """A value rounded to so many significant decimal digits."""
    v = value.cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v * scale) / scale)


def value_counts(df: DataFrame, groups: list[str], value: str, digits: int | None = None) -> DataFrame:
    """State: the groups, value and n.  Null and NaN values don't count.

    Each task combines its rows before the shuffle, so that a hot group costs a
    task no more than its distinct values.
    """
    v = F.col(value).cast("double")
    ok = df.where(v.isNotNull() & ~F.isnan(v))
    return ok.groupBy(*groups, (significant(v, digits) if digits else v).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge(*states: DataFrame) -> DataFrame:
    """The state of all rows of several states with the same groups."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    groups = [c for c in out.columns if c not in ("value", "n")]
    return out.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def coarser(state: DataFrame, groups: list[str]) -> DataFrame:
    """The state of fewer groups, e.g. of all days."""
    return state.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def _changes(b: pa.RecordBatch, keys: int) -> np.ndarray:
    """Numbers of the rows of a batch whose key columns differ from the row before; nulls are equal."""
    change = np.zeros(max(0, b.num_rows - 1), bool)
    for c in b.columns[:keys]:
        x, y = c.slice(0, b.num_rows - 1), c.slice(1)
        same = pc.fill_null(pc.equal(x, y), False).to_numpy(zero_copy_only=False)
        change |= ~(same | (x.is_null().to_numpy(zero_copy_only=False) & y.is_null().to_numpy(zero_copy_only=False)))
    return np.flatnonzero(change) + 1


def _blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in blocks of whole groups of equal keys, with the starts of the groups; the last block is the last group."""
    open_: list[pa.RecordBatch] = []  # parts of the group that may go on
    names = list(range(keys))

    def closed() -> tuple[pa.RecordBatch, np.ndarray]:
        return pa.Table.from_batches(open_).combine_chunks().to_batches()[0], np.zeros(1, np.int64)

    for b in batches:
        if not b.num_rows:
            continue
        edges = _changes(b, keys)
        start = 0
        if open_:
            if open_[0].slice(0, 1).select(names).to_pylist() == b.slice(0, 1).select(names).to_pylist():
                start = int(edges[0]) if len(edges) else b.num_rows
                open_.append(b.slice(0, start))
                if start == b.num_rows:
                    continue
            yield closed()
        last = int(edges[-1]) if len(edges) else 0
        if last > start:
            yield b.slice(start, last - start), np.concatenate([[start], edges[(edges > start) & (edges < last)]]) - start
        open_ = [b.slice(last)]
    if open_:
        yield closed()


def _picks(b: pa.RecordBatch, starts: np.ndarray, marks: list[int], before: np.ndarray | None = None, total: np.ndarray | None = None) -> tuple[np.ndarray, list[pa.Array]]:
    """Sums of n of each group, and for each mark the value that reaches its rank; null where that lies in another part of the group."""
    v, n = (b.column(b.num_columns - k).to_numpy(zero_copy_only=False) for k in (2, 1))
    c = np.cumsum(n)
    ends = np.concatenate([starts[1:], [len(n)]])
    base = c[starts] - n[starts]
    inside = c[ends - 1] - base
    if total is None:
        total, before = inside, np.zeros(len(starts), np.int64)
    out = []
    for k in marks:
        rank = np.maximum(1, -(-k * total // 1000)) - before
        here = (rank > 0) & (rank <= inside)
        at = np.minimum(np.searchsorted(c, base + np.maximum(rank, 1)), len(v) - 1)
        out.append(pa.array(v[at], pa.float64(), mask=~here))
    return inside, out


def percentiles(state: DataFrame, groups: list[str], targets: dict[str, int] | None = None, parts: int | None = None) -> DataFrame:
    """Per group: n and one column per target (in thousandths).

    The state is sorted by ranges of (group, value), so one group may span any
    number of ranges and none is large.  One pass over the sorted ranges takes
    the percentiles of the groups inside a range from their running sums; of the
    first and last group of each range it gives the sum, from which come the
    offsets of the ranges behind it, and a second pass over these groups only
    picks their values.  Groups without a value give no row; a null group key is
    a group.
    """
    targets = targets or TARGETS
    names, marks = list(targets), list(targets.values())
    spark = state.sparkSession
    ranges = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the ranges are drawn from a sample, so they are kept: both passes must see the same ones
    ranged = checkpointed(state.select(*groups, "value", "n").repartitionByRange(ranges, *groups, "value").sortWithinPartitions(*groups, "value"))
    fields = [state.schema[g] for g in groups]
    result = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    arrow = to_arrow_schema(result)
    k = len(groups)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True

        def picked(block: tuple, first: bool, last: bool) -> pa.RecordBatch:
            b, starts = block
            total, got = _picks(b, starts, marks)
            edge = np.zeros(len(starts), bool)
            edge[0] |= first
            edge[-1] |= last
            got = [pc.if_else(pa.array(edge), pa.scalar(None, pa.float64()), x) for x in got]
            return pa.RecordBatch.from_arrays([*b.select(list(range(k))).take(pa.array(starts)).columns, pa.array(np.full(len(starts), part), pa.int32(), mask=~edge), pa.array(total, pa.int64()), *got], schema=arrow)

        for block in _blocks(batches, k):
            if held is not None:
                yield picked(held, first, False)
                first = False
            held = block
        if held is not None:
            yield picked(held, first, True)

    made = checkpointed(ranged.mapInArrow(inside, result))
    whole = made.where("part is null").select(*groups, "n", *names)
    # at most two groups of each range, so these are few: no more than twice the number of ranges
    edges = made.where("part is not null")
    w = Window.partitionBy(*groups)
    offsets = edges.select(*groups, "part", (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("__before"), F.sum("n").over(w).alias("__total"))
    offsets = offsets.select(*(F.col(g).alias(f"__{i}") for i, g in enumerate(groups)), F.col("part").alias("__part"), "__before", "__total")
    here = ranged.withColumn("__at", F.spark_partition_id())
    on = F.col("__at") == F.col("__part")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__{i}"))
    open_ = here.join(F.broadcast(offsets), on).select(*groups, "__before", "__total", "value", "n")
    picked = T.StructType([*fields, T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])
    arrow_picked = to_arrow_schema(picked)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, starts in _blocks(batches, k + 2):
            keys = b.select(list(range(k + 2))).take(pa.array(starts)).columns
            before, total = (keys[k + i].to_numpy(zero_copy_only=False) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*keys[:k], pa.array(total, pa.int64()), *_picks(b, starts, marks, before, total)[1]], schema=arrow_picked)

    spanning = open_.mapInArrow(across, picked).groupBy(*groups, "n").agg(*(F.max(c).alias(c) for c in names)).select(*groups, "n", *names)
    return whole.unionByName(spanning)


def plausible_latencies(stats: DataFrame) -> DataFrame:
    """One row per flush with a usable max_ms: tool, server_id, day, max_ms.

    Of repeated rows the last ingested counts.  A maximum that is null, negative
    or above the total of its calls wasn't measured; an empty tool is the tool
    ''.  Late rows belong to the day they were flushed on.
    """
    last = stats.groupBy("stat_id").agg(F.max(F.struct("ingested_at", "flushed_at", "server_id", "tool", "total_ms", "max_ms")).alias("v")).select("v.*")
    ok = (F.col("max_ms") >= 0) & (F.col("max_ms") <= F.col("total_ms"))
    return last.where(ok).select("tool", "server_id", F.date_format("flushed_at", "yyyy-MM-dd").alias("day"), "max_ms")
