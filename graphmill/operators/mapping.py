"""Arrow batches through a Python function, for what no built-in expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_rows(df: DataFrame, fn: Callable[..., Iterable[tuple]], schema: str | T.StructType, batch: int = 512) -> DataFrame:
    """Rows that fn yields for each row of df; fn gets df's columns in order, as Python values.

    Runs in the tasks of df, without a shuffle.  Batches of ``batch`` output rows
    bound the memory, however many rows fn yields.  An empty df gives no rows.
    """
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out.extend(fn(*row))
                if len(out) >= batch:
                    yield flush()
        if out:
            yield flush()

    return df.mapInArrow(run, struct)


def spread(scan: DataFrame, by: str) -> DataFrame:
    """A scan in as many tasks as the cluster has cores, for work that costs far more than its bytes.

    Only a scan of fewer tasks than cores, a small table in one file, is
    shuffled; larger ones stay as they are.  scan must be a plain scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(2 * cores, F.col(by))
