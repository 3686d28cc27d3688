"""Running sums over ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """df with the running sum of a column within each group, in order.

    Rows are sorted by ranges of (group, order); each range's sum per group gives
    the offset of the ranges behind it.  So a group may span any number of
    tasks, and none needs more than its share of the rows.  Order columns should
    be unique within a group, else the sums of equal rows may change places.
    Null group keys form a group; null values count as 0.
    """
    n = parts or max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges are drawn from a sample, so they are kept: both uses must see the same ones
    ranged = checkpointed(df.repartitionByRange(n, *groups, *order).withColumn("__part", F.spark_partition_id()))
    v = F.coalesce(F.col(value), F.lit(0))
    sums = ranged.groupBy(*groups, "__part").agg(F.sum(v).alias("__inside"))
    before = F.sum("__inside").over(Window.partitionBy(*groups).orderBy("__part")) - F.col("__inside")
    offsets = sums.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(groups)), F.col("__part").alias("__p"), before.alias("__before"))
    on = F.col("__part") == F.col("__p")
    for k, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    w = Window.partitionBy(*groups, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("__sum", F.sum(v).over(w)).join(offsets, on)
    return summed.select(*df.columns, (F.col("__sum") + F.col("__before")).alias(out))
