"""Results per key where a few keys have most of the rows.

Every result is built from algebraic aggregates, so each task first combines its
own rows into one state per key (a hash table that spills) and only those
states are shuffled: a key with a third of all rows reaches the final task as
one row per map task.  Distinct counts are first reduced to (key, value) pairs,
which a hot key spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """key_value and n_rows for each value of the key that isn't null; other columns aren't read."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key_value")).agg(F.count(F.lit(1)).alias("n_rows"))


def hot_keys(tables: dict[str, tuple[DataFrame, str]], share: float = 0.02) -> DataFrame:
    """(table_name, key_value) of keys with at least this share of their table's rows.

    All rows count, repeated ones and those with a null key included; null is no
    key.  The result has at most 1 / share rows a table; an empty table gives none.
    """
    out = None
    for name, (df, key) in tables.items():
        total = df.count()  # from the files' footers
        hot = key_counts(df, key).where(F.col("n_rows") >= F.lit(share) * F.lit(total) - F.lit(1e-9))
        part = hot.select(F.lit(name).alias("table_name"), F.col("key_value").cast("string").alias("key_value"))
        out = part if out is None else out.unionAll(part)
    return out


def per_key(df: DataFrame, key: str, caller: str, value: str) -> DataFrame:
    """Per key: rows, distinct callers, and mean, least and largest value.

    Null keys give no row; null callers and values count as rows only.
    """
    v = F.col(value)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key_value"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct(F.col(caller)).alias("n_callers"),
            F.round(F.avg(v) + 1e-9, 6).alias("mean_value"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
        )
    )


#: Parts that the rows of hot keys are spread over.
SALTS = 1009


def keyed_join(rows: DataFrame, keys: DataFrame, on: list[str], keep: tuple[str, ...] = (), total: int | None = None, hot: float = 0.002) -> DataFrame:
    """Rows whose key is among keys, with the kept columns of keys.

    keys has each key once with its number n of rows.  Keys with at least the
    share ``hot`` of all rows, at most 1 / hot of them, meet their rows by
    broadcast; all others meet them by a shuffle in which every key is small.
    Both happen in one pass over the rows: those of hot keys are spread by a
    hash of the whole row, so no task gets more than its share of them.
    ``total`` is the number of rows, if known.  Null keys match nothing.
    """
    if total is None:
        total = keys.agg(F.sum("n")).first()[0] or 0
    limit = max(1.0, hot * total)
    many = keys.where(F.col("n") >= limit).select(*on, F.lit(True).alias("__hot"), *(F.col(c).alias(f"__hot_{k}") for k, c in enumerate(keep)))
    few = keys.where(F.col("n") < limit).select(*on, F.lit(0).cast("long").alias("__salt"), F.lit(True).alias("__cold"), *keep)
    marked = rows.join(F.broadcast(many), on, "left")
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*(F.col(c) for c in rows.columns)), F.lit(SALTS)) + 1).otherwise(F.lit(0).cast("long"))
    both = marked.withColumn("__salt", salt).join(few, [*on, "__salt"], "left").where(F.col("__hot") | F.col("__cold"))
    return both.select(*(F.col(c) for c in rows.columns), *(F.coalesce(F.col(f"__hot_{k}"), F.col(c)).alias(c) for k, c in enumerate(keep)))
