"""Ordered counts without a single ordered pass: sums before a bucket, then sums within it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, and buckets of a group of buckets, along a whole-numbered order
BUCKET_ROWS, GROUP_BUCKETS = 65_536, 65_536


def buckets(order: Column, rows: int | Column = BUCKET_ROWS) -> list[Column]:
    """Two levels of buckets along a dense whole-numbered order: no ordered pass holds more than a bucket's rows or a group's buckets."""
    fine = F.floor(order / rows)
    return [F.floor(fine / GROUP_BUCKETS), fine]


def running_sum(df: DataFrame, value: Column, order: Sequence[str], bucket: Column | Sequence[Column], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds `out`: the sum of value over the rows before each row, in the given order, within `by`.

    bucket must not decrease along the order and should hold a bounded number of rows; several are levels, from the
    coarsest, each ordered within the one before. Only the sums of a level's buckets are ordered, within the bucket of
    the level above, and rows are ordered within the finest, so that a key that holds most of the rows is no hot spot.
    """
    levels = [bucket] if isinstance(bucket, Column) else list(bucket)
    names = [f"_b{i}" for i in range(len(levels))]
    rows = df.withColumn("_v", value).withColumns(dict(zip(names, levels)))
    sums = rows.groupBy(*by, *names).agg(F.sum("_v").alias("_s"))
    base = None
    for i in range(len(names)):
        keys = [*by, *names[: i + 1]]
        own = sums if i == len(names) - 1 else sums.groupBy(*keys).agg(F.sum("_s").alias("_s"))
        before = own.select(*keys, (F.sum("_s").over(Window.partitionBy(*by, *names[:i]).orderBy(names[i])) - F.col("_s")).alias("_base"))
        if base is not None:
            above = base.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(keys[:-1])], F.col("_base").alias("_above"))
            # by-columns may be null: compare null-safe
            before = before.join(above, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(keys[:-1])]).select(*keys, (F.col("_base") + F.col("_above")).alias("_base"))
        base = before
    keys = [*by, *names]
    base = base.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)], "_base")
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(base, [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(keys)], "left").drop(*[f"_k{n}" for n in range(len(keys))])
    return joined.withColumn(out, F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum("_v").over(within), F.lit(0))).drop("_v", "_base", *names)


def position(df: DataFrame, order: Sequence[str], bucket: Column | Sequence[Column], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds `out`: how many rows stand before each row (0 for the first)."""
    return running_sum(df, F.lit(1).cast("long"), order, bucket, out, by)
