"""Exact order statistics of groups of any size, in one small lazy plan that reads its input twice.

Spark's exact percentile keeps every distinct value of a group in one buffer. Here a value falls into a bucket that depends
on nothing but itself: its sign and the logarithm of its size in steps of 1 / STEPS, so buckets are in the order of
values. First reading: the exact weight of each bucket of a group, and by running sums the bucket that holds a wanted
rank. Second reading: only the distinct values of that bucket are ordered.

The bound on buckets does not depend on the number of rows: STEPS * 0.7 for each doubling of size that values span. A
bucket that holds many distinct values (values that differ only behind their fifth digit) costs time, not accuracy.
Windows run over the buckets of a group and over the values of the last bucket, never over a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column
from trialspark.operators.joins import join_group

#: Buckets of a unit of the natural logarithm.
STEPS = 1 << 16
#: Above minus the logarithm of the least double, and above the logarithm of the largest.
_DEEP, _HIGH = 746.0, 711.0


def group_median(df: DataFrame, col: str, by: Sequence[str], name: str) -> DataFrame:
    """Exact median per group; the two middle values are averaged."""
    n = F.col("__n")
    ranks = [F.floor((n + 1) / 2), F.floor((n + 2) / 2)]
    return _at_ranks(_rows(df, col, by, F.lit(1)), by, ranks, name)


def group_kth(
    df: DataFrame,
    col: str,
    by: Sequence[str],
    rank: Column,
    name: str,
    weight: Column | None = None,
) -> DataFrame:
    """Exact k-th least value per group, `rank` a Column of the row count `__n`; NULL where there is no such rank.

    With `weight` each row stands for that many equal rows.
    """
    return _at_ranks(_rows(df, col, by, F.lit(1) if weight is None else weight), by, [rank], name)


def _rows(df: DataFrame, col: str, by: Sequence[str], weight: Column) -> DataFrame:
    return df.select(*[as_column(b) for b in by], as_column(col).cast("double").alias("__v"), weight.cast("bigint").alias("__w"))


def _bucket(v: Column) -> Column:
    """A whole number that never falls as v rises (the logarithm is monotone in floating point too); NULL for NULL."""
    size = F.floor((F.least(F.ln(F.abs(v)), F.lit(_HIGH)) + _DEEP) * STEPS) + 1
    return F.when(v == 0, F.lit(0)).when(v > 0, size).when(v < 0, -size)


def _at_ranks(rows: DataFrame, by: Sequence[str], ranks: Sequence[Column], name: str) -> DataFrame:
    keys = [as_column(b) for b in by]
    rows = rows.withColumn("__bucket", _bucket(F.col("__v")))
    w, start = F.col("__w"), F.col("__start")
    known = F.when(F.col("__bucket").isNotNull(), w).otherwise(0)
    ordered = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__bucket"))
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy(*keys, "__bucket")
        .agg(F.sum("__w").alias("__w"))
        .select(*keys, "__bucket", known.alias("__w"), F.coalesce(F.sum(known).over(before), F.lit(0)).alias("__start"), F.sum(known).over(whole).alias("__n"))
        .select("*", *[r.cast("bigint").alias(f"__r{k}") for k, r in enumerate(ranks)])
    )
    wanted = F.col("__n") == 0  # a group without values, or without that rank, keeps one bucket and gets NULL
    for k in range(len(ranks)):
        r = F.col(f"__r{k}")
        wanted = wanted | ((start < r) & (r <= start + w)) | (((r < 1) | (r > F.col("__n"))) & (start == 0))
    chosen = buckets.where(wanted).drop("__w", "__n")
    values = rows.groupBy(*keys, "__bucket", "__v").agg(F.sum("__w").alias("__w"))
    last = join_group(values, chosen, [*by, "__bucket"])
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.withColumn("__before", start + F.coalesce(F.sum("__w").over(inside), F.lit(0)))
    found = placed.groupBy(*keys).agg(*[
        F.max(F.when((F.col("__before") < F.col(f"__r{k}")) & (F.col(f"__r{k}") <= F.col("__before") + w), F.col("__v"))).alias(f"__a{k}")
        for k in range(len(ranks))
    ])
    result = F.col("__a0") if len(ranks) == 1 else (F.col("__a0") + F.col("__a1")) / 2
    return found.select(*keys, result.alias(name))
