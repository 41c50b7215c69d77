"""Rows in order over many tasks: running sums and maxima that no single task has to make.

Rows are range-partitioned by their order and sorted within partitions, the shares; a share's own running value is carried
on from the totals of earlier shares. Shares are stored once, as ranges drawn twice need not agree. An order of all
rows in one group needs no task that holds them: the few totals, one a share, are sent to the later shares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column
from trialspark.operators.joins import join_group
from trialspark.sources.tables import store

#: Shares at most: each one's total is sent to the later ones.
SHARES = 256


def in_shares(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """The rows, stored in `order`, with `__share` and their place `__at` (rising over all shares, with gaps)."""
    number = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), SHARES)
    ordered = df.repartitionByRange(number, *order).sortWithinPartitions(*order)
    return store(ordered.withColumns({"__share": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), name)


def within(by: Sequence[str]) -> Window:
    """Earlier rows of a group in the same share."""
    return Window.partitionBy(*[as_column(b) for b in by], "__share").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)


def carried(shares: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    """Rows with aggregates over all earlier shares of their group; NULL in a group's first share."""
    keys = [as_column(b) for b in by]
    each = shares.groupBy(*keys, "__share").agg(*[t.alias(n) for n, t in totals.items()])
    join = {n: F.max(n) if n.startswith("max") else F.sum(n) for n in totals}
    # a group's totals go to its own later shares; most groups of many have one share alone
    last = F.max("__share").over(Window.partitionBy(*keys)) if by else F.lit(SHARES - 1)
    later = each.withColumn("__last", last).where(F.col("__share") < F.col("__last"))
    later = later.select(*keys, *totals, F.explode(F.sequence(F.col("__share") + 1, F.col("__last"))).alias("__share"))
    before = later.groupBy(*keys, "__share").agg(*[j.alias(n) for n, j in join.items()])
    return join_group(shares, before, [*by, "__share"], "left")
