"""Places of rows within their group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import save


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, total: str, label: str) -> DataFrame:
    """Rows with their place (from 0) in their group by `order`, and the number of rows of the group.

    Rows are range-partitioned and sorted, and stored so that places stay; a row's place is its place in its task's share
    of the group and the rows of that group in earlier shares. No task holds a whole group. Rows equal in all of `order`
    keep the order of the input, and may be dealt to several tasks as well. Columns of `group` must not be null.
    """
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*group, *order, "_tie"]
    ordered = df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in keys)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in keys))
    ordered = save(ordered.drop("_tie").withColumns({"_share": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), label)
    shares = ordered.groupBy(*group, "_share").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumns({"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), total: F.sum("_rows").over(Window.partitionBy(*group))})
    placed = ordered.join(shares.drop("_rows"), [*group, "_share"])
    return placed.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_share", "_at", "_first", "_before")
