"""Grouped summaries, and group values attached to each row.

Every summary here is one `groupBy().agg()` with map-side partial aggregation,
so a group that holds a large share of the rows costs one partial row per task.
Attaching a group value is that summary joined back by its keys, not a window:
no task has to hold a whole group, and adaptive execution can split a heavy key
in the join. NULL is a group of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column, nan_to_null
from trialspark.operators.joins import assert_unique, join_group
from trialspark.operators.quantiles import group_median


def _keys(by: Sequence[str]) -> list[Column]:
    return [as_column(b) for b in by]


def is_floating(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in ("float", "double")


def clean(df: DataFrame, col: str) -> Column:
    """The column with NaN as NULL (only floating columns can hold NaN)."""
    return nan_to_null(col) if is_floating(df, col) else as_column(col)


def attach_group(
    df: DataFrame, by: Sequence[str], **aggs: Column
) -> DataFrame:
    """Attach group aggregates to each row, any number of them in one pass."""
    stats = df.groupBy(*_keys(by)).agg(*[a.alias(n) for n, a in aggs.items()])
    return join_group(df, stats, by)


def mean_of(
    df: DataFrame,
    col: str,
    by: Sequence[str],
    where: Column | str | None = None,
    name: str = "mean",
) -> DataFrame:
    """Grouped mean that skips missing values; `where` filters rows first."""
    df = df if where is None else df.where(where)
    return df.groupBy(*_keys(by)).agg(F.avg(clean(df, col)).alias(name))


def means_of(
    df: DataFrame, by: Sequence[str], scores: Mapping[str, tuple[str, Column | str | None]]
) -> DataFrame:
    """Several means of different row subsets in one pass.

    `scores` maps an output name to (column, row condition or None). Unlike a
    filter, a cell with no matching row is kept, with a NULL mean.
    """
    aggs = []
    for name, (col, among) in scores.items():
        value = clean(df, col)
        among = F.expr(among) if isinstance(among, str) else among
        aggs.append(F.avg(value if among is None else F.when(among, value)).alias(name))
    return df.groupBy(*_keys(by)).agg(*aggs)


def count_of(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*_keys(by)).agg(F.count(F.lit(1)).alias(name))


def ndistinct(
    df: DataFrame,
    col: str,
    by: Sequence[str] = (),
    count_null: bool = True,
    exact: bool = True,
    name: str = "n_distinct",
) -> DataFrame:
    """Grouped distinct count in which a missing value counts as a value.

    `exact=False` swaps in the HyperLogLog++ sketch, one bounded buffer per group.
    """
    c = as_column(col)
    n = F.count_distinct(c) if exact else F.approx_count_distinct(c)
    if count_null:
        n = n + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
    return df.groupBy(*_keys(by)).agg(n.cast("bigint").alias(name))


def median_of(
    df: DataFrame,
    col: str,
    by: Sequence[str] = (),
    exact: bool = True,
    name: str = "median",
) -> DataFrame:
    """Grouped median that skips missing values."""
    df = df.select(*_keys(by), clean(df, col).alias("__value"))
    if exact:
        return group_median(df, "__value", by, name)
    return df.groupBy(*_keys(by)).agg(
        F.percentile_approx("__value", 0.5).cast("double").alias(name)
    )


def combination_table(
    df: DataFrame,
    cols: Sequence[str],
    count_distinct: str,
    where: Column | str | None = None,
    name: str = "n_participants",
) -> DataFrame:
    """Distinct combinations of attributes with their number of distinct keys."""
    df = df if where is None else df.where(where)
    return ndistinct(df, count_distinct, cols, name=name)


def describe_by(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Mean, standard deviation, count, least and greatest value per group."""
    v = clean(df, col)
    return df.groupBy(*_keys(by)).agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.count(v).alias("n"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def with_group_count(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    return attach_group(df, by, **{name: F.count(F.lit(1))})


def with_group_ndistinct(
    df: DataFrame, col: str, by: Sequence[str], name: str = "n_distinct"
) -> DataFrame:
    return join_group(df, ndistinct(df, col, by, name=name), by)


def with_group_mean(
    df: DataFrame,
    col: str,
    by: Sequence[str],
    name: str = "group_mean",
) -> DataFrame:
    return attach_group(df, by, **{name: F.avg(clean(df, col))})


def with_group_median(
    df: DataFrame,
    col: str,
    by: Sequence[str],
    exact: bool = True,
    name: str = "group_median",
) -> DataFrame:
    return join_group(df, median_of(df, col, by, exact, name), by)


def attach_total(df: DataFrame, total: DataFrame, name: str) -> DataFrame:
    """Attach the single value of a one-row summary to each row."""
    return df.withColumn(name, total.scalar())


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Key combinations that occur more than once."""
    return count_of(df, keys, name).where(F.col(name) > 1)

