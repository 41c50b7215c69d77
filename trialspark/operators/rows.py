"""Row filters; a row is kept only where the condition is TRUE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column, total_looking
from trialspark.operators.joins import join_group


def good_trials(
    df: DataFrame, cols: Sequence[str], min_total: float = 0.50, inclusive: bool = True
) -> DataFrame:
    """Trials whose summed measures reach `min_total` (or exceed it)."""
    total = total_looking(*cols)
    limit = F.lit(float(min_total))
    return df.where(total >= limit if inclusive else total > limit)


def exclude_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Rows whose value is known and not listed."""
    c = as_column(col)
    return df.where(~c.isin(*values) if values else c.isNotNull())


def filter_group(
    df: DataFrame, by: Sequence[str], value: Column, keep: Column, name: str = "group_value"
) -> DataFrame:
    """Rows of the groups whose aggregate `value`, attached as `name`, passes `keep`."""
    stats = df.groupBy(*[as_column(b) for b in by]).agg(value.alias(name)).where(keep)
    return join_group(df, stats, by)


def subset_by_level(df: DataFrame, factor: str, level) -> DataFrame:
    return df.where(as_column(factor) == F.lit(level))


def complete_subjects(
    df: DataFrame, wid: str, within: str, levels: Sequence | None = None
) -> DataFrame:
    """Rows of the subjects that were seen at every within level.

    The number of levels is taken from the table unless the levels are listed.
    """
    c = as_column(within)
    if levels is None:
        wanted = df.agg(F.count_distinct(c)).scalar()
        counted = c
    else:
        wanted = F.lit(len(set(levels)))
        counted = F.when(c.isin(*levels), c)
    seen = (
        df.groupBy(as_column(wid))
        .agg(F.count_distinct(counted).alias("__levels"))
        .where(F.col("__levels") == wanted)
        .drop("__levels")
    )
    return df.join(seen, [wid], "left_semi")
