"""Joins of facts with subject attributes and with group summaries.

Whether a side is broadcast is left to Spark, which knows the size of files and of finished stages. Otherwise both sides
are shuffled, with adaptive splitting of heavy keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column


def join_group(df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one-row-per-group `stats` to its rows; NULL keys match."""
    taken = [c for c in stats.columns if c not in by]
    if not by:
        # a single row of totals: attached as a scalar, no join at all
        if how != "inner":
            return df.join(stats, how=how)
        packed = stats.select(F.struct(*[as_column(c) for c in taken]).alias("totals"))
        return (
            df.withColumn("__totals", packed.scalar())
            .select("*", *[F.col("__totals").getField(c).alias(c) for c in taken])
            .drop("__totals")
        )
    keys = {b: f"__key_{i}" for i, b in enumerate(by)}
    right = stats.select(
        *[as_column(b).alias(k) for b, k in keys.items()], *[as_column(c) for c in taken]
    )
    cond = [as_column(b).eqNullSafe(F.col(k)) for b, k in keys.items()]
    out = df.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*keys.values())


def merge_subjects(
    facts: DataFrame,
    subjects: DataFrame,
    on: Sequence[str] | str,
    null_safe: bool = False,
    suffixes: tuple[str, str] = ("_x", "_y"),
    unique: bool = False,
) -> DataFrame:
    """Inner join on the key; other columns of the same name get suffixes.

    `null_safe=True` lets missing keys match each other; with `unique=True` a
    repeated subject raises instead of multiplying its facts.
    """
    on = [on] if isinstance(on, str) else list(on)
    if unique:
        subjects = assert_unique(subjects, on)
    shared = [c for c in facts.columns if c in subjects.columns and c not in on]
    left = facts.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = subjects.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    if null_safe:
        return join_group(left, right, on)
    return left.join(right, on, "inner")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table itself; evaluating it fails when a key combination repeats."""
    worst = (
        df.groupBy(*[as_column(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("worst"))
    )
    message = "repeated key: " + ", ".join(keys)
    return df.where(
        F.when(worst.scalar() > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    )


def exclude_subjects(df: DataFrame, exclusions: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows whose key is not in the exclusion table."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(exclusions.select(*[as_column(c) for c in on]), on, "left_anti")
