"""Header clean-up, column selection, missing values and factor levels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions.scalars import as_column, level_index, quoted
from trialspark.operators.numbering import carried, in_shares, within


def rename_regex(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rewrite every column name with an ordered list of regex replacements."""
    names = list(df.columns)
    for pattern, repl in rules:
        names = [re.sub(pattern, repl, n) for n in names]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"renaming gives repeated columns: {repeated}")
    return df.toDF(*names)


def names_containing(df: DataFrame, *substrings: str, ignore_case: bool = True) -> list[str]:
    """Columns holding a substring, by substring and then by table order."""
    fold = str.lower if ignore_case else str
    found: list[str] = []
    for s in substrings:
        found += [c for c in df.columns if fold(s) in fold(c) and c not in found]
    return found


def select_contains(
    df: DataFrame, keys: Sequence[str], *substrings: str, ignore_case: bool = True
) -> DataFrame:
    """Keys first, then the columns whose name holds a substring."""
    rest = [c for c in names_containing(df, *substrings, ignore_case=ignore_case) if c not in keys]
    return df.select(*[as_column(c) for c in [*keys, *rest]])


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from `first` to `last` in the table's present column order."""
    i, j = df.columns.index(first), df.columns.index(last)
    if j < i:
        raise ValueError(f"{last!r} comes before {first!r}")
    return df.columns[i : j + 1]


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[as_column(c) for c in df.columns if c not in names])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    if old not in df.columns:
        raise ValueError(f"no column {old!r}")
    return df.withColumnRenamed(old, new)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def fill_measures(
    df: DataFrame, value: float = 0.0, cols: Sequence[str] | None = None
) -> DataFrame:
    """Missing measures become `value`; keys and text stay as they are."""
    cols = numeric_columns(df) if cols is None else list(cols)
    return df.fillna(value, subset=[quoted(c) if "." in c else c for c in cols])


def level_order(
    df: DataFrame,
    col: str,
    levels: Sequence | None = None,
    name: str | None = None,
    reverse: bool = False,
) -> DataFrame:
    """Attach the 1-based level index of a factor.

    Without `levels` they are the sorted distinct values, any number of them: numbered over many tasks (which stores
    them) and joined back.
    """
    name = name or f"{col}_level"
    if levels is not None:
        return df.withColumn(name, level_index(col, list(levels)[::-1] if reverse else list(levels)))
    level = F.col("__level")
    known = df.select(as_column(col).alias("__level")).where(level.isNotNull()).distinct()
    shares = in_shares(known, [level.desc() if reverse else level.asc()], "levels")
    own = F.coalesce(F.count(F.lit(1)).over(within([])), F.lit(0))
    placed = carried(shares, [], rows=F.count(F.lit(1)))
    ranked = placed.select("__level", (F.coalesce("rows", F.lit(0)) + own + 1).cast("int").alias(name))
    return df.join(ranked, as_column(col) == level, "left").drop("__level")
