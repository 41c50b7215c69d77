"""Wide to long, long to wide, and splitting one text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column, level_index
from trialspark.operators.columns import column_range

NON_ALNUM = r"[^\p{L}\p{N}]+"
_BITS = 62


def melt_range(
    df: DataFrame, first: str, last: str, key: str = "aoi", value: str = "looking_time"
) -> DataFrame:
    """Columns first..last become (key, value) rows; missing values are kept."""
    measures = column_range(df, first, last)
    ids = [as_column(c) for c in df.columns if c not in measures]
    return df.unpivot(ids, [as_column(c) for c in measures], key, value)


def separate(df: DataFrame, col: str, into: Sequence[str], sep: str = NON_ALNUM) -> DataFrame:
    """Split a text column on `sep` into the columns `into`, in its place.

    Pieces beyond the last are dropped, missing ones are NULL.
    """
    pieces = F.split(as_column(col), sep)
    out: list[Column] = []
    for c in df.columns:
        if c == col:
            out += [F.get(pieces, i).alias(n) for i, n in enumerate(into)]
        else:
            out.append(as_column(c))
    return df.select(*out)


def spread(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    values_from: str,
    levels: Sequence[str],
    on_duplicate: str = "error",
    on_unlisted: str = "error",
) -> DataFrame:
    """One column per level of `names_from`, one row per key.

    One aggregation by the keys only, so one exchange with map-side combining.
    A repeated (key, level) raises, or keeps the greatest value when
    `on_duplicate="max"`. The guard rides in the same aggregation: each level
    is a bit, and the sum of the bits differs from their union as soon as one
    level occurs twice. A row whose level is not listed (or missing) raises too, or is
    left out knowingly with `on_unlisted="drop"`.
    """
    if on_duplicate not in ("error", "max"):
        raise ValueError(f"on_duplicate={on_duplicate!r}")
    if on_unlisted not in ("error", "drop"):
        raise ValueError(f"on_unlisted={on_unlisted!r}")
    levels = list(levels)
    name, value = as_column(names_from), as_column(values_from)
    place = level_index(name, levels) - 1
    df = df.withColumn("__place", place)
    aggs = [F.max(F.when(F.col("__place") == i, value)).alias(str(x)) for i, x in enumerate(levels)]
    wrong: list[tuple[Column, str]] = []
    guards: list[str] = []
    if on_unlisted == "error":
        aggs.append(F.sum(F.col("__place").isNull().cast("int")).alias("__unlisted"))
        guards.append("__unlisted")
        wrong.append((F.col("__unlisted") > 0, f"a level of {names_from} is not listed"))
    if on_duplicate == "error":
        message = "repeated key: " + ", ".join([*keys, names_from])
        for w in range(0, len(levels), _BITS):
            inside = F.col("__place").between(w, min(w + _BITS, len(levels)) - 1)
            bit = F.when(inside, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__place") - w))
            guards += [f"__sum_{w}", f"__or_{w}"]
            aggs += [F.sum(bit).alias(f"__sum_{w}"), F.bit_or(bit).alias(f"__or_{w}")]
            wrong.append((F.coalesce(F.col(f"__sum_{w}") != F.col(f"__or_{w}"), F.lit(False)), message))
    out = df.groupBy(*[as_column(k) for k in keys]).agg(*aggs)
    for condition, message in wrong:
        out = out.where(F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
    return out.drop(*guards)
