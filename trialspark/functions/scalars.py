"""Scalar rules, Column in and Column out.

Missing is always NULL: a missing operand gives a missing result, a condition
that is NULL picks neither branch, and NaN is turned into NULL where it could
enter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_column(c: ColumnOrName) -> Column:
    """A column name may hold dots or blanks, so names are quoted."""
    return c if isinstance(c, Column) else F.col(quoted(c))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def nan_to_null(c: ColumnOrName) -> Column:
    """NaN counts as missing."""
    c = as_column(c)
    return F.when(~F.isnan(c), c)


def if_else(cond: Column, yes, no) -> Column:
    """Two-way conditional; a NULL condition stays NULL."""
    return F.when(cond, yes).when(~cond, no)


def flag(cond: Column) -> Column:
    """0/1 integer flag of a condition."""
    return if_else(cond, F.lit(1), F.lit(0))


def total_looking(*measures: ColumnOrName) -> Column:
    """Row-wise sum, added left to right so that boundary tests are repeatable."""
    return reduce(add, [as_column(m) for m in measures])


def correct(target: ColumnOrName, distractor: ColumnOrName) -> Column:
    return flag(as_column(target) > as_column(distractor))


def incorrect(target: ColumnOrName, distractor: ColumnOrName) -> Column:
    return flag(as_column(distractor) > as_column(target))


def no_anticipation(target: ColumnOrName, distractor: ColumnOrName) -> Column:
    return flag(as_column(target) + as_column(distractor) == F.lit(0.0))


def complement(flag_column: ColumnOrName) -> Column:
    return F.lit(1) - as_column(flag_column)


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den; a zero denominator gives NULL."""
    return F.try_divide(as_column(num), as_column(den))


def to_number(c: ColumnOrName) -> Column:
    """Text to double; text that is no number gives NULL."""
    return nan_to_null(as_column(c).try_cast("double"))


def recode(c: ColumnOrName, mapping: Mapping, default=None) -> Column:
    """Replace listed values; others become `default`, NULL stays NULL."""
    c = as_column(c)
    out = None
    for value, label in mapping.items():
        hit = c == F.lit(value)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.when(c.isNotNull(), F.lit(default))


def block_number(trial: ColumnOrName, size: int = 3) -> Column:
    """Trials 1..size are block 1, the next `size` block 2, and so on."""
    return F.floor((as_column(trial) + F.lit(size - 1)) / F.lit(size)).cast("int")


def interaction(*factors: ColumnOrName, sep: str = ".") -> Column:
    """Composite level name; missing when any part is missing."""
    pieces: list[Column] = []
    for f in factors:
        if pieces:
            pieces.append(F.lit(sep))
        pieces.append(as_column(f).cast("string"))
    return F.concat(*pieces)


def high_low(
    value: ColumnOrName, median: ColumnOrName, labels: Sequence[str] = ("Low", "High")
) -> Column:
    """First label below the median, second at or above it."""
    low, high = labels
    return if_else(as_column(median) > as_column(value), F.lit(low), F.lit(high))


def level_index(c: ColumnOrName, levels: Sequence) -> Column:
    """1-based position of a value in its ordered levels; NULL when not a level."""
    if not levels:
        return F.lit(None).cast("int")
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), as_column(c))
    return F.nullif(place, F.lit(0)).cast("int")


def reverse_levels(index: ColumnOrName, k: int) -> Column:
    """Level index in the reversed order of k levels."""
    return F.lit(k + 1) - as_column(index)
