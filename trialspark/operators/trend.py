"""Trend line and local smoother, each with its confidence band, per series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions.scalars import as_column
from trialspark.functions.tails import t_q
from trialspark.operators.groups import clean
from trialspark.operators.joins import join_group
from trialspark.operators.ttests import sum_squares

#: Places of a series' range that its x are told apart by, and places at which the smoother's traces are taken.
RESOLUTION, BAND_PLACES = 1 << 20, 512


def trend_lines(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of each series, one row per series."""
    xs, ys = clean(df, x).cast("double"), clean(df, y).cast("double")
    used = F.when(xs.isNotNull() & ys.isNotNull(), xs)
    return (
        df.groupBy(*[as_column(b) for b in by])
        .agg(
            F.regr_count(ys, xs).alias("n"),
            F.regr_avgx(ys, xs).alias("x_mean"),
            F.regr_avgy(ys, xs).alias("y_mean"),
            F.regr_sxx(ys, xs).alias("sxx"),
            F.regr_sxy(ys, xs).alias("sxy"),
            F.regr_syy(ys, xs).alias("syy"),
            F.min(used).alias("x_min"),
            F.max(used).alias("x_max"),
        )
        .withColumn("slope", F.try_divide("sxy", "sxx"))
        .withColumn("intercept", F.col("y_mean") - F.col("slope") * F.col("x_mean"))
        .withColumn(
            "r2", F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy"))
        )
    )


def _grid(grid: Sequence[float] | None, n_grid: int) -> Column:
    """x places of the drawn line: the given ones, or evenly spaced over the range."""
    if grid is not None:
        return F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    span = F.col("x_max") - F.col("x_min")
    return F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_grid - 1)),
            lambda i: F.col("x_min") + span * i / F.lit(float(n_grid - 1)),
        )
    )


def trend(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    se: bool = False,
    conf: float = 0.95,
    method: str = "lm",
    span: float = 0.75,
    grid: Sequence[float] | None = None,
    n_grid: int = 80,
) -> DataFrame:
    """Drawn points of a trend per series: a line, or a local smoother."""
    if method == "loess":
        return _local_quadratic(df, x, y, by, span, grid, n_grid, se, conf)
    if method != "lm":
        raise ValueError(f"method={method!r}")
    keys = [as_column(b) for b in by]
    lines = trend_lines(df, x, y, by)
    points = lines.select("*", _grid(grid, n_grid).alias("x")).withColumn(
        "fit", F.col("intercept") + F.col("slope") * F.col("x")
    )
    if not se:
        return points.select(*keys, "x", "fit")
    dof = (F.col("n") - 2).cast("double")
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    gap = F.col("x") - F.col("x_mean")
    error = F.sqrt(
        F.when(dof > 0, F.try_divide(rest, dof))
        * (1 / F.col("n") + F.try_divide(gap * gap, F.col("sxx")))
    )
    half = F.col("se") * t_q(F.lit(1 - (1 - conf) / 2), F.col("df"))
    return (
        points.select(*keys, "x", "fit", error.alias("se"), dof.alias("df"))
        .select("*", (F.col("fit") - half).alias("lower"), (F.col("fit") + half).alias("upper"))
    )


def _local_quadratic(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str],
    span: float,
    grid: Sequence[float] | None,
    n_grid: int,
    se: bool,
    conf: float,
) -> DataFrame:
    """Local quadratic fit with tricube weights over the nearest share of points, and its confidence band.

    Rows are first merged by x, then to RESOLUTION places of a series' range, so what one task gets of a series is
    bounded; x that differ by more than that share of the range are left as they are. A place of the drawn line finds
    its width by a search to both sides of the sorted x.

    The band is that of a linear smoother: fit = sum of l(b) y(b), se = s * |l|, s from the residuals at the data over
    trace (I - L)(I - L)', with degrees of freedom from that trace and the trace of its square, for all distinct x of a
    series up to BAND_PLACES; neighbours are merged to as many for these traces where there are more.
    """
    if not 0 < span <= 1:
        raise ValueError(f"span={span!r}")
    keys = [as_column(b) for b in by]
    xs, ys = clean(df, x).cast("double"), clean(df, y).cast("double")
    n, mean = F.col("__n"), F.col("__y")
    merged = (
        df.select(*keys, xs.alias("__x"), ys.alias("__y"))
        .where(F.col("__x").isNotNull() & mean.isNotNull())
        .groupBy(*keys, "__x")
        .agg(F.count(F.lit(1)).alias("__n"), F.avg("__y").alias("__y"), sum_squares(mean).alias("__ss"))
    )
    ranges = merged.groupBy(*keys).agg(F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    step = F.floor(F.coalesce(F.try_divide(F.col("__x") - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0)) * RESOLUTION)
    one = F.count(F.lit(1)) == 1
    total = F.sum(n)
    apart = F.greatest(F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / total, F.lit(0.0))
    points = (
        join_group(merged, ranges, by)
        .groupBy(*keys, step.alias("__step"))
        .agg(
            F.when(one, F.max("__x")).otherwise(F.sum(n * F.col("__x")) / total).alias("__x"),
            F.when(one, F.max("__y")).otherwise(F.sum(n * mean) / total).alias("__y"),
            F.when(one, F.max("__ss")).otherwise(F.sum("__ss") + apart).alias("__ss"),
            total.alias("__n"),
        )
        .drop("__step")
    )

    def draw(series: pa.Table) -> pa.Table:
        series = series.sort_by("__x")
        xs_, ys_, ss, ns = (series.column(c).to_numpy().astype(float) for c in ("__x", "__y", "__ss", "__n"))
        places = np.array(grid, float) if grid is not None else xs_[0] + (xs_[-1] - xs_[0]) * np.arange(n_grid) / max(n_grid - 1, 1)
        rows = [_operator_row(xs_, ns, x0, span) for x0 in places]
        out = {"x": places, "fit": [float(row @ ys_) for row in rows]}
        if se:
            variance, dof = _residual_variance(xs_, ys_, ss, ns, span)
            out |= {"se": [math.sqrt(variance * float(row @ (row / ns))) for row in rows], "df": np.full(len(places), dof)}
        first = series.take(pa.array(np.zeros(len(places), np.int64)))
        columns = {b: first.column(b) for b in by} | {k: pa.array(np.asarray(v, float), from_pandas=True) for k, v in out.items()}
        return pa.table(columns)

    added = ["x", "fit", "se", "df"] if se else ["x", "fit"]
    schema = T.StructType([points.schema[b] for b in by] + [T.StructField(c, T.DoubleType()) for c in added])
    drawn = points.groupBy(*keys).applyInArrow(draw, schema)
    if not se:
        return drawn
    half = F.col("se") * t_q(F.lit(1 - (1 - conf) / 2), F.col("df"))
    return drawn.select("*", (F.col("fit") - half).alias("lower"), (F.col("fit") + half).alias("upper"))


def _width(x: np.ndarray, n: np.ndarray, x0: float, wanted: float) -> float:
    """Distance within which `wanted` points lie; x is sorted, n are the points at each."""
    cut = int(np.searchsorted(x, x0))
    sides = (x0 - x[:cut][::-1], x[cut:] - x0)
    upto = tuple(np.r_[0.0, np.cumsum(m)] for m in (n[:cut][::-1], n[cut:]))
    best = math.inf
    for own in sides:
        low, high = 0, len(own)
        while low < high:
            middle = (low + high) // 2
            if sum(u[np.searchsorted(d, own[middle], side="right")] for d, u in zip(sides, upto)) >= wanted:
                high = middle
            else:
                low = middle + 1
        if low < len(own):
            best = min(best, float(own[low]))
    return best


def _operator_row(x: np.ndarray, n: np.ndarray, x0: float, span: float) -> np.ndarray:
    """What each mean value counts in the fit at x0."""
    h = _width(x, n, x0, max(math.floor(n.sum() * span + 1e-5), 1))
    row = np.zeros(len(x))
    if h > 0:
        near = np.flatnonzero(np.abs(x - x0) < h)
        u = (x[near] - x0) / h
        w = n[near] * (1 - np.abs(u) ** 3) ** 3
    else:
        near = np.flatnonzero(x == x0)
        u, w = np.zeros(len(near)), n[near]
    s = [float((w * u**k).sum()) for k in range(5)]
    if len(near) >= 3:
        minors = (s[2] * s[4] - s[3] * s[3], s[1] * s[4] - s[2] * s[3], s[1] * s[3] - s[2] * s[2])
        share, whole = minors[0] - minors[1] * u + minors[2] * u * u, s[0] * minors[0] - s[1] * minors[1] + s[2] * minors[2]
    elif len(near) == 2:
        share, whole = s[2] - s[1] * u, s[0] * s[2] - s[1] * s[1]
    else:
        share, whole = np.ones(len(near)), s[0]
    row[near] = w * share / whole if whole else math.nan
    return row


def _residual_variance(x: np.ndarray, y: np.ndarray, ss: np.ndarray, n: np.ndarray, span: float) -> tuple[float, float]:
    """Residual variance and its degrees of freedom, from the fit at the data."""
    at, count = x, n
    if len(x) > BAND_PLACES:
        part = np.minimum((np.cumsum(n) - n) * BAND_PLACES // n.sum(), BAND_PLACES - 1).astype(int)
        count = np.bincount(part, n, BAND_PLACES)
        at, count = (np.bincount(part, n * x, BAND_PLACES)[count > 0] / count[count > 0]), count[count > 0]
    rows = np.array([_operator_row(at, count, x0, span) for x0 in at])
    fit = rows @ y if at is x else np.interp(x, at, [float(_operator_row(x, n, x0, span) @ y) for x0 in at])
    rest = float((ss + n * (y - fit) ** 2).sum())
    shared = rows / count
    both = shared + shared.T - shared @ rows.T  # of two rows at these places, but for a row with itself
    own = np.diag(both)
    first = float((count * (1 - own)).sum())
    second = float((np.outer(count, count) * both * both).sum() + (count * (1 - 2 * own)).sum())
    if not first > 1e-9 or not second > 0:
        return math.nan, math.nan
    return rest / first, first * first / second
