"""Participant counts, proportion and block series, median split, figure series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import (
    as_column,
    block_number,
    high_low,
    interaction,
    to_number,
)
from trialspark.operators.columns import level_order
from trialspark.operators.groups import clean, mean_of, ndistinct, with_group_mean
from trialspark.operators.joins import join_group
from trialspark.operators.quantiles import group_median


def participant_counts(
    df: DataFrame, by: Sequence[str], subject: str = "subject", name: str = "num_participants"
) -> DataFrame:
    return ndistinct(df, subject, by, name=name)


def proportion(
    df: DataFrame,
    score: str,
    by: Sequence[str],
    among: Column | str | None = None,
    name: str = "proportion",
) -> DataFrame:
    """Mean of a 0/1 score per cell, over the rows where `among` holds."""
    return mean_of(df, score, by, among, name)


def median_split(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    labels: Sequence[str] = ("Low", "High"),
    per_subject: str | None = None,
    median_name: str = "median_by_group",
    name: str = "vocab_size",
) -> DataFrame:
    """Label rows low or high against their group's median.

    The median is over rows, so subjects weigh by their number of rows; with
    `per_subject` each subject counts once per group.
    """
    rows = df.select(*[as_column(b) for b in by], clean(df, value).alias("__value"))
    if per_subject is not None:
        rows = df.select(
            *[as_column(b) for b in by],
            as_column(per_subject).alias("__subject"),
            clean(df, value).alias("__value"),
        ).distinct()
    medians = group_median(rows, "__value", by, median_name)
    return join_group(df, medians, by).withColumn(
        name, high_low(clean(df, value), median_name, labels)
    )


def with_block(
    df: DataFrame, trial: str = "trial_number", block_size: int = 3, name: str = "blocks_num"
) -> DataFrame:
    return df.withColumn(name, block_number(trial, block_size))


def block_scores(
    df: DataFrame,
    score: str,
    subject: str,
    by: Sequence[str],
    block_size: int = 3,
    trial: str = "trial_number",
    name: str = "block_anticipation",
) -> DataFrame:
    """Mean score per subject and block (and the design columns `by`)."""
    return mean_of(
        with_block(df, trial, block_size), score, [subject, *by, "blocks_num"], name=name
    )


def block_series(
    df: DataFrame,
    score: str,
    by: Sequence[str],
    block_size: int = 3,
    trial: str = "trial_number",
    name: str = "proportion",
) -> DataFrame:
    """Mean score per cell and block, over trials."""
    return mean_of(with_block(df, trial, block_size), score, [*by, "blocks_num"], name=name)


def block_series_subject(
    blocks: DataFrame,
    by: Sequence[str],
    score: str = "block_anticipation",
    name: str = "proportion_anticipation",
) -> DataFrame:
    """Attach the cell mean of subject block scores to each of its rows."""
    return with_group_mean(blocks, score, by, name)


def figure_series(
    df: DataFrame,
    x: str,
    y: str,
    series: Sequence[str],
    facets: Sequence[str],
    reverse: Sequence[str] = (),
    levels: Mapping[str, Sequence] | None = None,
    only: Column | str | None = None,
) -> DataFrame:
    """The data behind one figure.

    Numeric axis, one composite series key, and a `<facet>_order` column per
    facet that gives its place, reversed where asked. Levels are those of the
    whole table, so a facet keeps its place when `only` shows a part.
    """
    levels = dict(levels or {})
    for f in facets:
        df = level_order(df, f, levels.get(f), f"{f}_order", f in reverse)
    out = df if only is None else df.where(only)
    return out.select(
        *[as_column(f) for f in facets],
        *[f"{f}_order" for f in facets],
        *[as_column(s) for s in series if s not in facets],
        interaction(*series).alias("series"),
        to_number(x).alias("x"),
        clean(df, y).alias("y"),
    )


@dataclass(frozen=True)
class Figure:
    """One figure of a study: mean `y` over `x`, a line for each `series` and a panel for each `facets`, of rows `only`."""

    name: str
    x: str
    y: str
    series: Sequence[str] = ()
    facets: Sequence[str] = ()
    only: Column | str | None = None


def stacked_figures(df: DataFrame, figures: Sequence[Figure]) -> DataFrame:
    """The series of many figures from one reading of the table: `figure`, `facet`, `series`, `x`, `y` (mean) and `n`.

    A row enters every figure that shows it, and all figures are summed up by one aggregation, within tasks first.
    """
    if len({f.name for f in figures}) < len(figures):
        raise ValueError("repeated figure name")
    label = lambda names: interaction(*names) if names else F.lit(None).cast("string")
    entries = []
    for f in figures:
        shown = F.lit(True) if f.only is None else F.expr(f.only) if isinstance(f.only, str) else f.only
        entry = F.struct(
            F.lit(f.name).alias("figure"), label(f.facets).alias("facet"), label(f.series).alias("series"),
            to_number(f.x).alias("x"), clean(df, f.y).cast("double").alias("y"),
        )
        entries.append(F.when(shown, entry))
    rows = df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
    return rows.groupBy("figure", "facet", "series", "x").agg(F.avg("y").alias("y"), F.count("y").alias("n"))


def order_series(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by the keys; meant for a sink, pairing elsewhere is by key."""
    return df.orderBy(*[F.asc_nulls_last(k) for k in keys])
