"""One-way analysis of variance, Levene's test, Student-Newman-Keuls pairs.

Rows are reduced to count, mean and centred sum of squares per design cell; all
further steps run over those cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column, interaction
from trialspark.functions.tails import f_p, range_p, range_q
from trialspark.operators.groups import attach_group, clean
from trialspark.operators.joins import join_group
from trialspark.operators.numbering import carried, in_shares
from trialspark.operators.ttests import sum_squares

#: Places of ordered levels that meet a lower one in one place.
BLOCK = 256


def cell_summary(
    df: DataFrame, value: str, group: str | Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """n, mean and ss per level (crossed levels for several factors)."""
    factors = [group] if isinstance(group, str) else list(group)
    v = clean(df, value)
    level = as_column(factors[0]) if len(factors) == 1 else interaction(*factors)
    return (
        df.select(*[as_column(b) for b in by], level.alias("level"), v.alias("v"))
        .where(F.col("v").isNotNull() & F.col("level").isNotNull())
        .groupBy(*[as_column(b) for b in by], "level")
        .agg(F.count("v").alias("n"), F.avg("v").alias("mean"), sum_squares(F.col("v")).alias("ss"))
    )


def _totals(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per `by` group: number of cells and rows, grand mean, sum of squares inside cells."""
    return cells.groupBy(*[as_column(b) for b in by]).agg(
        F.count(F.lit(1)).alias("__cells"),
        F.sum("n").alias("__rows"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("__grand"),
        F.sum("ss").alias("__inside"),
    )


def _ratio_table(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.col("mean") - F.col("__grand")
    return (
        join_group(cells, _totals(cells, by), by)
        .groupBy(*[as_column(b) for b in by])
        .agg(
            (F.count(F.lit(1)) - 1).cast("double").alias("df_n"),
            (F.sum("n") - F.count(F.lit(1))).cast("double").alias("df_d"),
            F.sum(F.col("n") * gap * gap).alias("ss_n"),
            F.sum("ss").alias("ss_d"),
        )
        .withColumn("ms_d", F.try_divide("ss_d", "df_d"))
        .withColumn("f", F.try_divide(F.try_divide("ss_n", "df_n"), F.col("ms_d")))
    )


def anova_oneway(
    df: DataFrame, value: str, group: str | Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """F test of equal level means, one row per `by` group."""
    out = _ratio_table(cell_summary(df, value, group, by), by)
    return out.withColumn("p", f_p("f", "df_n", "df_d"))


def levene(
    df: DataFrame,
    value: str,
    group: str | Sequence[str],
    center: str = "mean",
    by: Sequence[str] = (),
) -> DataFrame:
    """Equality of variances: one-way test of distances from the level mean."""
    if center != "mean":
        raise ValueError(f"center={center!r}")
    factors = [group] if isinstance(group, str) else list(group)
    v = clean(df, value)
    centred = attach_group(df, [*by, *factors], __center=F.avg(v))
    return anova_oneway(
        centred.withColumn("__distance", F.abs(v - F.col("__center"))), "__distance", group, by
    )


def snk(
    df: DataFrame, value: str, group: str, by: Sequence[str] = (), alpha: float = 0.05
) -> DataFrame:
    """Studentized-range test of all pairs of level means.

    Levels are ordered by mean (and name, where means are equal); a pair that spans r ordered means is judged
    against the range of r means. Unequal counts use the mean of 1/n. The cells, one a level, are made and stored
    once, in that order over many tasks; a cell meets those of higher place block by block of BLOCK places.
    """
    keys = [as_column(b) for b in by]
    order = [*[F.asc_nulls_first(k) for k in keys], F.asc("mean"), F.asc("level")]
    cells = in_shares(cell_summary(df, value, group, by), order, "snk-cells")
    first = cells.groupBy(*keys, "__share").agg(F.min("__at").alias("__first"))
    placed = join_group(carried(cells, by, rows=F.count(F.lit(1))), first, [*by, "__share"])
    place = F.coalesce("rows", F.lit(0)) + F.col("__at") - F.col("__first")
    ranked = join_group(placed.withColumn("__place", place), _totals(cells, by), by)
    block = lambda c: F.floor(c / BLOCK).cast("bigint")
    low = ranked.select(
        *keys, F.struct("level", "n", "mean").alias("__low"), F.col("__place").alias("__from"),
        (F.col("__rows") - F.col("__cells")).cast("double").alias("df"), F.col("__inside").alias("__ss_d"),
        F.explode(F.sequence(block(F.col("__place")), block(F.col("__cells") - 1))).alias("__block"),
    )
    high = ranked.select(*keys, F.struct("level", "n", "mean").alias("__high"), F.col("__place").alias("__to"), block(F.col("__place")).alias("__block"))
    pairs = join_group(low, high, [*by, "__block"]).where(F.col("__from") < F.col("__to"))
    low, high = F.col("__low"), F.col("__high")
    out = pairs.select(
        *keys,
        low["level"].alias("level_1"),
        high["level"].alias("level_2"),
        (high["mean"] - low["mean"]).alias("mean_diff"),
        (F.col("__to") - F.col("__from") + 1).cast("double").alias("span"),
        "df",
        F.sqrt(F.try_divide("__ss_d", "df") / 2 * (1 / low["n"] + 1 / high["n"])).alias("se"),
    ).withColumn("q", F.try_divide("mean_diff", "se"))
    half = F.col("se") * range_q(F.lit(1 - alpha), F.col("span"), F.col("df"))
    return out.select(
        "*",
        range_p("q", "span", "df").alias("p"),
        (F.col("mean_diff") - half).alias("ci_low"),
        (F.col("mean_diff") + half).alias("ci_high"),
    )
