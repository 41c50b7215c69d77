"""Pooled two-sample t-test and paired comparisons of factor levels.

The data is reduced to count, mean and variance per cell in one aggregation;
the test is arithmetic on those few rows, and only its p-value leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.scalars import as_column
from trialspark.functions.tails import t_p, t_q
from trialspark.operators.groups import clean
from trialspark.operators.joins import join_group
from trialspark.operators.numbering import carried, in_shares, within

ADJUSTMENTS = ("holm", "bonferroni", "none")


def sum_squares(v: Column) -> Column:
    """Centred sum of squares; 0 for a single value."""
    return F.coalesce(F.var_samp(v) * (F.count(v) - 1), F.lit(0.0))


def fail_when(df: DataFrame, cond: Column, message: str) -> DataFrame:
    return df.where(
        F.when(cond, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    )


def unlisted(level: Column, levels: Sequence) -> Column:
    return ~F.coalesce(level.isin(*levels), F.lit(False))


def t_test(
    df: DataFrame, value: str, group: str, by: Sequence[str] = (), conf: float = 0.95
) -> DataFrame:
    """Two-sample t-test with pooled variance, one row per `by` group."""
    keys = [as_column(b) for b in by]
    v, level = clean(df, value), as_column(group)
    cells = (
        df.where(level.isNotNull() & v.isNotNull())
        .groupBy(*keys, level.alias("level"))
        .agg(F.count(v).alias("n"), F.avg(v).alias("mean"), sum_squares(v).alias("ss"))
        .select(*keys, "level", F.struct("level", "n", "mean", "ss").alias("cell"))
    )
    two = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.min_by("cell", "level").alias("a"),
        F.max_by("cell", "level").alias("b"),
    )
    two = fail_when(two, F.col("k") != 2, f"{group} must have exactly 2 levels")
    a, b = F.col("a"), F.col("b")
    dof = (a["n"] + b["n"] - 2).cast("double")
    pooled = F.try_divide(a["ss"] + b["ss"], dof)
    out = two.select(
        *keys,
        a["level"].alias("group_1"),
        b["level"].alias("group_2"),
        a["n"].alias("n_1"),
        b["n"].alias("n_2"),
        a["mean"].alias("mean_1"),
        b["mean"].alias("mean_2"),
        (a["mean"] - b["mean"]).alias("mean_diff"),
        F.sqrt(pooled * (1 / a["n"] + 1 / b["n"])).alias("se"),
        dof.alias("df"),
    ).withColumn("t", F.try_divide("mean_diff", "se"))
    half = F.col("se") * t_q(F.lit(1 - (1 - conf) / 2), F.col("df"))
    return out.select(
        "*",
        t_p("t", "df").alias("p"),
        (F.col("mean_diff") - half).alias("ci_low"),
        (F.col("mean_diff") + half).alias("ci_high"),
    )


def pair_levels(
    df: DataFrame,
    value: str,
    factor: str,
    subject: str,
    levels: Sequence,
    by: Sequence[str] = (),
    on_unlisted: str = "error",
) -> DataFrame:
    """One row per subject with its mean at each level of a within factor.

    A row at another level (or none) raises, unless left out knowingly with `on_unlisted="drop"`.
    """
    if on_unlisted not in ("error", "drop"):
        raise ValueError(f"on_unlisted={on_unlisted!r}")
    v, level = clean(df, value), as_column(factor)
    out = df.groupBy(*[as_column(b) for b in by], as_column(subject)).agg(
        *[F.avg(F.when(level == F.lit(x), v)).alias(str(x)) for x in levels],
        F.count(F.when(unlisted(level, levels), 1)).alias("__unlisted"),
    )
    if on_unlisted == "error":
        out = fail_when(out, F.col("__unlisted") > 0, f"a level of {factor} is not listed")
    return out.drop("__unlisted")


def pairwise_t(
    df: DataFrame,
    value: str,
    factor: str,
    subject: str,
    levels: Sequence,
    adjust: str = "holm",
    by: Sequence[str] = (),
    on_unlisted: str = "error",
) -> DataFrame:
    """Paired t-test of every two levels, later minus earlier level.

    Values are paired by subject; a pair uses the subjects seen at both levels.
    All pairs are summarised in one aggregation, without a row per pair.
    """
    levels = list(levels)
    keys = [as_column(b) for b in by]
    pairs = list(combinations(range(len(levels)), 2))
    aggs, rows = [], []
    for i, j in pairs:
        diff = as_column(str(levels[j])) - as_column(str(levels[i]))
        n, m, s = (f"__{what}_{i}_{j}" for what in ("n", "mean", "std"))
        aggs += [F.count(diff).alias(n), F.avg(diff).alias(m), F.stddev_samp(diff).alias(s)]
        rows.append(
            F.struct(
                F.lit(levels[i]).alias("level_1"),
                F.lit(levels[j]).alias("level_2"),
                F.col(n).alias("n"),
                F.col(m).alias("mean_diff"),
                F.col(s).alias("sd_diff"),
            )
        )
    tested = (
        pair_levels(df, value, factor, subject, levels, by, on_unlisted)
        .groupBy(*keys)
        .agg(*aggs)
        .select(*keys, F.inline(F.array(*rows)))
        .withColumn("df", (F.col("n") - 1).cast("double"))
        .withColumn("t", F.try_divide("mean_diff", F.col("sd_diff") / F.sqrt("n")))
        .withColumn("p", t_p("t", "df"))
    )
    if adjust not in ADJUSTMENTS:
        raise ValueError(f"adjust={adjust!r}")
    return _adjusted_pairs(tested, adjust, by)


def p_adjust(
    df: DataFrame, p: str = "p", adjust: str = "holm", by: Sequence[str] = (), name: str = "p_adj"
) -> DataFrame:
    """Adjust the p-values of a family of comparisons (per `by` group) of any size.

    Equal p-values of a family are adjusted alike, so the step-down runs over its different ones with their counts:
    ordered over many tasks (which stores them), with counts and the running maximum carried from share to share.
    """
    if adjust not in ADJUSTMENTS:
        raise ValueError(f"adjust={adjust!r}")
    value, keys = as_column(p), [as_column(b) for b in by]
    if adjust == "none":
        return df.withColumn(name, value)
    m = F.count(value)
    if adjust == "bonferroni":
        sized = join_group(df, df.groupBy(*keys).agg(m.alias("__m")), by)
        return sized.withColumn(name, F.when(value.isNotNull(), F.least(F.lit(1.0), value * F.col("__m")))).drop("__m")
    family = {b: f"__by_{i}" for i, b in enumerate(by)}
    renamed = df.where(value.isNotNull()).select(*[as_column(b).alias(k) for b, k in family.items()], value.alias("__p"))
    groups = list(family.values())
    values = renamed.groupBy(*groups, "__p").agg(F.count(F.lit(1)).alias("__same"))
    shares = in_shares(values, [*[F.asc_nulls_first(g) for g in groups], F.asc("__p")], "p-values")
    sizes = shares.groupBy(*groups).agg(F.sum("__same").alias("__m"))
    before = F.coalesce("rows", F.lit(0)) + F.coalesce(F.sum("__same").over(within(groups)), F.lit(0))
    steps = join_group(carried(shares, groups, rows=F.sum("__same")), sizes, groups)
    steps = steps.select(*groups, "__p", "__share", "__at", ((F.col("__m") - before) * F.col("__p")).alias("__step"))
    upto = F.greatest("__step", F.coalesce(F.max("__step").over(within(groups)), F.lit(0.0)), F.coalesce("max_step", F.lit(0.0)))
    adjusted = carried(steps, groups, max_step=F.max("__step")).select(*groups, "__p", F.least(F.lit(1.0), upto).alias(name))
    same = value == F.col("__p")
    for b, k in family.items():
        same = same & as_column(b).eqNullSafe(F.col(k))
    return df.join(adjusted, same, "left").drop("__p", *groups)


def _adjusted_pairs(df: DataFrame, adjust: str, by: Sequence[str]) -> DataFrame:
    """`p_adjust` of a family of few comparisons, as many as the listed levels have pairs: ranked side by side."""
    value, keys = as_column("p"), [as_column(b) for b in by]
    if adjust != "holm":
        return p_adjust(df, "p", adjust, by)
    pairs = F.col("__pairs")
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct(*[as_column(c) for c in df.columns if c not in by])).alias("__pairs"))
    family = F.filter(F.transform(pairs, lambda r: r["p"]), lambda v: v.isNotNull())
    step = lambda v: F.size(F.filter(family, lambda o: o >= v)) * v
    upto = lambda r: F.least(F.lit(1.0), F.array_max(F.transform(F.filter(family, lambda o: o <= r["p"]), step)))
    return rows.select(*keys, F.inline(F.transform(pairs, lambda r: r.withField("p_adj", F.when(r["p"].isNotNull(), upto(r))))))
