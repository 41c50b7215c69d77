"""Trial-study views of the driver tables, as the registered queries read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions.scalars import flag
from trialspark.plans.trials import attach_subjects, quality_filter, score

MEASURES = ("circle", "distractor", "target")
PHASES = ("Training", "Test")
TRIALS = 15
# Which event types play which area of interest.
AOI_EVENTS = {"circle": ("view", "signup"), "distractor": ("error",), "target": ("click", "purchase")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(value: Column) -> Column:
    """Sum of values of two decimals, the same in any order."""
    return F.sum(F.rint(value * 100).cast("bigint")) / F.lit(100)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looking time per subject, phase and trial.

    Times are summed in whole hundredths, so neither row order nor a retried
    task can move a total across a cut-off.
    """
    day = F.dayofmonth("ts")
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("user_id").alias("subject"),
            F.when(day <= TRIALS, "Training").otherwise("Test").alias("trial_type"),
            ((day - 1) % TRIALS + 1).alias("trial_number"),
        )
        .agg(
            *[
                exact_sum(F.when(F.col("event_type").isin(*events), F.col("value")).otherwise(0.0))
                .alias(aoi)
                for aoi, events in AOI_EVENTS.items()
            ]
        )
    )


def wide_name(aoi: str, phase: str, trial: int) -> str:
    return f"Total Fixation Duration_{phase}{trial}_{aoi.capitalize()}_Sum"


def wide_names() -> list[str]:
    return [
        wide_name(aoi, phase, n)
        for aoi in MEASURES
        for phase in ("Test", "Training")
        for n in range(1, TRIALS + 1)
    ]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recording, one column per phase, trial and area of interest."""
    cell = [
        F.max(F.when((F.col("trial_type") == phase) & (F.col("trial_number") == n), F.col(aoi))).alias(wide_name(aoi, phase, n))
        for aoi in MEASURES
        for phase in ("Test", "Training")
        for n in range(1, TRIALS + 1)
    ]
    return trials(spark, sf_dir).groupBy(F.col("subject").alias("recording.name")).agg(*cell)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject attributes as they arrive: joined group text, numbers as text."""
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("subject"),
        F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string")).alias(
            "lang_group"
        ),
        F.when(F.col("c_nationkey") % 2 == 0, "7 months").otherwise("20 months").alias("age_group"),
        F.when(balance >= 9000, "n/a").otherwise(balance.cast("string")).alias(
            "total_concept_prod"
        ),
        flag(balance > 0).alias("keeper"),
    )


def good(spark: SparkSession, sf_dir: str, **rules) -> DataFrame:
    return quality_filter(trials(spark, sf_dir), "subject", "trial_type", MEASURES, **rules)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good trials, scored, with subject attributes."""
    return attach_subjects(score(good(spark, sf_dir)), master(spark, sf_dir))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated measures by order status between customer groups."""
    return (
        table(spark, sf_dir, "orders")
        .join(
            table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "inner"
        )
        .select(
            F.col("o_custkey").alias("subject"),
            F.col("o_orderstatus").alias("block"),
            F.col("c_mktsegment").alias("language"),
            F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("half"),
            F.col("o_totalprice").alias("score"),
        )
    )


def mixed_means(spark: SparkSession, sf_dir: str, within: bool = True) -> DataFrame:
    """`mixed` reduced to the mean per subject (and block) before the join.

    The subject tests need no more than these means, and a customer with very
    many orders is combined before its rows meet in one task.
    """
    keys = ["o_custkey", "o_orderstatus"] if within else ["o_custkey"]
    means = table(spark, sf_dir, "orders").groupBy(*keys).agg(F.avg("o_totalprice").alias("score"))
    return means.join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "inner"
    ).select(
        F.col("o_custkey").alias("subject"),
        *([F.col("o_orderstatus").alias("block")] if within else []),
        F.col("c_mktsegment").alias("language"),
        F.when(F.col("c_nationkey") % 2 == 0, "even").otherwise("odd").alias("half"),
        "score",
    )
