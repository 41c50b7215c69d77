"""From a wide export and a subject table to scored, merged trials."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.functions.scalars import (
    as_column,
    complement,
    correct,
    incorrect,
    nan_to_null,
    no_anticipation,
    safe_ratio,
    to_number,
    total_looking,
)
from trialspark.operators.columns import column_range, rename_regex
from trialspark.operators.joins import assert_unique, join_group, merge_subjects
from trialspark.operators.reshape import separate
from trialspark.operators.rows import good_trials

# Header clean-up of the measurement export, in order.
EXPORT_RULES = (
    ("Total Fixation Duration_Test", "Test"),
    ("Total Fixation Duration_Training", "Training"),
    ("Circle_Sum", "Circle"),
    ("Target_Sum", "Target"),
    ("Distractor_Sum", "Distractor"),
    ("Test", "Test_"),
    ("Training", "Training_"),
)


def to_trials(
    wide: DataFrame,
    key: str,
    rename_rules: Sequence[tuple[str, str]] = EXPORT_RULES,
    first: str | None = None,
    last: str | None = None,
    into: tuple[str, str] = ("trial_type", "trial_number"),
    measures: Sequence[str] = ("Circle", "Distractor", "Target"),
    fill: float | None = 0.0,
    check_key: bool = True,
) -> DataFrame:
    """Wide export to one row per (key, phase, trial) with one column per measure.

    The header alone says which column belongs to which trial, so each wide row
    is turned into its trial rows in place, without moving any measure between
    tasks. Same rows as fill, melt, separate and spread in turn. A repeated key
    raises; that check moves only the key column.
    """
    df = rename_regex(wide, rename_rules)
    names = [c for c in df.columns if any(m.lower() in c.lower() for m in measures)]
    if first is not None or last is not None:
        kept = set(column_range(df, first or df.columns[0], last or df.columns[-1]))
        names = [c for c in names if c in kept]
    folded = {m.lower(): m for m in measures}
    cells: dict[tuple[str, str], dict[str, str]] = {}
    for c in names:
        pieces = re.split(r"[\W_]+", c)
        if len(pieces) < 3:
            raise ValueError(f"column {c!r} does not name a phase, a trial and a measure")
        phase, trial, aoi = *pieces[:2], folded.get(pieces[2].lower())
        if aoi is None:
            raise ValueError(f"column {c!r} names no measure")
        if aoi in cells.setdefault((phase, trial), {}):
            raise ValueError(f"two columns for {phase} {trial} {aoi}")
        cells[(phase, trial)][aoi] = c

    def cell(columns: dict[str, str], measure: str) -> Column:
        if measure not in columns:
            return F.lit(None).cast("double")
        value = nan_to_null(as_column(columns[measure]).cast("double"))
        return value if fill is None else F.coalesce(value, F.lit(fill))

    rows = F.array(
        *[
            F.struct(
                F.lit(phase).alias(into[0]),
                F.lit(trial).alias(into[1]),
                *[cell(columns, m).alias(m) for m in measures],
            )
            for (phase, trial), columns in cells.items()
        ]
    )
    if check_key:
        df = assert_unique(df, [key])
    return df.select(as_column(key), F.inline(rows))


def quality_filter(
    trials: DataFrame,
    subject: str,
    phase: str,
    measures: Sequence[str],
    min_total: float = 0.50,
    inclusive: bool = True,
    min_trials: int = 5,
    n_phases: int = 2,
) -> DataFrame:
    """Good trials of good subjects.

    In this order: drop bad trials, count the good ones per subject and phase,
    keep phases with enough, keep subjects with all phases. The counts are
    aggregated first (one row per subject and phase) and only their result is
    joined to the trials, so a subject with very many rows never sits in one task.
    A trial without subject belongs to nobody and is dropped.
    """
    trials = trials.where(as_column(subject).isNotNull())
    good = good_trials(trials, measures, min_total, inclusive).withColumn(
        "all_looking_time", total_looking(*measures)
    )
    per_phase = (
        good.groupBy(as_column(subject), as_column(phase))
        .agg(F.count(F.lit(1)).alias("num_good_trial"))
        .where(F.col("num_good_trial") >= min_trials)
    )
    phases = F.count(F.lit(1)).over(Window.partitionBy(as_column(subject)))
    kept = per_phase.withColumn("good_baby", phases).where(F.col("good_baby") == n_phases)
    return join_group(good, kept, [subject, phase])


def score(trials: DataFrame, target: str = "target", distractor: str = "distractor") -> DataFrame:
    """Anticipation flags and the share of looking at the target."""
    return (
        trials.withColumn("correct_anticipation", correct(target, distractor))
        .withColumn("incorrect_anticipation", incorrect(target, distractor))
        .withColumn("no_anticipation", no_anticipation(target, distractor))
        .withColumn("all_anticipation", complement("no_anticipation"))
        .withColumn(
            "prop_look_correct", safe_ratio(target, as_column(target) + as_column(distractor))
        )
    )


def clean_master(
    master: DataFrame,
    keep: Column | str | None = "keeper = 1",
    group_column: str = "lang_group",
    into: Sequence[str] = ("language", "group"),
    numeric: Sequence[str] = ("total_vocab_prod", "total_concept_prod"),
) -> DataFrame:
    """Subject table with split group column, kept subjects only, numbers typed."""
    if group_column in master.columns:
        master = separate(master, group_column, into)
    if keep is not None:
        master = master.where(keep)
    return master.withColumns({c: to_number(c) for c in numeric if c in master.columns})


def attach_subjects(
    trials: DataFrame,
    master: DataFrame,
    on: str = "subject",
    keep: Column | str | None = "keeper = 1",
    trial: str | None = "trial_number",
    unique: bool = False,
    **clean,
) -> DataFrame:
    """Trials with the attributes of their (kept) subject, types repaired; `unique` refuses repeated subjects."""
    merged = merge_subjects(trials, clean_master(master, keep, **clean), on, unique=unique)
    return merged if trial is None else merged.withColumn(trial, to_number(trial).cast("int"))
