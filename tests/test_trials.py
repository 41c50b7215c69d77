"""Quality rules and scores on the hand-made study, and driver-table pipelines."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators.columns import fill_measures, rename_regex, select_contains
from trialspark.operators.reshape import melt_range, separate, spread
from trialspark.plans import series as se
from trialspark.plans.trials import (
    EXPORT_RULES,
    attach_subjects,
    quality_filter,
    score,
    to_trials,
)

AOIS = ("Circle", "Distractor", "Target")
SAME = {
    "S01": (0.3, 0.1, 0.3),
    "S02": (0.25, 0.125, 0.125),
    "S04": (0.6, None, None),
    "S05": (0.3, 0.1, 0.3),
    "S06": (0.0, 0.4, 0.2),
}


def looks(subject, phase, n):
    if subject == "S03":
        return (0.6 if phase == "Training" or n <= 4 else 0.0, 0.0, 0.0)
    return SAME[subject]


@pytest.fixture(scope="module")
def export(spark):
    cells = [(a, p, n) for a in range(3) for p in ("Test", "Training") for n in range(1, 10)]
    names = [f"Total Fixation Duration_{p}{n}_{AOIS[a]}_Sum" for a, p, n in cells]
    data = [(s, *[looks(s, p, n)[a] for a, p, n in cells]) for s in sorted([*SAME, "S03"])]
    schema = ", ".join(["`recording.name` string", *[f"`{n}` double" for n in names]])
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def master(spark):
    data = [
        (f"S0{i}", "Bilinguals-A" if i % 2 else "Monolinguals", int(i != 5), "7 months", str(10 * i))
        for i in range(1, 7)
    ]
    return spark.createDataFrame(
        data, "subject string, lang_group string, keeper int, age_group string, total_concept_prod string"
    )


@pytest.fixture(scope="module")
def trials(export):
    return to_trials(export, "recording.name").toDF(
        "subject", "trial_type", "trial_number", "circle", "distractor", "target"
    )


MEASURES = ("circle", "distractor", "target")


def test_same_rows_as_the_steps_in_turn(export):
    wide = fill_measures(rename_regex(export, EXPORT_RULES), 0.0)
    chosen = select_contains(wide, ["recording.name"], *AOIS)
    long = separate(
        melt_range(chosen, "Test_1_Circle", "Training_9_Target"),
        "aoi", ["trial_type", "trial_number", "aoi"],
    )
    stepwise = spread(long, ["recording.name", "trial_type", "trial_number"], "aoi", "looking_time", AOIS)
    direct = to_trials(export, "recording.name")
    assert direct.columns == stepwise.columns
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, stepwise.collect()))
    assert direct.count() == 6 * 18


def test_repeated_recording_is_an_error(export):
    with pytest.raises(Exception, match="repeated key"):
        to_trials(export.union(export), "recording.name").collect()


@pytest.mark.parametrize("inclusive, kept", [
    (True, ["S01", "S02", "S04", "S05", "S06"]), (False, ["S01", "S04", "S05", "S06"]),
])
def test_quality_rules(trials, inclusive, kept):
    good = quality_filter(trials, "subject", "trial_type", MEASURES, inclusive=inclusive)
    got = good.groupBy("subject").count().collect()
    assert sorted(r["subject"] for r in got) == kept
    assert {r["count"] for r in got} == {18}
    assert {tuple(r) for r in good.select("num_good_trial", "good_baby").collect()} == {(9, 2)}


def test_scores(trials):
    scored = score(quality_filter(trials, "subject", "trial_type", MEASURES))
    cols = ["correct_anticipation", "incorrect_anticipation", "no_anticipation",
            "all_anticipation", "prop_look_correct"]
    got = {r["subject"]: tuple(r[c] for c in cols) for r in scored.collect()}
    assert got["S01"] == (1, 0, 0, 1, pytest.approx(0.75, abs=1e-12))
    assert got["S02"] == (0, 0, 0, 1, 0.5)
    assert got["S04"] == (0, 0, 1, 0, None)
    assert got["S06"] == (0, 1, 0, 1, pytest.approx(1 / 3, abs=1e-12))


@pytest.fixture(scope="module")
def merged(trials, master):
    return attach_subjects(
        score(quality_filter(trials, "subject", "trial_type", MEASURES)), master
    ).cache()


def test_merge_and_types(merged):
    assert merged.where("subject = 'S05'").count() == 0 and merged.count() == 4 * 18
    types = dict(merged.dtypes)
    assert types["trial_number"] == "int" and types["total_concept_prod"] == "double"
    got = {r["subject"]: (r["language"], r["group"]) for r in merged.collect()}
    assert got["S01"] == ("Bilinguals", "A") and got["S02"] == ("Monolinguals", None)


def test_series(merged):
    among = se.proportion(merged, "correct_anticipation", ["language"], "no_anticipation = 0")
    assert {r["language"]: r["proportion"] for r in among.collect()} == {
        "Bilinguals": 1.0, "Monolinguals": 0.0
    }
    blocks = se.block_scores(merged, "correct_anticipation", "subject", ["trial_type"])
    assert sorted({r["blocks_num"] for r in blocks.collect()}) == [1, 2, 3]
    assert blocks.count() == 4 * 2 * 3
    count = se.participant_counts(merged, ["age_group", "language"]).collect()
    assert {r["language"]: r["num_participants"] for r in count} == {
        "Bilinguals": 1, "Monolinguals": 3
    }


def test_median_split_ties_are_high(merged):
    got = se.median_split(merged, "total_concept_prod", ["language"])
    by_subject = {r["subject"]: (r["median_by_group"], r["vocab_size"]) for r in got.collect()}
    assert by_subject == {
        "S01": (10.0, "High"), "S02": (40.0, "Low"), "S04": (40.0, "High"), "S06": (40.0, "High")
    }


def test_median_split_weights(spark):
    rows = [("a", 1.0)] * 5 + [("b", 2.0), ("c", 3.0), ("d", None)]
    df = spark.createDataFrame(rows, "subject string, v double").withColumn("g", F.lit("x"))
    by_row = {r["subject"]: r["vocab_size"] for r in se.median_split(df, "v", ["g"]).collect()}
    assert by_row == {"a": "High", "b": "High", "c": "High", "d": None}
    once = se.median_split(df, "v", ["g"], per_subject="subject")
    assert {r["subject"]: r["vocab_size"] for r in once.collect()} == {
        "a": "Low", "b": "High", "c": "High", "d": None
    }


def test_figure_series(merged):
    props = se.proportion(merged, "all_anticipation", ["age_group", "language", "trial_type", "trial_number"])
    fig = se.figure_series(
        props, "trial_number", "proportion", ["language"], ["age_group", "trial_type"],
        reverse=["trial_type"], only="trial_number <= 2",
    )
    got = {(r["trial_type"], r["trial_type_order"]) for r in fig.collect()}
    assert got == {("Training", 1), ("Test", 2)}
    assert fig.count() == 2 * 2 * 2
    ordered = se.order_series(fig, "trial_type_order", "series", "x").collect()
    assert [r["x"] for r in ordered] == [1.0, 2.0] * 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_subject_is_not_gathered(spark, trials):
    """One subject with most of the rows: same answer, and no window over its rows."""
    hot = trials.unionByName(
        spark.range(20_000).select(
            F.lit("S99").alias("subject"),
            F.when(F.col("id") % 2 == 0, "Test").otherwise("Training").alias("trial_type"),
            F.col("id").cast("string").alias("trial_number"),
            *[F.lit(0.4).alias(m) for m in MEASURES],
        )
    )
    good = quality_filter(hot, "subject", "trial_type", MEASURES)
    assert good.where("subject = 'S99'").count() == 20_000
    plan = plan_of(good)
    assert "CartesianProduct" not in plan and "Python" not in plan
    lines = plan.splitlines()
    window = next(i for i, l in enumerate(lines) if "Window" in l)
    assert any("HashAggregate" in l for l in lines[window:])  # over counts, not rows


def test_wide_rows_are_not_shuffled(spark, export, tmp_path):
    export.write.parquet(str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide"))
    # the key check, in a subquery of its own, moves the key column only
    assert "Exchange" not in plan_of(to_trials(stored, "recording.name", check_key=False))
    assert to_trials(stored, "recording.name").count() == 6 * 18
