"""Registered queries: every operator applied to the driver tables.

Floating results are rounded where engines may sum in another order; p-values
have queries of their own, as SQL cannot produce them.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.functions import scalars as sc
from trialspark.operators import anova as an
from trialspark.operators import columns as co
from trialspark.operators import groups as gr
from trialspark.operators import joins as jo
from trialspark.operators import oneway as ow
from trialspark.operators import reshape as rs
from trialspark.operators import rows as ro
from trialspark.operators import trend as tr
from trialspark.operators import ttests as tt
from trialspark.plans import series as se
from trialspark.plans import trials as tl
from trialspark.plans import views as vw
from trialspark.sources import tables as src

QUERIES: dict = {}

KEY = ("subject", "trial_type", "trial_number")
CELL = ("age_group", "language", "trial_type", "trial_number")
AGES = ("20 months", "7 months")
LOOKED = "no_anticipation = 0"
OLDER = "age_group = '20 months'"
YOUNGER = "age_group = '7 months'"
OF_BUILDING = "language = 'BUILDING'"
BLOCK = 5
STATUS = ("F", "O", "P")
RULES = (*tl.EXPORT_RULES, (r"\.", "_"))
BOTH = ("age_group", "trial_type")
FIGURES = (
    se.Figure("correct", "trial_number", "correct_anticipation", ["language"], BOTH, LOOKED),
    se.Figure("incorrect", "trial_number", "incorrect_anticipation", ["language"], BOTH, LOOKED),
    se.Figure("none", "trial_number", "no_anticipation", ["language"], BOTH),
    se.Figure("all_by_age", "trial_number", "all_anticipation", ["age_group"], ["trial_type"]),
    se.Figure("older", "trial_number", "correct_anticipation", ["language", "trial_type"], (), f"{LOOKED} AND {OLDER}"),
    se.Figure("vocabulary", "total_concept_prod", "prop_look_correct", ["language"], ["age_group"]),
    se.Figure("whole", "trial_number", "prop_look_correct"),
)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _orders(spark, sf):
    return vw.table(spark, sf, "orders")


def _customer(spark, sf):
    return vw.table(spark, sf, "customer")


def _scored(spark, sf):
    return tl.score(vw.trials(spark, sf))


def _renamed(spark, sf):
    return co.rename_regex(vw.wide(spark, sf), RULES)


def _vocab(spark, sf):
    return se.median_split(vw.merged(spark, sf), "total_concept_prod", ["language"])


def _blocks(spark, sf, score="correct_anticipation"):
    return se.block_scores(
        _vocab(spark, sf),
        score,
        "subject",
        ["age_group", "language", "trial_type", "vocab_size"],
        BLOCK,
    )


def _series(spark, sf):
    return se.proportion(
        vw.merged(spark, sf),
        "correct_anticipation",
        ["language", "trial_type", "trial_number"],
        LOOKED,
    )


# ---- sources, header, projection ----


@query
def src_scan_null_token(spark: SparkSession, sf: str) -> DataFrame:
    df = src.read_table(spark, f"{sf}/orders.parquet", "parquet", null_token="P")
    return df.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query
def sink_series_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return src.stored(prop_correct(spark, sf), "series")


@query
def sink_series_csv(spark: SparkSession, sf: str) -> DataFrame:
    return src.stored(prop_correct(spark, sf), "series", "csv")


@query
def sink_many_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Seven figures of the study written in one pass over its merged table, and read back one by one."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/figures-{uuid.uuid4().hex}"
    src.write_figures(se.stacked_figures(vw.merged(spark, sf), FIGURES), path)
    back = [src.read_figure(spark, path, f.name).select("figure", "facet", "series", "x", "y", "n") for f in FIGURES]
    return rounded(reduce(DataFrame.unionByName, back), "y")


@query
def header_regex_rename(spark: SparkSession, sf: str) -> DataFrame:
    return _renamed(spark, sf)


@query
def select_contains(spark: SparkSession, sf: str) -> DataFrame:
    return co.select_contains(_renamed(spark, sf), ["recording_name"], "target", "circle")


@query
def select_column_range(spark: SparkSession, sf: str) -> DataFrame:
    df = _renamed(spark, sf)
    return df.select("recording_name", *co.column_range(df, "Test_14_Circle", "Training_3_Circle"))


@query
def drop_column(spark: SparkSession, sf: str) -> DataFrame:
    return co.drop_columns(_customer(spark, sf), "c_name", "c_acctbal")


@query
def rename_column(spark: SparkSession, sf: str) -> DataFrame:
    return co.rename_column(_customer(spark, sf), "c_mktsegment", "Language")


# ---- missing values ----


def _daily(spark, sf):
    """Value per user, day and event type; most days lack some types."""
    sums = (
        vw.table(spark, sf, "events")
        .groupBy("user_id", F.dayofmonth("ts").alias("day"), "event_type")
        .agg(vw.exact_sum(F.col("value")).alias("total"))
    )
    return rs.spread(
        sums, ["user_id", "day"], "event_type", "total", ["click", "error", "purchase", "signup", "view"]
    )


@query
def fill_null_zero(spark: SparkSession, sf: str) -> DataFrame:
    return co.fill_measures(_daily(spark, sf), 0.0, ["click", "error", "purchase", "signup", "view"])


@query
def mean_na_rm(spark: SparkSession, sf: str) -> DataFrame:
    df = gr.mean_of(_scored(spark, sf), "prop_look_correct", ["trial_type", "trial_number"])
    return rounded(df, "mean")


@query
def nan_to_null(spark: SparkSession, sf: str) -> DataFrame:
    both = F.col("target") + F.col("distractor")
    ratio = F.when(both == 0, F.lit(float("nan"))).otherwise(F.try_divide("target", both))
    return vw.trials(spark, sf).select(*KEY, sc.nan_to_null(ratio).alias("ratio"))


@query
def filter_null_semantics(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where(F.col("prop_look_correct") != 0).select(*KEY)


# ---- filters ----


@query
def filter_equality(spark: SparkSession, sf: str) -> DataFrame:
    return (
        vw.merged(spark, sf)
        .where(OLDER)
        .where("trial_type = 'Test'")
        .where(OF_BUILDING)
        .select(*KEY, "circle", "distractor", "target")
    )


@query
def filter_threshold_strict(spark: SparkSession, sf: str) -> DataFrame:
    return ro.good_trials(vw.trials(spark, sf), vw.MEASURES, 0.50, inclusive=False)


@query
def filter_threshold_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    return ro.good_trials(vw.trials(spark, sf), vw.MEASURES, 0.50)


@query
def filter_not_in(spark: SparkSession, sf: str) -> DataFrame:
    return ro.exclude_values(_customer(spark, sf), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query
def exclude_left_anti(spark: SparkSession, sf: str) -> DataFrame:
    dropped = vw.master(spark, sf).where("keeper = 0")
    return jo.exclude_subjects(vw.trials(spark, sf), dropped, "subject")


@query
def qualify_group_count(spark: SparkSession, sf: str) -> DataFrame:
    good = ro.good_trials(vw.trials(spark, sf), vw.MEASURES)
    return ro.filter_group(
        good, ["subject", "trial_type"], F.count(F.lit(1)), F.col("n") >= 10, "n"
    )


@query
def qualify_group_ndistinct(spark: SparkSession, sf: str) -> DataFrame:
    many = qualify_group_count(spark, sf)
    return ro.filter_group(
        many, ["subject"], F.count_distinct("trial_type"), F.col("good_baby") == 2, "good_baby"
    )


@query
def subset_by_level(spark: SparkSession, sf: str) -> DataFrame:
    return ro.subset_by_level(vw.merged(spark, sf), "language", "HOUSEHOLD").select(
        *KEY, "correct_anticipation"
    )


@query
def complete_subjects(spark: SparkSession, sf: str) -> DataFrame:
    df = _orders(spark, sf).withColumn("o_orderdate", F.to_date("o_orderdate"))
    return ro.complete_subjects(df, "o_custkey", "o_orderstatus")


# ---- reshape ----


@query
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return rs.melt_range(_renamed(spark, sf), "Test_1_Circle", "Training_15_Target")


@query
def separate_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = _orders(spark, sf).select(
        "o_orderkey", "o_orderpriority", F.col("o_orderpriority").alias("again")
    )
    two = rs.separate(df, "o_orderpriority", ["code", "word"])
    return rs.separate(two, "again", ["part_1", "part_2", "part_3"])


@query
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    counts = gr.count_of(vw.table(spark, sf, "events"), ["user_id", "event_type"])
    return rs.spread(
        counts,
        ["user_id"],
        "event_type",
        "n",
        ["click", "error", "purchase", "signup", "view"],
    )


@query
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return gr.duplicate_keys(vw.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- joins ----


@query
def join_inner_equi(spark: SparkSession, sf: str) -> DataFrame:
    facts = vw.trials(spark, sf).select(*KEY, F.col("target").alias("score"))
    subjects = _customer(spark, sf).select(
        F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("score"), "c_mktsegment"
    )
    return jo.merge_subjects(facts, subjects, "subject")


@query
def pair_levels(spark: SparkSession, sf: str) -> DataFrame:
    df = tt.pair_levels(vw.mixed_means(spark, sf), "score", "block", "subject", levels=STATUS)
    return rounded(df.toDF("subject", "score_f", "score_o", "score_p"),
                   "score_f", "score_o", "score_p")


@query
def attach_global_ndistinct(spark: SparkSession, sf: str) -> DataFrame:
    df = vw.merged(spark, sf).where(YOUNGER).where(OF_BUILDING)
    total = gr.ndistinct(df, "subject")
    return gr.attach_total(df.select(*KEY), total, "num_participants")


# ---- aggregates ----


@query
def agg_mean_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(gr.mean_of(vw.merged(spark, sf), "target", CELL), "mean")


@query
def agg_mean_filtered(spark: SparkSession, sf: str) -> DataFrame:
    df = gr.mean_of(vw.merged(spark, sf), "correct_anticipation", CELL, where=LOOKED)
    return rounded(df, "mean")


@query
def agg_count(spark: SparkSession, sf: str) -> DataFrame:
    return gr.count_of(vw.trials(spark, sf), ["subject", "trial_type"])


@query
def agg_participants_per_cell(spark: SparkSession, sf: str) -> DataFrame:
    return se.participant_counts(vw.merged(spark, sf), ["age_group", "language"])


@query
def agg_median(spark: SparkSession, sf: str) -> DataFrame:
    df = gr.median_of(vw.merged(spark, sf), "total_concept_prod", ["language"])
    return rounded(df, "median")


@query
def agg_median_wide_domain(spark: SparkSession, sf: str) -> DataFrame:
    lines = vw.table(spark, sf, "lineitem")
    df = gr.median_of(lines, "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return rounded(df, "median")


@query
def agg_combination_table(spark: SparkSession, sf: str) -> DataFrame:
    return gr.combination_table(
        vw.merged(spark, sf), ["age_group", "language", "group"], "subject"
    )


@query
def agg_mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["language", "trial_type", "blocks_num"]
    blocks = gr.mean_of(
        se.with_block(vw.merged(spark, sf), block_size=BLOCK),
        "correct_anticipation",
        ["subject", *keys],
        name="block_anticipation",
    )
    return rounded(gr.mean_of(blocks, "block_anticipation", keys), "mean")


@query
def agg_describe(spark: SparkSession, sf: str) -> DataFrame:
    df = gr.describe_by(vw.mixed(spark, sf), "score", ["language", "block"])
    return rounded(df, "mean", "std", digits=4)


# ---- group values on rows ----


@query
def win_group_count(spark: SparkSession, sf: str) -> DataFrame:
    return gr.with_group_count(vw.trials(spark, sf).select(*KEY), ["subject", "trial_type"])


@query
def win_group_ndistinct(spark: SparkSession, sf: str) -> DataFrame:
    return gr.with_group_ndistinct(
        vw.trials(spark, sf).select(*KEY), "trial_type", ["subject"], "good_baby"
    )


@query
def win_group_median(spark: SparkSession, sf: str) -> DataFrame:
    df = gr.with_group_median(
        vw.merged(spark, sf).select(*KEY, "language", "total_concept_prod"),
        "total_concept_prod",
        ["language"],
    )
    return rounded(df, "group_median")


@query
def win_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    df = gr.with_group_mean(
        vw.merged(spark, sf).select(*KEY, "language", "prop_look_correct"),
        "prop_look_correct",
        ["language", "trial_type"],
    )
    return rounded(df, "group_mean")


# ---- scalar rules ----


@query
def score_total_looking(spark: SparkSession, sf: str) -> DataFrame:
    return vw.trials(spark, sf).select(
        *KEY, sc.total_looking(*vw.MEASURES).alias("all_looking_time")
    )


@query
def score_ifelse_null(spark: SparkSession, sf: str) -> DataFrame:
    verdict = sc.if_else(F.col("prop_look_correct") >= 0.5, F.lit("good"), F.lit("bad"))
    return _scored(spark, sf).select(*KEY, verdict.alias("verdict"))


@query
def score_anticipation_flags(spark: SparkSession, sf: str) -> DataFrame:
    return vw.trials(spark, sf).select(
        *KEY,
        sc.correct("target", "distractor").alias("correct_anticipation"),
        sc.incorrect("target", "distractor").alias("incorrect_anticipation"),
        sc.no_anticipation("target", "distractor").alias("no_anticipation"),
    )


@query
def score_all_anticipation(spark: SparkSession, sf: str) -> DataFrame:
    return vw.trials(spark, sf).select(
        *KEY, sc.complement(sc.no_anticipation("target", "distractor")).alias("all_anticipation")
    )


@query
def score_prop_correct(spark: SparkSession, sf: str) -> DataFrame:
    ratio = sc.safe_ratio("target", F.col("target") + F.col("distractor"))
    return vw.trials(spark, sf).select(*KEY, r6(ratio).alias("prop_look_correct"))


@query
def cast_text_number(spark: SparkSession, sf: str) -> DataFrame:
    return vw.master(spark, sf).select(
        "subject",
        sc.to_number("total_concept_prod").alias("total_concept_prod"),
        sc.to_number("lang_group").alias("not_a_number"),
    )


@query
def factor_levels(spark: SparkSession, sf: str) -> DataFrame:
    return co.level_order(
        _customer(spark, sf).select("c_custkey", "c_mktsegment"), "c_mktsegment", name="level"
    )


@query
def factor_reverse(spark: SparkSession, sf: str) -> DataFrame:
    df = _orders(spark, sf).select("o_orderkey", "o_orderstatus")
    return co.level_order(df, "o_orderstatus", name="level", reverse=True)


@query
def recode_levels(spark: SparkSession, sf: str) -> DataFrame:
    phase = sc.recode("trial_type", {"Training": "Pre-switch"}, default="Post-switch")
    return vw.trials(spark, sf).select(*KEY, phase.alias("trial_type_fig"))


@query
def block_number(spark: SparkSession, sf: str) -> DataFrame:
    return vw.trials(spark, sf).select(
        *KEY,
        sc.block_number("trial_number").alias("blocks_num"),
        sc.block_number("trial_number", BLOCK).alias("blocks_of_five"),
    )


@query
def interaction_key(spark: SparkSession, sf: str) -> DataFrame:
    return _customer(spark, sf).select(
        "c_custkey", sc.interaction("c_mktsegment", "c_nationkey").alias("cell")
    )


@query
def median_split(spark: SparkSession, sf: str) -> DataFrame:
    df = _vocab(spark, sf).select(*KEY, "language", "median_by_group", "vocab_size")
    return rounded(df, "median_by_group")


@query
def median_split_per_subject(spark: SparkSession, sf: str) -> DataFrame:
    df = se.median_split(
        vw.merged(spark, sf), "total_concept_prod", ["language"], per_subject="subject"
    ).select(*KEY, "language", "median_by_group", "vocab_size")
    return rounded(df, "median_by_group")


@query
def median_split_by_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = se.with_block(vw.merged(spark, sf).where(OLDER), block_size=BLOCK)
    df = se.median_split(
        rows,
        "total_concept_prod",
        ["language", "trial_type", "blocks_num"],
        labels=("low", "high"),
    ).select(*KEY, "language", "blocks_num", "median_by_group", "vocab_size")
    return rounded(df, "median_by_group")


@query
def series_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return se.order_series(prop_correct(spark, sf), *CELL)


# ---- composites ----


@query
def trials_from_wide(spark: SparkSession, sf: str) -> DataFrame:
    return tl.to_trials(
        vw.wide(spark, sf),
        "recording_name",
        RULES,
        first="Test_1_Circle",
        last="Training_15_Target",
    )


@query
def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return vw.good(spark, sf, min_trials=10)


@query
def quality_filter_strict(spark: SparkSession, sf: str) -> DataFrame:
    return vw.good(spark, sf, inclusive=False)


@query
def anticipation_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = _scored(spark, sf).drop(*vw.MEASURES)
    return rounded(df, "prop_look_correct")


@query
def merged_trials(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(vw.merged(spark, sf), "prop_look_correct", "all_looking_time")


@query
def language_table(spark: SparkSession, sf: str) -> DataFrame:
    return gr.combination_table(
        vw.merged(spark, sf),
        ["subject", "age_group", "language", "group", "total_concept_prod"],
        "subject",
        where=f"{OLDER} AND {OF_BUILDING}",
    )


@query
def prop_correct(spark: SparkSession, sf: str) -> DataFrame:
    df = se.proportion(vw.merged(spark, sf), "correct_anticipation", CELL, LOOKED)
    return rounded(df, "proportion")


@query
def prop_incorrect(spark: SparkSession, sf: str) -> DataFrame:
    df = se.proportion(vw.merged(spark, sf), "incorrect_anticipation", CELL, LOOKED)
    return rounded(df, "proportion")


@query
def prop_none(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(se.proportion(vw.merged(spark, sf), "no_anticipation", CELL), "proportion")


@query
def prop_correct_all(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(se.proportion(vw.merged(spark, sf), "correct_anticipation", CELL), "proportion")


@query
def prop_any(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(se.proportion(vw.merged(spark, sf), "all_anticipation", CELL), "proportion")


@query
def prop_all_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = {
        "correct": ("correct_anticipation", LOOKED),
        "incorrect": ("incorrect_anticipation", LOOKED),
        "none": ("no_anticipation", None),
        "any": ("all_anticipation", None),
        "looking": ("prop_look_correct", None),
    }
    return rounded(gr.means_of(vw.merged(spark, sf), CELL, scores), *scores)


@query
def vocab_means(spark: SparkSession, sf: str) -> DataFrame:
    df = gr.mean_of(
        _vocab(spark, sf),
        "total_concept_prod",
        ["language", "vocab_size"],
        where=OLDER,
        name="mean_vocabulary",
    )
    return rounded(df, "mean_vocabulary", digits=4)


@query
def block_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_blocks(spark, sf), "block_anticipation")


@query
def block_scores_any(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_blocks(spark, sf, "all_anticipation"), "block_anticipation")


@query
def block_series(spark: SparkSession, sf: str) -> DataFrame:
    df = se.block_series(
        vw.merged(spark, sf),
        "correct_anticipation",
        ["age_group", "language", "trial_type"],
        BLOCK,
    )
    return rounded(df, "proportion")


@query
def block_series_subject(spark: SparkSession, sf: str) -> DataFrame:
    df = se.block_series_subject(
        _blocks(spark, sf).where(OLDER), ["language", "trial_type", "blocks_num", "vocab_size"]
    )
    return rounded(df, "block_anticipation", "proportion_anticipation")


@query
def vocab_trial_series(spark: SparkSession, sf: str) -> DataFrame:
    df = se.proportion(
        _vocab(spark, sf).where(OLDER),
        "correct_anticipation",
        ["language", "trial_type", "trial_number", "vocab_size"],
        name="proportion_looking",
    )
    return rounded(df, "proportion_looking")


@query
def factor_many_levels(spark: SparkSession, sf: str) -> DataFrame:
    """A factor with nearly as many levels as rows."""
    df = _orders(spark, sf).select("o_orderkey", "o_totalprice")
    return co.level_order(df, "o_totalprice", name="level", reverse=True)


@query
def figure_series(spark: SparkSession, sf: str) -> DataFrame:
    df = se.figure_series(
        prop_any(spark, sf),
        x="trial_number",
        y="proportion",
        series=["language"],
        facets=["age_group", "trial_type"],
        reverse=["age_group", "trial_type"],
        levels={"age_group": AGES, "trial_type": sorted(vw.PHASES)},
        only=YOUNGER,
    )
    return df


# ---- tests ----


@query
def t_test(spark: SparkSession, sf: str) -> DataFrame:
    df = tt.t_test(vw.mixed(spark, sf), "score", "half", by=["block"])
    return rounded(
        df.select("block", "group_1", "group_2", "n_1", "n_2", "mean_1", "mean_2", "df", "t"),
        "mean_1", "mean_2", digits=4,
    ).withColumn("t", r6("t"))


@query
def t_test_series(spark: SparkSession, sf: str) -> DataFrame:
    """Units are the trial proportions of each cell, as for a general comparison."""
    df = tt.t_test(prop_correct(spark, sf), "proportion", "age_group", by=["trial_type"])
    return rounded(
        df.select("trial_type", "group_1", "group_2", "n_1", "n_2", "mean_1", "mean_2", "df", "t"),
        "mean_1", "mean_2", digits=5,
    ).withColumn("t", F.round("t", 4))


@query
def t_test_p(spark: SparkSession, sf: str) -> DataFrame:
    return tt.t_test(vw.mixed(spark, sf), "score", "half", by=["block"])


@query
def pairwise_t(spark: SparkSession, sf: str) -> DataFrame:
    df = tt.pairwise_t(
        vw.mixed_means(spark, sf), "score", "block", "subject", STATUS, "none", by=["language"]
    )
    return rounded(
        df.select("language", "level_1", "level_2", "n", "mean_diff", "sd_diff", "df", "t"),
        "mean_diff", "sd_diff", digits=4,
    ).withColumn("t", r6("t"))


@query
def pairwise_t_p(spark: SparkSession, sf: str) -> DataFrame:
    both = [
        tt.pairwise_t(
            vw.mixed_means(spark, sf), "score", "block", "subject", STATUS, adjust, by=["language"],
        ).withColumn("adjust", F.lit(adjust))
        for adjust in ("holm", "bonferroni")
    ]
    return both[0].unionByName(both[1])


def _shares(spark, sf):
    """A number in 0..1 per nation, in families of one region."""
    nation = vw.table(spark, sf, "nation")
    below = (F.col("c_acctbal") < 0).cast("int")
    return (
        _customer(spark, sf)
        .groupBy("c_nationkey")
        .agg((F.sum(below) / F.count(F.lit(1)) / 10).alias("p"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
        .select("n_regionkey", "n_nationkey", "p")
    )


@query
def p_adjust(spark: SparkSession, sf: str) -> DataFrame:
    df = tt.p_adjust(_shares(spark, sf), "p", "holm", ["n_regionkey"], "p_holm")
    df = tt.p_adjust(df, "p", "bonferroni", ["n_regionkey"], "p_bonferroni")
    return rounded(df, "p", "p_holm", "p_bonferroni", digits=9)


@query
def p_adjust_one_family(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as one family of comparisons, with many equal values."""
    x = ((F.col("o_totalprice") * 100).cast("bigint") % 997 + 1) / F.lit(998.0)
    df = _orders(spark, sf).select("o_orderkey", (x * x * x * x).alias("p"))
    return rounded(tt.p_adjust(df, "p", "holm", name="p_holm"), "p", "p_holm", digits=9)


@query
def anova_oneway(spark: SparkSession, sf: str) -> DataFrame:
    df = ow.anova_oneway(vw.mixed(spark, sf), "score", "language", by=["block"])
    return df.select(
        "block", "df_n", "df_d",
        *[F.round(F.col(c) / 1e6, 3).alias(c) for c in ("ss_n", "ss_d", "ms_d")],
        r6("f").alias("f"),
    )


@query
def anova_oneway_p(spark: SparkSession, sf: str) -> DataFrame:
    return ow.anova_oneway(vw.mixed(spark, sf), "score", "language", by=["block"])


@query
def snk(spark: SparkSession, sf: str) -> DataFrame:
    df = ow.snk(vw.mixed(spark, sf), "score", "language", by=["block"])
    return df.select(
        "block", "level_1", "level_2", F.round("mean_diff", 4).alias("mean_diff"), "span", "df",
        F.round("se", 4).alias("se"), r6("q").alias("q"),
    )


@query
def snk_p(spark: SparkSession, sf: str) -> DataFrame:
    return ow.snk(vw.mixed(spark, sf), "score", "language", by=["block"])


@query
def snk_ungrouped(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of nations, without groups."""
    df = ow.snk(_customer(spark, sf), "c_acctbal", "c_nationkey")
    return df.select(
        "level_1", "level_2", F.round("mean_diff", 4).alias("mean_diff"), "span", "df",
        F.round("se", 4).alias("se"), r6("q").alias("q"),
    )


@query
def levene(spark: SparkSession, sf: str) -> DataFrame:
    df = ow.levene(vw.mixed(spark, sf), "score", ["language", "half"], by=["block"])
    return df.select(
        "block", "df_n", "df_d",
        *[F.round(F.col(c) / 1e6, 3).alias(c) for c in ("ss_n", "ss_d")],
        r6("f").alias("f"),
    )


def _effects(df: DataFrame, *by: str) -> DataFrame:
    return df.select(
        *by, "effect", "df_n", "df_d",
        *[F.round(F.col(c) / 1e6, 3).alias(c) for c in ("ss_n", "ss_d")],
        r6("f").alias("f"),
        r6("ges").alias("ges"),
        "n_subjects",
        "n_dropped",
    )


@query
def anova_between(spark: SparkSession, sf: str) -> DataFrame:
    return _effects(an.anova(vw.mixed_means(spark, sf, within=False), "score", "subject", between="language"))


def _sector(df: DataFrame) -> DataFrame:
    goods = {"BUILDING": "goods", "MACHINERY": "goods"}
    return df.withColumn("sector", sc.recode("language", goods, default="other"))


@query
def anova_between_two(spark: SparkSession, sf: str) -> DataFrame:
    df = _sector(vw.mixed_means(spark, sf, within=False))
    return _effects(an.anova(df, "score", "subject", between=["sector", "half"], type=2))


@query
def anova_rm(spark: SparkSession, sf: str) -> DataFrame:
    df = an.anova(
        vw.mixed_means(spark, sf), "score", "subject", "block", by=["language"], within_levels=STATUS
    )
    return _effects(df, "language")


@query
def anova_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return _effects(
        an.anova(
            vw.mixed_means(spark, sf), "score", "subject", "block", "language", within_levels=STATUS
        )
    )


@query
def anova_mixed_type2(spark: SparkSession, sf: str) -> DataFrame:
    return _effects(
        an.anova(
            vw.mixed_means(spark, sf), "score", "subject", "block", "language", type=2,
            within_levels=STATUS,
        )
    )


@query
def anova_mixed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of scored trials between age groups, per phase."""
    blocks = se.block_scores(
        vw.merged(spark, sf), "correct_anticipation", "subject", ["age_group", "trial_type"], BLOCK
    )
    df = an.anova(
        blocks, "block_anticipation", "subject", "blocks_num", "age_group", by=["trial_type"],
        within_levels=[1, 2, 3],
    )
    return df.select(
        "trial_type", "effect", "df_n", "df_d", r6("ss_n").alias("ss_n"), r6("ss_d").alias("ss_d"),
        r6("f").alias("f"), r6("ges").alias("ges"), "n_subjects", "n_dropped",
    )


@query
def anova_mixed_p(spark: SparkSession, sf: str) -> DataFrame:
    return an.anova(
        vw.mixed_means(spark, sf), "score", "subject", "block", "language", within_levels=STATUS
    )


@query
def anova_mixed_two_between(spark: SparkSession, sf: str) -> DataFrame:
    df = _sector(vw.mixed_means(spark, sf))
    return _effects(
        an.anova(df, "score", "subject", "block", ["sector", "half"], within_levels=STATUS)
    )


@query
def anova_mixed_five_by_two(spark: SparkSession, sf: str) -> DataFrame:
    return an.anova(
        vw.mixed_means(spark, sf), "score", "subject", "block", ["language", "half"],
        within_levels=STATUS,
    )


@query
def sphericity(spark: SparkSession, sf: str) -> DataFrame:
    df = an.anova(
        vw.mixed_means(spark, sf), "score", "subject", "block", "language", within_levels=STATUS
    )
    return df.where(F.col("w").isNotNull()).select(
        "effect", *[F.round(c, 8).alias(c) for c in ("w", "gg_eps", "hf_eps")]
    )


@query
def trend_lm(spark: SparkSession, sf: str) -> DataFrame:
    df = tr.trend_lines(_series(spark, sf), "trial_number", "proportion", ["language", "trial_type"])
    return rounded(
        df.select("language", "trial_type", "n", "intercept", "slope", "r2"),
        "intercept", "slope", "r2",
    )


@query
def trend_lm_band(spark: SparkSession, sf: str) -> DataFrame:
    df = tr.trend(
        _series(spark, sf), "trial_number", "proportion", ["language", "trial_type"], se=True
    )
    return df.select(
        "language", "trial_type", r6("x").alias("x"), r6("fit").alias("fit"), r6("se").alias("se"),
        "df",
    )


@query
def trend_lm_band_ci(spark: SparkSession, sf: str) -> DataFrame:
    return tr.trend(
        _series(spark, sf), "trial_number", "proportion", ["language", "trial_type"], se=True
    )


def _loess(spark: SparkSession, sf: str, se: bool) -> DataFrame:
    return tr.trend(
        _series(spark, sf),
        "trial_number",
        "proportion",
        ["language", "trial_type"],
        se=se,
        method="loess",
        grid=[float(n) for n in range(1, vw.TRIALS + 1)],
    )


@query
def trend_loess(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_loess(spark, sf, False), "fit")


@query
def trend_loess_band(spark: SparkSession, sf: str) -> DataFrame:
    df = _loess(spark, sf, True).select("language", "trial_type", "x", "fit", "se", "df")
    return rounded(df, "fit", "se", "df")


@query
def trend_loess_band_ci(spark: SparkSession, sf: str) -> DataFrame:
    return _loess(spark, sf, True)


@query
def anova_many_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty within levels: a supplier's mean price at each quantity, between halves of the suppliers."""
    lines, suppliers = vw.table(spark, sf, "lineitem"), vw.table(spark, sf, "supplier")
    means = lines.groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("quantity")).agg(F.avg("l_extendedprice").alias("price"))
    half = F.when(F.col("s_suppkey") % 3 == 0, "third").otherwise("rest").alias("half")
    df = means.join(suppliers.select("s_suppkey", half), F.col("l_suppkey") == F.col("s_suppkey"))
    out = an.anova(df, "price", "s_suppkey", "quantity", "half", within_levels=list(range(1, 51)))
    return out.select(
        "effect", "df_n", "df_d",
        *[F.round(F.col(c) / 1e6, 2).alias(c) for c in ("ss_n", "ss_d")],
        *[F.round(c, 5).alias(c) for c in ("f", "ges", "gg_eps")],
        "n_subjects", "n_dropped",
    )
