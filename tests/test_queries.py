"""Every registered query beside its SQL, at the smallest scale."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from trialspark.plans.oracles import ORACLES
from trialspark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
REPORTS = {
    "t_test_p", "pairwise_t_p", "anova_oneway_p", "snk_p", "anova_mixed_p",
    "anova_mixed_five_by_two", "trend_lm_band_ci", "trend_loess_band_ci",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry():
    assert set(ORACLES) == set(QUERIES) - REPORTS


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_p_values(spark, name):
    df = entry.queries()[name](spark, SF)
    ps = [c for c in df.columns if c.startswith("p")]
    rows = df.collect()
    assert rows and all(r[c] is None or 0 <= r[c] <= 1 for r in rows for c in ps)


@pytest.mark.parametrize("name", ["quality_filter", "merged_trials", "median_split", "levene"])
def test_equal_when_nothing_is_broadcast(spark, con, name):
    """The shuffled route of the same query."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == ""
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "proportion" in df.columns
