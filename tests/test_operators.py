"""Small hand-made tables: missing values, ties, boundaries, repeated keys."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialspark.functions import scalars as sc
from trialspark.operators import columns as co
from trialspark.operators import groups as gr
from trialspark.operators import joins as jo
from trialspark.operators import quantiles as qu
from trialspark.operators import reshape as rs
from trialspark.operators import rows as ro
from trialspark.plans.series import median_split

SLOW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
NAN = float("nan")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v or 0) for v in r])


def one(spark, column, **values):
    names = list(values)
    types = {bool: "boolean", int: "int", float: "double", str: "string", type(None): "double"}
    schema = ", ".join(f"{n} {types[type(values[n])]}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_conditionals_keep_missing(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 1.0), (None, 1.0), (0.0, 0.0)], "t double, d double")
    got = df.select(
        sc.correct("t", "d"), sc.incorrect("t", "d"), sc.no_anticipation("t", "d"),
        sc.complement(sc.no_anticipation("t", "d")), sc.safe_ratio("t", F.col("t") + F.col("d")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (1, 0, 0, 1, 2 / 3), (0, 0, 0, 1, 0.5), (None,) * 5, (0, 0, 1, 0, None)
    ]


def test_scalar_rules(spark):
    assert one(spark, sc.to_number("x"), x=" 1.5 ") == 1.5
    assert one(spark, sc.to_number("x"), x="n/a") is None
    assert one(spark, sc.to_number("x"), x="NaN") is None
    assert one(spark, sc.nan_to_null("x"), x=NAN) is None
    assert [one(spark, sc.block_number("n"), n=n) for n in (1, 3, 4, 6, 7, 9, 0, -3)] == [
        1, 1, 2, 2, 3, 3, 0, -1
    ]
    assert one(spark, sc.recode("p", {"Training": "Pre"}, "Post"), p="Training") == "Pre"
    assert one(spark, sc.recode("p", {"Training": "Pre"}, "Post"), p="Test") == "Post"
    assert one(spark, sc.recode("p", {"1": "a"}, "b"), p=None) is None
    assert one(spark, sc.interaction("a", "b"), a="x", b=3) == "x.3"
    assert one(spark, sc.interaction("a", "b"), a="x", b=None) is None
    assert one(spark, sc.high_low("v", "m"), v=2.0, m=2.0) == "High"
    assert one(spark, sc.high_low("v", "m"), v=1.0, m=2.0) == "Low"
    assert one(spark, sc.high_low("v", "m"), v=None, m=2.0) is None
    assert one(spark, sc.level_index("v", ["a", "b"]), v="c") is None
    assert one(spark, sc.reverse_levels(sc.level_index("v", ["a", "b", "c"]), 3), v="a") == 3


def test_header_rules_are_ordered(spark):
    df = spark.createDataFrame([(1, 2)], "`Total Fixation Duration_Test1_Circle_Sum` int, k int")
    rules = [("Total Fixation Duration_Test", "Test"), ("Circle_Sum", "Circle"), ("Test", "Test_")]
    assert co.rename_regex(df, rules).columns == ["Test_1_Circle", "k"]
    with pytest.raises(ValueError, match="repeated"):
        co.rename_regex(df, [(".*", "x")])


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "aCircle int, b int, target int, circle2 int")
    assert co.select_contains(df, ["b"], "Circle", "Target").columns == [
        "b", "aCircle", "circle2", "target"
    ]
    assert co.select_contains(df, ["b"], "Circle", ignore_case=False).columns == ["b", "aCircle"]
    assert co.column_range(df, "b", "circle2") == ["b", "target", "circle2"]
    with pytest.raises(ValueError):
        co.column_range(df, "target", "b")
    assert co.drop_columns(df, "b").columns == ["aCircle", "target", "circle2"]
    assert co.rename_column(df, "b", "c").columns[1] == "c"
    with pytest.raises(ValueError):
        co.rename_column(df, "none", "c")


def test_fill_leaves_text_alone(spark):
    df = spark.createDataFrame([(None, NAN, None), ("k", 1.0, 2)], "key string, x double, n int")
    assert rows(co.fill_measures(df)) == [("k", 1.0, 2), (None, 0.0, 0)]
    dotted = spark.createDataFrame([(None,)], "`a.b` double")
    assert rows(co.fill_measures(dotted)) == [(0.0,)]


def test_factor_levels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "f string")
    assert rows(co.level_order(df, "f")) == [("a", 1), ("b", 2), (None, None)]
    assert rows(co.level_order(df, "f", reverse=True)) == [("a", 2), ("b", 1), (None, None)]
    assert rows(co.level_order(df, "f", ["b", "a", "c"])) == [("a", 2), ("b", 1), (None, None)]
    assert rows(co.level_order(df, "f", ["b"])) == [("a", None), ("b", 1), (None, None)]


def test_threshold_boundary(spark):
    df = spark.createDataFrame([(0.25, 0.25), (0.5, None), (0.3, 0.3)], "a double, b double")
    assert ro.good_trials(df, ["a", "b"], 0.5).count() == 2
    assert ro.good_trials(df, ["a", "b"], 0.5, inclusive=False).count() == 1


def test_exclusion_drops_missing(spark):
    df = spark.createDataFrame([("S01",), ("S02",), (None,)], "s string")
    assert rows(ro.exclude_values(df, "s", ["S01"])) == [("S02",)]
    assert rows(jo.exclude_subjects(df, df.where("s = 'S01'"), "s")) == [("S02",), (None,)]


def test_group_filter_and_complete_subjects(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 1), (None, 2)], "s string, w int"
    )
    got = ro.filter_group(df, ["s"], F.count_distinct("w"), F.col("k") == 2, "k")
    assert rows(got) == [("a", 1, 2), ("a", 2, 2), (None, 1, 2), (None, 2, 2)]
    assert rows(ro.complete_subjects(df, "s", "w")) == [("a", 1), ("a", 2)]
    assert ro.complete_subjects(df, "s", "w", levels=[1]).count() == 4
    assert ro.complete_subjects(df, "s", "w", levels=[1, 2, 3]).count() == 0


def test_separate(spark):
    df = spark.createDataFrame(
        [("Bilinguals-A",), ("Monolinguals",), ("a_b.c",), (None,), ("é–x",)], "g string"
    )
    got = [tuple(r) for r in rs.separate(df, "g", ["language", "group"]).collect()]
    assert got == [("Bilinguals", "A"), ("Monolinguals", None), ("a", "b"), (None, None), ("é", "x")]


def test_spread_guards_repeated_keys(spark):
    df = spark.createDataFrame(
        [("k", "x", 1.0), ("k", "y", None), ("l", "y", 3.0)], "k string, n string, v double"
    )
    assert rows(rs.spread(df, ["k"], "n", "v", ["x", "y"])) == [("k", 1.0, None), ("l", None, 3.0)]
    twice = df.union(spark.createDataFrame([("k", "y", None)], df.schema))
    with pytest.raises(Exception, match="repeated key"):
        rs.spread(twice, ["k"], "n", "v", ["x", "y"]).collect()
    assert rs.spread(twice, ["k"], "n", "v", ["x", "y"], on_duplicate="max").count() == 2
    many = spark.range(1).select(
        F.lit("k").alias("k"), F.explode(F.array(*[F.lit(f"c{i}") for i in range(130)])).alias("n"),
        F.lit(1).alias("v"),
    )
    assert len(rs.spread(many, ["k"], "n", "v", [f"c{i}" for i in range(130)]).columns) == 131
    with pytest.raises(Exception, match="repeated key"):
        rs.spread(many.union(many.where("n = 'c125'")), ["k"], "n", "v", [f"c{i}" for i in range(130)]).collect()


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert gr.assert_unique(df, ["k", "v"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        gr.assert_unique(df, ["k"]).collect()
    assert rows(gr.duplicate_keys(df, ["k"])) == [(1, 2)]


def test_merge_suffixes_and_missing_keys(spark):
    a = spark.createDataFrame([("s", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("s", 3), (None, 4)], "k string, v int")
    got = jo.merge_subjects(a, b, "k")
    assert got.columns == ["k", "v_x", "v_y"] and rows(got) == [("s", 1, 3)]
    assert rows(jo.merge_subjects(a, b, "k", null_safe=True)) == [("s", 1, 3), (None, 2, 4)]


def test_missing_in_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("a", NAN), ("b", NAN), (None, 2.0)], "g string, v double"
    )
    assert rows(gr.mean_of(df, "v", ["g"])) == [("a", 1.0), ("b", None), (None, 2.0)]
    assert rows(gr.median_of(df, "v", ["g"])) == [("a", 1.0), ("b", None), (None, 2.0)]
    assert rows(gr.count_of(df, ["g"])) == [("a", 3), ("b", 1), (None, 1)]
    assert rows(gr.ndistinct(df, "g")) == [(3,)]
    assert rows(gr.ndistinct(df, "g", count_null=False)) == [(2,)]
    got = gr.means_of(df, ["g"], {"m": ("v", "v > 1"), "n": ("v", None)})
    assert rows(got) == [("a", None, 1.0), ("b", None, None), (None, 2.0, 2.0)]


def test_group_values_on_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), (None, 3.0)], "g string, v double")
    assert rows(gr.with_group_count(df, ["g"])) == [("a", 1.0, 2), ("a", 4.0, 2), (None, 3.0, 1)]
    assert rows(gr.with_group_mean(df, "v", ["g"])) == [
        ("a", 1.0, 2.5), ("a", 4.0, 2.5), (None, 3.0, 3.0)
    ]
    assert rows(gr.with_group_median(df, "v", ["g"])) == rows(gr.with_group_mean(df, "v", ["g"]))
    assert rows(gr.with_group_median(df, "v", [])) == [
        ("a", 1.0, 3.0), ("a", 4.0, 3.0), (None, 3.0, 3.0)
    ]
    assert {r[2] for r in rows(gr.with_group_ndistinct(df, "v", ["g"]))} == {1, 2}
    total = gr.ndistinct(df, "v", name="n")
    assert {r[2] for r in rows(gr.attach_total(df, total, "total"))} == {3}


def exact_median(values):
    values, n = sorted(values), len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-4, 4)), min_size=1, max_size=30))
def test_median_property(spark, pairs):
    df = spark.createDataFrame([(g, float(v)) for g, v in pairs], "g string, v double").repartition(3)
    got = dict(rows(gr.median_of(df, "v", ["g"])))
    for g in {g for g, _ in pairs}:
        assert got[g] == exact_median([float(v) for h, v in pairs if h == g])


@pytest.mark.parametrize("steps", [1, 1 << 16])
def test_median_survives_poor_buckets(spark, monkeypatch, steps):
    """Ranks are found whatever a bucket holds, in hot and in tied groups, of either sign and any size."""
    monkeypatch.setattr(qu, "STEPS", steps)
    df = spark.range(3001).select(
        F.when(F.col("id") < 2000, "hot").otherwise("rest").alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 1009).cast("double")).alias("v"),
    )
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e-300, 1.7e308, -1.7e308, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, -1.0, 2.0**60, 2.0**60 + 256]
    more = [(f"odd{k}", odd[j]) for k in range(len(odd)) for j in range(len(odd)) if j != k]
    df = df.union(spark.createDataFrame(more, "g string, v double"))
    want = df.groupBy("g").agg(F.median("v"))
    assert rows(gr.median_of(df, "v", ["g"])) == rows(want)
    assert rows(gr.median_of(df, "v")) == rows(df.agg(F.median("v")))


def planned(df):
    """Numbers of exchanges and scans in the planned tree."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line for line in plan.splitlines()), sum("FileScan" in line or "Scan " in line for line in plan.splitlines())


def test_median_split_has_a_small_plan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).cast("double").alias("v")).write.parquet(path)
    df = median_split(spark.read.parquet(path), "v", ["g"])
    exchanges, scans = planned(df)
    assert exchanges <= 8 and scans <= 3
    assert df.where("vocab_size IS NOT NULL").count() == 1000


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.none() | st.integers(-3, 3)), min_size=1, max_size=20))
def test_median_skips_missing_values(spark, pairs):
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in pairs], "g string, v double").repartition(3)
    assert rows(gr.median_of(df, "v", ["g"])) == rows(df.groupBy("g").agg(F.median("v")))
    assert rows(gr.median_of(df, "v")) == rows(df.agg(F.median("v")))


def test_no_rank_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    for k in (0, 3):
        assert rows(qu.group_kth(df, "v", ["g"], F.lit(k), "k")) == [("a", None), ("b", None)]


def test_many_levels_are_numbered_over_tasks(spark):
    df = spark.range(200_000).select(F.format_string("l%06d", (F.col("id") * 7919) % 200_000).alias("f"), "id").union(spark.createDataFrame([(None, -1)], "f string, id long"))
    for reverse in (False, True):
        out = co.level_order(df, "f", reverse=reverse)
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        number = F.substring("f", 2, 6).cast("int")
        want = F.when(F.col("f").isNotNull(), 200_000 - number if reverse else number + 1)
        assert out.where(~F.col("f_level").eqNullSafe(want)).count() == 0 and out.count() == 200_001


def test_figures_of_one_pass(spark, tmp_path):
    from trialspark.plans.series import Figure, stacked_figures
    from trialspark.sources.tables import read_figure, write_figures

    df = spark.createDataFrame([("a", 1, 2.0, 0), ("a", 1, 4.0, 1), ("b", 2, NAN, 0), (None, 2, 1.0, 0)], "g string, t int, v double, k int")
    figures = [Figure("all", "t", "v", ["g"]), Figure("some", "t", "v", ["g"], ["k"], "k = 0"), Figure("flat", "k", "t")]
    out = stacked_figures(df, figures)
    assert rows(out.where("figure = 'all'").drop("figure")) == [(None, "a", 1.0, 3.0, 2), (None, "b", 2.0, None, 0), (None, None, 2.0, 1.0, 1)]
    assert rows(out.where("figure = 'some'").drop("figure")) == [("0", "a", 1.0, 2.0, 1), ("0", "b", 2.0, None, 0), ("0", None, 2.0, 1.0, 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    path = str(tmp_path / "figures")
    write_figures(out, path)
    write_figures(stacked_figures(df, [Figure("flat", "t", "k")]), path)  # the others stay
    assert rows(read_figure(spark, path, "flat").select("x", "y")) == [(1.0, 0.5), (2.0, 0.0)]
    assert read_figure(spark, path, "all").count() == 3
    with pytest.raises(ValueError, match="repeated"):
        stacked_figures(df, [figures[0], figures[0]])


@SLOW
@given(st.dictionaries(st.integers(0, 9), st.lists(st.none() | st.integers(0, 5), min_size=3, max_size=3)))
def test_long_and_wide_are_inverse(spark, table):
    data = [(k, *v) for k, v in table.items()]
    df = spark.createDataFrame(data, "k int, x int, y int, z int")
    long = rs.melt_range(df, "x", "z")
    assert long.count() == 3 * len(data)
    assert rows(rs.spread(long, ["k"], "aoi", "looking_time", ["x", "y", "z"])) == rows(df)


def test_sketches_are_offered(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    for r in gr.median_of(df, "v", ["g"], exact=False).collect():
        assert abs(r["median"] - 500) < 5
    for r in gr.ndistinct(df, "v", ["g"], exact=False).collect():
        assert abs(r["n_distinct"] - 500) < 50


def test_median_of_many_groups_is_lazy(spark):
    df = spark.range(60).select((F.col("id") % 20).alias("g"), F.col("id").cast("double").alias("v"))
    want = rows(df.groupBy("g").agg(F.median("v")))
    assert rows(gr.median_of(df, "v", ["g"])) == want
    got = gr.with_group_median(df, "v", ["g"])
    assert {(r["g"], r["group_median"]) for r in got.collect()} == set(want)


def test_median_keeps_large_whole_numbers(spark):
    big = 2**53
    df = spark.createDataFrame([("a", big + 1), ("a", big + 1), ("a", big + 3), ("b", None)], "g string, v bigint")
    got = qu.group_kth(df, "v", ["g"], F.lit(1), "k").collect()
    assert {r["g"] for r in got} == {"a", "b"}
    assert rows(gr.median_of(df, "v", ["g"])) == [("a", float(big + 1)), ("b", None)]


def test_median_orders_no_whole_group(spark):
    """Windows run over buckets and over the last bucket: values are exchanged by (group, value) first."""
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    plan = gr.median_of(df, "v", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "__bucket" in line or "__which" in line
    assert "collect" not in plan


def test_kth_with_weights_in_a_hot_group(spark):
    df = spark.range(500).select(F.lit("a").alias("g"), (F.col("id") % 50).cast("double").alias("v"), F.when(F.col("id") % 50 == 7, 1000).otherwise(1).alias("w"))
    expanded = sorted(v for v in range(50) for _ in range(10 * (1000 if v == 7 else 1)))
    for k in (1, 60, 70, 71, 5000, len(expanded)):
        got = qu.group_kth(df, "v", ["g"], F.lit(k), "k", F.col("w")).first()
        assert got["k"] == expanded[k - 1]


def test_unlisted_level_raises(spark):
    df = spark.createDataFrame([("k", "x", 1.0), ("k", "y", 2.0), ("l", None, 3.0)], "k string, n string, v double")
    with pytest.raises(Exception, match="not listed"):
        rs.spread(df.where("n IS NOT NULL"), ["k"], "n", "v", ["x"]).collect()
    with pytest.raises(Exception, match="not listed"):
        rs.spread(df, ["k"], "n", "v", ["x", "y"]).collect()
    assert rows(rs.spread(df, ["k"], "n", "v", ["x"], on_unlisted="drop")) == [("k", 1.0), ("l", None)]


def test_repeated_subject_is_refused_on_request(spark):
    facts = spark.createDataFrame([("s", 1)], "s string, v int")
    twice = spark.createDataFrame([("s", "a"), ("s", "b")], "s string, g string")
    assert jo.merge_subjects(facts, twice, "s").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        jo.merge_subjects(facts, twice, "s", unique=True).collect()
