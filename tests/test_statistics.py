"""Known answers: a 7-subject unbalanced mixed design and a 3-point line."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import anova as an
from trialspark.operators.anova import (
    _effects_by_model,
    cell_table,
    subject_table,
)
from trialspark.operators.oneway import anova_oneway, levene, snk
from trialspark.operators.trend import trend, trend_lines
from trialspark.operators.ttests import p_adjust, pairwise_t, t_test

G2 = [
    ("S01", "A", (0.2, 0.4, 0.6)),
    ("S02", "A", (0.3, 0.3, 0.9)),
    ("S03", "A", (0.1, 0.5, 0.5)),
    ("S04", "B", (0.6, 0.6, 0.7)),
    ("S05", "B", (0.4, 0.8, 0.8)),
    ("S06", "B", (0.5, 0.7, 1.0)),
    ("S07", "B", (0.7, 0.6, 0.9)),
]


def anova(df, dv, wid, within=None, between=(), **rules):
    """Blocks 1 to 3 unless said otherwise."""
    return an.anova(df, dv, wid, within, between, **({"within_levels": [1, 2, 3]} | rules))


def close(x, digits=9):
    return pytest.approx(x, rel=10**-digits, abs=10**-digits)


@pytest.fixture(scope="module")
def design(spark):
    rows = [(s, g, b, y) for s, g, ys in G2 for b, y in enumerate(ys, start=1)]
    return spark.createDataFrame(rows, "subject string, grp string, block int, y double").cache()


def effects(df):
    return {r["effect"]: r for r in df.collect()}


def check_golden(got):
    assert got["(Intercept)"]["ss_n"] == close(6.380992063492)
    assert got["grp"]["ss_n"] == close(0.373373015873)
    assert got["grp"]["ss_d"] == close(0.051388888889)
    assert (got["grp"]["df_n"], got["grp"]["df_d"]) == (1, 5)
    assert got["grp"]["f"] == close(36.328185328185)
    assert got["block"]["ss_n"] == close(0.507698412698)
    assert got["block"]["ss_d"] == close(0.202777777778)
    assert (got["block"]["df_n"], got["block"]["df_d"]) == (2, 10)
    assert got["grp:block"]["ss_n"] == close(0.023888888889)
    assert got["block"]["w"] == close(0.853353349597)
    assert got["block"]["gg_eps"] == close(0.872108246815)
    assert got["block"]["hf_eps"] == close(1.300040212321)
    assert got["grp"]["gg_eps"] is None


def test_mixed_design(design):
    got = effects(anova(design, "y", "subject", "block", "grp"))
    check_golden(got)
    assert got["grp"]["p"] == close(0.001809011495)
    assert got["block"]["f"] == close(12.518590998043)
    assert got["block"]["p"] == close(0.001893887400)
    assert got["grp:block"]["f"] == close(0.589041095890)
    assert got["grp:block"]["p"] == close(0.573011722645)
    assert got["grp"]["ges"] == close(0.594979132414)
    assert got["block"]["ges"] == close(0.666388874421)
    assert got["grp:block"]["ges"] == close(0.085914085914)
    assert got["block"]["p_gg"] == close(0.003272243328)
    assert got["grp:block"]["p_gg"] == close(0.553705852645)
    assert got["block"]["p_hf"] == close(got["block"]["p"])
    assert got["block"]["n_subjects"] == 7 and got["block"]["n_dropped"] == 0


def test_type_two(design):
    got = effects(anova(design, "y", "subject", "block", "grp", type=2))
    assert got["block"]["ss_n"] == close(0.486666666667)
    assert got["grp"]["ss_n"] == close(0.373373015873)


@pytest.mark.parametrize("type", [2, 3])
def test_cell_models_agree_with_column_arithmetic(design, type):
    subjects = subject_table(design, "y", "subject", "block", ["grp"], [], [1, 2, 3], "error")
    cells = cell_table(subjects, ["grp"], [], 2)
    by_model = effects(_effects_by_model(cells, "block", ["grp"], [], 2, type))
    by_columns = effects(anova(design, "y", "subject", "block", "grp", type=type))
    for name, r in by_columns.items():
        for c in ("df_n", "df_d", "ss_n", "ss_d", "n_subjects"):
            assert by_model[name][c] == close(r[c])


def test_repeated_measures_per_group(design):
    got = anova(design, "y", "subject", "block", by=["grp"])
    rows = {(r["grp"], r["effect"]): r for r in got.collect()}
    assert len(rows) == 4
    a = effects(anova(design.where("grp = 'A'"), "y", "subject", "block"))
    assert rows[("A", "block")]["f"] == close(a["block"]["f"])
    # deviations of the three subjects of A by hand
    assert a["block"]["ss_n"] == close(3 * sum((m - 0.42222222222222) ** 2 for m in (0.2, 0.4, 2 / 3)))


def test_between_only_equals_oneway_on_subject_means(design):
    got = effects(anova(design, "y", "subject", between="grp"))
    means = design.groupBy("subject", "grp").agg(F.avg("y").alias("y"))
    one = anova_oneway(means, "y", "grp").first()
    assert got["grp"]["f"] == close(one["f"]) and got["grp"]["f"] == close(36.328185328185)
    assert got["grp"]["ss_n"] == close(one["ss_n"])


def two_by_two(spark, cells):
    rows = [
        (f"s{i}{j}{k}", a, b, y)
        for i, (a, b, ys) in enumerate(cells)
        for j in [0]
        for k, y in enumerate(ys)
    ]
    return spark.createDataFrame(rows, "subject string, a string, b string, y double")


def test_two_between_factors_balanced(spark):
    cells = [
        ("a1", "b1", (1.0, 3.0)),
        ("a1", "b2", (2.0, 4.0)),
        ("a2", "b1", (5.0, 7.0)),
        ("a2", "b2", (10.0, 12.0)),
    ]
    df = two_by_two(spark, cells)
    third = effects(anova(df, "y", "subject", between=["a", "b"], type=3))
    second = effects(anova(df, "y", "subject", between=["a", "b"], type=2))
    # cell means 2 3 / 6 11, two subjects each
    assert third["a"]["ss_n"] == close(72.0)
    assert third["b"]["ss_n"] == close(18.0)
    assert third["a:b"]["ss_n"] == close(8.0)
    assert third["a"]["ss_d"] == close(8.0)
    for e in ("a", "b", "a:b"):
        assert second[e]["ss_n"] == close(third[e]["ss_n"])


def test_two_between_factors_unbalanced(spark):
    cells = [
        ("a1", "b1", (1.0, 3.0, 2.0)),
        ("a1", "b2", (2.0, 4.0)),
        ("a2", "b1", (5.0, 7.0)),
        ("a2", "b2", (10.0, 12.0, 11.0, 15.0)),
    ]
    got = effects(anova(two_by_two(spark, cells), "y", "subject", between=["a", "b"], type=3))
    # contrast form of one-degree effects: (sum w m)^2 / sum w^2 / n
    means, n = (2.0, 3.0, 6.0, 12.0), (3, 2, 2, 4)
    for effect, w in (("a", (1, 1, -1, -1)), ("b", (1, -1, 1, -1)), ("a:b", (1, -1, -1, 1))):
        top = sum(x * m for x, m in zip(w, means)) ** 2
        assert got[effect]["ss_n"] == close(top / sum(1 / k for k in n))


def test_empty_cell_is_an_error(spark):
    df = two_by_two(spark, [("a1", "b1", (1.0, 2.0)), ("a1", "b2", (1.0, 2.0)), ("a2", "b1", (1.0, 3.0))])
    with pytest.raises(Exception, match="no subject"):
        anova(df, "y", "subject", between=["a", "b"]).collect()


def test_mixed_two_between_reduces_when_second_factor_is_balanced(design):
    subjects = design.withColumn(
        "half", F.when(F.col("subject").isin("S01", "S02", "S04", "S05"), "x").otherwise("y")
    )
    got = effects(anova(subjects, "y", "subject", "block", ["grp", "half"]))
    assert set(got) == {
        "(Intercept)", "grp", "half", "grp:half",
        "block", "grp:block", "half:block", "grp:half:block",
    }
    # cells hold 2, 1, 2, 2 subjects
    assert got["block"]["df_d"] == 2 * 3 and got["grp"]["df_d"] == 3
    m = {r["subject"]: r["m"] * 3**0.5 for r in
         design.groupBy("subject").agg(F.avg("y").alias("m")).collect()}
    cell = [
        ([m["S01"], m["S02"]], 1, 1), ([m["S03"]], 1, -1),
        ([m["S04"], m["S05"]], -1, 1), ([m["S06"], m["S07"]], -1, -1),
    ]
    top = sum(w * sum(v) / len(v) for v, w, _ in cell) ** 2
    assert got["grp"]["ss_n"] == close(top / sum(1 / len(v) for v, _, _ in cell))


def test_incomplete_subjects(spark, design):
    extra = spark.createDataFrame([("S08", "A", 1, 0.9)], design.schema)
    got = effects(anova(design.unionByName(extra), "y", "subject", "block", "grp"))
    check_golden(got)
    assert got["block"]["n_dropped"] == 1
    with pytest.raises(Exception, match="lacks a level"):
        anova(
            design.unionByName(extra), "y", "subject", "block", "grp", incomplete="error"
        ).collect()


def test_subject_in_two_groups_is_an_error(spark, design):
    extra = spark.createDataFrame([("S01", "B", 1, 0.9)], design.schema)
    with pytest.raises(Exception, match="differs within"):
        anova(design.unionByName(extra), "y", "subject", "block", "grp").collect()


def test_four_levels_determinant(spark):
    rows = [
        (f"s{i}", b, float((i * 7 + b * b * 3 + i * b) % 11)) for i in range(8) for b in range(4)
    ]
    df = spark.createDataFrame(rows, "subject string, block int, y double")
    r = effects(anova(df, "y", "subject", "block", within_levels=range(4)))["block"]
    assert 0 < r["w"] < 1 and 1 / 3 <= r["gg_eps"] <= 1 and 0 < r["p_w"] < 1


def test_t_test(design):
    means = design.groupBy("subject", "grp").agg(F.avg("y").alias("y"))
    r = t_test(means, "y", "grp").first()
    assert (r["group_1"], r["group_2"]) == ("A", "B")
    assert r["mean_1"] == close(0.422222222222) and r["mean_2"] == close(0.691666666667)
    assert r["t"] == close(-6.027286730212) and r["df"] == 5
    assert r["p"] == close(0.001809011495)
    assert r["ci_low"] < r["mean_diff"] < r["ci_high"] < 0
    f = anova_oneway(means, "y", "grp").first()
    assert r["t"] ** 2 == close(f["f"]) and r["p"] == close(f["p"])
    with pytest.raises(Exception, match="exactly 2 levels"):
        t_test(design, "y", "block").collect()


def test_pairwise(design):
    want = {
        (1, 2): (2.091290026731, 0.081452828201, 0.244358484604, 0.081452828201),
        (1, 3): (5.765925913446, 0.001187255926, 0.003561767777, 0.003561767777),
        (2, 3): (2.679711003789, 0.036550232156, 0.109650696468, 0.073100464312),
    }
    for adjust, at in (("bonferroni", 2), ("holm", 3)):
        got = pairwise_t(design, "y", "block", "subject", [1, 2, 3], adjust).collect()
        assert len(got) == 3
        for r in got:
            w = want[(r["level_1"], r["level_2"])]
            assert r["t"] == close(w[0]) and r["df"] == 6
            assert r["p"] == close(w[1]) and r["p_adj"] == close(w[at])


def test_adjustment_skips_missing_p(spark):
    df = spark.createDataFrame([(0.01,), (None,), (0.04,)], "p double")
    got = {r["p"]: r["p_adj"] for r in p_adjust(df).collect()}
    assert got[0.01] == close(0.02) and got[0.04] == close(0.04) and got[None] is None


def test_levene_and_oneway(design):
    r = levene(design.where("block = 3"), "y", "grp").first()
    assert (r["df_n"], r["df_d"]) == (1, 5)
    assert r["f"] == close(1.098901098901) and r["p"] == close(0.342512308451)
    r = anova_oneway(design.where("block = 1"), "y", "grp").first()
    assert r["f"] == close(15.0) and r["ms_d"] == close(0.014)
    assert r["p"] == close(0.011724811004)


def test_snk(design):
    # two levels: the same p as the F test
    r = snk(design.where("block = 1"), "y", "grp").first()
    assert r["p"] == close(0.011724811004, 6)
    assert r["mean_diff"] == close(0.35) and r["ci_low"] > 0
    rows = snk(design, "y", "block", by=["grp"]).collect()
    assert len(rows) == 6
    assert sorted(r["span"] for r in rows if r["grp"] == "A") == [2, 2, 3]


def test_trend(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0)], "x int, y double")
    r = trend_lines(df, "x", "y").first()
    assert r["slope"] == close(0.5) and r["intercept"] == close(2 / 3)
    assert (r["sxx"], r["sxy"], r["syy"]) == (close(2.0), close(1.0), close(2 / 3))
    assert r["r2"] == close(0.75)
    pts = trend(df, "x", "y", se=True, grid=[2.0]).first()
    # residual variance 1/6, se at the mean sqrt(1/18), t quantile at df 1 = 12.7062047362
    assert pts["fit"] == close(5 / 3) and pts["se"] == close((1 / 18) ** 0.5)
    assert pts["upper"] - pts["fit"] == close(12.7062047361747 * (1 / 18) ** 0.5)
    drawn = trend(df, "x", "y").collect()
    assert len(drawn) == 80 and drawn[0]["x"] == 1.0 and drawn[-1]["x"] == 3.0


def loess_by_hand(points, x0, span):
    import numpy as np

    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    d = np.abs(x - x0)
    h = np.sort(d)[max(int(len(x) * span + 1e-5), 1) - 1]
    w = np.clip(1 - np.minimum(d / h, 1) ** 3, 0, None) ** 3
    keep = w > 0
    a = np.vander(x[keep] - x0, 3, increasing=True) * np.sqrt(w[keep])[:, None]
    return np.linalg.lstsq(a, y[keep] * np.sqrt(w[keep]), rcond=None)[0][0]


def test_local_smoother(spark):
    points = [(float(x), (x * x * 7 % 13) / 10) for x in range(1, 12)] + [(4.0, 0.3), (4.0, 0.9)]
    df = spark.createDataFrame(points, "x double, y double")
    grid = [1.0, 2.5, 4.0, 8.25, 11.0]
    got = {r["x"]: r["fit"] for r in trend(df, "x", "y", method="loess", grid=grid).collect()}
    for x0 in grid:
        assert got[x0] == close(loess_by_hand(points, x0, 0.75), 8)
    # a quadratic is reproduced, per series
    df = spark.createDataFrame(
        [(s, float(x), s + x * x * 0.5) for s in (1, 2) for x in range(9)], "s int, x double, y double"
    )
    for r in trend(df, "x", "y", by=["s"], method="loess").collect():
        assert r["fit"] == close(r["s"] + r["x"] ** 2 * 0.5, 8)


def band_by_hand(points, places, span):
    """fit, se and df from the operator matrix of single rows."""
    import numpy as np

    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points])

    def row(x0):
        d = np.abs(x - x0)
        h = np.sort(d)[max(int(len(x) * span + 1e-5), 1) - 1]
        w = np.clip(1 - np.minimum(d / h, 1) ** 3, 0, None) ** 3
        a = np.vander(x - x0, 3, increasing=True)
        return (np.linalg.pinv(a * np.sqrt(w)[:, None]) * np.sqrt(w))[0]

    left = np.eye(len(x)) - np.array([row(v) for v in x])
    square = left @ left.T
    variance = ((left @ y) ** 2).sum() / np.trace(square)
    dof = np.trace(square) ** 2 / np.trace(square @ square)
    return {x0: (row(x0) @ y, np.sqrt(variance * (row(x0) ** 2).sum()), dof) for x0 in places}


def test_band_of_the_local_smoother(spark):
    """Uneven x with ties, in rows of any order."""
    points = [(x**1.5, (x * x * 7 % 13) / 10) for x in range(1, 14)] + [(8.0, 0.3), (8.0, 0.9), (1.0, 0.2)]
    df = spark.createDataFrame(points[::-1], "x double, y double").repartition(3)
    grid = [1.0, 2.5, 8.0, 20.25, 46.0]
    got = {r["x"]: r for r in trend(df, "x", "y", method="loess", se=True, grid=grid).collect()}
    for x0, (fit, se, dof) in band_by_hand(points, grid, 0.75).items():
        r = got[x0]
        assert r["fit"] == close(fit, 8) and r["se"] == close(se, 8) and r["df"] == close(dof, 8)
        assert r["lower"] < r["fit"] < r["upper"] and r["upper"] - r["fit"] == close(r["fit"] - r["lower"], 8)


def test_band_of_many_places(spark, monkeypatch):
    """Traces on merged places come near those of all."""
    from trialspark.operators import trend as module

    df = spark.range(400).select((F.col("id") / 7.0).alias("x"), (F.sin(F.col("id") / 60.0) + (F.col("id") * 37 % 11) / 10.0).alias("y"), F.lit(None).cast("int").alias("s"))
    whole = trend(df, "x", "y", by=["s"], method="loess", se=True, n_grid=9).collect()
    monkeypatch.setattr(module, "BAND_PLACES", 50)
    for a, b in zip(whole, trend(df, "x", "y", by=["s"], method="loess", se=True, n_grid=9).collect()):
        assert a["s"] is None and a["fit"] == close(b["fit"], 12)
        assert abs(a["se"] / b["se"] - 1) < 0.02 and abs(a["df"] / b["df"] - 1) < 0.02


def test_local_smoother_moves_little(spark, tmp_path):
    """At most six exchanges, no row for each pair of point and place."""
    path = str(tmp_path / "points")
    spark.range(100).select((F.col("id") % 2).alias("s"), (F.col("id") * 1.0).alias("x"), (F.col("id") * 1.0).alias("y")).write.parquet(path)
    plan = trend(spark.read.parquet(path), "x", "y", by=["s"], method="loess")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 6 and "Generate" not in plan


def test_result_does_not_depend_on_row_order_or_partitions(design):
    want = effects(anova(design, "y", "subject", "block", "grp"))
    shuffled = design.orderBy(F.desc("y")).repartition(5, "block")
    got = effects(anova(shuffled, "y", "subject", "block", "grp"))
    for name, r in want.items():
        assert got[name]["ss_n"] == close(r["ss_n"], 12) and got[name]["ss_d"] == close(r["ss_d"], 12)


def many_levels(spark, b, groups):
    import numpy as np

    rng = np.random.default_rng(b)
    y = {(g, i): rng.normal(size=b) + 0.02 * np.arange(b) * (1 + k) + rng.normal() for k, (g, n) in enumerate(groups.items()) for i in range(n)}
    rows = [(f"{g}{i}", g, k, float(v)) for (g, i), ys in y.items() for k, v in enumerate(ys)]
    return y, spark.createDataFrame(rows, "subject string, grp string, block int, y double").repartition(4)


@pytest.mark.parametrize("levels", [9, 60])
def test_anova_with_many_within_levels(spark, levels):
    """Against sums over the table of subjects by levels; groups of different size."""
    import numpy as np

    sizes = {"a": 70, "b": 80}
    y, df = many_levels(spark, levels, sizes)
    df = df.union(spark.createDataFrame([("half", "a", 0, 1.0)], df.schema))
    got = effects(anova(df, "y", "subject", "block", "grp", within_levels=list(range(levels))))
    part = {g: np.array([v for (h, _), v in y.items() if h == g]) for g in sizes}
    centred = {g: x - x.mean(1, keepdims=True) for g, x in part.items()}
    error = sum(((x - x.mean(0)) ** 2).sum() for x in centred.values())
    between = sum(levels * ((x.mean(1) - x.mean()) ** 2).sum() for x in part.values())
    gaps = np.array([x.mean(0) for x in centred.values()])
    harmonic = len(sizes) ** 2 / sum(1 / n for n in sizes.values())
    within = harmonic * (gaps.mean(0) ** 2).sum()  # unweighted means, type III
    weights = np.array(list(sizes.values()))[:, None]
    both = (weights * (gaps - (weights * gaps).sum(0) / weights.sum()) ** 2).sum()
    e = sum(sizes.values()) - 2
    row = got["block"]
    assert row["ss_d"] == close(error, 8) and row["ss_n"] == close(within, 8) and row["df_d"] == e * (levels - 1)
    assert got["grp:block"]["ss_n"] == close(both, 8) and got["grp"]["ss_d"] == close(between, 8)
    assert row["n_dropped"] == 1 and row["n_subjects"] == 150
    cov = sum((x - x.mean(0)).T @ (x - x.mean(0)) for x in centred.values())
    assert row["gg_eps"] == close(np.trace(cov) ** 2 / ((levels - 1) * (cov**2).sum()), 8)
    eigen = np.linalg.eigvalsh(cov)[1:]
    assert row["w"] == pytest.approx(np.exp(np.log(eigen / eigen.mean()).sum()), rel=1e-6)


def test_long_contrasts_agree_with_columns(spark, design, monkeypatch):
    from trialspark.operators import anova as module

    for between in ([], ["grp"]):
        for type_ in (2, 3):
            want = effects(anova(design, "y", "subject", "block", between, type=type_, within_levels=[1, 2, 3]))
            monkeypatch.setattr(module, "WIDE", 2)
            got = effects(anova(design, "y", "subject", "block", between, type=type_, within_levels=[1, 2, 3]))
            monkeypatch.undo()
            assert got.keys() == want.keys()
            for name, r in want.items():
                assert all(got[name][c] == close(v, 8) if isinstance(v, float) else got[name][c] == v for c, v in r.asDict().items())


def test_plan_does_not_grow_with_levels(spark):
    def size(b):
        df = spark.range(1).selectExpr("id AS subject", "cast(id AS int) AS block", "1.0D AS y")
        return len(anova(df, "y", "subject", "block", within_levels=list(range(b)))._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert size(20) == size(200)


def test_long_design_refuses_unlisted_levels_and_two_groups(spark):
    y, df = many_levels(spark, 9, {"a": 3, "b": 3})
    with pytest.raises(Exception, match="is not listed"):
        anova(df, "y", "subject", "block", "grp", within_levels=list(range(1, 10))).collect()
    with pytest.raises(Exception, match="differs within one"):
        anova(df.withColumn("grp", F.when(F.col("block") == 1, "z").otherwise(F.col("grp"))), "y", "subject", "block", "grp", within_levels=list(range(9))).collect()
    with pytest.raises(Exception, match="lacks a level"):
        anova(df, "y", "subject", "block", "grp", within_levels=list(range(10)), incomplete="error").collect()


def test_a_million_p_values(spark):
    """One family, many ties, a few nulls: the plain step-down formula, and no task that holds it."""
    import numpy as np

    df = spark.range(1_000_000).select("id", F.when(F.col("id") % 1000 == 7, None).otherwise(F.pow((F.xxhash64("id") % 30011 + 30011) / 60022.0, F.lit(6))).alias("p"))
    out = p_adjust(df, adjust="holm")
    for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
        assert "Window [" not in line or "__share" in line
    got = out.toPandas()
    known = got[got["p"].notna()].sort_values("p")
    plain = np.minimum(1, np.maximum.accumulate((len(known) - np.arange(len(known))) * known["p"].to_numpy()))
    # rows of one value share the largest step of theirs
    plain = np.maximum.reduceat(plain, np.flatnonzero(np.r_[True, np.diff(known["p"]) > 0]))[np.cumsum(np.r_[False, np.diff(known["p"]) > 0])]
    assert len(got) == 1_000_000 and got["p_adj"].isna().sum() == 1000
    assert np.allclose(known["p_adj"], plain, rtol=1e-12)


def test_families_of_any_number_and_size(spark):
    """Many small families and a hot one, a NULL family among them."""
    import pandas as pd

    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") < 12, None).otherwise(F.col("id") % 5000).cast("int").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 99_700.0).alias("p")
    )
    got = p_adjust(rows, adjust="holm", by=["g"]).toPandas()
    assert len(got) == 30_000
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values("p", kind="stable").reset_index(drop=True)
        upto = ((len(part) - pd.Series(range(len(part)))) * part["p"]).cummax().clip(upper=1)
        want = upto.groupby(part["p"]).transform("max")
        assert (abs(part["p_adj"] - want) < 1e-12).all()


def test_snk_makes_its_cells_once(spark, tmp_path, monkeypatch):
    """The table is read once, for the cells that are stored; small blocks give the same pairs, without a constant key."""
    from trialspark.operators import oneway as module

    path = str(tmp_path / "values")
    spark.range(400).selectExpr("id % 40 AS g", "if(id % 3 = 0, null, id % 2) AS b", "cast(id * id % 17 + id % 40 AS double) AS v").write.parquet(path)
    def rounded(df):
        return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())

    for by in ([], ["b"]):
        want = rounded(snk(spark.read.parquet(path), "v", "g", by=by))
        assert len(want) > 700
        monkeypatch.setattr(module, "BLOCK", 3)
        out = snk(spark.read.parquet(path), "v", "g", by=by)
        monkeypatch.undo()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "values" not in plan and "xxhash64" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
        assert rounded(out) == want


def test_holm_never_exceeds_bonferroni(spark):
    ps = [0.5, 0.001, 0.02, 0.02, 0.9, 0.049]
    df = spark.createDataFrame([(p, g) for p in ps for g in "ab"], "p double, g string")
    both = p_adjust(p_adjust(df, adjust="holm", by=["g"], name="holm"), adjust="bonferroni", by=["g"], name="bonf")
    rows = sorted(both.where("g = 'a'").collect(), key=lambda r: r["p"])
    assert all(r["p"] <= r["holm"] <= r["bonf"] for r in rows)
    assert [r["holm"] for r in rows] == sorted(r["holm"] for r in rows)
    assert rows[0]["holm"] == close(0.006) and rows[0]["bonf"] == close(0.006)
    assert rows[3]["holm"] == close(0.049 * 3)


def test_unlisted_levels_and_missing_factors(spark, design):
    """What has no place raises or is counted, it does not vanish."""
    with pytest.raises(Exception, match="is not listed"):
        anova(design, "y", "subject", "block", "grp", within_levels=[1, 2]).collect()
    with pytest.raises(Exception, match="is not listed"):
        pairwise_t(design, "y", "block", "subject", [1, 2]).collect()
    assert len(pairwise_t(design, "y", "block", "subject", [1, 2], on_unlisted="drop").collect()) == 1
    with pytest.raises(ValueError, match="within_levels"):
        an.anova(design, "y", "subject", "block")
    extra = spark.createDataFrame([(s, g, b, 0.5) for s, g in (("S08", None), ("S09", None), (None, "A")) for b in (1, 2, 3)], design.schema)
    got = effects(anova(design.unionByName(extra), "y", "subject", "block", "grp"))
    check_golden(got)
    assert got["block"]["n_dropped"] == 3 and got["block"]["n_subjects"] == 7
    with pytest.raises(Exception, match="lacks a level"):
        anova(design.unionByName(extra), "y", "subject", "block", "grp", incomplete="error").collect()


def test_no_single_task_over_cells(design):
    for df in (anova_oneway(design, "y", "grp"), snk(design, "y", "grp"), anova(design, "y", "subject", "block", "grp")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "collect_list" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
