"""Factorial, repeated-measures and mixed analysis of variance.

Three reductions, each one aggregation: rows to one row per subject (its mean
at each within level), subjects to orthonormal contrast moments per between
cell, cells to effects. The contrast moments are centred sums, so nothing is
lost to cancellation and any subject or cell may be as large as it likes.
With up to one between factor the last step is column arithmetic; with more, or
with more than WIDE within levels, the type II / III comparisons of cell-mean
models are solved per `by` group from its cell rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import chain, combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions.scalars import as_column
from trialspark.functions.tails import chi2_p, f_p
from trialspark.operators.groups import clean
from trialspark.operators.joins import join_group
from trialspark.operators.ttests import fail_when, sum_squares, unlisted

EFFECT = "effect"
#: Within levels up to which a level has columns of its own; beyond, contrasts are an array and their pairs rows.
WIDE = 8


def helmert(b: int) -> list[list[float]]:
    """b - 1 orthonormal contrasts of b levels."""
    return [
        [1 / math.sqrt(k * (k + 1))] * k
        + [-k / math.sqrt(k * (k + 1))]
        + [0.0] * (b - k - 1)
        for k in range(1, b)
    ]


def subject_table(
    df: DataFrame,
    dv: str,
    wid: str,
    within: str | None,
    between: Sequence[str],
    by: Sequence[str],
    levels: Sequence,
    incomplete: str,
) -> DataFrame:
    """Per subject: between factors, overall score m and contrasts c1..cp.

    A subject without every within level, without a between factor or without an id has NULL scores and is only
    counted (rows without an id as one). A row at a level that is not listed raises.
    """
    v = clean(df, dv)
    if within is None:
        means = [F.avg(v).alias("__y0")]
        stray = F.lit(False)
    else:
        means = [
            F.avg(F.when(as_column(within) == F.lit(x), v)).alias(f"__y{i}")
            for i, x in enumerate(levels)
        ]
        stray = unlisted(as_column(within), levels)
    unit = [as_column(c) for c in [*by, wid]]
    factors = [as_column(b) for b in between]
    # one exchange: each factor's least and greatest value differ if a subject is in two cells
    guards = [F.count(F.when(stray, 1)).alias("__stray")]
    for i, b in enumerate(factors):
        guards += [F.min(b).alias(f"__least{i}"), F.max(b).alias(f"__most{i}"), F.count(F.when(b.isNull(), 1)).alias(f"__none{i}")]
    subjects = df.groupBy(*unit).agg(*means, *guards)
    subjects = fail_when(subjects, F.col("__stray") > 0, f"a level of {within} is not listed")
    missing = as_column(wid).isNull()
    two = F.lit(False)
    for i in range(len(factors)):
        two = two | F.coalesce(F.col(f"__least{i}") != F.col(f"__most{i}"), F.lit(False))
        missing = missing | (F.col(f"__none{i}") > 0)
    if between:
        subjects = fail_when(subjects, as_column(wid).isNotNull() & two, f"{' or '.join(between)} differs within one {wid}")
    subjects = subjects.withColumns({b: F.when(~missing, F.col(f"__most{i}")) for i, b in enumerate(between)})
    y = [F.col(f"__y{i}") for i in range(len(means))]
    for c in y:
        missing = missing | c.isNull()
    if incomplete == "error":
        subjects = fail_when(subjects, missing, f"a {wid} lacks a level of {within}")

    def mix(weights: Sequence[float]) -> Column:
        total = F.lit(0.0)
        for w, c in zip(weights, y, strict=True):
            if w:
                total = total + F.lit(w) * c
        return F.when(~missing, total)

    b = len(y)
    return subjects.select(
        *[as_column(k) for k in by],
        *factors,
        mix([1 / math.sqrt(b)] * b).alias("m"),
        *[mix(w).alias(f"c{k}") for k, w in enumerate(helmert(b), start=1)],
    )


def cell_table(subjects: DataFrame, between: Sequence[str], by: Sequence[str], p: int) -> DataFrame:
    """Per between cell: n, dropped, means and centred cross-products."""
    n = F.count("m")
    aggs = [
        n.alias("n"),
        (F.count(F.lit(1)) - n).alias("dropped"),
        F.avg("m").alias("m"),
        sum_squares(F.col("m")).alias("ss_m"),
    ]
    for k in range(1, p + 1):
        aggs.append(F.avg(f"c{k}").alias(f"c{k}"))
        for j in range(1, k + 1):
            cross = F.covar_samp(f"c{j}", f"c{k}") * (n - 1)
            aggs.append(F.coalesce(cross, F.lit(0.0)).alias(f"s{j}_{k}"))
    return subjects.groupBy(*[as_column(b) for b in [*by, *between]]).agg(*aggs)


def long_subject_table(
    df: DataFrame,
    dv: str,
    wid: str,
    within: str,
    between: Sequence[str],
    by: Sequence[str],
    levels: Sequence,
    incomplete: str,
) -> DataFrame:
    """As `subject_table`, with the contrasts as one array `c`: its plan does not grow with the number of levels."""
    v, b = clean(df, dv), len(levels)
    place = F.array_position(F.lit(list(levels)).cast(T.ArrayType(df.schema[within].dataType)), as_column(within))
    unit, factors = [as_column(c) for c in [*by, wid]], [as_column(f) for f in between]
    guards = [F.struct(*[g(f).alias(f"f{i}") for i, f in enumerate(factors)] or [F.lit(0).alias("f")]).alias(n) for n, g in (("__least", F.min), ("__most", F.max))]
    none = F.lit(False)
    for f in factors:
        none = none | f.isNull()
    cells = df.groupBy(*unit, place.alias("__place")).agg(F.avg(v).alias("__y"), F.count(F.when(none, 1)).alias("__none"), *guards)
    cells = fail_when(cells, F.coalesce(F.col("__place"), F.lit(0)) == 0, f"a level of {within} is not listed")
    found = F.array_sort(F.collect_list(F.when(F.col("__y").isNotNull(), F.struct("__place", "__y"))))
    sides = [F.min(F.col("__least")[f"f{i}"]).alias(f"__least{i}") for i in range(len(factors))]
    sides += [F.max(F.col("__most")[f"f{i}"]).alias(f"__most{i}") for i in range(len(factors))]
    subjects = cells.groupBy(*unit).agg(found.alias("__found"), F.sum("__none").alias("__none"), *sides)
    two = F.lit(False)
    for i in range(len(factors)):
        two = two | F.coalesce(F.col(f"__least{i}") != F.col(f"__most{i}"), F.lit(False))
    if between:
        subjects = fail_when(subjects, as_column(wid).isNotNull() & two, f"{' or '.join(between)} differs within one {wid}")
    missing = as_column(wid).isNull() | (F.col("__none") > 0)
    subjects = subjects.withColumns({f: F.when(~missing, F.col(f"__most{i}")) for i, f in enumerate(between)})
    missing = missing | (F.size("__found") < b)
    if incomplete == "error":
        subjects = fail_when(subjects, missing, f"a {wid} lacks a level of {within}")
    y = F.transform("__found", lambda r: r["__y"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    helmert_ = F.transform(
        F.sequence(F.lit(1), F.lit(b - 1)), lambda k: (total(F.slice("__all", F.lit(1), k)) - k * F.get("__all", k)) / F.sqrt(k * (k + 1))
    )
    subjects = subjects.withColumn("__all", F.when(~missing, y))
    return subjects.select(
        *[as_column(k) for k in by], *factors, F.when(~missing, total(F.col("__all")) / math.sqrt(b)).alias("m"), F.when(~missing, helmert_).alias("c")
    )


def long_cell_table(subjects: DataFrame, between: Sequence[str], by: Sequence[str]) -> DataFrame:
    """As `cell_table`, with the means of the contrasts as an array `c`, and their centred cross-products as `s` (row by
    row of the lower triangle). Each pair of contrasts is a row, aggregated within tasks first."""
    keys = [as_column(k) for k in [*by, *between]]
    n = F.count("m")
    plain = subjects.groupBy(*keys).agg(n.alias("n"), (F.count(F.lit(1)) - n).alias("dropped"), F.avg("m").alias("m"), sum_squares(F.col("m")).alias("ss_m"))
    rows = subjects.select(*keys, "c", F.posexplode("c").alias("__j", "__a"))
    rows = rows.select(*keys, "__j", "__a", F.posexplode(F.slice("c", F.lit(1), F.col("__j") + 1)).alias("__k", "__b"))
    cross = F.coalesce(F.covar_samp("__a", "__b") * (F.count(F.lit(1)) - 1), F.lit(0.0))
    pairs = rows.groupBy(*keys, "__j", "__k").agg(cross.alias("s"), F.avg("__a").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct("__j", "__k", "s", "c")))
    packed = pairs.groupBy(*keys).agg(ordered.alias("__p"))
    diagonal = F.filter("__p", lambda r: r["__j"] == r["__k"])
    packed = packed.select(*keys, F.transform(diagonal, lambda r: r["c"]).alias("c"), F.transform("__p", lambda r: r["s"]).alias("s"))
    return join_group(plain, packed, [*by, *between], "left")


def _s(j: int, k: int) -> str:
    return f"s{min(j, k)}_{max(j, k)}"


def _determinant(p: int) -> Column:
    if p == 1:
        return F.col("s1_1")
    if p == 2:
        return F.col("s1_1") * F.col("s2_2") - F.col("s1_2") * F.col("s1_2")

    @F.pandas_udf(T.DoubleType())
    def det(flat: pd.Series) -> pd.Series:
        return pd.Series([float(np.linalg.det(np.reshape(a, (p, p)))) for a in flat])

    return det(F.array(*[F.col(_s(j, k)) for j in range(1, p + 1) for k in range(1, p + 1)]))


def _effects_by_columns(
    cells: DataFrame, within: str | None, between: Sequence[str], by: Sequence[str], p: int, type: int
) -> DataFrame:
    """Effects for no or one between factor, as column arithmetic."""
    keys = [as_column(b) for b in by]
    n = F.col("n")
    scores = ["m", *[f"c{k}" for k in range(1, p + 1)]]
    grand = cells.groupBy(*keys).agg(
        *[F.try_divide(F.sum(n * F.col(s)), F.sum("n")).alias(f"g_{s}") for s in scores]
    )
    cells = join_group(cells, grand, by)
    aggs = [
        F.count(F.when(n > 0, 1)).cast("double").alias("a"),
        F.sum("n").cast("double").alias("n"),
        F.sum("dropped").alias("dropped"),
        F.sum(F.try_divide(F.lit(1.0), n)).alias("inv_n"),
        F.sum("ss_m").alias("ss_m"),
    ]
    for s in scores:
        gap = F.col(s) - F.col(f"g_{s}")
        aggs += [
            F.avg(F.when(n > 0, F.col(s))).alias(f"u_{s}"),
            F.max(f"g_{s}").alias(f"g_{s}"),
            F.sum(n * gap * gap).alias(f"b_{s}"),
        ]
    for k in range(1, p + 1):
        aggs += [F.sum(_s(j, k)).alias(_s(j, k)) for j in range(1, k + 1)]
    out = cells.groupBy(*keys).agg(*aggs).withColumn("e", F.col("n") - F.col("a"))

    def level_ss(names: Sequence[str]) -> Column:
        """Effect without the between factor: unweighted (III) or weighted (II) mean."""
        total = F.lit(0.0)
        for s in names:
            if type == 3:
                h = F.col("inv_n") / (F.col("a") * F.col("a"))
                total = total + F.try_divide(F.col(f"u_{s}") * F.col(f"u_{s}"), h)
            else:
                total = total + F.col("n") * F.col(f"g_{s}") * F.col(f"g_{s}")
        return total

    def gap_ss(names: Sequence[str]) -> Column:
        total = F.lit(0.0)
        for s in names:
            total = total + F.col(f"b_{s}")
        return total

    trace, squares = F.lit(0.0), F.lit(0.0)
    for k in range(1, p + 1):
        trace = trace + F.col(_s(k, k))
        for j in range(1, p + 1):
            squares = squares + F.col(_s(j, k)) * F.col(_s(j, k))
    contrasts = scores[1:]
    pe = F.lit(float(p)) * F.col("e")
    rows = [("(Intercept)", False, F.lit(1.0), F.col("e"), level_ss(["m"]), F.col("ss_m"))]
    if between:
        g = between[0]
        rows.append((g, False, F.col("a") - 1, F.col("e"), gap_ss(["m"]), F.col("ss_m")))
    if within is not None:
        rows.append((within, True, F.lit(float(p)), pe, level_ss(contrasts), F.col("trace")))
        if between:
            rows.append((
                f"{between[0]}:{within}", True, p * (F.col("a") - 1), pe,
                gap_ss(contrasts), F.col("trace"),
            ))
    det = _determinant(p) if p > 1 else F.lit(None).cast("double")
    return (
        out.withColumn("trace", trace)
        .withColumn("squares", squares)
        .withColumn("det", det)
        .select(
            *keys,
            F.col("n").cast("bigint").alias("n_subjects"),
            F.col("dropped").alias("n_dropped"),
            (F.col("ss_m") + F.col("trace")).alias("ss_error"),
            "e", "trace", "squares", "det",
            F.inline(F.array(*[
                F.struct(
                    F.lit(effect).alias(EFFECT),
                    F.lit(inside).alias("is_within"),
                    dfn.alias("df_n"),
                    dfd.alias("df_d"),
                    ssn.alias("ss_n"),
                    ssd.alias("ss_d"),
                )
                for effect, inside, dfn, dfd, ssn, ssd in rows
            ])),
        )
    )


def _sum_to_zero(level: np.ndarray) -> np.ndarray:
    names = np.unique(level)
    code = np.zeros((len(level), len(names) - 1))
    for k, name in enumerate(names[:-1]):
        code[level == name, k] = 1
        code[level == names[-1], k] = -1
    return code


def _scaled_determinant(s: np.ndarray, trace: float) -> float:
    """Determinant of s over its mean diagonal value: no power of a scale that could leave the range of numbers."""
    p = len(s)
    return float(np.linalg.det(s * (p / trace))) if trace > 0 else math.nan


def _factorial_effects(
    cells: pd.DataFrame, within: str | None, between: Sequence[str], p: int, type: int
) -> list[dict]:
    """Effects from the cell rows of one `by` group, any number of factors.

    An effect's sum of squares is the gain in residual of a cell-mean model
    without it over one with it: against all other terms (III), or against the
    terms that do not contain it (II).
    """
    dropped = int(cells["dropped"].sum())
    cells = cells[cells["n"] > 0]
    sizes = [cells[b].nunique() for b in between]
    if len(cells) != math.prod(sizes):
        raise ValueError("a combination of " + ", ".join(between) + " has no subject")
    codes = {b: _sum_to_zero(cells[b].to_numpy()) for b in between}
    terms = list(chain.from_iterable(combinations(between, r) for r in range(len(between) + 1)))
    design = {}
    for term in terms:
        block = np.ones((len(cells), 1))
        for b in term:
            block = np.hstack([
                block[:, [i]] * codes[b][:, [j]]
                for i, j in product(range(block.shape[1]), range(codes[b].shape[1]))
            ])
        design[term] = block
    root = np.sqrt(cells["n"].to_numpy(dtype=float))[:, None]

    def residual(use: Sequence[tuple], y: np.ndarray) -> float:
        target = root * y
        if not use:
            return float((target**2).sum())
        x = root * np.hstack([design[t] for t in use])
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        return float(((target - x @ beta) ** 2).sum())

    def effect_ss(term: tuple, y: np.ndarray) -> float:
        if type == 3:
            rest = [t for t in terms if t != term]
        else:
            rest = [t for t in terms if not set(term) <= set(t)]
        return residual(rest, y) - residual([*rest, term], y)

    e = float(cells["n"].sum() - len(cells))
    if "s" in cells:
        s = np.zeros((p, p))
        s[np.tril_indices(p)] = np.sum(cells["s"].tolist(), axis=0)
        s = s + np.tril(s, -1).T
    else:
        s = np.array([
            [cells[_s(j, k)].sum() for k in range(1, p + 1)] for j in range(1, p + 1)
        ]).reshape(p, p)
    ss_m, trace = float(cells["ss_m"].sum()), float(np.trace(s))
    shared = {
        "n_subjects": int(cells["n"].sum()),
        "n_dropped": dropped,
        "ss_error": ss_m + trace,
        "e": e,
        "trace": trace,
        "squares": float((s**2).sum()),
        "det": _scaled_determinant(s, trace) if p > 1 else None,
    }
    parts = [(False, cells[["m"]].to_numpy(dtype=float), 1, ss_m)]
    if within is not None:
        y = np.array(cells["c"].tolist(), float) if "c" in cells else cells[[f"c{k}" for k in range(1, p + 1)]].to_numpy(dtype=float)
        parts.append((True, y, p, trace))
    rows = []
    for inside, y, width, ss_d in parts:
        for term in terms:
            name = ":".join([*term, *([within] if inside else [])]) or "(Intercept)"
            rows.append(shared | {
                EFFECT: name,
                "is_within": inside,
                "df_n": float(width * design[term].shape[1]),
                "df_d": width * e,
                "ss_n": effect_ss(term, y),
                "ss_d": ss_d,
            })
    return rows


# Fixed layout of the effect rows before the finishing columns are added.
_EFFECT_FIELDS = (
    "n_subjects bigint, n_dropped bigint, ss_error double, e double, trace double, "
    "squares double, det double, effect string, is_within boolean, df_n double, "
    "df_d double, ss_n double, ss_d double"
)


def _effects_by_model(
    cells: DataFrame, within: str | None, between: Sequence[str], by: Sequence[str], p: int, type: int
) -> DataFrame:
    fields = T.StructType(
        [cells.schema[b] for b in by] + T.StructType.fromDDL(_EFFECT_FIELDS).fields
    )
    by, between = list(by), list(between)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pd.DataFrame(_factorial_effects(pdf, within, between, p, type))
        for b in by:
            rows[b] = pdf[b].iloc[0]
        return rows[fields.names]

    return cells.groupBy(*[as_column(b) for b in by]).applyInPandas(solve, fields)


def sphericity_columns(df: DataFrame, p: int, scaled: bool = False) -> DataFrame:
    """Mauchly W and the epsilon corrections of the within effects (p > 1). `scaled`: `det` is over the mean variance."""
    inside = F.col("is_within") & F.lit(p > 1)
    e, tr = F.col("e"), F.col("trace")
    gg = F.try_divide(tr * tr, p * F.col("squares"))
    hf = F.try_divide((e + 1) * p * gg - 2, p * (e - p * gg))
    w = F.nanvl("det", F.lit(None).cast("double")) if scaled else F.try_divide(F.col("det"), F.pow(tr / p, F.lit(p)))
    return df.select(
        "*",
        F.when(inside, w).alias("w"),
        F.when(inside, gg).alias("gg_eps"),
        F.when(inside, hf).alias("hf_eps"),
    )


def _mauchly_p(p: int) -> Column:
    """Chi-square approximation with its second-order term."""
    e = F.col("e")
    rho = 1 - (2 * p * p + p + 2) / (6 * p * e)
    x = F.when(F.col("w") > 0, -e * rho * F.ln("w"))
    dof = p * (p + 1) / 2 - 1
    second = ((p + 2) * (p - 1) * (p - 2) * (2 * p**3 + 6 * p * p + 3 * p + 2)) / (
        288 * (e * rho) * (e * rho)
    )
    first = chi2_p(x, F.lit(dof))
    if p == 2:
        return first
    return first + second * (chi2_p(x, F.lit(dof + 4.0)) - first)


def anova(
    df: DataFrame,
    dv: str,
    wid: str,
    within: str | None = None,
    between: Sequence[str] | str = (),
    type: int = 3,
    by: Sequence[str] = (),
    within_levels: Sequence | None = None,
    incomplete: str = "drop",
) -> DataFrame:
    """Analysis of variance, one row per effect (and `by` group).

    Sums of squares, F, p, generalized eta squared and, for within effects of
    more than two levels, sphericity and corrected p. Subjects that lack a
    within level or a between factor are left out and counted in `n_dropped`, or refused with
    `incomplete="error"`.
    """
    if type not in (2, 3):
        raise ValueError(f"type={type!r}")
    if incomplete not in ("drop", "error"):
        raise ValueError(f"incomplete={incomplete!r}")
    between = [between] if isinstance(between, str) else list(between)
    if within is None:
        levels: list = [None]
    else:
        if within_levels is None:
            raise ValueError("within needs within_levels, the levels in their order")
        levels = list(within_levels)
    p = len(levels) - 1
    if len(levels) > WIDE:
        subjects = long_subject_table(df, dv, wid, within, between, by, levels, incomplete)
        cells = long_cell_table(subjects, between, by)
    else:
        subjects = subject_table(df, dv, wid, within, between, by, levels, incomplete)
        cells = cell_table(subjects, between, by, p)
    by_columns = len(levels) <= WIDE and len(between) <= 1
    solve = _effects_by_columns if by_columns else _effects_by_model
    effects = sphericity_columns(solve(cells, within, between, by, p, type), p, scaled=not by_columns)
    effects = effects.withColumn(
        "f",
        F.try_divide(F.col("ss_n") * F.col("df_d"), F.col("ss_d") * F.col("df_n")),
    )
    gg = F.least(F.lit(1.0), F.col("gg_eps"))
    hf = F.least(F.lit(1.0), F.col("hf_eps"))
    none = F.lit(None).cast("double")
    return effects.select(
        *[as_column(b) for b in by],
        EFFECT,
        "df_n",
        "df_d",
        "ss_n",
        "ss_d",
        "f",
        f_p("f", "df_n", "df_d").alias("p"),
        F.try_divide(F.col("ss_n"), F.col("ss_n") + F.col("ss_error")).alias("ges"),
        "w",
        (_mauchly_p(p) if p > 1 else none).alias("p_w"),
        "gg_eps",
        f_p("f", F.col("df_n") * gg, F.col("df_d") * gg).alias("p_gg"),
        "hf_eps",
        f_p("f", F.col("df_n") * hf, F.col("df_d") * hf).alias("p_hf"),
        "n_subjects",
        "n_dropped",
    )
