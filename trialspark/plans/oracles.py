"""DuckDB SQL with the same answer as each registered query, written apart from it."""

from __future__ import annotations

KEY = "subject, trial_type, trial_number"
CELL = "age_group, language, trial_type, trial_number"
LOOK = "coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type IN ({0})), 0)"
MEASURES = ("circle", "distractor", "target")

TRIALS = f"""trials AS (
  SELECT user_id AS subject,
         CASE WHEN day(ts) <= 15 THEN 'Training' ELSE 'Test' END AS trial_type,
         CAST((day(ts) - 1) % 15 + 1 AS INTEGER) AS trial_number,
         CAST({LOOK.format("'view', 'signup'")} AS DOUBLE) AS circle,
         CAST({LOOK.format("'error'")} AS DOUBLE) AS distractor,
         CAST({LOOK.format("'click', 'purchase'")} AS DOUBLE) AS target
  FROM events GROUP BY ALL)"""

SCORES = """
  CASE WHEN target > distractor THEN 1 ELSE 0 END AS correct_anticipation,
  CASE WHEN distractor > target THEN 1 ELSE 0 END AS incorrect_anticipation,
  CASE WHEN target + distractor = 0 THEN 1 ELSE 0 END AS no_anticipation,
  CASE WHEN target + distractor = 0 THEN 0 ELSE 1 END AS all_anticipation,
  target / nullif(target + distractor, 0) AS prop_look_correct"""

SCORED = f"{TRIALS}, scored AS (SELECT *, {SCORES} FROM trials)"


def good(op: str = ">=", min_trials: int = 5) -> str:
    return f"""{TRIALS},
good_trials AS (
  SELECT *, circle + distractor + target AS all_looking_time FROM trials
  WHERE circle + distractor + target {op} CAST(0.5 AS DOUBLE)),
counted AS (
  SELECT *, count(*) OVER (PARTITION BY subject, trial_type) AS num_good_trial FROM good_trials
  QUALIFY num_good_trial >= {min_trials}),
good AS (
  SELECT *, count(DISTINCT trial_type) OVER (PARTITION BY subject) AS good_baby FROM counted
  QUALIFY good_baby = 2)"""


MASTER = """master AS (
  SELECT c_custkey AS subject,
         c_mktsegment AS language,
         CAST(c_nationkey AS VARCHAR) AS "group",
         CASE WHEN c_nationkey % 2 = 0 THEN '7 months' ELSE '20 months' END AS age_group,
         CASE WHEN c_acctbal < 9000 THEN c_acctbal END AS total_concept_prod,
         1 AS keeper
  FROM customer WHERE c_acctbal > 0)"""

MERGED = f"""{good()}, {MASTER},
merged AS (SELECT good.*, {SCORES}, master.* EXCLUDE (subject)
           FROM good JOIN master USING (subject))"""

VOCAB = f"""{MERGED},
vocab AS (
  SELECT *, CASE WHEN median_by_group > total_concept_prod THEN 'Low'
                 WHEN median_by_group <= total_concept_prod THEN 'High' END AS vocab_size
  FROM (SELECT *, median(total_concept_prod) OVER (PARTITION BY language) AS median_by_group
        FROM merged))"""

FIVE = "CAST(floor((trial_number + 4) / 5) AS INTEGER) AS blocks_num"


def blocks(score: str) -> str:
    return f"""{VOCAB},
blocks AS (
  SELECT subject, age_group, language, trial_type, vocab_size, {FIVE},
         avg({score}) AS block_anticipation
  FROM vocab GROUP BY ALL)"""


SERIES = f"""{MERGED},
series AS (
  SELECT language, trial_type, trial_number, avg(correct_anticipation) AS proportion
  FROM merged WHERE no_anticipation = 0 GROUP BY ALL)"""

MIXED = """mixed AS (
  SELECT o_custkey AS subject, o_orderstatus AS block, c_mktsegment AS language,
         CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS half,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'goods' ELSE 'other' END AS sector,
         o_totalprice AS score
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def wide_columns(names: str) -> list[tuple[str, str]]:
    """(expression, name) of the wide table, areas first, then phase, then trial."""
    return [
        (
            f"max({aoi}) FILTER (WHERE trial_type = '{phase}' AND trial_number = {n})",
            names.format(aoi=aoi.capitalize(), phase=phase, n=n),
        )
        for aoi in MEASURES
        for phase in ("Test", "Training")
        for n in range(1, 16)
    ]


RENAMED = "{phase}_{n}_{aoi}"


def wide(keep) -> str:
    cols = [(e, n) for e, n in wide_columns(RENAMED) if keep(n)]
    listed = ",\n  ".join(f'{e} AS "{n}"' for e, n in cols)
    return f"WITH {TRIALS} SELECT subject AS recording_name,\n  {listed}\nFROM trials GROUP BY subject"


def in_range(first: str, last: str):
    names = [n for _, n in wide_columns(RENAMED)]
    kept = set(names[names.index(first) : names.index(last) + 1])
    return lambda n: n in kept


def proportion(score: str, where: str = "TRUE") -> str:
    return f"""WITH {MERGED}
SELECT {CELL}, round(avg({score}), 6) AS proportion FROM merged WHERE {where} GROUP BY ALL"""


LOOKED = "no_anticipation = 0"
DAILY = ", ".join(
    f"coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = '{e}') AS DOUBLE), 0)"
    f" AS {e}"
    for e in ("click", "error", "purchase", "signup", "view")
)

TWO_GROUPS = """
  SELECT {by}, a.g AS group_1, b.g AS group_2, a.n AS n_1, b.n AS n_2,
         round(a.m, {d}) AS mean_1, round(b.m, {d}) AS mean_2,
         CAST(a.n + b.n - 2 AS DOUBLE) AS df,
         round((a.m - b.m) / sqrt((a.ss + b.ss) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)), {t}) AS t
  FROM cells a JOIN cells b USING ({by}) WHERE a.g < b.g"""

ONE_WAY = """
cells AS (
  SELECT block, {level} AS level, count({v}) AS n, avg({v}) AS m,
         var_samp({v}) * (count({v}) - 1) AS ss FROM {source} GROUP BY ALL),
grand AS (SELECT block, sum(n * m) / sum(n) AS g FROM cells GROUP BY block),
sums AS (
  SELECT block, count(*) - 1 AS df_n, sum(n) - count(*) AS df_d,
         sum(n * (m - g) * (m - g)) AS ss_n, sum(ss) AS ss_d
  FROM cells JOIN grand USING (block) GROUP BY block)"""


def contrasts(cell: str) -> str:
    """Subject means per status, and their contrast moments per cell."""
    keys = f"{cell}, " if cell else ""
    return f"""
seen AS (
  SELECT subject, {keys}avg(score) FILTER (WHERE block = 'F') AS f,
         avg(score) FILTER (WHERE block = 'O') AS o, avg(score) FILTER (WHERE block = 'P') AS p
  FROM mixed GROUP BY ALL),
scores AS (
  SELECT {keys}(f + o + p) / sqrt(3.0) AS m, (f - o) / sqrt(2.0) AS c1,
         (f + o - 2 * p) / sqrt(6.0) AS c2
  FROM seen WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL),
short AS (SELECT {keys}count(*) AS dropped FROM seen
          WHERE f IS NULL OR o IS NULL OR p IS NULL GROUP BY ALL),
cells AS (
  SELECT {keys}CAST(count(*) AS DOUBLE) AS n, avg(m) AS m, avg(c1) AS c1, avg(c2) AS c2,
         var_samp(m) * (count(*) - 1) AS sm, var_samp(c1) * (count(*) - 1) AS s11,
         var_samp(c2) * (count(*) - 1) AS s22, covar_samp(c1, c2) * (count(*) - 1) AS s12
  FROM scores GROUP BY ALL)"""


def effect_rows(rows: list[tuple[str, str, str, str, str]], source: str, lead: str = "") -> str:
    """rows: effect, df_n, df_d, ss_n, ss_d as SQL over `source`."""
    parts = [
        f"SELECT {lead}'{e}' AS effect, CAST({dn} AS DOUBLE) AS df_n, CAST({dd} AS DOUBLE) AS df_d,"
        f" {sn} AS sn, {sd} AS sd, error, total, dropped FROM {source}"
        for e, dn, dd, sn, sd in rows
    ]
    return f"""
SELECT {lead}effect, df_n, df_d, round(sn / 1e6, 3) AS ss_n, round(sd / 1e6, 3) AS ss_d,
       round(sn * df_d / (sd * df_n), 6) AS f, round(sn / (sn + error), 6) AS ges,
       CAST(total AS BIGINT) AS n_subjects, CAST(dropped AS BIGINT) AS n_dropped
FROM ({' UNION ALL '.join(parts)})"""


TOTALS = """
total AS (
  SELECT count(*) AS a, sum(n) AS total, sum(n * m) / sum(n) AS gm, sum(n * c1) / sum(n) AS g1,
         sum(n * c2) / sum(n) AS g2, avg(m) AS um, avg(c1) AS u1, avg(c2) AS u2,
         sum(1 / n) / (count(*) * count(*)) AS h, sum(sm) AS sm, sum(s11) AS s11,
         sum(s22) AS s22, sum(s12) AS s12
  FROM cells),
sums AS (
  SELECT total.*, total.total - total.a AS e, total.sm + total.s11 + total.s22 AS error,
         total.s11 + total.s22 AS trace,
         (SELECT sum(n * (cells.m - gm) * (cells.m - gm)) FROM cells, total) AS bm,
         (SELECT sum(n * ((cells.c1 - g1) * (cells.c1 - g1) + (cells.c2 - g2) * (cells.c2 - g2)))
          FROM cells, total) AS bc,
         coalesce((SELECT sum(dropped) FROM short), 0) AS dropped
  FROM total)"""


def mixed_rows(type: int, between: str = "language", within: str = "block"):
    if type == 3:
        intercept, inside = "um * um / h", "(u1 * u1 + u2 * u2) / h"
    else:
        intercept, inside = "total * gm * gm", "total * (g1 * g1 + g2 * g2)"
    return [
        ("(Intercept)", "1", "e", intercept, "sm"),
        (between, "a - 1", "e", "bm", "sm"),
        (within, "2", "2 * e", inside, "trace"),
        (f"{between}:{within}", "2 * (a - 1)", "2 * e", "bc", "trace"),
    ]


def signed(x: str, a: bool, b: bool) -> str:
    """Sum of 2 x 2 cell means with the signs of an effect."""
    sign = [f"CASE WHEN sector = 'goods' THEN 1 ELSE -1 END"] * a
    sign += [f"CASE WHEN half = 'even' THEN 1 ELSE -1 END"] * b
    return f"sum({' * '.join([*sign, x])})"


def two_between() -> str:
    sides = {"(Intercept)": (0, 0), "sector": (1, 0), "half": (0, 1), "sector:half": (1, 1)}
    cols, rows = [], []
    for i, (name, (a, b)) in enumerate(sides.items()):
        m, c1, c2 = (signed(x, a, b) for x in ("m", "c1", "c2"))
        cols.append(f"{m} * {m} / sum(1 / n) AS m_{i}")
        cols.append(f"({c1} * {c1} + {c2} * {c2}) / sum(1 / n) AS c_{i}")
        rows.append((name, "1", "e", f"m_{i}", "sm"))
        inside = "block" if i == 0 else f"{name}:block"
        rows.append((inside, "2", "2 * e", f"c_{i}", "trace"))
    return f"""WITH {MIXED}, {contrasts('sector, half')},
sums AS (
  SELECT {', '.join(cols)}, sum(n) AS total, sum(n) - count(*) AS e, sum(sm) AS sm,
         sum(s11 + s22) AS trace, sum(sm + s11 + s22) AS error,
         coalesce((SELECT sum(dropped) FROM short), 0) AS dropped
  FROM cells)""" + effect_rows(rows, "sums")


def between_two() -> str:
    """Type II of a 2 x 2 design: strata differences weighted by their precision."""

    def adjusted(factor: str, first: str, stratum: str) -> str:
        return f"""(SELECT sum(w * d) * sum(w * d) / sum(w) FROM (
    SELECT 1 / sum(1 / n) AS w, sum(CASE WHEN {factor} = '{first}' THEN m ELSE -m END) AS d
    FROM cells GROUP BY {stratum}))"""

    rows = [
        ("(Intercept)", "1", "e", "total * gm * gm", "sm"),
        ("sector", "1", "e", "ss_a", "sm"),
        ("half", "1", "e", "ss_b", "sm"),
        ("sector:half", "1", "e", "ss_ab", "sm"),
    ]
    cross = signed("m", True, True)
    return f"""WITH {MIXED},
seen AS (SELECT subject, sector, half, avg(score) AS m FROM mixed GROUP BY ALL),
cells AS (SELECT sector, half, CAST(count(*) AS DOUBLE) AS n, avg(m) AS m,
                 var_samp(m) * (count(*) - 1) AS sm FROM seen GROUP BY ALL),
sums AS (
  SELECT sum(n) AS total, sum(n) - count(*) AS e, sum(sm) AS sm, sum(sm) AS error, 0 AS dropped,
         sum(n * m) / sum(n) AS gm, {cross} * {cross} / sum(1 / n) AS ss_ab,
         {adjusted('sector', 'goods', 'half')} AS ss_a,
         {adjusted('half', 'even', 'sector')} AS ss_b
  FROM cells)""" + effect_rows(rows, "sums")


BETWEEN = f"""WITH {MIXED},
seen AS (SELECT subject, language, avg(score) AS m FROM mixed GROUP BY ALL),
cells AS (SELECT language, CAST(count(*) AS DOUBLE) AS n, avg(m) AS m,
                 var_samp(m) * (count(*) - 1) AS sm FROM seen GROUP BY ALL),
total AS (SELECT count(*) AS a, sum(n) AS total, sum(n * m) / sum(n) AS gm, avg(m) AS um,
                 sum(1 / n) / (count(*) * count(*)) AS h, sum(sm) AS sm FROM cells),
sums AS (SELECT *, total - a AS e, sm AS error, 0 AS dropped,
                (SELECT sum(n * (cells.m - gm) * (cells.m - gm)) FROM cells, total) AS bm
         FROM total)""" + effect_rows(
    [("(Intercept)", "1", "e", "um * um / h", "sm"), ("language", "a - 1", "e", "bm", "sm")],
    "sums",
)

REPEATED = f"""WITH {MIXED}, {contrasts('language')},
sums AS (
  SELECT cells.*, n AS total, n - 1 AS e, s11 + s22 AS trace, sm + s11 + s22 AS error,
         coalesce(dropped, 0) AS dropped
  FROM cells LEFT JOIN short USING (language))""" + effect_rows(
    [
        ("(Intercept)", "1", "e", "n * m * m", "sm"),
        ("block", "2", "2 * e", "n * (c1 * c1 + c2 * c2)", "trace"),
    ],
    "sums",
    "language, ",
)

BLOCK_ROWS = [
    (e, dn, dd, sn, sd)
    for e, dn, dd, sn, sd in mixed_rows(3, "age_group", "blocks_num")
]
ANOVA_BLOCKS = f"""WITH {MERGED},
means AS (
  SELECT subject, age_group, trial_type, {FIVE}, avg(correct_anticipation) AS y
  FROM merged GROUP BY ALL),
seen AS (
  SELECT subject, age_group, trial_type, max(y) FILTER (WHERE blocks_num = 1) AS f,
         max(y) FILTER (WHERE blocks_num = 2) AS o, max(y) FILTER (WHERE blocks_num = 3) AS p
  FROM means GROUP BY ALL),
scores AS (
  SELECT trial_type, age_group, (f + o + p) / sqrt(3.0) AS m, (f - o) / sqrt(2.0) AS c1,
         (f + o - 2 * p) / sqrt(6.0) AS c2
  FROM seen WHERE f IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL),
short AS (SELECT trial_type, count(*) AS dropped FROM seen
          WHERE f IS NULL OR o IS NULL OR p IS NULL GROUP BY ALL),
cells AS (
  SELECT trial_type, age_group, CAST(count(*) AS DOUBLE) AS n, avg(m) AS m, avg(c1) AS c1,
         avg(c2) AS c2, var_samp(m) * (count(*) - 1) AS sm,
         var_samp(c1) * (count(*) - 1) AS s11, var_samp(c2) * (count(*) - 1) AS s22
  FROM scores GROUP BY ALL),
total AS (
  SELECT trial_type, count(*) AS a, sum(n) AS total, sum(n * m) / sum(n) AS gm,
         sum(n * c1) / sum(n) AS g1, sum(n * c2) / sum(n) AS g2, avg(m) AS um, avg(c1) AS u1,
         avg(c2) AS u2, sum(1 / n) / (count(*) * count(*)) AS h, sum(sm) AS sm,
         sum(s11 + s22) AS trace
  FROM cells GROUP BY trial_type),
gaps AS (
  SELECT trial_type, sum(n * (cells.m - gm) * (cells.m - gm)) AS bm,
         sum(n * ((cells.c1 - g1) * (cells.c1 - g1) + (cells.c2 - g2) * (cells.c2 - g2))) AS bc
  FROM cells JOIN total USING (trial_type) GROUP BY trial_type),
sums AS (
  SELECT total.*, bm, bc, total - a AS e, sm + trace AS error, coalesce(dropped, 0) AS dropped
  FROM total JOIN gaps USING (trial_type) LEFT JOIN short USING (trial_type))""" + effect_rows(
    BLOCK_ROWS, "sums", "trial_type, "
).replace(" / 1e6, 3)", ", 6)")

SPHERICITY = f"""WITH {MIXED}, {contrasts('language')}, {TOTALS},
eps AS (
  SELECT (s11 * s22 - s12 * s12) / (trace * trace / 4) AS w,
         trace * trace / (2 * (s11 * s11 + 2 * s12 * s12 + s22 * s22)) AS gg, e FROM sums)
SELECT effect, round(w, 8) AS w, round(gg, 8) AS gg_eps,
       round(((e + 1) * 2 * gg - 2) / (2 * (e - 2 * gg)), 8) AS hf_eps
FROM eps, (VALUES ('block'), ('language:block')) names(effect)"""

LINES = """
lines AS (
  SELECT language, trial_type, count(*) AS n, avg(trial_number) AS xm, min(trial_number) AS lo,
         max(trial_number) AS hi, regr_sxx(proportion, trial_number) AS sxx,
         regr_sxy(proportion, trial_number) AS sxy, regr_syy(proportion, trial_number) AS syy,
         regr_slope(proportion, trial_number) AS slope,
         regr_intercept(proportion, trial_number) AS intercept
  FROM series GROUP BY ALL)"""

LOESS = f"""WITH {SERIES},
places AS (SELECT language, trial_type, CAST(unnest(range(1, 16)) AS DOUBLE) AS x
           FROM (SELECT DISTINCT language, trial_type FROM series)),
near AS (
  SELECT language, trial_type, x, trial_number - x AS gap, abs(trial_number - x) AS d, proportion,
         row_number() OVER (PARTITION BY language, trial_type, x ORDER BY abs(trial_number - x)) AS r,
         count(*) OVER (PARTITION BY language, trial_type, x) AS n
  FROM series JOIN places USING (language, trial_type)),
width AS (SELECT language, trial_type, x, d AS h FROM near
          WHERE r = greatest(floor(n * 0.75 + 0.00001), 1)),
local AS (
  SELECT language, trial_type, x, gap / h AS u, pow(1 - pow(d / h, 3), 3) AS w, proportion AS y
  FROM near JOIN width USING (language, trial_type, x) WHERE d < h),
sums AS (
  SELECT language, trial_type, x, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2,
         sum(w*u*u*u) AS s3, sum(w*u*u*u*u) AS s4, sum(w*y) AS t0, sum(w*u*y) AS t1,
         sum(w*u*u*y) AS t2
  FROM local GROUP BY ALL)
SELECT language, trial_type, x,
       round((t0*(s2*s4 - s3*s3) - s1*(t1*s4 - s3*t2) + s2*(t1*s3 - s2*t2))
           / (s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s3*s2) + s2*(s1*s3 - s2*s2)), 6) AS fit
FROM sums"""

#: The operator row of each place over single rows; traces of (I - L)(I - L)' and its square from it.
LOESS_BAND = f"""WITH {SERIES},
pts AS (SELECT language, trial_type, row_number() OVER (ORDER BY language, trial_type, trial_number) AS id,
        CAST(trial_number AS DOUBLE) AS spot, proportion AS y FROM series WHERE proportion IS NOT NULL),
places AS (SELECT DISTINCT language, trial_type, CAST(unnest(range(1, 16)) AS DOUBLE) AS x FROM pts
           UNION SELECT language, trial_type, spot FROM pts),
near AS (
  SELECT language, trial_type, x, id, y, spot - x AS gap, abs(spot - x) AS d,
         row_number() OVER (PARTITION BY language, trial_type, x ORDER BY abs(spot - x)) AS r,
         count(*) OVER (PARTITION BY language, trial_type, x) AS n
  FROM pts JOIN places USING (language, trial_type)),
width AS (SELECT language, trial_type, x, d AS h FROM near
          WHERE r = greatest(floor(n * 0.75 + 0.00001), 1)),
local AS (
  SELECT language, trial_type, x, id, y, gap / h AS u, pow(1 - pow(d / h, 3), 3) AS w
  FROM near JOIN width USING (language, trial_type, x) WHERE d < h),
sums AS (
  SELECT language, trial_type, x, sum(w) AS s0, sum(w*u) AS s1, sum(w*u*u) AS s2,
         sum(w*u*u*u) AS s3, sum(w*u*u*u*u) AS s4 FROM local GROUP BY ALL),
op AS (
  SELECT language, trial_type, x, id, y,
         w * (s2*s4 - s3*s3 - (s1*s4 - s2*s3) * u + (s1*s3 - s2*s2) * u * u)
           / (s0*(s2*s4 - s3*s3) - s1*(s1*s4 - s2*s3) + s2*(s1*s3 - s2*s2)) AS l
  FROM local JOIN sums USING (language, trial_type, x)),
fitted AS (SELECT language, trial_type, x, sum(l * y) AS fit, sum(l * l) AS norm FROM op GROUP BY ALL),
rows_ AS (SELECT p.language, p.trial_type, p.id AS i, q.id AS j, coalesce(o.l, 0) AS l
          FROM pts p JOIN pts q USING (language, trial_type)
          LEFT JOIN op o ON o.language = p.language AND o.trial_type = p.trial_type AND o.x = p.spot AND o.id = q.id),
cross_ AS (SELECT a.language, a.trial_type, a.i, b.i AS j, sum(a.l * b.l) AS ll
           FROM rows_ a JOIN rows_ b ON a.language = b.language AND a.trial_type = b.trial_type AND a.j = b.j GROUP BY ALL),
resid AS (SELECT c.language, c.trial_type, c.i, c.j, CASE WHEN c.i = c.j THEN 1 ELSE 0 END - a.l - b.l + c.ll AS v
          FROM cross_ c JOIN rows_ a ON a.i = c.i AND a.j = c.j JOIN rows_ b ON b.i = c.j AND b.j = c.i),
traces AS (SELECT language, trial_type, sum(v) FILTER (WHERE i = j) AS one, sum(v * v) AS two FROM resid GROUP BY ALL),
rest AS (SELECT p.language, p.trial_type, sum((y - fit) * (y - fit)) AS rss FROM pts p
         JOIN fitted f ON f.language = p.language AND f.trial_type = p.trial_type AND f.x = p.spot GROUP BY ALL)
SELECT language, trial_type, x, round(fit, 6) AS fit, round(sqrt(rss / one * norm), 6) AS se, round(one * one / two, 6) AS df
FROM fitted JOIN traces USING (language, trial_type) JOIN rest USING (language, trial_type)
WHERE x IN (SELECT CAST(unnest(range(1, 16)) AS DOUBLE))"""

def figure(name: str, x: str, y: str, series: str = "NULL", facet: str = "NULL", only: str = "TRUE") -> str:
    return f"""SELECT '{name}' AS figure, CAST({facet} AS VARCHAR) AS facet, CAST({series} AS VARCHAR) AS series,
CAST({x} AS DOUBLE) AS x, round(avg({y}), 6) AS y, count({y}) AS n FROM merged WHERE {only} GROUP BY ALL"""


PANELS = "age_group || '.' || trial_type"
FIGURES = f"WITH {MERGED} " + " UNION ALL ".join([
    figure("correct", "trial_number", "correct_anticipation", "language", PANELS, LOOKED),
    figure("incorrect", "trial_number", "incorrect_anticipation", "language", PANELS, LOOKED),
    figure("none", "trial_number", "no_anticipation", "language", PANELS),
    figure("all_by_age", "trial_number", "all_anticipation", "age_group", "trial_type"),
    figure("older", "trial_number", "correct_anticipation", "language || '.' || trial_type", only=f"{LOOKED} AND age_group = '20 months'"),
    figure("vocabulary", "total_concept_prod", "prop_look_correct", "language", "age_group"),
    figure("whole", "trial_number", "prop_look_correct"),
])

ORACLES: dict[str, str] = {
    "sink_many_figures": FIGURES,
    "src_scan_null_token": """
SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice,
       CAST(o_orderdate AS DATE) AS o_orderdate, nullif(o_orderpriority, 'P') AS o_orderpriority FROM orders""",
    "sink_series_roundtrip": proportion("correct_anticipation", LOOKED),
    "sink_series_csv": proportion("correct_anticipation", LOOKED),
    "header_regex_rename": wide(lambda n: True),
    "select_contains": wide(lambda n: "Target" in n or "Circle" in n),
    "select_column_range": wide(in_range("Test_14_Circle", "Training_3_Circle")),
    "drop_column": "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    "rename_column": 'SELECT * RENAME (c_mktsegment AS "Language") FROM customer',
    "fill_null_zero": f"""
SELECT user_id, CAST(day(ts) AS INTEGER) AS day, {DAILY} FROM events GROUP BY ALL""",
    "mean_na_rm": f"""WITH {SCORED}
SELECT trial_type, trial_number, round(avg(prop_look_correct), 6) AS mean
FROM scored GROUP BY ALL""",
    "nan_to_null": f"""WITH {TRIALS}
SELECT {KEY}, target / nullif(target + distractor, 0) AS ratio FROM trials""",
    "filter_null_semantics": f"""WITH {SCORED}
SELECT {KEY} FROM scored WHERE prop_look_correct <> 0""",
    "filter_equality": f"""WITH {MERGED}
SELECT {KEY}, circle, distractor, target FROM merged
WHERE age_group = '20 months' AND trial_type = 'Test' AND language = 'BUILDING'""",
    "filter_threshold_strict": f"""WITH {TRIALS}
SELECT * FROM trials WHERE circle + distractor + target > CAST(0.5 AS DOUBLE)""",
    "filter_threshold_inclusive": f"""WITH {TRIALS}
SELECT * FROM trials WHERE circle + distractor + target >= CAST(0.5 AS DOUBLE)""",
    "filter_not_in": "SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "exclude_left_anti": f"""WITH {TRIALS}
SELECT * FROM trials WHERE subject NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal <= 0)""",
    "qualify_group_count": f"""WITH {TRIALS}
SELECT *, count(*) OVER (PARTITION BY subject, trial_type) AS n FROM trials
WHERE circle + distractor + target >= CAST(0.5 AS DOUBLE) QUALIFY n >= 10""",
    "qualify_group_ndistinct": f"""WITH {good(min_trials=10)}
SELECT {KEY}, circle, distractor, target, num_good_trial AS n, good_baby FROM good""",
    "subset_by_level": f"""WITH {MERGED}
SELECT {KEY}, correct_anticipation FROM merged WHERE language = 'HOUSEHOLD'""",
    "complete_subjects": """
SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders WHERE o_custkey IN (
  SELECT o_custkey FROM orders GROUP BY o_custkey
  HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders))""",
    "wide_to_long": f"""WITH {TRIALS}, long AS (
  SELECT user_ids.subject, p.phase, n.n, circle, distractor, target
  FROM (SELECT DISTINCT subject FROM trials) user_ids
  CROSS JOIN (VALUES ('Test'), ('Training')) p(phase)
  CROSS JOIN (SELECT CAST(unnest(range(1, 16)) AS INTEGER) AS n) n
  LEFT JOIN trials ON trials.subject = user_ids.subject AND trial_type = phase
                  AND trial_number = n.n)
SELECT subject AS recording_name, phase || '_' || n || '_Circle' AS aoi, circle AS looking_time
FROM long
UNION ALL SELECT subject, phase || '_' || n || '_Distractor', distractor FROM long
UNION ALL SELECT subject, phase || '_' || n || '_Target', target FROM long""",
    "separate_columns": """
SELECT o_orderkey, parts[1] AS code, parts[2] AS word,
       parts[1] AS part_1, parts[2] AS part_2, parts[3] AS part_3
FROM (SELECT o_orderkey, string_split_regex(o_orderpriority, '[^a-zA-Z0-9]+') AS parts
      FROM orders)""",
    "long_to_wide": """
SELECT user_id, """
    + ", ".join(
        f"nullif(count(*) FILTER (WHERE event_type = '{e}'), 0) AS {e}"
        for e in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events GROUP BY user_id",
    "duplicate_keys": """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING n > 1""",
    "join_inner_equi": f"""WITH {TRIALS}
SELECT {KEY}, target AS score_x, c_acctbal AS score_y, c_mktsegment
FROM trials JOIN customer ON subject = c_custkey""",
    "pair_levels": f"""WITH {MIXED}
SELECT subject, round(avg(score) FILTER (WHERE block = 'F'), 6) AS score_f,
       round(avg(score) FILTER (WHERE block = 'O'), 6) AS score_o,
       round(avg(score) FILTER (WHERE block = 'P'), 6) AS score_p
FROM mixed GROUP BY subject""",
    "attach_global_ndistinct": f"""WITH {MERGED}, part_of AS (
  SELECT * FROM merged WHERE age_group = '7 months' AND language = 'BUILDING')
SELECT {KEY}, (SELECT count(DISTINCT subject) FROM part_of) AS num_participants FROM part_of""",
    "agg_mean_by_cell": f"""WITH {MERGED}
SELECT {CELL}, round(avg(target), 6) AS mean FROM merged GROUP BY ALL""",
    "agg_mean_filtered": proportion("correct_anticipation", LOOKED).replace("proportion", "mean"),
    "agg_count": f"""WITH {TRIALS}
SELECT subject, trial_type, count(*) AS n FROM trials GROUP BY ALL""",
    "agg_participants_per_cell": f"""WITH {MERGED}
SELECT age_group, language, count(DISTINCT subject) AS num_participants FROM merged GROUP BY ALL""",
    "agg_median": f"""WITH {MERGED}
SELECT language, round(median(total_concept_prod), 6) AS median FROM merged GROUP BY ALL""",
    "agg_median_wide_domain": """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median
FROM lineitem GROUP BY ALL""",
    "agg_combination_table": f"""WITH {MERGED}
SELECT age_group, language, "group", count(DISTINCT subject) AS n_participants
FROM merged GROUP BY ALL""",
    "agg_mean_of_means": f"""WITH {MERGED}, b AS (
  SELECT subject, language, trial_type, {FIVE}, avg(correct_anticipation) AS s
  FROM merged GROUP BY ALL)
SELECT language, trial_type, blocks_num, round(avg(s), 6) AS mean FROM b GROUP BY ALL""",
    "agg_describe": f"""WITH {MIXED}
SELECT language, block, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std,
       count(score) AS n, min(score) AS min, max(score) AS max FROM mixed GROUP BY ALL""",
    "win_group_count": f"""WITH {TRIALS}
SELECT {KEY}, count(*) OVER (PARTITION BY subject, trial_type) AS n FROM trials""",
    "win_group_ndistinct": f"""WITH {TRIALS}
SELECT {KEY}, count(DISTINCT trial_type) OVER (PARTITION BY subject) AS good_baby FROM trials""",
    "win_group_median": f"""WITH {MERGED}
SELECT {KEY}, language, total_concept_prod,
       round(median(total_concept_prod) OVER (PARTITION BY language), 6) AS group_median
FROM merged""",
    "win_group_mean": f"""WITH {MERGED}
SELECT {KEY}, language, prop_look_correct,
       round(avg(prop_look_correct) OVER (PARTITION BY language, trial_type), 6) AS group_mean
FROM merged""",
    "score_total_looking": f"""WITH {TRIALS}
SELECT {KEY}, circle + distractor + target AS all_looking_time FROM trials""",
    "score_ifelse_null": f"""WITH {SCORED}
SELECT {KEY}, CASE WHEN prop_look_correct >= 0.5 THEN 'good' WHEN prop_look_correct < 0.5
       THEN 'bad' END AS verdict FROM scored""",
    "score_anticipation_flags": f"""WITH {SCORED}
SELECT {KEY}, correct_anticipation, incorrect_anticipation, no_anticipation FROM scored""",
    "score_all_anticipation": f"WITH {SCORED} SELECT {KEY}, all_anticipation FROM scored",
    "score_prop_correct": f"""WITH {SCORED}
SELECT {KEY}, round(prop_look_correct, 6) AS prop_look_correct FROM scored""",
    "cast_text_number": """
SELECT c_custkey AS subject, CASE WHEN c_acctbal < 9000 THEN c_acctbal END AS total_concept_prod,
       TRY_CAST(c_mktsegment AS DOUBLE) AS not_a_number FROM customer""",
    "factor_levels": """
SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) AS INTEGER) AS level
FROM customer""",
    "factor_many_levels": """
SELECT o_orderkey, o_totalprice, CAST(dense_rank() OVER (ORDER BY o_totalprice DESC) AS INTEGER) AS level
FROM orders""",
    "factor_reverse": """
SELECT o_orderkey, o_orderstatus,
       CAST(dense_rank() OVER (ORDER BY o_orderstatus DESC) AS INTEGER) AS level FROM orders""",
    "recode_levels": f"""WITH {TRIALS}
SELECT {KEY}, CASE trial_type WHEN 'Training' THEN 'Pre-switch' ELSE 'Post-switch' END
       AS trial_type_fig FROM trials""",
    "block_number": f"""WITH {TRIALS}
SELECT {KEY}, CAST((trial_number + 2) // 3 AS INTEGER) AS blocks_num,
       CAST((trial_number + 4) // 5 AS INTEGER) AS blocks_of_five FROM trials""",
    "interaction_key": "SELECT c_custkey, c_mktsegment || '.' || c_nationkey AS cell FROM customer",
    "median_split": f"""WITH {VOCAB}
SELECT {KEY}, language, round(median_by_group, 6) AS median_by_group, vocab_size FROM vocab""",
    "median_split_per_subject": f"""WITH {MERGED}, med AS (
  SELECT language, median(v) AS m FROM (
    SELECT DISTINCT language, subject, total_concept_prod AS v FROM merged) GROUP BY language)
SELECT {KEY}, language, round(m, 6) AS median_by_group,
       CASE WHEN m > total_concept_prod THEN 'Low' WHEN m <= total_concept_prod THEN 'High' END
       AS vocab_size FROM merged JOIN med USING (language)""",
    "median_split_by_block": f"""WITH {MERGED}, older AS (
  SELECT *, {FIVE} FROM merged WHERE age_group = '20 months'), med AS (
  SELECT *, median(total_concept_prod) OVER (PARTITION BY language, trial_type, blocks_num) AS m
  FROM older)
SELECT {KEY}, language, blocks_num, round(m, 6) AS median_by_group,
       CASE WHEN m > total_concept_prod THEN 'low' WHEN m <= total_concept_prod THEN 'high' END
       AS vocab_size FROM med""",
    "series_ordered": proportion("correct_anticipation", LOOKED) + f" ORDER BY {CELL}",
    "trials_from_wide": f"""WITH {TRIALS}, every AS (
  SELECT * FROM (SELECT DISTINCT subject FROM trials)
  CROSS JOIN (VALUES ('Test'), ('Training')) p(trial_type)
  CROSS JOIN (SELECT CAST(unnest(range(1, 16)) AS INTEGER) AS trial_number))
SELECT subject AS recording_name, trial_type, CAST(trial_number AS VARCHAR) AS trial_number,
       coalesce(circle, 0) AS "Circle", coalesce(distractor, 0) AS "Distractor",
       coalesce(target, 0) AS "Target"
FROM every LEFT JOIN trials USING ({KEY})""",
    "quality_filter": f"WITH {good(min_trials=10)} SELECT * FROM good",
    "quality_filter_strict": f"WITH {good('>')} SELECT * FROM good",
    "anticipation_scores": f"""WITH {SCORED}
SELECT * EXCLUDE (circle, distractor, target)
       REPLACE (round(prop_look_correct, 6) AS prop_look_correct) FROM scored""",
    "merged_trials": f"""WITH {MERGED}
SELECT * REPLACE (round(prop_look_correct, 6) AS prop_look_correct,
                  round(all_looking_time, 6) AS all_looking_time) FROM merged""",
    "language_table": f"""WITH {MERGED}
SELECT subject, age_group, language, "group", total_concept_prod,
       count(DISTINCT subject) AS n_participants
FROM merged WHERE age_group = '20 months' AND language = 'BUILDING' GROUP BY ALL""",
    "prop_correct": proportion("correct_anticipation", LOOKED),
    "prop_incorrect": proportion("incorrect_anticipation", LOOKED),
    "prop_none": proportion("no_anticipation"),
    "prop_correct_all": proportion("correct_anticipation"),
    "prop_any": proportion("all_anticipation"),
    "prop_all_scores": f"""WITH {MERGED}
SELECT {CELL}, round(avg(correct_anticipation) FILTER (WHERE {LOOKED}), 6) AS correct,
       round(avg(incorrect_anticipation) FILTER (WHERE {LOOKED}), 6) AS incorrect,
       round(avg(no_anticipation), 6) AS "none", round(avg(all_anticipation), 6) AS "any",
       round(avg(prop_look_correct), 6) AS looking FROM merged GROUP BY ALL""",
    "vocab_means": f"""WITH {VOCAB}
SELECT language, vocab_size, round(avg(total_concept_prod), 4) AS mean_vocabulary
FROM vocab WHERE age_group = '20 months' GROUP BY ALL""",
    "block_scores": f"""WITH {blocks('correct_anticipation')}
SELECT * REPLACE (round(block_anticipation, 6) AS block_anticipation) FROM blocks""",
    "block_scores_any": f"""WITH {blocks('all_anticipation')}
SELECT * REPLACE (round(block_anticipation, 6) AS block_anticipation) FROM blocks""",
    "block_series": f"""WITH {MERGED}
SELECT age_group, language, trial_type, {FIVE}, round(avg(correct_anticipation), 6) AS proportion
FROM merged GROUP BY ALL""",
    "block_series_subject": f"""WITH {blocks('correct_anticipation')}
SELECT * REPLACE (round(block_anticipation, 6) AS block_anticipation),
       round(avg(block_anticipation) OVER (
         PARTITION BY language, trial_type, blocks_num, vocab_size), 6) AS proportion_anticipation
FROM blocks WHERE age_group = '20 months'""",
    "vocab_trial_series": f"""WITH {VOCAB}
SELECT language, trial_type, trial_number, vocab_size,
       round(avg(correct_anticipation), 6) AS proportion_looking
FROM vocab WHERE age_group = '20 months' GROUP BY ALL""",
    "figure_series": f"""WITH {MERGED}
SELECT age_group, trial_type, 1 AS age_group_order,
       CASE trial_type WHEN 'Training' THEN 1 ELSE 2 END AS trial_type_order, language,
       language AS series, CAST(trial_number AS DOUBLE) AS x, round(avg(all_anticipation), 6) AS y
FROM merged WHERE age_group = '7 months' GROUP BY ALL""",
    "t_test": f"""WITH {MIXED}, cells AS (
  SELECT block, half AS g, count(score) AS n, avg(score) AS m,
         var_samp(score) * (count(score) - 1) AS ss FROM mixed GROUP BY ALL)"""
    + TWO_GROUPS.format(by="block", d=4, t=6),
    "t_test_series": f"""WITH {MERGED}, props AS (
  SELECT {CELL}, round(avg(correct_anticipation), 6) AS y FROM merged WHERE {LOOKED} GROUP BY ALL),
cells AS (
  SELECT trial_type, age_group AS g, count(y) AS n, avg(y) AS m,
         var_samp(y) * (count(y) - 1) AS ss FROM props GROUP BY ALL)"""
    + TWO_GROUPS.format(by="trial_type", d=5, t=4),
    "pairwise_t": f"""WITH {MIXED}, levels AS (
  SELECT subject, language, block, avg(score) AS y FROM mixed GROUP BY ALL),
pairs AS (
  SELECT a.language, a.block AS level_1, b.block AS level_2, b.y - a.y AS d
  FROM levels a JOIN levels b ON a.subject = b.subject AND a.block < b.block)
SELECT language, level_1, level_2, count(d) AS n, round(avg(d), 4) AS mean_diff,
       round(stddev_samp(d), 4) AS sd_diff, CAST(count(d) - 1 AS DOUBLE) AS df,
       round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t
FROM pairs GROUP BY ALL""",
    "p_adjust": """WITH shares AS (
  SELECT c_nationkey AS n_nationkey, count(*) FILTER (WHERE c_acctbal < 0) / count(*) / 10 AS p
  FROM customer GROUP BY ALL),
ranked AS (
  SELECT n_regionkey, n_nationkey, p, count(*) OVER (PARTITION BY n_regionkey) AS m,
         row_number() OVER (PARTITION BY n_regionkey ORDER BY p, n_nationkey) AS i
  FROM shares JOIN nation USING (n_nationkey))
SELECT n_regionkey, n_nationkey, round(p, 9) AS p,
       round(least(1.0, max((m - i + 1) * p) OVER (PARTITION BY n_regionkey ORDER BY i)), 9) AS p_holm,
       round(least(1.0, m * p), 9) AS p_bonferroni
FROM ranked""",
    "p_adjust_one_family": """WITH x AS (SELECT o_orderkey, (CAST(floor(o_totalprice * 100) AS BIGINT) % 997 + 1) / CAST(998 AS DOUBLE) AS x FROM orders),
p AS (SELECT o_orderkey, x * x * x * x AS p FROM x),
steps AS (SELECT p, ((SELECT count(*) FROM p) - coalesce(sum(count(*)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * p AS step FROM p GROUP BY p)
SELECT o_orderkey, round(p.p, 9) AS p, round(least(1.0, a.upto), 9) AS p_holm
FROM p JOIN (SELECT p, max(step) OVER (ORDER BY p) AS upto FROM steps) a ON a.p = p.p""",
    "anova_oneway": f"WITH {MIXED}, "
    + ONE_WAY.format(level="language", v="score", source="mixed")
    + """
SELECT block, CAST(df_n AS DOUBLE) AS df_n, CAST(df_d AS DOUBLE) AS df_d,
       round(ss_n / 1e6, 3) AS ss_n, round(ss_d / 1e6, 3) AS ss_d,
       round(ss_d / df_d / 1e6, 3) AS ms_d, round((ss_n / df_n) / (ss_d / df_d), 6) AS f
FROM sums""",
    "snk": f"WITH {MIXED}, "
    + ONE_WAY.format(level="language", v="score", source="mixed")
    + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY m) AS r FROM cells)
SELECT block, a.level AS level_1, b.level AS level_2, round(b.m - a.m, 4) AS mean_diff,
       CAST(b.r - a.r + 1 AS DOUBLE) AS span, CAST(df_d AS DOUBLE) AS df,
       round(sqrt(ss_d / df_d / 2 * (1.0 / a.n + 1.0 / b.n)), 4) AS se,
       round((b.m - a.m) / sqrt(ss_d / df_d / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q
FROM ranked a JOIN ranked b USING (block) JOIN sums USING (block) WHERE a.r < b.r""",
    "snk_ungrouped": """WITH cells AS (
  SELECT c_nationkey AS level, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) * (count(*) - 1) AS ss
  FROM customer GROUP BY ALL),
sums AS (SELECT sum(n) - count(*) AS df_d, coalesce(sum(ss), 0) AS ss_d FROM cells),
ranked AS (SELECT *, row_number() OVER (ORDER BY m, level) AS r FROM cells)
SELECT a.level AS level_1, b.level AS level_2, round(b.m - a.m, 4) AS mean_diff,
       CAST(b.r - a.r + 1 AS DOUBLE) AS span, CAST(df_d AS DOUBLE) AS df,
       round(sqrt(ss_d / df_d / 2 * (1.0 / a.n + 1.0 / b.n)), 4) AS se,
       round((b.m - a.m) / sqrt(ss_d / df_d / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q
FROM ranked a JOIN ranked b ON a.r < b.r CROSS JOIN sums""",
    "levene": f"""WITH {MIXED}, away AS (
  SELECT block, language || '.' || half AS cell,
         abs(score - avg(score) OVER (PARTITION BY block, language, half)) AS d FROM mixed), """
    + ONE_WAY.format(level="cell", v="d", source="away")
    + """
SELECT block, CAST(df_n AS DOUBLE) AS df_n, CAST(df_d AS DOUBLE) AS df_d,
       round(ss_n / 1e6, 3) AS ss_n, round(ss_d / 1e6, 3) AS ss_d,
       round((ss_n / df_n) / (ss_d / df_d), 6) AS f FROM sums""",
    "anova_between": BETWEEN,
    "anova_between_two": between_two(),
    "anova_rm": REPEATED,
    "anova_mixed": f"WITH {MIXED}, {contrasts('language')}, {TOTALS}"
    + effect_rows(mixed_rows(3), "sums"),
    "anova_mixed_type2": f"WITH {MIXED}, {contrasts('language')}, {TOTALS}"
    + effect_rows(mixed_rows(2), "sums"),
    "anova_mixed_blocks": ANOVA_BLOCKS,
    "anova_mixed_two_between": two_between(),
    "sphericity": SPHERICITY,
    "trend_lm": f"""WITH {SERIES}, {LINES}
SELECT language, trial_type, n, round(intercept, 6) AS intercept, round(slope, 6) AS slope,
       round(sxy * sxy / (sxx * syy), 6) AS r2 FROM lines""",
    "trend_lm_band": f"""WITH {SERIES}, {LINES}, drawn AS (
  SELECT *, lo + (hi - lo) * i / 79.0 AS x
  FROM (SELECT *, CAST(unnest(range(0, 80)) AS DOUBLE) AS i FROM lines))
SELECT language, trial_type, round(x, 6) AS x, round(intercept + slope * x, 6) AS fit,
       round(sqrt((syy - slope * sxy) / (n - 2) * (1.0 / n + (x - xm) * (x - xm) / sxx)), 6) AS se,
       CAST(n - 2 AS DOUBLE) AS df FROM drawn""",
    "trend_loess": LOESS,
    "trend_loess_band": LOESS_BAND,
    "anova_many_levels": """WITH y AS (
  SELECT l_suppkey AS s, CAST(l_quantity AS INTEGER) AS k, CASE WHEN l_suppkey % 3 = 0 THEN 'third' ELSE 'rest' END AS g, avg(l_extendedprice) AS y
  FROM lineitem GROUP BY ALL),
whole AS (SELECT s, g, avg(y) AS m FROM y GROUP BY ALL HAVING count(*) = 50),
own AS (SELECT g, count(*) AS n, avg(m) AS mg, sum(m) AS t, var_samp(m) * (count(*) - 1) AS ss FROM whole GROUP BY g),
top AS (SELECT count(*) AS a, sum(n) AS n, sum(1.0 / n) AS inv, avg(mg) AS u, sum(t) / sum(n) AS grand, sum(ss) AS ss FROM own),
c AS (SELECT y.s, y.g, k, y - m AS c FROM y JOIN whole USING (s)),
cell AS (SELECT g, k, avg(c) AS c, count(*) AS n FROM c GROUP BY ALL),
level AS (SELECT k, avg(c) AS u, sum(n * c) / sum(n) AS w FROM cell GROUP BY k),
r AS (SELECT s, c.g, c.k, c.c - cell.c AS r FROM c JOIN cell ON cell.g = c.g AND cell.k = c.k),
cov AS (SELECT a.k AS j, b.k AS k, sum(a.r * b.r) AS v FROM r a JOIN r b ON a.s = b.s GROUP BY ALL),
sph AS (SELECT pow(sum(v) FILTER (WHERE j = k), 2) / (49 * sum(v * v)) AS gg, sum(v) FILTER (WHERE j = k) AS error FROM cov),
rows_ AS (
  SELECT '(Intercept)' AS effect, 1 AS df_n, n - a AS df_d, 50 * u * u * a * a / inv AS ss_n, 50 * ss AS ss_d, NULL AS gg FROM top
  UNION ALL SELECT 'half', a - 1, n - a, 50 * (SELECT sum(o.n * pow(o.mg - top.grand, 2)) FROM own o), 50 * ss, NULL FROM top
  UNION ALL SELECT 'quantity', 49, 49 * (n - a), (SELECT sum(l.u * l.u) FROM level l) * a * a / inv, error, gg FROM top, sph
  UNION ALL SELECT 'half:quantity', 49 * (a - 1), 49 * (n - a), (SELECT sum(cell.n * pow(cell.c - level.w, 2)) FROM cell JOIN level USING (k)), error, gg FROM top, sph)
SELECT effect, CAST(df_n AS DOUBLE) AS df_n, CAST(df_d AS DOUBLE) AS df_d, round(ss_n / 1e6, 2) AS ss_n, round(ss_d / 1e6, 2) AS ss_d,
       round(ss_n * df_d / (ss_d * df_n), 5) AS f, round(ss_n / (ss_n + 50 * ss + error), 5) AS ges, round(rows_.gg, 5) AS gg_eps,
       CAST(n AS BIGINT) AS n_subjects, (SELECT count(DISTINCT s) FROM y) - CAST(n AS BIGINT) AS n_dropped
FROM rows_, top, sph""",
}
