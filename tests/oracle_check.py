"""Run registered queries next to their DuckDB SQL and compare every value.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(
        (tuple(_norm(r[n]) for n in names) for r in df.collect()), key=_key
    )


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=_key)


def compare(df, con, sql) -> str:
    """Empty when equal, else the first difference."""
    names, got = spark_rows(df)
    wanted_names, want = duck_rows(con, sql)
    if names != wanted_names:
        return f"columns {names} / {wanted_names}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}"
    if not got:
        return "no rows"
    for a, b in zip(got, want):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{dict(zip(names, a))} / {dict(zip(names, b))}"
    return ""


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                verdict = compare(df, con, oracles[name])
                verdict = verdict and "DIFFERS " + verdict
            else:
                n = len(df.collect())
                verdict = f"(no SQL) {n} rows" if n else "DIFFERS no rows"
        except Exception as e:  # report and go on
            verdict = f"DIFFERS {type(e).__name__}: {str(e)[:600]}"
        bad += verdict.startswith("DIFFERS")
        print(f"{name:28s} {time.time() - start:6.2f}s  {verdict or 'equal'}", flush=True)
    print(f"{bad} differ; unknown SQL: {sorted(set(oracles) - set(queries))}")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
