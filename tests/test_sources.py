from pyspark.sql import functions as F

from trialspark.sources.tables import read_table, stored, write_series


def test_csv_null_token_and_inference(spark, tmp_path):
    (tmp_path / "a.csv").write_text("recording.name,x,note\nS01,0.5,-\nS02,-,ok\n")
    df = read_table(spark, str(tmp_path / "a.csv"), "csv")
    assert dict(df.dtypes) == {"recording.name": "string", "x": "double", "note": "string"}
    assert [tuple(r) for r in df.collect()] == [("S01", 0.5, None), ("S02", None, "ok")]
    typed = read_table(spark, str(tmp_path / "a.csv"), "csv", schema="k string, x string, n string")
    assert [r["x"] for r in typed.collect()] == ["0.5", None]


def test_parquet_null_token_only_touches_text(spark, tmp_path):
    df = spark.createDataFrame([("-", 1), ("a-", -1)], "s string, n int")
    df.write.parquet(str(tmp_path / "p"))
    got = read_table(spark, str(tmp_path / "p")).collect()
    assert sorted((r["s"], r["n"]) for r in got if r["s"]) == [("a-", -1)]
    kept = read_table(spark, str(tmp_path / "p"), null_token=None).where("s = '-'").count()
    assert kept == 1
    chosen = read_table(spark, str(tmp_path / "p"), null_columns=["n"]).where("s = '-'")
    assert chosen.count() == 1
    assert "EqualTo(s,-)" in chosen._jdf.queryExecution().executedPlan().toString()


def test_write_series_and_store(spark, tmp_path):
    df = spark.range(5).withColumn("y", F.col("id") * 0.5)
    write_series(df, str(tmp_path / "fig_1"), "csv")
    back = read_table(spark, str(tmp_path / "fig_1"), "csv")
    assert sorted(r["y"] for r in back.collect()) == [0.0, 0.5, 1.0, 1.5, 2.0]
    for format in ("parquet", "csv"):
        back = stored(df, "series", format)
        assert sorted(r["y"] for r in back.collect()) == [0.0, 0.5, 1.0, 1.5, 2.0]
        assert "/series-" in back.inputFiles()[0]
