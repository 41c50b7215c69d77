"""Table files in and result series out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions.scalars import as_column


def read_table(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    null_token: str | None = "-",
    schema: T.StructType | str | None = None,
    null_columns: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Read a table in which one token stands for a missing cell.

    Without a schema the types come from the file, for CSV by inference over it.
    In typed files the token is looked for in text columns, or only in
    `null_columns`; filters on the other columns still reach the file.
    """
    reader = spark.read.options(**options)
    if format == "csv":
        reader = reader.option("header", options.get("header", True))
        if null_token is not None:
            reader = reader.option("nullValue", null_token)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.format(format).load(path)
    if null_token is None or format == "csv":
        return df
    return df.select(
        *[
            F.nullif(as_column(f.name), F.lit(null_token)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            and (null_columns is None or f.name in null_columns)
            else as_column(f.name)
            for f in df.schema.fields
        ]
    )


def write_series(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write one figure's data series to its own directory."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def stored(df: DataFrame, name: str, format: str = "parquet") -> DataFrame:
    """Write a series to a new folder of the warehouse, and read it back."""
    spark = df.sparkSession
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"
    write_series(df, path, format)
    return read_table(spark, path, format, null_token=None)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read several times to the folder all executors see, and read it back.

    The folder is `spark.checkpoint.dir`, or one in the warehouse where that is unset.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_figures(stacked: DataFrame, path: str, format: str = "parquet") -> None:
    """Write the series of many figures in one pass, each to `figure=<name>`; other figures in the folder stay."""
    writer = stacked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if format == "csv":
        writer = writer.option("header", True)
    writer.partitionBy("figure").format(format).save(path)


def read_figure(spark: SparkSession, path: str, figure: str, format: str = "parquet") -> DataFrame:
    """One figure's series; only its folder is read."""
    reader = spark.read.option("header", True).option("inferSchema", True) if format == "csv" else spark.read
    return reader.format(format).load(path).where(F.col("figure").cast("string") == figure)
