"""Readers and writers with this library's defaults; everything else is Spark's own."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: Any) -> DataFrame:
    """Read a path. CSV has a header unless options say otherwise; types are inferred only on demand."""
    if kind == "csv":
        options = {"header": True, **options}
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(
    df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options: Any
) -> None:
    if kind == "csv":
        options = {"header": True, **options}
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_jdbc(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options: Any) -> DataFrame:
    """A table over JDBC; partition is (column, lower, upper, number) for a parallel read."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition:
        column, low, high, n = partition
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


def save_table(df: DataFrame, name: str, mode: str = "error", kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


def create_database(spark: SparkSession, name: str, if_not_exists: bool = True) -> None:
    spark.sql(f"CREATE DATABASE {'IF NOT EXISTS ' if if_not_exists else ''}`{name}`")


def drop_database(spark: SparkSession, name: str, if_exists: bool = True, cascade: bool = False) -> None:
    spark.sql(f"DROP DATABASE {'IF EXISTS ' if if_exists else ''}`{name}`{' CASCADE' if cascade else ''}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
