"""Sessions and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
#: Null instead of an error for bad casts and zero divisors, one time zone, adaptive plans with skewed joins split.
DEFAULTS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidemark", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with this library's defaults; master and settings of the environment stand where none are given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=DEFAULTS | (conf or {})).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temporary views of the tables of a folder."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
