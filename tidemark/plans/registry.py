"""Registry of named queries: one callable and, where SQL can express it, one SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL text that must give the same rows."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "flagship_segment_revenue",
    """
    SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01'
    GROUP BY c_mktsegment
    """,
)
def flagship_segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by market segment. Lines are summed by order, then by customer, before each join: the widest shuffle
    carries a row for each order and task, and the join with customers one for each customer."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    by_order = lines.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("n_lines")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    sums = F.sum("revenue").alias("revenue"), F.sum("n_lines").alias("n_lines")
    by_customer = by_order.join(orders, F.col("l_orderkey") == orders.o_orderkey).groupBy("o_custkey").agg(*sums)
    joined = by_customer.join(customers, F.col("o_custkey") == customers.c_custkey)
    return joined.groupBy("c_mktsegment").agg(F.round(sums[0], 2).alias("revenue"), sums[1])


def queries() -> dict[str, Query]:
    """All queries; importing the catalogue modules registers them."""
    from tidemark.plans import catalogue

    catalogue.load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLES)
