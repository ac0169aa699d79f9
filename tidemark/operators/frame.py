"""DataFrame operators beyond Spark's own methods, all as compositions of built-in ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

#: Values that are counted one by one without bounds; rank error of the bounds, as a share of the rows.
COUNTED, NEAR = 100_000, 5e-4

# --- joins -----------------------------------------------------------------------------------------------------------


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both sides have, each kept once."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("a natural join needs a common column")
    return left.join(right, common, how)


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the ranges [start, end) that hold them, as an equi-join on buckets of the given width.

    A range stands once in each bucket that it touches, so width should be near the usual length of a range."""
    bucket = lambda c: F.floor(c / F.lit(width))
    left = points.withColumn("__bucket", bucket(F.col(at)))
    last = F.when(F.col(end) > F.col(start), bucket(F.col(end))).otherwise(bucket(F.col(start)))
    right = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), last)))
    return left.join(right, "__bucket").filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of its group at or before it: a union and one running
    window, so both sides are shuffled once by the group and neither is multiplied."""
    kept = F.struct(*values).alias("__value")
    right_rows = right.select(*by, on, F.lit(0).alias("__side"), kept)
    left_rows = left.select(*by, on, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    both = right_rows.unionByName(left_rows, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(F.col(on).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__value", ignorenulls=True).over(before)).filter("__side = 1")
    return found.select("__left.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are dealt over salts tasks: left rows get one salt, right rows stand once for each.
    For inner, left and left semi or anti joins."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't be {how}")
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")


def bounded_broadcast(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if Catalyst's estimate of its size is below the bound, else df as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most_bytes else df


# --- grouping --------------------------------------------------------------------------------------------------------


def two_phase_distinct(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """(by, n_distinct): distinct pairs first, so a hot group is dealt over many tasks before it is counted."""
    return df.select(*by, column).distinct().groupBy(*by).agg(F.count(column).alias("n_distinct"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. order should end in a unique column."""
    return (
        df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        .filter(F.col("__rank") <= k)
        .drop("__rank")
    )


def numbered(df: DataFrame, order: list[Column], name: str, path: str) -> DataFrame:
    """df with name: 1, 2, ... in the given order, which should end in a unique column. Rows are sorted by range partitions
    and written to path; each partition's offset is the sum of the counts before it, so no task ever has all rows."""
    spark = df.sparkSession
    placed = df.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    # A row for each partition.
    counts = sorted(placed.groupBy("__part").count().collect())
    offsets = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    offset = F.broadcast(spark.createDataFrame(offsets, "__part int, __offset long"))
    within = F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)
    return placed.join(offset, "__part").withColumn(name, within + F.col("__offset") + 1).drop("__part", "__at", "__offset")


def quantiles(df: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """For each share, the least value that at least this share of the values does not exceed; nulls do not count, NaN is the
    largest value. Exact: a sketch gives bounds a few thousandths of the rows apart, and only what lies between them is
    counted by value, so neither a task nor the driver holds the column."""
    numbers = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    n, real = numbers.select(F.count("v"), F.count_if(~F.isnan("v"))).first()
    ranks = [max(1, math.ceil(Fraction(str(p)) * n)) for p in at]
    numbers = numbers.filter("NOT isnan(v)")
    bounds: list[float | None] = [None] * (2 * len(at))
    if real > COUNTED:
        shares = [min(1.0, max(0.0, rank / real + side * 2 * NEAR)) for rank in ranks for side in (-1, 1)]
        bounds = numbers.approxQuantile("v", shares, NEAR)
    return [_ranked(numbers, rank, low, high) if rank <= real else math.nan if n else None for rank, low, high in zip(ranks, bounds[::2], bounds[1::2], strict=True)]


def _ranked(numbers: DataFrame, rank: int, low: float | None, high: float | None) -> float:
    """The value v of a rank, counted from 1, which lies between the bounds; values below them are counted as one."""
    kept = numbers if high is None else numbers.filter(F.col("v") <= high)
    value = F.col("v") if low is None else F.when(F.col("v") >= low, F.col("v"))
    counts = kept.groupBy(value.alias("v")).count().collect()
    seen = sum(c for v, c in counts if v is None)
    for v, c in sorted((v, c) for v, c in counts if v is not None):
        seen += c
        if seen >= rank:
            return v
    raise AssertionError("the bounds of a quantile do not hold it")


def grouped(data: GroupedData, name: str, *columns: str) -> DataFrame:
    """An aggregate of each column by its name, for those that grouped data has no method for: count_distinct,
    collect_list, collect_set, first, last, stddev, variance, median, mode."""
    f = getattr(F, name)
    return data.agg(*[f(F.col(c)).alias(f"{name}({c})") for c in columns])


def transform_groups(df: DataFrame, by: list[str], func: Callable) -> DataFrame:
    """func over each group's pandas frame; the result has the schema of df."""
    return df.groupBy(*by).applyInPandas(func, df.schema)


def crosstab(df: DataFrame, rows: str, columns: str, values: list | None = None) -> DataFrame:
    """Counts of pairs: a row for each value of the one, a column for each of the other."""
    data = df.groupBy(F.col(rows).cast("string").alias(f"{rows}_{columns}"))
    pivoted = data.pivot(columns, values) if values else data.pivot(columns)
    return pivoted.agg(F.count(F.lit(1))).na.fill(0)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def union_coerced(left: DataFrame, right: DataFrame) -> DataFrame:
    """A union by position in which a text meets a number as text and mixed numbers meet as doubles."""
    if len(left.columns) != len(right.columns):
        raise ValueError("a union needs as many columns on both sides")
    numbers = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    a, b = [], []
    for (x, s), (y, t) in zip(left.dtypes, right.dtypes, strict=True):
        kind = s if s == t else "double" if {s, t} <= numbers and {s, t} & {"float", "double"} else "bigint" if {s, t} <= numbers else "string"
        a.append(F.col(x).cast(kind).alias(x))
        b.append(F.col(y).cast(kind).alias(x))
    return left.select(*a).union(right.select(*b))


# --- cleaning and sampling -------------------------------------------------------------------------------------------


def drop_nulls(df: DataFrame, how: str = "any", thresh: int | None = None, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(how=how, thresh=thresh, subset=subset)


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key falls below a fraction of the hash space: the same rows in every run and at every parallelism."""
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < F.lit(int(fraction * (1 << 20))))


def map_partitions(df: DataFrame, func: Callable[[Iterator], Iterable], schema: str) -> DataFrame:
    """A function over the rows of each partition. mapInPandas is faster where the work can be vectorised."""
    return df.sparkSession.createDataFrame(df.rdd.mapPartitions(func), schema)


def sessionize(df: DataFrame, by: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """df with session: a number that rises where the gap to the row before exceeds gap_seconds."""
    order = Window.partitionBy(by).orderBy(at, tie)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    begins = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("__begins", begins).withColumn("session", F.sum("__begins").over(order)).drop("__begins")
