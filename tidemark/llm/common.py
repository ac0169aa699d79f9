"""Shared folders, written intermediate tables and small column helpers for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, but only if everything
    runs on this machine (tests): on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


#: What Python workers get at a time while a table is written, and shuffle files that go with the query that made them.
WRITE_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: it cuts the lineage and survives lost executors.
    The files go with freed(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    with settings(spark, WRITE_CONF):
        df.write.parquet(path)
    _file_system(spark, path).deleteOnExit(_path(spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def freed(*tables: DataFrame | None) -> None:
    """Remove the files of written tables that no table still to be computed reads."""
    for t in tables:
        if t is not None and (path := _PATHS.pop(t, None)):
            dropped(t.sparkSession, path)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Rows of a few numbers that may be broadcast (some 16 MB).
BROADCAST_ROWS = 400_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to hold few rows; beyond that as it is, for a shuffled join. For
    written tables of a few numbers a row."""
    return F.broadcast(df) if df.count() <= most else df


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a scratch path that nothing reads any more."""
    _file_system(spark, path).delete(_path(spark, path), True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Of a batch, what is decoded into Python strings at a time: rows, and characters (a single longer text comes whole).
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts are bounded, so that a worker's memory does not follow the batch."""
    sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + (n or 0) > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def free_name(docs: DataFrame, name: str = "__found") -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name


def with_found(
    docs: DataFrame, text: str, fields: str, compute: Callable[[], Callable[[list[str]], list]], name: str = "__found"
) -> DataFrame:
    """docs with one more column, a struct of the fields ('name type, ...') computed from whole texts (null: empty).
    compute() is called once a task and gives the function from texts to the columns of the struct. All columns pass
    through untouched, whatever their names; that of the struct must be a free one."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], text_or_empty(f"`{text}`").alias("text"))
    made = T.StructType.fromDDL(fields)
    places = [f"f{i}" for i in range(len(made))]
    schema = T.StructType(
        [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]
        + [T.StructField(n, f.dataType) for n, f in zip(places, made, strict=True)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = compute()
        try:
            for batch in batches:
                for b in slices(batch, len(names)):
                    kept = [b.column(i) for i in range(len(names))]
                    found = [x if isinstance(x, pa.Array) else pa.array(x) for x in of(b.column(len(names)).to_pylist())]
                    yield pa.RecordBatch.from_arrays(kept + found, names + places)
        finally:  # an idle worker keeps no words
            getattr(of, "done", lambda: None)()

    found = F.struct(*[F.col(n).alias(f.name) for n, f in zip(places, made, strict=True)]).alias(name)
    return source.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)], found)


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo: the rule that deals rows into learning and held-out ones."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def parallelism(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block, put back after it."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

