"""Versioned Parquet tables: append, overwrite, update, delete, merge, history and time travel.

A table is a folder with one Parquet snapshot for each version (v=N) and one small JSON entry for each commit (_log).
An entry is created without overwriting, so of two writers of one version the second fails. All changes of rows are
DataFrame plans: a merge is one full outer join and a projection. A snapshot holds all rows: a change costs a rewrite of
the table, which is the price of plain Parquet without row tracking.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Values = dict[str, "str | Column"]


def _expr(v: str | Column) -> Column:
    return F.expr(v) if isinstance(v, str) else v


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- log ---------------------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, df: DataFrame, path: str) -> VersionedTable:
        out = cls(df.sparkSession, path)
        if out.exists():
            raise ValueError(f"there is a table at {path}")
        out._commit(df, "CREATE TABLE AS SELECT", {}, -1)
        return out

    def exists(self) -> bool:
        return self._fs.exists(self._path(f"{self.path}/_log"))

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/_log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    @property
    def version(self) -> int:
        return self.versions()[-1]

    def _entry(self, version: int) -> dict:
        text = self.spark.read.text(f"{self.path}/_log/{version}.json").first()
        return json.loads(text[0])

    def _commit(self, df: DataFrame, operation: str, parameters: dict, base: int) -> int:
        version = base + 1
        name = f"v={version}-{time.time_ns()}"
        df.write.parquet(f"{self.path}/{name}")
        entry = {"version": version, "timestamp": time.time(), "operation": operation, "parameters": parameters, "data": name}
        stream = self._fs.create(self._path(f"{self.path}/_log/{version}.json"), False)
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()
        return version

    def to_df(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest unless one is given."""
        known = self.versions()
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"version {version} does not exist; known: {known}")
        return self.spark.read.parquet(f"{self.path}/{self._entry(version)['data']}")

    def history(self, limit: int | None = None) -> DataFrame:
        """Commits, the latest first."""
        entries = [self._entry(v) for v in reversed(self.versions())][:limit]
        rows = [(e["version"], float(e["timestamp"]), e["operation"], json.dumps(e["parameters"])) for e in entries]
        out = self.spark.createDataFrame(rows, "version long, at double, operation string, operation_parameters string")
        return out.select("version", F.timestamp_seconds("at").alias("timestamp"), "operation", "operation_parameters")

    def detail(self) -> DataFrame:
        files = self.to_df().inputFiles()
        size = sum(self._fs.getFileStatus(self._path(f)).getLen() for f in files)
        row = [("parquet", self.path, self.version, len(files), size)]
        return self.spark.createDataFrame(row, "format string, location string, version long, num_files long, size_in_bytes long")

    # --- changes -----------------------------------------------------------------------------------------------------

    def append(self, df: DataFrame, merge_schema: bool = False) -> int:
        now = self.to_df()
        if not merge_schema and set(df.columns) != set(now.columns):
            raise ValueError(f"columns differ: {sorted(set(df.columns) ^ set(now.columns))}; merge_schema=True adds them")
        return self._commit(now.unionByName(df, allowMissingColumns=merge_schema), "WRITE", {"mode": "Append"}, self.version)

    def overwrite(self, df: DataFrame) -> int:
        return self._commit(df, "WRITE", {"mode": "Overwrite"}, self.version)

    def delete(self, condition: str | Column | None = None) -> int:
        """Delete the rows for which the condition is true; rows for which it is null stay."""
        now = self.to_df()
        hit = F.lit(True) if condition is None else F.coalesce(_expr(condition), F.lit(False))
        return self._commit(now.filter(~hit), "DELETE", {"predicate": str(condition)}, self.version)

    def update(self, values: Values, condition: str | Column | None = None) -> int:
        now = self.to_df()
        hit = F.lit(True) if condition is None else F.coalesce(_expr(condition), F.lit(False))
        changed = {c: F.when(hit, _expr(v).cast(now.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
        return self._commit(now.select(*[changed.get(c, F.col(c)).alias(c) for c in now.columns]), "UPDATE", {"predicate": str(condition)}, self.version)

    def merge(self, source: DataFrame, condition: str | Column) -> Merge:
        """A merge whose expressions call the table `target` and the source `source`."""
        return Merge(self, source, condition)

    def restore(self, version: int) -> int:
        return self._commit(self.to_df(version), "RESTORE", {"version": version}, self.version)

    def optimize(self, files: int = 1, order_by: list[str] | None = None) -> int:
        """Rewrite the rows in fewer files, in order if columns are given."""
        now = self.to_df()
        now = now.repartitionByRange(files, *order_by).sortWithinPartitions(*order_by) if order_by else now.coalesce(files)
        return self._commit(now, "OPTIMIZE", {"files": files}, self.version)

    def vacuum(self, keep: int = 1) -> list[int]:
        """Remove all but the last versions; gives those removed."""
        gone = self.versions()[:-keep]
        for v in gone:
            data = self._entry(v)["data"]
            self._fs.delete(self._path(f"{self.path}/_log/{v}.json"), False)
            self._fs.delete(self._path(f"{self.path}/{data}"), True)
        return gone


@dataclass
class _Clause:
    when: str
    action: str
    condition: str | Column | None
    values: Values | None


@dataclass
class Merge:
    """Clauses of a merge, tried in the order in which they were added; the first whose condition holds applies."""

    table: VersionedTable
    source: DataFrame
    condition: str | Column
    clauses: list[_Clause] = field(default_factory=list)

    def _add(self, when: str, action: str, condition: str | Column | None, values: Values | None) -> Merge:
        self.clauses.append(_Clause(when, action, condition, values))
        return self

    def when_matched_update(self, values: Values, condition: str | Column | None = None) -> Merge:
        return self._add("matched", "update", condition, values)

    def when_matched_update_all(self, condition: str | Column | None = None) -> Merge:
        return self._add("matched", "update", condition, None)

    def when_matched_delete(self, condition: str | Column | None = None) -> Merge:
        return self._add("matched", "delete", condition, None)

    def when_not_matched_insert(self, values: Values, condition: str | Column | None = None) -> Merge:
        return self._add("source", "insert", condition, values)

    def when_not_matched_insert_all(self, condition: str | Column | None = None) -> Merge:
        return self._add("source", "insert", condition, None)

    def when_not_matched_by_source_update(self, values: Values, condition: str | Column | None = None) -> Merge:
        return self._add("target", "update", condition, values)

    def when_not_matched_by_source_delete(self, condition: str | Column | None = None) -> Merge:
        return self._add("target", "delete", condition, None)

    def result(self) -> DataFrame:
        """The rows after the merge. Rows of the table that several source rows match raise an error when it runs."""
        now = self.table.to_df()
        target = now.withColumn("__t", F.monotonically_increasing_id()).alias("target")
        joined = target.join(self.source.withColumn("__s", F.lit(1)).alias("source"), _expr(self.condition), "full_outer")
        is_t, is_s = F.col("target.__t").isNotNull(), F.col("source.__s").isNotNull()
        side = {"matched": is_t & is_s, "source": ~is_t & is_s, "target": is_t & ~is_s}
        chosen, kept = F.lit(-1), {}
        for i, c in reversed(list(enumerate(self.clauses))):
            hit = side[c.when] if c.condition is None else side[c.when] & F.coalesce(_expr(c.condition), F.lit(False))
            chosen = F.when(hit, F.lit(i)).otherwise(chosen)
        joined = joined.withColumn("__clause", chosen)
        names = set(self.source.columns)
        for column in now.columns:
            value = F.col(f"target.{column}")
            for i, c in enumerate(self.clauses):
                if c.action == "delete":
                    continue
                if c.values is None:
                    new = F.col(f"source.{column}") if column in names else (value if c.action == "update" else F.lit(None))
                elif column in c.values:
                    new = _expr(c.values[column])
                else:
                    new = F.col(f"target.{column}") if c.action == "update" else F.lit(None)
                value = F.when(F.col("__clause") == i, new.cast(now.schema[column].dataType)).otherwise(value)
            kept[column] = value
        deletes = [i for i, c in enumerate(self.clauses) if c.action == "delete"]
        stays = ~F.col("__clause").isin(deletes) if deletes else F.lit(True)
        stays = stays & (is_t | (F.col("__clause") >= 0))
        rows = joined.select(F.col("target.__t").alias("__t"), stays.alias("__stays"), *[v.alias(c) for c, v in kept.items()])
        self._reject_ambiguous(joined)
        return rows.filter("__stays").select(*now.columns)

    def _reject_ambiguous(self, joined: DataFrame) -> None:
        if not any(c.when == "matched" for c in self.clauses):
            return
        twice = joined.filter(F.col("source.__s").isNotNull() & F.col("target.__t").isNotNull()).groupBy("target.__t").count().filter("count > 1")
        if not twice.isEmpty():
            raise ValueError("several source rows match one row of the table")

    def execute(self) -> int:
        parameters = {"condition": str(self.condition), "clauses": [f"{c.when} {c.action}" for c in self.clauses]}
        return self.table._commit(self.result(), "MERGE", parameters, self.table.version)
