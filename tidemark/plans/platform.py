"""SQL text, statistics, user functions, sources, versioned tables, time windows and streams as queries."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd

from tidemark import functions as F
from tidemark.operators import frame
from tidemark.plans.registry import register, table
from tidemark.sources import io
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import events as streams


def scratch(spark, what: str) -> str:
    """A new path in the folder that executors share, or in one of our own where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


# --- SQL text --------------------------------------------------------------------------------------------------------


def sql_query(name: str, tables: str, text: str, oracle: str | None = None, args=None) -> None:
    """The same text on both sides, over temporary views."""

    @register(name, oracle or text)
    def query(spark, d):
        names = tables.split()
        frames = {t: table(spark, d, t) for t in names}
        return spark.sql(_bound(text, names), args=args, **frames)


def _bound(text: str, names: list[str]) -> str:
    """Table names after FROM and JOIN as placeholders for frames."""
    return re.sub(rf"(?i)\b(FROM|JOIN)\s+({'|'.join(names)})\b", r"\1 {\2}", text)


sql_query("sql_cte_subquery", "orders customer", """WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey)
SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND n > 2""")
sql_query("sql_window_having", "lineitem", """SELECT l_suppkey, n, rank() OVER (ORDER BY n DESC, l_suppkey) AS place FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500) t""",
          """SELECT l_suppkey, n, CAST(rank() OVER (ORDER BY n DESC, l_suppkey) AS INTEGER) AS place FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500) t""")
sql_query("sql_set_operations", "nation supplier", "(SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION (SELECT n_nationkey FROM nation INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
sql_query("sql_exists_case", "customer orders", """SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'yes' ELSE 'no' END AS finished FROM customer""")
sql_query("sql_lateral_values", "region", "SELECT r_name, v.x AS x FROM region CROSS JOIN (VALUES (1), (2)) AS v(x)")
sql_query("sql_parameters", "part", "SELECT p_partkey FROM part WHERE p_size > :low AND p_type = :kind", "SELECT p_partkey FROM part WHERE p_size > 40 AND p_type = 'ECONOMY'", args={"low": 40, "kind": "ECONOMY"})
sql_query("sql_distinct_order_limit", "orders", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 3")


@register("sql_ddl_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def sql_ddl_table(spark, d):
    """CREATE TABLE AS, INSERT INTO and a query of the table, in the session catalog."""
    name = f"segments_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT * FROM {{c}} WHERE c_acctbal > 0", c=table(spark, d, "customer"))
    spark.sql(f"INSERT INTO {name} SELECT * FROM {{c}} WHERE NOT c_acctbal > 0", c=table(spark, d, "customer"))
    out, path = spark.sql(f"SELECT c_mktsegment, count(*) AS n FROM {name} GROUP BY c_mktsegment"), scratch(spark, "segments")
    io.write(out, path)
    io.drop_table(spark, name)
    return io.read(spark, path, schema="c_mktsegment string, n bigint")


# --- statistics ------------------------------------------------------------------------------------------------------


@register("stats_crosstab", "SELECT event_type AS event_type_day, CAST(count(*) FILTER (WHERE day(ts) <= 10) AS BIGINT) AS early, CAST(count(*) FILTER (WHERE day(ts) > 10) AS BIGINT) AS late FROM events GROUP BY 1")
def stats_crosstab(spark, d):
    e = table(spark, d, "events").withColumn("day", F.when(F.day("ts") <= 10, "early").otherwise("late"))
    return frame.crosstab(e, "event_type", "day", ["early", "late"])


@register("stats_describe")
def stats_describe(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_extendedprice").describe()


@register("stats_summary")
def stats_summary(spark, d):
    return table(spark, d, "lineitem").select("l_quantity", "l_discount").summary("count", "min", "50%", "max")


@register("stats_freq_items")
def stats_freq_items(spark, d):
    return table(spark, d, "lineitem").freqItems(["l_returnflag"], 0.3)


@register("stats_null_handling", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(status, 'none') AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS status FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON c_custkey = o_custkey")
def stats_null_handling(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("status"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left").select("c_custkey", "n", "status").na.fill({"n": 0, "status": "none"})


@register("stats_replace_dropna", "SELECT event_id, CASE event_type WHEN 'click' THEN 'tap' ELSE event_type END AS event_type FROM events WHERE event_type <> 'error'")
def stats_replace_dropna(spark, d):
    e = table(spark, d, "events").select("event_id", F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"))
    return frame.drop_nulls(e, subset=["event_type"]).replace("click", "tap", ["event_type"])


@register("hash_sample_rows")
def hash_sample_rows(spark, d):
    return frame.hash_sample(table(spark, d, "orders"), "o_orderkey", 0.1)


@register("partition_facts", "SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS ids FROM region")
def partition_facts(spark, d):
    t = table(spark, d, "region").select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), F.input_file_name().alias("f"))
    return t.agg(F.count("f").alias("n"), F.count_distinct("i").alias("ids"))


# --- user functions --------------------------------------------------------------------------------------------------


@register("udf_scalar_pandas", "SELECT p_partkey, round(p_retailprice * 1.2, 4) AS gross FROM part")
def udf_scalar_pandas(spark, d):
    @F.pandas_udf("double")
    def gross(price: pd.Series) -> pd.Series:
        return (price * 1.2).round(4)

    return table(spark, d, "part").select("p_partkey", gross("p_retailprice").alias("gross"))


@register("udf_scalar_arrow", "SELECT p_partkey, p_name || '!' AS loud FROM part")
def udf_scalar_arrow(spark, d):
    loud = F.udf(lambda s: s + "!", "string", useArrow=True)
    return table(spark, d, "part").select("p_partkey", loud("p_name").alias("loud"))


@register("udf_grouped_aggregate", "SELECT p_type, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY 1")
def udf_grouped_aggregate(spark, d):
    """A row for each type and batch first, so a hot type's group holds two numbers a batch."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.groupby("p_type", dropna=False).p_retailprice.agg(low="min", high="max").reset_index()

    @F.pandas_udf("double")
    def spread(low: pd.Series, high: pd.Series) -> float:
        return round(high.max() - low.min(), 4)

    parts = table(spark, d, "part").select("p_type", "p_retailprice").mapInPandas(ends, "p_type string, low double, high double")
    return parts.groupBy("p_type").agg(spread("low", "high").alias("spread"))


@register("udf_map_in_pandas", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 490000")
def udf_map_in_pandas(spark, d):
    def large(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[b.o_totalprice > 490000]

    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").mapInPandas(large, "o_orderkey long, o_totalprice double")


@register("udf_apply_in_pandas", "SELECT s_suppkey, s_nationkey, round(s_acctbal - min(s_acctbal) OVER (PARTITION BY s_nationkey), 2) AS above FROM supplier")
def udf_apply_in_pandas(spark, d):
    """The least balance of a nation comes from an aggregate, so groups may be cut: one holds 4,096 keys at most."""

    def above(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(above=(g.s_acctbal - g.low).round(2))[["s_suppkey", "s_nationkey", "above"]]

    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    least = s.groupBy(F.col("s_nationkey").alias("of")).agg(F.min("s_acctbal").alias("low"))
    parts = s.join(least, F.col("s_nationkey").eqNullSafe(F.col("of"))).withColumn("part", F.shiftright("s_suppkey", 12))
    return parts.groupBy("s_nationkey", "part").applyInPandas(above, "s_suppkey long, s_nationkey int, above double")


@register("udtf_words", "SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey FROM part")
def udtf_words(spark, d):
    class Words:
        def eval(self, key: int, text: str):
            for w in text.split(" "):
                yield w, key

    f = F.udtf(Words, returnType="word string, p_partkey bigint")
    spark.udtf.register("tidemark_words", f)
    return spark.sql("SELECT w.word, w.p_partkey FROM {part} p, LATERAL tidemark_words(p.p_partkey, p.p_name) w", part=table(spark, d, "part"))


# --- sources and versioned tables ------------------------------------------------------------------------------------


def _round_trip(kind: str) -> None:
    @register(f"source_{kind}", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
    def trip(spark, d):
        t, path = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), scratch(spark, kind)
        io.write(t, path, kind)
        return io.read(spark, path, kind, schema="s_suppkey bigint, s_name string, s_acctbal double")


for _kind in ("parquet", "csv", "json", "orc"):
    _round_trip(_kind)


@register("source_text", "SELECT s_name AS value FROM supplier")
def source_text(spark, d):
    path = scratch(spark, "text")
    io.write(table(spark, d, "supplier").select("s_name"), path, "text")
    return io.read(spark, path, "text")


@register("source_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_partitioned(spark, d):
    path = scratch(spark, "parts")
    io.write(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return io.read(spark, path).filter("o_orderstatus = 'F'")


def _accounts(spark, d) -> VersionedTable:
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return VersionedTable.create(t, scratch(spark, "versioned"))


@register(
    "versioned_merge",
    """SELECT c_custkey, c_mktsegment, CASE WHEN o_custkey IS NOT NULL THEN c_acctbal + total ELSE c_acctbal END AS c_acctbal FROM customer
    LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey
    WHERE NOT (o_custkey IS NOT NULL AND total > 1000000) AND NOT (o_custkey IS NULL AND c_acctbal < 0)
    UNION ALL SELECT -1 - n_nationkey, 'NEW', 0.0 FROM nation""",
)
def versioned_merge(spark, d):
    t = _accounts(spark, d)
    due = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    new = table(spark, d, "nation").selectExpr("-1L - n_nationkey AS o_custkey", "0.0D AS total")
    merge = t.merge(due.unionByName(new), "target.c_custkey = source.o_custkey")
    merge.when_matched_delete("source.total > 1000000").when_matched_update({"c_acctbal": "target.c_acctbal + source.total"})
    merge.when_not_matched_insert({"c_custkey": "source.o_custkey", "c_mktsegment": "'NEW'", "c_acctbal": "source.total"})
    merge.when_not_matched_by_source_delete("target.c_acctbal < 0").execute()
    return t.to_df()


@register("versioned_update_delete", "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE NOT c_acctbal < 0")
def versioned_update_delete(spark, d):
    t = _accounts(spark, d)
    t.delete("c_acctbal < 0")
    t.update({"c_acctbal": "c_acctbal * 2"}, "c_mktsegment = 'MACHINERY'")
    return t.to_df()


@register("versioned_time_travel", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def versioned_time_travel(spark, d):
    t = _accounts(spark, d)
    t.delete("c_custkey % 2 = 0")
    return t.to_df(0)


@register("versioned_history", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'DELETE'), (0, 'CREATE TABLE AS SELECT')) AS v(version, operation)")
def versioned_history(spark, d):
    t = _accounts(spark, d)
    t.delete("c_custkey % 2 = 0")
    return t.history().select("version", "operation")


# --- time windows and streams ----------------------------------------------------------------------------------------


def _ts(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_DAILY = """SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"""


@register("time_window_tumbling", _DAILY)
def time_window_tumbling(spark, d):
    w = streams.windowed_counts(_ts(spark, d))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@register("time_window_sliding", "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY ALL")
def time_window_sliding(spark, d):
    w = streams.windowed_counts(_ts(spark, d), "1 day", "12 hours")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@register(
    "time_window_session",
    """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL
    OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""",
)
def time_window_session(spark, d):
    s = streams.session_counts(_ts(spark, d))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@register("stream_windowed_counts", _DAILY)
def stream_windowed_counts(spark, d):
    """The tumbling window as a stream: update batches written by batch number, the last state of a window kept."""
    schema, out = table(spark, d, "events").schema, scratch(spark, "stream")
    counts = streams.windowed_counts(streams.event_stream(spark, f"{d}/{{events.parquet}}", schema), late="60 days")
    streams.drain_batches(counts, lambda df, i: df.withColumn("batch", F.lit(i)).write.parquet(f"{out}/b={i}"), scratch(spark, "checkpoint"))
    rows = spark.read.parquet(f"{out}/*").groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "v.n", F.round("v.total", 2).alias("total"))


@register("stream_deduplicated", "SELECT count(DISTINCT event_id) AS n FROM events")
def stream_deduplicated(spark, d):
    schema, out = table(spark, d, "events").schema, scratch(spark, "stream")
    rows = streams.first_of_each(streams.event_stream(spark, f"{d}/{{events.parquet}}", schema), ["event_id"]).select("event_id")
    streams.drain(rows, out, scratch(spark, "checkpoint"))
    return spark.read.schema("event_id bigint").parquet(out).agg(F.count(F.lit(1)).alias("n"))
