"""DataFrame, grouped-data, catalog and RDD methods that the other modules do not use."""

from __future__ import annotations

import uuid

from tidemark import functions as F
from tidemark.operators import frame
from tidemark.plans.registry import register, table


@register("frame_renaming", "SELECT n_nationkey AS key, n_name AS label, n_regionkey AS region FROM nation WHERE n_nationkey < 10")
def frame_renaming(spark, d):
    n = table(spark, d, "nation").toDF("key", "label", "region").alias("n").hint("coalesce", 1)
    return n.transform(lambda t: t.where("key < 10")).select(n.colRegex("`(key|label|region)`"))


@register("frame_select_expr", "SELECT p_partkey, upper(p_name) AS shout, p_size * 2 AS twice FROM part WHERE p_size IN (1, 2)")
def frame_select_expr(spark, d):
    return table(spark, d, "part").where("p_size IN (1, 2)").selectExpr("p_partkey", "upper(p_name) AS shout", "p_size * 2 AS twice")


@register("frame_grouped_methods", "SELECT c_mktsegment, CAST(sum(c_custkey) AS BIGINT) AS s, min(c_acctbal) AS low, max(c_acctbal) AS high, count(*) AS n FROM customer GROUP BY 1")
def frame_grouped_methods(spark, d):
    """The methods of a grouping, each over the rows that one scan and one aggregation have left of a segment and sign."""
    c = table(spark, d, "customer").withColumn("sign", F.sign("c_acctbal")).groupBy("c_mktsegment", "sign")
    c = c.agg(F.sum("c_custkey").alias("s"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count(F.lit(1)).alias("n")).persist()
    g = c.groupby("c_mktsegment")
    out = g.sum("s", "n").join(g.min("low"), "c_mktsegment").join(g.max("high"), "c_mktsegment")
    return out.select("c_mktsegment", F.col("sum(s)").alias("s"), F.col("min(low)").alias("low"), F.col("max(high)").alias("high"), F.col("sum(n)").alias("n"))


@register("frame_aggregate_by_name", "SELECT p_type, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def frame_aggregate_by_name(spark, d):
    return frame.grouped(table(spark, d, "part").groupBy("p_type"), "count_distinct", "p_brand").toDF("p_type", "brands")


@register("frame_aggregate_dict", "SELECT p_type, max(p_size) AS high, min(p_retailprice) AS low FROM part GROUP BY 1")
def frame_aggregate_dict(spark, d):
    out = table(spark, d, "part").groupBy("p_type").agg({"p_size": "max", "p_retailprice": "min"})
    return out.select("p_type", F.col("max(p_size)").alias("high"), F.col("min(p_retailprice)").alias("low"))


@register("frame_melt", "SELECT p_partkey, 'p_name' AS variable, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part")
def frame_melt(spark, d):
    return table(spark, d, "part").melt(["p_partkey"], ["p_name", "p_brand"], "variable", "value")


@register("frame_statistics", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS v FROM lineitem")
def frame_statistics(spark, d):
    return table(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("v"))


@register("frame_samples")
def frame_samples(spark, d):
    """A sampling operator, its stratified form and a split: shares, not rows, are fixed."""
    e = table(spark, d, "events")
    left, right = e.randomSplit([0.7, 0.3], 5)
    parts = {"sample": e.sample(0.2, seed=3), "by": e.sampleBy("event_type", {"click": 0.5}, 3), "left": left, "right": right}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


@register("frame_catalog_view", "SELECT r_regionkey, r_name FROM region")
def frame_catalog_view(spark, d):
    """A temporary view, through the catalog."""
    name = f"regions_{uuid.uuid4().hex}"
    table(spark, d, "region").createOrReplaceTempView(name)
    assert spark.catalog.tableExists(name)
    return spark.read.table(name)


@register("frame_cached_twice", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part")
def frame_cached_twice(spark, d):
    """One cached column read by two aggregates."""
    p = table(spark, d, "part").select("p_size").persist()
    n, total = p.agg(F.count(F.lit(1)).alias("n")), p.agg(F.sum("p_size").alias("s"))
    return n.join(total)


@register("rdd_reduce_by_key", "SELECT p_type, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY 1")
def rdd_reduce_by_key(spark, d):
    """The RDD surface (map, reduceByKey, toDF); the DataFrame form is faster."""
    pairs = table(spark, d, "part").select("p_type", "p_size").rdd.map(lambda r: (r.p_type, r.p_size)).reduceByKey(lambda a, b: a + b)
    return spark.createDataFrame(pairs, "p_type string, s long")


@register("rdd_map_partitions", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n FROM part")
def rdd_map_partitions(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return frame.map_partitions(rows, lambda it: ((r.p_partkey, len(r.p_name)) for r in it), "p_partkey long, n long")


@register("range_rows", "SELECT n.range AS id, n.range * n.range AS square FROM (SELECT unnest(range(0, (SELECT count(*) FROM nation), 2)) AS range) n")
def range_rows(spark, d):
    n = table(spark, d, "nation").count()
    return spark.range(0, n, 2).withColumn("square", F.col("id") * F.col("id"))


@register("bitmap_aggregates", "SELECT c_mktsegment, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n FROM customer GROUP BY 1")
def bitmap_aggregates(spark, d):
    """Exact distinct counts through bitmaps that merge: one bitmap for each bucket of keys, then their bit counts."""
    c = table(spark, d, "customer").withColumn("b", F.bitmap_bucket_number("c_custkey"))
    first = c.groupBy("c_mktsegment", "b").agg(F.bitmap_construct_agg(F.bitmap_bit_position("c_custkey")).alias("m"))
    merged = first.groupBy("c_mktsegment", "b").agg(F.bitmap_or_agg("m").alias("m"))
    return merged.groupBy("c_mktsegment").agg(F.sum(F.bitmap_count("m")).alias("n"))


@register("null_safe_numbers", "SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS bad, value / nullif(user_id % 3, 0) AS q FROM events")
def null_safe_numbers(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.cast("event_type", "double").alias("bad"), F.try_divide("value", F.col("user_id") % 3).alias("q"))


@register("try_aggregates", "SELECT event_type, round(sum(value), 2) AS s, round(avg(value), 4) AS a FROM events GROUP BY 1")
def try_aggregates(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.try_sum("value"), 2).alias("s"), F.round(F.try_avg("value"), 4).alias("a"))
