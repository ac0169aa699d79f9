"""Grouped, global and multi-dimensional aggregation, pivots and windows."""

from __future__ import annotations

from pyspark.sql import Window

from tidemark import functions as F
from tidemark.operators import frame
from tidemark.plans.registry import register, table


def _r(c, alias, digits=4):
    return F.round(c, digits).alias(alias)


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty,
    round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        _r(F.sum("l_quantity"), "sum_qty", 2),
        _r(F.sum("l_extendedprice"), "sum_base", 2),
        _r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), "sum_disc", 2),
        _r(F.avg("l_quantity"), "avg_qty"),
        _r(F.avg("l_discount"), "avg_disc"),
        F.count(F.lit(1)).alias("n"),
    )


@register(
    "aggregate_basic",
    """SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_totalprice) AS low, max(o_totalprice) AS high,
    round(avg(o_totalprice), 4) AS mean, CAST(sum(o_custkey) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS n_if,
    bool_and(o_totalprice > 0) AS all_positive, bool_or(o_totalprice > 499000) AS some_large FROM orders GROUP BY 1""",
)
def aggregate_basic(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min(p).alias("low"), F.max(p).alias("high"),
        _r(F.mean(p), "mean"), F.sum("o_custkey").alias("total"), F.count_if(p > 200000).alias("n_if"),
        F.bool_and(p > 0).alias("all_positive"), F.bool_or(p > 499000).alias("some_large"),
    )


@register(
    "aggregate_statistics",
    """SELECT l_returnflag, round(stddev_samp(l_extendedprice), 3) AS sd, round(stddev_pop(l_extendedprice), 3) AS sdp,
    round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c,
    round(covar_samp(l_quantity, l_extendedprice), 2) AS cs, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp,
    round(kurtosis_pop(l_quantity), 5) AS k,
    round((sum(power(l_quantity - m, 3)) / count(*)) / power(var_pop(l_quantity), 1.5), 5) AS s
    FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY 1""",
)
def aggregate_statistics(spark, d):
    q, p = "l_quantity", "l_extendedprice"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        _r(F.stddev(p), "sd", 3), _r(F.stddev_pop(p), "sdp", 3), _r(F.variance(q), "v"), _r(F.var_pop(q), "vp"), _r(F.corr(q, p), "c", 6),
        _r(F.covar_samp(q, p), "cs", 2), _r(F.covar_pop(q, p), "cp", 2), _r(F.kurtosis(q), "k", 5), _r(F.skewness(q), "s", 5),
    )


@register(
    "aggregate_regression",
    """SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icpt,
    round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n,
    round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay,
    round(regr_sxx(l_extendedprice, l_quantity), 1) AS sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 1) AS sxy,
    round(regr_syy(l_extendedprice, l_quantity) / 1000000, 1) AS syy FROM lineitem GROUP BY 1""",
)
def aggregate_regression(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(
        _r(F.regr_slope(y, x), "slope"), _r(F.regr_intercept(y, x), "icpt", 3), _r(F.regr_r2(y, x), "r2", 6), F.regr_count(y, x).alias("n"),
        _r(F.regr_avgx(y, x), "ax"), _r(F.regr_avgy(y, x), "ay", 3), _r(F.regr_sxx(y, x), "sxx", 1), _r(F.regr_sxy(y, x) / 1000, "sxy", 1),
        _r(F.regr_syy(y, x) / 1000000, "syy", 1),
    )


@register(
    "aggregate_order_statistics",
    """SELECT p_brand, median(p_retailprice) AS med, quantile_cont(p_retailprice, 0.25) AS q1, max_by(p_partkey, p_retailprice * 1000000 + p_partkey) AS priciest,
    min_by(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest, mode(p_type ORDER BY p_type) IS NOT NULL AS has_mode, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes FROM part GROUP BY 1""",
)
def aggregate_order_statistics(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.median(p).alias("med"), F.percentile(p, 0.25).alias("q1"), F.max_by("p_partkey", p * 1000000 + F.col("p_partkey")).alias("priciest"),
        F.min_by("p_partkey", p * 1000000 + F.col("p_partkey")).alias("cheapest"), F.mode("p_type").isNotNull().alias("has_mode"), F.sum_distinct(F.col("p_size")).alias("sizes"),
    )


@register(
    "aggregate_bits",
    """SELECT p_brand, bit_and(p_partkey) AS a, bit_or(p_partkey) AS o, bit_xor(p_partkey) AS x, round(product(1 + p_size / 1000.0), 4) AS pr FROM part GROUP BY 1""",
)
def aggregate_bits(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(
        F.bit_and("p_partkey").alias("a"), F.bit_or("p_partkey").alias("o"), F.bit_xor("p_partkey").alias("x"), _r(F.product(1 + F.col("p_size") / 1000), "pr")
    )


@register(
    "aggregate_collect",
    """SELECT n_regionkey, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT length(n_name)::INTEGER)) AS lengths,
    string_agg(n_name, '|' ORDER BY n_name) AS joined, first(n_regionkey) AS f, any_value(n_regionkey) AS a FROM nation GROUP BY 1""",
)
def aggregate_collect(spark, d):
    """Groups of a dimension table of fixed size."""
    return table(spark, d, "nation").groupBy("n_regionkey").agg(
        F.sort_array(F.collect_list("n_name")).alias("names"), F.sort_array(F.collect_set(F.length("n_name"))).alias("lengths"),
        F.array_join(F.sort_array(F.array_agg("n_name")), "|").alias("joined"), F.first("n_regionkey").alias("f"), F.any_value("n_regionkey").alias("a"),
    )


@register("aggregate_global", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_tax), 6) AS tax, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def aggregate_global(spark, d):
    return table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), _r(F.sum("l_extendedprice"), "total", 2), _r(F.avg("l_tax"), "tax", 6), F.countDistinct("l_suppkey").alias("suppliers"))


@register("aggregate_distinct_skew_safe", "SELECT event_type, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY 1")
def aggregate_distinct_skew_safe(spark, d):
    return frame.two_phase_distinct(table(spark, d, "events"), ["event_type"], "user_id")


@register("aggregate_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) >= 12 AND sum(o_totalprice) > 1000000")
def aggregate_having(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    return g.filter((g.n >= 12) & (g.t > 1000000)).select("o_custkey", "n", F.round("t", 2).alias("total"))


@register("approximate_distinct", None)
def approximate_distinct(spark, d):
    """Sketches: HyperLogLog++ and the approximate percentile. Estimates, so only their shape is fixed."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_quantity", [0.25, 0.5, 0.75], 1000).alias("quartiles")
    )


_CUBE = "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q, CAST({} AS BIGINT) AS gid FROM lineitem GROUP BY {}"


@register("rollup_levels", _CUBE.format("grouping(l_returnflag, l_linestatus)", "ROLLUP (l_returnflag, l_linestatus)"))
def rollup_levels(spark, d):
    g = table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), _r(F.sum("l_quantity"), "q", 2), F.grouping_id().alias("gid"))


@register("cube_subsets", _CUBE.format("grouping(l_returnflag, l_linestatus)", "CUBE (l_returnflag, l_linestatus)"))
def cube_subsets(spark, d):
    g = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), _r(F.sum("l_quantity"), "q", 2), F.grouping_id().alias("gid"))


@register("grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, d, "lineitem").groupingSets([[a], [b], []], a, b).agg(F.count(F.lit(1)).alias("n"))


@register(
    "pivot_values",
    """SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS f, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS o FROM lineitem GROUP BY 1""",
)
def pivot_values(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", _r(F.col("F"), "f", 2), _r(F.col("O"), "o", 2))


@register(
    "pivot_several",
    """SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS click_n, round(sum(value) FILTER (WHERE event_type = 'click'), 2) AS click_total,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS view_n, round(sum(value) FILTER (WHERE event_type = 'view'), 2) AS view_total FROM events GROUP BY 1""",
)
def pivot_several(spark, d):
    g = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view"])
    p = g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return p.na.fill(0, ["click_n", "view_n"])


@register("unpivot_columns", "SELECT s_suppkey, 'acctbal' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def unpivot_columns(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "s_acctbal AS acctbal", "cast(s_nationkey AS double) AS nation")
    return frame.unpivot(s, ["s_suppkey"], ["acctbal", "nation"])


# --- windows ---------------------------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def _orders(spark, d):
    return table(spark, d, "orders"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


@register(
    "window_ranking",
    """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER v AS INTEGER) AS rk, CAST(dense_rank() OVER v AS INTEGER) AS dr,
    CAST(ntile(4) OVER w AS INTEGER) AS nt, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""",
)
def window_ranking(spark, d):
    t, w = _orders(spark, d)
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t.select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"),
        F.ntile(4).over(w).alias("nt"), _r(F.percent_rank().over(v), "pr", 6), _r(F.cume_dist().over(v), "cd", 6),
    )


@register(
    "window_offsets",
    f"""SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, -1.0) OVER w AS after2, first_value(o_orderkey) OVER w AS f,
    last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
    nth_value(o_orderkey, 3) OVER w AS third FROM orders {_W}""",
)
def window_offsets(spark, d):
    t, w = _orders(spark, d)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.select(
        "o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, -1.0).over(w).alias("after2"),
        F.first_value("o_orderkey").over(w).alias("f"), F.last_value("o_orderkey").over(whole).alias("l"), F.nth_value("o_orderkey", 3).over(w).alias("third"),
    )


@register(
    "window_frames",
    """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS moving,
    max(o_totalprice) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n,
    round(CAST(count(*) OVER (PARTITION BY o_custkey) AS DOUBLE) * o_totalprice, 2) AS off_mean FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def window_frames(spark, d):
    t, w = _orders(spark, d)
    whole, p = Window.partitionBy("o_custkey"), F.col("o_totalprice")
    return t.select(
        "o_orderkey", _r(F.sum(p).over(w), "running", 2), _r(F.avg(p).over(w.rowsBetween(-2, 0)), "moving", 3),
        F.max(p).over(w.rowsBetween(1, 3)).alias("ahead"), F.count(F.lit(1)).over(whole).alias("n"), _r(F.count(F.lit(1)).over(whole) * p, "off_mean", 2),
    )


@register(
    "window_range_frame",
    """SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS day_count FROM events""",
)
def window_range_frame(spark, d):
    e = table(spark, d, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000))
    return e.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0)).alias("day_count"))


@register(
    "sessionize_events",
    """SELECT event_id, user_id, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000
    THEN 1 ELSE 0 END AS b FROM events)""",
)
def sessionize_events(spark, d):
    return frame.sessionize(table(spark, d, "events"), "user_id", "ts", 3600, "event_id").select("event_id", "user_id", "session")
