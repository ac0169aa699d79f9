"""Scans, filters, projections, joins, set operations, ordering and limits."""

from __future__ import annotations

from tidemark import functions as F
from tidemark.operators import frame
from tidemark.plans.platform import scratch
from tidemark.plans.registry import register, table

# --- filters and projections -----------------------------------------------------------------------------------------


@register(
    "filter_predicates",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_linestatus = 'O'
      AND l_shipdate < TIMESTAMP '1998-01-01' AND (l_discount > 0.05 OR l_tax <= 0.02)""",
)
def filter_predicates(spark, d):
    t = table(spark, d, "lineitem")
    hit = t.l_quantity.between(10, 20) & F.isin("l_returnflag", "A", "R") & ~(t.l_linestatus == "O")
    hit &= t.l_shipdate < F.lit("1998-01-01").cast("timestamp_ntz")
    return t.filter(hit & ((t.l_discount > 0.05) | (t.l_tax <= 0.02))).select("l_orderkey", "l_linenumber", "l_quantity")


@register(
    "filter_patterns",
    """SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%ring' OR p_name ILIKE 'RED%' OR regexp_matches(p_name, '^b.*t$'))
      AND p_brand IS NOT NULL AND starts_with(p_brand, 'Brand') AND contains(p_type, 'O')""",
)
def filter_patterns(spark, d):
    t = table(spark, d, "part")
    named = t.p_name.like("%ring") | t.p_name.ilike("RED%") | t.p_name.rlike("^b.*t$")
    return t.filter(named & t.p_brand.isNotNull() & t.p_brand.startswith("Brand") & t.p_type.contains("O")).select("p_partkey", "p_name")


@register(
    "project_arithmetic",
    """SELECT o_orderkey, round(o_totalprice * 1.1 - 5, 4) AS a, o_totalprice / nullif(o_custkey, 0) AS b,
      o_orderkey % 7 AS c, -o_orderkey AS e, o_totalprice > 200000 AND o_orderstatus = 'F' AS f,
      CAST(o_orderkey AS VARCHAR) AS g, o_orderstatus IS NOT DISTINCT FROM 'P' AS h FROM orders""",
)
def project_arithmetic(spark, d):
    t = table(spark, d, "orders")
    return t.select(
        "o_orderkey",
        F.round(t.o_totalprice * 1.1 - 5, 4).alias("a"),
        F.try_divide("o_totalprice", "o_custkey").alias("b"),
        (t.o_orderkey % 7).alias("c"),
        (-t.o_orderkey).alias("e"),
        ((t.o_totalprice > 200000) & (t.o_orderstatus == "F")).alias("f"),
        F.to_str("o_orderkey").alias("g"),
        t.o_orderstatus.eqNullSafe("P").alias("h"),
    )


@register(
    "project_columns",
    "SELECT c_custkey AS customer, c_mktsegment AS segment, c_acctbal + 1 AS balance_next, upper(c_mktsegment) AS shout FROM customer",
)
def project_columns(spark, d):
    t = table(spark, d, "customer").withColumnRenamed("c_custkey", "customer").withColumnsRenamed({"c_mktsegment": "segment"})
    t = t.withColumn("balance_next", F.col("c_acctbal") + 1).withColumns({"shout": F.upper("segment")})
    return t.drop("c_name", "c_nationkey", "c_acctbal")


@register("case_expression", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part")
def case_expression(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.case_when((s < 10, "small"), (s < 30, "medium"), else_value="large").alias("kind"))


# --- joins -----------------------------------------------------------------------------------------------------------


def _co(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 5000"), table(spark, d, "orders").filter("o_totalprice > 250000")


_CO = "(SELECT * FROM customer WHERE c_acctbal > 5000) c {} JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c_custkey = o_custkey"


def _join(how: str, sql: str) -> None:
    @register(f"join_{how}", f"SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM {_CO.format(sql)}")
    def join(spark, d):
        c, o = _co(spark, d)
        return c.join(o, c.c_custkey == o.o_custkey, how).select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL OUTER")):
    _join(_how, _sql)


@register("join_left_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_left_semi(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_semi").select("c_custkey")


@register("join_left_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 100000)")
def join_left_anti(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 100000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == o.o_custkey, "left_anti").select("c_custkey")


@register("join_cross_dimensions", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross_dimensions(spark, d):
    """Two dimension tables of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@register("join_natural", "SELECT n_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(spark, d):
    r = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return frame.natural_join(table(spark, d, "nation"), r).select("n_regionkey", "n_name", "r_name")


@register(
    "join_null_safe",
    """SELECT a.k AS k, CAST(a.n AS BIGINT) AS n, CAST(b.m AS BIGINT) AS m FROM
    (SELECT nullif(event_type, 'error') AS k, count(*) AS n FROM events GROUP BY 1) a JOIN
    (SELECT nullif(event_type, 'error') AS k, max(user_id) AS m FROM events GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""",
)
def join_null_safe(spark, d):
    e = table(spark, d, "events").withColumn("k", F.nullif(F.col("event_type"), F.lit("error")))
    a, b = e.groupBy("k").agg(F.count(F.lit(1)).alias("n")), e.groupBy("k").agg(F.max("user_id").alias("m"))
    return a.alias("a").join(b.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k"))).select("a.k", "n", "m")


@register(
    "join_theta",
    """SELECT l_orderkey, l_linenumber, o_orderkey FROM lineitem JOIN orders
    ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_extendedprice > o_totalprice / 4""",
)
def join_theta(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    on = (li.l_orderkey == o.o_orderkey) & (li.l_shipdate > o.o_orderdate) & (li.l_extendedprice > o.o_totalprice / 4)
    return li.join(o, on).select("l_orderkey", "l_linenumber", "o_orderkey")


@register("join_self_alias", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_alias(spark, d):
    n = table(spark, d, "nation")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return n.alias("a").join(n.alias("b"), on).select(F.col("a.n_name").alias("left_name"), F.col("b.n_name").alias("right_name"))


@register("join_broadcast_checked", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast_checked(spark, d):
    n, r = frame.bounded_broadcast(table(spark, d, "nation")), frame.bounded_broadcast(table(spark, d, "region"))
    s = table(spark, d, "supplier")
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@register(
    "join_salted",
    "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') p USING (user_id) GROUP BY ALL",
)
def join_salted(spark, d):
    e = table(spark, d, "events")
    buyers = e.filter("event_type = 'purchase'").select("user_id").distinct()
    return frame.salted_join(e, buyers, ["user_id"], 8).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "join_range",
    """SELECT l_orderkey, l_linenumber, p_partkey FROM (SELECT * FROM lineitem WHERE l_quantity > 45) l
    JOIN (SELECT p_partkey, p_retailprice * 30 AS low, p_retailprice * 30 + 50 AS high FROM part WHERE p_size = 7) p
    ON l_extendedprice >= low AND l_extendedprice < high""",
)
def join_range(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 45")
    p = table(spark, d, "part").filter("p_size = 7").selectExpr("p_partkey", "p_retailprice * 30 AS low", "p_retailprice * 30 + 50 AS high")
    return frame.range_join(li, p, "l_extendedprice", "low", "high", 50.0).select("l_orderkey", "l_linenumber", "p_partkey")


@register(
    "join_asof",
    """SELECT a.event_id AS event_id, a.user_id AS user_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error') a
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def join_asof(spark, d):
    e = table(spark, d, "events")
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    buys = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return frame.asof_join(errors, buys, "ts", ["user_id"], ["last_value"]).select("event_id", "user_id", "last_value")


# --- set operations --------------------------------------------------------------------------------------------------

_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier"


def _sets(spark, d):
    return (
        table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")),
        table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")),
    )


def _set_operation(name: str, sql: str, f) -> None:
    @register(f"set_{name}", sql)
    def operation(spark, d):
        return f(*_sets(spark, d))


for _name, _sql, _f in (
    ("union_all", f"{_A} UNION ALL {_B}", lambda a, b: a.unionAll(b)),
    ("union", f"{_A} UNION {_B}", lambda a, b: a.union(b).distinct()),
    ("intersect", f"{_A} INTERSECT {_B}", lambda a, b: a.intersect(b)),
    ("intersect_all", f"{_A} INTERSECT ALL {_B}", lambda a, b: a.intersectAll(b)),
    ("subtract", f"{_A} EXCEPT {_B}", lambda a, b: a.subtract(b)),
    ("except_all", f"{_A} EXCEPT ALL {_B}", lambda a, b: a.exceptAll(b)),
):
    _set_operation(_name, _sql, _f)


@register("union_by_name", "SELECT c_nationkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL FROM supplier")
def union_by_name(spark, d):
    c = table(spark, d, "customer").selectExpr("c_nationkey AS k", "c_acctbal AS v", "c_mktsegment AS s")
    return c.unionByName(table(spark, d, "supplier").selectExpr("s_acctbal AS v", "s_nationkey AS k"), allowMissingColumns=True)


@register("union_coerced", "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation UNION ALL SELECT r_name FROM region")
def union_coerced(spark, d):
    return frame.union_coerced(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), table(spark, d, "region").select("r_name"))


@register("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@register(
    "drop_duplicates_first",
    "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type",
)
def drop_duplicates_first(spark, d):
    """One row a key, chosen: an aggregate, since dropDuplicates keeps any."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


# --- order and limits ------------------------------------------------------------------------------------------------


@register("top_n_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_n_orders(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return t.orderBy(F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")).limit(25)


@register("limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 30")
def limit_offset(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(30).limit(10)


@register(
    "top_k_per_group",
    """SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment
    ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3""",
)
def top_k_per_group(spark, d):
    t = table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return frame.top_k(t, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@register("order_nulls", "SELECT user_id, k, row_number() OVER (ORDER BY k ASC NULLS LAST, user_id) AS place FROM (SELECT DISTINCT user_id, nullif(event_type, 'error') AS k FROM events)")
def order_nulls(spark, d):
    e = table(spark, d, "events").select("user_id", F.nullif(F.col("event_type"), F.lit("error")).alias("k")).distinct()
    return frame.numbered(e, [F.asc_nulls_last("k"), F.asc_nulls_last("user_id")], "place", scratch(spark, "ordered"))


@register("range_partitioned_sort", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def range_partitioned_sort(spark, d):
    t = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    return t.repartitionByRange(8, "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")
