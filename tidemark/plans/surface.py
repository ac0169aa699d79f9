"""Methods, functions, statements and options of the public surface that the other modules do not use."""

from __future__ import annotations

import json
import uuid

import pandas as pd

from tidemark import functions as F
from tidemark.operators import frame
from tidemark.plans.platform import scratch
from tidemark.plans.registry import register, table
from tidemark.sources import io
from tidemark.streaming import events as streams

C, L = F.col, F.lit


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex}"


def _saved(df, what: str):
    """df in the shared folder and read again, for results whose tables are dropped before they are used."""
    path = scratch(df.sparkSession, what)
    io.write(df, path)
    return io.read(df.sparkSession, path, schema=df.schema.simpleString()[7:-1].replace(":", " "))


# --- columns ---------------------------------------------------------------------------------------------------------


@register(
    "column_operators",
    """SELECT s_suppkey, s_suppkey <> 3 AS ne, pow(s_suppkey, 2) AS p, 2 * s_suppkey AS rm, 100.0::DOUBLE / (s_suppkey + 1) AS rd, 100 % (s_suppkey + 1) AS rr, pow(2.0::DOUBLE, s_suppkey % 8) AS rp,
    s_suppkey IN (1, 2, 3) AS isin, s_name LIKE '%1' AS tail, substr(s_name, 1, 4) AS head, s_acctbal IS NULL AS isnull, CAST(s_suppkey AS VARCHAR) AS text FROM supplier""",
)
def column_operators(spark, d):
    k, n = C("s_suppkey"), C("s_name")
    return table(spark, d, "supplier").select(
        "s_suppkey", (k != 3).alias("ne"), (k**2).alias("p"), (2 * k).alias("rm"), (100.0 / (k + 1)).alias("rd"), (100 % (k + 1)).alias("rr"), (2.0 ** (k % 8)).alias("rp"),
        k.isin(1, 2, 3).alias("isin"), n.endswith("1").alias("tail"), n.substr(1, 4).alias("head"), C("s_acctbal").isNull().alias("isnull"), k.astype("string").alias("text"),
    )


@register("column_fields", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, p_brand AS brand, p_size AS size, CASE WHEN p_size > 25 THEN 'large' WHEN p_size > 10 THEN 'medium' END AS kind FROM part")
def column_fields(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.split("p_name", " ").alias("words"), F.struct("p_brand").alias("s"), F.create_map(L("size"), "p_size").alias("m"))
    kind = F.when(C("p_size") > 25, "large").when(C("p_size") > 10, "medium")
    return p.select("p_partkey", C("words").getItem(0).name("first"), C("s").getField("p_brand").alias("brand"), C("m").getItem("size").alias("size"), kind.alias("kind"))


@register("column_mixed_types", "SELECT o_orderkey, o_orderkey IN (1, 2, 5, 32) AS among, o_orderkey BETWEEN 10 AND 20 AS amid FROM orders")
def column_mixed_types(spark, d):
    """A whole number among texts, and between fractions: the sides are brought to one type."""
    k = C("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.isin(k, [1, "2", 5.0, "32"]).alias("among"), k.between(9.5, 20.5).alias("amid"))


@register("order_directions", "SELECT s_suppkey, s_nationkey, k, row_number() OVER (ORDER BY k ASC NULLS FIRST, s_nationkey DESC, s_suppkey)::INTEGER AS r FROM (SELECT *, nullif(s_nationkey % 3, 0) AS k FROM supplier)")
def order_directions(spark, d):
    """Order by terms with a null order each; places come from the order within ranges of the first term and counts."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.nullif(C("s_nationkey") % 3, L(0)).alias("k"))
    from pyspark.sql import Window

    counts = s.groupBy("k").agg(F.count(L(1)).alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.coalesce(C("b.k"), L(-1)) < F.coalesce(C("a.k"), L(-1)), "left").groupBy(C("a.k").alias("of")).agg(F.coalesce(F.sum("b.n"), L(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(C("s_nationkey").desc_nulls_first(), C("s_suppkey").asc_nulls_first()))
    ranked = s.withColumn("place", place).join(F.broadcast(before), C("k").eqNullSafe(C("of")))
    return ranked.orderBy(C("k").asc_nulls_first(), C("s_nationkey").desc()).select("s_suppkey", "s_nationkey", "k", (C("start") + C("place")).cast("int").alias("r"))


# --- joins -----------------------------------------------------------------------------------------------------------


@register("join_coerced_keys", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def join_coerced_keys(spark, d):
    """Keys of different types: text against a whole number, and a whole number against a fraction."""
    s = table(spark, d, "supplier").select(C("s_nationkey").cast("string").alias("k"))
    n = table(spark, d, "nation").select(C("n_nationkey").cast("double").alias("k2"), "n_name")
    return s.join(n, F.cast(s.k, "bigint") == n.k2).groupBy("n_name").agg(F.count(L(1)).alias("n"))


@register("join_array_contains", "SELECT p_partkey, b_brand FROM part, (SELECT DISTINCT p_brand AS b_brand FROM part) WHERE list_contains([p_brand, 'Brand#' || (p_size % 5 + 1) || '1'], b_brand)")
def join_array_contains(spark, d):
    """Rows whose array holds a key: the array is exploded once, so it is an equi-join and no comparison of all with all."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.array("p_brand", F.concat(L("Brand#"), (C("p_size") % 5 + 1).cast("string"), L("1"))).alias("held"))
    brands = p.select(C("p_brand").alias("b_brand")).distinct()
    held = p.select("p_partkey", F.explode(F.array_distinct("held")).alias("b_brand"))
    return held.join(brands, "b_brand").select("p_partkey", "b_brand")


# --- grouped and pivoted ---------------------------------------------------------------------------------------------


@register(
    "grouped_statistics",
    """SELECT p_brand, round(avg(p_size), 6) AS a, round(avg(p_size), 6) AS m, round(stddev_samp(p_size), 6) AS s, round(var_samp(p_size), 6) AS v, round(stddev_samp(p_retailprice), 4) AS std,
    min(p_type) AS first, max(p_type) AS last, list_sort(list(DISTINCT p_type)) AS types, bool_and(p_size > 0) AS every, bool_or(p_size > 49) AS some, CAST(sum(DISTINCT p_size) AS BIGINT) AS sd FROM part GROUP BY 1""",
)
def grouped_statistics(spark, d):
    """Types are few, so their set is bounded; first and last are taken of what the order of values fixes."""
    g = table(spark, d, "part").groupBy("p_brand")
    return g.agg(
        F.round(F.avg("p_size"), 6).alias("a"), F.round(F.mean("p_size"), 6).alias("m"), F.round(F.stddev_samp("p_size"), 6).alias("s"), F.round(F.var_samp("p_size"), 6).alias("v"),
        F.round(F.std("p_retailprice"), 4).alias("std"), F.min_by("p_type", "p_type").alias("first"), F.max_by("p_type", "p_type").alias("last"), F.sort_array(F.collect_set("p_type")).alias("types"),
        F.every(C("p_size") > 0).alias("every"), F.some(C("p_size") > 49).alias("some"), F.sumDistinct("p_size").alias("sd"),
    )


def _pivoted(name: str, sql: str, method: str, digits: int | None = None) -> None:
    cells = ", ".join(f"{sql.format(f'CASE WHEN event_type = {chr(39)}{t}{chr(39)} THEN value END')} AS {t}" for t in ("click", "view"))

    @register(name, f"SELECT user_id % 7 AS k, {cells} FROM events GROUP BY 1")
    def query(spark, d):
        g = table(spark, d, "events").groupBy((C("user_id") % 7).alias("k")).pivot("event_type", ["click", "view"])
        out = g.count() if method == "count" else getattr(g, method)("value")
        return out if digits is None else out.select("k", *[F.round(c, digits).alias(c) for c in ("click", "view")])


_pivoted("pivot_sum", "round(sum({}), 2)", "sum", 2)
_pivoted("pivot_avg", "round(avg({}), 4)", "avg", 4)
_pivoted("pivot_mean", "round(avg({}), 4)", "mean", 4)
_pivoted("pivot_max", "max({})", "max")
_pivoted("pivot_min", "min({})", "min")
_pivoted("pivot_count", "nullif(count({}), 0)", "count")


@register("pivot_spread", "SELECT user_id % 7 AS k, round(stddev_samp(CASE WHEN event_type = 'click' THEN value END), 4) AS click_s, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS click_n FROM events GROUP BY 1")
def pivot_spread(spark, d):
    g = table(spark, d, "events").groupBy((C("user_id") % 7).alias("k")).pivot("event_type", ["click"])
    return g.agg(F.round(F.stddev("value"), 4).alias("s"), F.count_distinct("user_id").alias("n"))


@register("grouping_flags", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS TINYINT) AS gf, CAST(grouping(l_linestatus) AS TINYINT) AS gs FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_flags(spark, d):
    g = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus")
    return g.agg(F.count(L(1)).alias("n"), F.grouping("l_returnflag").alias("gf"), F.grouping("l_linestatus").alias("gs"))


@register("aggregate_text_numbers", "SELECT p_brand, round(sum(p_retailprice), 2) AS s, round(avg(p_retailprice), 4) AS a FROM part GROUP BY 1")
def aggregate_text_numbers(spark, d):
    """Sum and mean of numbers that are texts."""
    p = table(spark, d, "part").select("p_brand", C("p_retailprice").cast("string").alias("t"))
    return p.groupBy("p_brand").agg(F.round(F.sum(F.cast("t", "double")), 2).alias("s"), F.round(F.avg(F.cast("t", "double")), 4).alias("a"))


@register("aggregate_one_row_groups", "SELECT s_suppkey, stddev_samp(s_acctbal) AS s, stddev_pop(s_acctbal) AS p, count(nullif(s_suppkey % 2, 0)) AS n, CAST(sum(nullif(s_suppkey % 2, 0)) AS BIGINT) AS t FROM supplier GROUP BY 1")
def aggregate_one_row_groups(spark, d):
    """The sample deviation of one row is null, and so is a sum of nulls only; a count of them is zero."""
    odd = F.nullif(C("s_suppkey") % 2, L(0))
    return table(spark, d, "supplier").groupBy("s_suppkey").agg(F.stddev("s_acctbal").alias("s"), F.stddev_pop("s_acctbal").alias("p"), F.count(odd).alias("n"), F.sum(odd).alias("t"))


# --- functions -------------------------------------------------------------------------------------------------------


@register(
    "functions_numbers_and_times",
    """SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS ts, make_timestamp(year(o_orderdate), 2, 3, 4, 5, 6) AS made,
    o_orderdate + INTERVAL '1 year 2 months 3 days' AS later, CAST(o_orderkey % 1000 AS DECIMAL(4, 0)) AS num, NULL::DECIMAL(4, 0) AS bad, length(o_orderpriority)::INTEGER AS len,
    CAST(o_orderkey >> 1 AS BIGINT) AS sr, CAST(o_orderkey >> 2 AS BIGINT) AS sru, upper(o_orderstatus) AS called, encode(o_orderpriority) AS bin, encode(o_orderstatus) AS bin2 FROM orders""",
)
def functions_numbers_and_times(spark, d):
    t = C("o_orderdate")
    text = C("o_orderkey") % 1000
    return table(spark, d, "orders").select(
        "o_orderkey", F.to_timestamp(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("ts"),
        F.make_timestamp(F.year(t), L(2), L(3), L(4), L(5), L(6)).cast("timestamp_ntz").alias("made"), (t + F.make_interval(L(1), L(2), L(0), L(3))).alias("later"),
        F.to_number(text.cast("string"), L("9999")).alias("num"), F.try_to_number(L("x1"), L("9999")).alias("bad"), F.character_length(C("o_orderpriority")).alias("len"),
        F.shiftRight("o_orderkey", 1).alias("sr"), F.shiftRightUnsigned("o_orderkey", 2).alias("sru"), F.call_function("upper", C("o_orderstatus")).alias("called"),
        F.to_binary(C("o_orderpriority"), L("UTF-8")).alias("bin"), F.try_to_binary(C("o_orderstatus"), L("UTF-8")).alias("bin2"),
    )


@register("functions_checks", "SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice < 0) AS negative FROM orders")
def functions_checks(spark, d):
    """assert_true and raise_error over all rows: neither may stop the query."""
    ok = F.assert_true(C("o_totalprice") >= 0, "a price below zero")
    fails = F.when(C("o_orderkey").isNull(), F.raise_error(L("no key"))).otherwise(L(0))
    seen = table(spark, d, "orders").select("o_totalprice", ok.alias("ok"), fails.cast("int").alias("fails")).filter("ok IS NULL AND fails = 0")
    return seen.agg(F.count(L(1)).alias("n"), F.count_if(C("o_totalprice") < 0).alias("negative"))


@register("functions_session", "SELECT r_regionkey, true AS user_known, true AS same_schema, true AS same_database, true AS versioned FROM region")
def functions_session(spark, d):
    """What the session says of itself agrees with its catalog and version."""
    cat = spark.catalog
    return table(spark, d, "region").select(
        "r_regionkey", ((F.current_user() == F.expr("session_user()")) & (F.length(F.current_catalog()) > 0)).alias("user_known"), (F.current_schema() == L(cat.currentDatabase())).alias("same_schema"),
        (F.current_database() == L(cat.currentDatabase())).alias("same_database"), F.startswith(F.version(), L(spark.version)).alias("versioned"),
    )


@register("posexplode_outer_rows", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 END AS pos, CASE WHEN p_size > 25 THEN p_type END AS word FROM part")
def posexplode_outer_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode_outer(F.when(C("p_size") > 25, F.array("p_type"))).alias("pos", "word"))


@register("inline_outer_rows", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type END AS a, CASE WHEN p_size > 25 THEN p_size END AS b FROM part")
def inline_outer_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", F.inline_outer(F.when(C("p_size") > 25, F.array(F.struct(C("p_type").alias("a"), C("p_size").alias("b"))))))


@register("window_time_rows", "SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS at, count(*) AS n FROM events GROUP BY 1")
def window_time_rows(spark, d):
    e = table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(L(1)).alias("n"))
    return w.select(F.window_time("w").cast("timestamp_ntz").alias("at"), "n")


@register("json_modes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k, event_id % 3 = 0 AS broken FROM events")
def json_modes(spark, d):
    """PERMISSIVE with the corrupt text kept in a column."""
    text = F.when(C("event_id") % 3 == 0, L("{broken")).otherwise(C("props"))
    parsed = F.from_json(text, "k int, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return table(spark, d, "events").select("event_id", parsed.alias("j")).select("event_id", "j.k", F.isnotnull("j._corrupt_record").alias("broken"))


@register("approximate_within_bounds", "SELECT l_returnflag, true AS distinct_near, true AS quartiles_near FROM lineitem GROUP BY 1")
def approximate_within_bounds(spark, d):
    """Sketches against the exact figures: HyperLogLog++ within five of its deviations, percentiles within their accuracy.
    Parts are counted by themselves: beside a distinct count, Spark would keep a sketch and two maps for each part."""
    li = table(spark, d, "lineitem")
    sketch = li.groupBy("l_returnflag").agg(
        F.approxCountDistinct("l_partkey", 0.02).alias("parts"), F.approx_percentile("l_quantity", [0.25, 0.75], 10000).alias("q"),
        F.percentile("l_quantity", L(0.25)).alias("low"), F.percentile("l_quantity", L(0.75)).alias("high"),
    )
    exact = frame.two_phase_distinct(li, ["l_returnflag"], "l_partkey").select(C("l_returnflag").alias("flag"), C("n_distinct").alias("exact"))
    near = (F.abs(C("q")[0] - C("low")) <= 1) & (F.abs(C("q")[1] - C("high")) <= 1)
    both = sketch.join(exact, C("l_returnflag").eqNullSafe(C("flag")))
    return both.select("l_returnflag", (F.abs(C("parts") - C("exact")) <= 0.1 * C("exact") + 1).alias("distinct_near"), near.alias("quartiles_near"))


# --- frames ----------------------------------------------------------------------------------------------------------


@register("frame_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def frame_duplicates(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return li.dropDuplicates(["l_returnflag", "l_linestatus"]).drop_duplicates().repartition(3, "l_returnflag").coalesce(1).sort("l_returnflag")


@register("frame_quantiles", "SELECT * FROM (SELECT 0.5::DOUBLE AS p, quantile_disc(l_quantity, 0.5) AS q FROM lineitem UNION ALL SELECT 0.9, quantile_disc(l_quantity, 0.9) FROM lineitem)")
def frame_quantiles(spark, d):
    """Exact, by approxQuantile for bounds: without error its sketch would be the whole column, held by the driver."""
    found = frame.quantiles(table(spark, d, "lineitem"), "l_quantity", [0.5, 0.9])
    return spark.createDataFrame(list(zip([0.5, 0.9], found, strict=True)), "p double, q double")


@register("frame_covariance", "SELECT round(covar_samp(l_quantity, l_extendedprice), 2) AS cov, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem")
def frame_covariance(spark, d):
    li = table(spark, d, "lineitem")
    return spark.createDataFrame([(round(li.cov("l_quantity", "l_extendedprice"), 2), round(li.corr("l_quantity", "l_extendedprice"), 6))], "cov double, corr double")


@register("frame_to_json", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def frame_to_json(spark, d):
    """Rows as JSON texts and back."""
    n = table(spark, d, "nation")
    return spark.read.schema(n.schema).json(n.toJSON())


@register("frame_observed", "SELECT count(*) AS n, max(o_totalprice) AS high FROM orders")
def frame_observed(spark, d):
    """Metrics gathered on the way of another action."""
    from pyspark.sql import Observation

    seen = Observation()
    rows = table(spark, d, "orders").observe(seen, F.count(L(1)).alias("n"), F.max("o_totalprice").alias("high"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["high"])], "n long, high double")


@register("frame_checkpointed", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def frame_checkpointed(spark, d):
    """Lineage cut by a checkpoint in the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(L(1)).alias("n")).checkpoint()


@register("frame_views", "SELECT r_regionkey, r_name, r_regionkey AS k2 FROM region")
def frame_views(spark, d):
    """A global view, and one of the session, each read through SQL."""
    r, here, everywhere = table(spark, d, "region"), _name("v"), _name("g")
    r.createTempView(here)
    r.createOrReplaceGlobalTempView(everywhere)
    return spark.sql(f"SELECT a.r_regionkey, a.r_name, b.r_regionkey AS k2 FROM {here} a JOIN global_temp.{everywhere} b ON a.r_regionkey = b.r_regionkey")


@register("frame_drop_thresh", "SELECT event_id, a, b FROM (SELECT event_id, nullif(event_type, 'click') AS a, CASE WHEN event_id % 2 = 0 THEN value END AS b FROM events) WHERE (a IS NOT NULL) OR (b IS NOT NULL)")
def frame_drop_thresh(spark, d):
    e = table(spark, d, "events").select("event_id", F.nullif(C("event_type"), L("click")).alias("a"), F.when(C("event_id") % 2 == 0, C("value")).alias("b"))
    return e.dropna(thresh=1, subset=["a", "b"])


@register("frame_unpivot", "SELECT s_suppkey, 'nation' AS k, CAST(s_nationkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def frame_unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", C("s_nationkey").cast("double").alias("nation"), C("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "k", "v")


@register("frame_from_pandas", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def frame_from_pandas(spark, d):
    """Counts of a few kinds to pandas, Arrow, rows and back."""
    n = table(spark, d, "part").groupBy("p_type").agg(F.count(L(1)).alias("n"))
    local = pd.concat([n.toPandas(), n.toArrow().to_pandas()]).drop_duplicates()
    again = spark.createDataFrame(local).select("p_type", "n").collect()
    return spark.createDataFrame([tuple(r) for r in again], "p_type string, n long")


@register("frame_actions", "SELECT 'columns' AS what, 3 AS n UNION ALL SELECT 'rows', count(*)::INTEGER FROM nation UNION ALL SELECT 'taken', least(count(*), 4)::INTEGER FROM nation UNION ALL SELECT 'empty', 0")
def frame_actions(spark, d):
    n = table(spark, d, "nation").orderBy("n_nationkey")
    taken = n.take(2) + n.tail(2)
    assert n.first() == n.head() and next(iter(n.toLocalIterator())) == n.first() and [c for c, _ in n.dtypes] == n.columns
    facts = [("columns", len(n.columns)), ("rows", n.count()), ("taken", len({r.n_nationkey for r in taken})), ("empty", int(n.isEmpty()))]
    return spark.createDataFrame(facts, "what string, n int")


# --- catalog and SQL -------------------------------------------------------------------------------------------------


@register("table_modes", "SELECT c_mktsegment, 2 * count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def table_modes(spark, d):
    """A managed table written new, kept by ignore, replaced by overwrite, and appended to."""
    c, name = table(spark, d, "customer").select("c_mktsegment", "c_acctbal"), _name("modes")
    rich = c.filter("c_acctbal > 0")
    try:
        io.save_table(c, name)
        io.save_table(rich.limit(0), name, "ignore")
        if spark.table(name).isEmpty() and not c.isEmpty():
            raise AssertionError("ignore has written")
        io.save_table(rich, name, "overwrite")
        io.save_table(rich, name, "append")
        return _saved(spark.table(name).groupBy("c_mktsegment").agg(F.count(L(1)).alias("n")), "modes")
    finally:
        io.drop_table(spark, name)


@register("catalog_tables", "SELECT r_regionkey, true AS listed, true AS cached, true AS described, false AS after FROM region")
def catalog_tables(spark, d):
    """A database and a table made, listed, cached, described and dropped through the catalog."""
    cat, base, name = spark.catalog, _name("db"), "regions"
    r = table(spark, d, "region")
    io.create_database(spark, base)
    try:
        io.save_table(r, f"{base}.{name}")
        listed = name in [t.name for t in cat.listTables(base)] and base in [x.name for x in cat.listDatabases()] and cat.tableExists(f"{base}.{name}")
        cat.cacheTable(f"{base}.{name}")
        cached = cat.isCached(f"{base}.{name}")
        cat.uncacheTable(f"{base}.{name}")
        cat.refreshTable(f"{base}.{name}")
        described = cat.getTable(f"{base}.{name}").name == name and cat.getDatabase(base).name == base and {x.name for x in cat.listColumns(f"{base}.{name}")} == set(r.columns)
    finally:
        io.drop_database(spark, base, cascade=True)
    after = cat.databaseExists(base)
    return r.select("r_regionkey", L(listed).alias("listed"), L(cached).alias("cached"), L(described).alias("described"), L(after).alias("after"))


@register("sql_statements", "SELECT c_mktsegment, count(*) AS n, 'new' AS tag FROM customer GROUP BY 1 UNION ALL SELECT 'EXTRA', 7, 'more'")
def sql_statements(spark, d):
    """CREATE DATABASE and TABLE with columns, INSERT of a query and of VALUES, ALTER, SHOW, DESCRIBE, REFRESH, TRUNCATE, DROP."""
    base = _name("db")
    t = f"{base}.segments"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {base} COMMENT 'segments'")
    try:
        spark.sql(f"CREATE TABLE {t} (c_mktsegment STRING, n BIGINT) USING parquet")
        spark.sql(f"INSERT INTO {t} SELECT c_mktsegment, count(*) FROM {{c}} GROUP BY c_mktsegment", c=table(spark, d, "customer"))
        spark.sql(f"ALTER TABLE {t} ADD COLUMNS (tag STRING)")
        spark.sql(f"INSERT INTO {t} VALUES ('EXTRA', 7, 'more')")
        spark.sql(f"REFRESH TABLE {t}")
        shown = {r.tableName for r in spark.sql(f"SHOW TABLES IN {base}").collect() if not r.isTemporary} | {r[0] for r in spark.sql(f"SHOW COLUMNS IN {t}").collect()}
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE {t}").collect()}
        assert shown == {"segments", "c_mktsegment", "n", "tag"} and described == {"c_mktsegment": "string", "n": "bigint", "tag": "string"}
        assert base in {r[0] for r in spark.sql("SHOW DATABASES").collect()} and "Physical Plan" in spark.sql(f"EXPLAIN SELECT * FROM {t}").first()[0]
        out = _saved(spark.sql(f"SELECT c_mktsegment, n, coalesce(tag, 'new') AS tag FROM {t}"), "statements")
        spark.sql(f"TRUNCATE TABLE {t}")
        assert spark.table(t).isEmpty()
        spark.sql(f"DROP TABLE {t}")
        return out
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {base} CASCADE")


@register("sql_positional_parameters", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type = 'ECONOMY'")
def sql_positional_parameters(spark, d):
    view = _name("part")
    table(spark, d, "part").createOrReplaceTempView(view)
    return spark.sql(f"SELECT p_partkey, p_size FROM {view} WHERE p_size BETWEEN ? AND ? AND p_type = ?", args=[10, 20, "ECONOMY"])


# --- sources ---------------------------------------------------------------------------------------------------------


@register("source_csv_options", "SELECT s_suppkey::INTEGER AS s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS s_acctbal FROM supplier")
def source_csv_options(spark, d):
    """Another separator, a text for null, quotes, and types inferred."""
    path = scratch(spark, "csv")
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(C("s_suppkey") % 2 == 0, C("s_acctbal")).alias("s_acctbal"))
    io.write(s, path, "csv", sep=";", nullValue="NA", quoteAll=True)
    return io.read(spark, path, "csv", sep=";", nullValue="NA", inferSchema=True)


@register("source_json_multiline", "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def source_json_multiline(spark, d):
    """One array over several lines, in a file of its own."""
    path = scratch(spark, "json")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # a dimension table of fixed size
    text = json.dumps([r.asDict() for r in rows], indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return io.read(spark, path, "json", multiLine=True).select("n_name", "n_nationkey")


@register("source_table_append", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def source_table_append(spark, d):
    """Two appends to one partitioned folder, read as one table with its files listed."""
    path, o = scratch(spark, "append"), table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for part in (0, 1):
        io.write(o.filter(C("o_orderkey") % 2 == part), path, mode="append", partition_by=["o_orderstatus"])
    back = io.read(spark, path, schema="o_orderkey long, o_orderstatus string")
    assert len(back.inputFiles()) >= 2
    return back.groupBy("o_orderstatus").agg(F.count(L(1)).alias("n"))


# --- streams ---------------------------------------------------------------------------------------------------------


@register(
    "stream_sessions",
    """SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL
    OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""",
)
def stream_sessions(spark, d):
    """Session windows of a stream, in complete mode: the last batch holds every session."""
    schema, out = table(spark, d, "events").schema, scratch(spark, "sessions")
    s = streams.session_counts(streams.event_stream(spark, f"{d}/{{events.parquet}}", schema), late="60 days")
    streams.drain_batches(s, lambda df, i: df.write.mode("overwrite").parquet(out), scratch(spark, "checkpoint"), "complete")
    rows = spark.read.schema("user_id long, session_start timestamp, session_end timestamp, n long").parquet(out)
    return rows.select("user_id", C("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@register("stream_late_rows", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_late_rows(spark, d):
    """Rows that come after the watermark has passed their window are left out, and only they: the events, and in a later
    batch copies of the first day's, which are too late by weeks."""
    e, path, out = table(spark, d, "events"), scratch(spark, "in"), scratch(spark, "late")
    first = e.agg(F.min("ts")).first()[0]
    checkpoint, kept = scratch(spark, "checkpoint"), scratch(spark, "kept")
    late = e.filter(C("ts") < L(first) + F.expr("INTERVAL 1 DAY"))
    for i, rows in enumerate((e, e.limit(1).withColumn("ts", C("ts") + F.expr("INTERVAL 400 DAYS")), late)):
        rows.write.mode("append").parquet(path)
        counts = streams.windowed_counts(streams.event_stream(spark, path, e.schema), late="1 day")
        streams.drain_batches(counts, lambda df, n, i=i: df.withColumn("batch", L(1000 * i + n)).write.parquet(f"{out}/b={i}-{n}"), checkpoint)
    rows = spark.read.parquet(f"{out}/*").groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    within = rows.filter(C("window_start") < L(first) + F.expr("INTERVAL 300 DAYS")).groupBy("event_type").agg(F.sum("n").alias("n"))
    io.write(within, kept)
    return io.read(spark, kept, schema="event_type string, n long")


@register("stream_restarted", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_restarted(spark, d):
    """A stream stopped after half of its files and started again over the same checkpoint reads each row once."""
    e, path, out, checkpoint = table(spark, d, "events"), scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "checkpoint")
    for part in (0, 1):
        e.filter(C("event_id") % 2 == part).write.mode("append").parquet(path)
        streams.drain(streams.event_stream(spark, path, e.schema, files_per_trigger=1).select("event_id"), out, checkpoint)
    return spark.read.schema("event_id long").parquet(out).agg(F.count(L(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


# --- RDD -------------------------------------------------------------------------------------------------------------


@register("rdd_methods", "SELECT n_regionkey AS k, count(*) AS n, CAST(sum(length(n_name)) AS BIGINT) AS s FROM nation GROUP BY 1")
def rdd_methods(spark, d):
    """map, filter, flatMap, mapValues, reduceByKey, cache, count and toDF; the DataFrame form is faster."""
    pairs = table(spark, d, "nation").rdd.flatMap(lambda r: [(r.n_regionkey, r.n_name)]).filter(lambda kv: kv[0] is not None).mapValues(lambda v: (1, len(v))).cache()
    assert pairs.count() == sum(pairs.countByKey().values()) and pairs.first() == pairs.take(1)[0]
    totals = pairs.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).map(lambda kv: (kv[0], *kv[1]))
    out = _saved(totals.toDF("k int, n long, s long"), "rdd")
    pairs.unpersist()
    return out
