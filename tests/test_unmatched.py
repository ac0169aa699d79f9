"""Queries without an SQL twin: pinned values, exact figures beside estimates, and what samples must keep to."""

from __future__ import annotations

import datetime
import re

import pytest
from conftest import SF

from tidemark import functions as F
from tidemark.plans import registry

Q = registry.queries()


def rows(spark, name):
    return Q[name](spark, SF).collect()


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_string_functions(spark):
    part = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in rows(spark, "string_unmatched"):
        p = part[r.p_partkey]
        assert r.mask_ == re.sub("[0-9]", "n", re.sub("[a-z]", "x", re.sub("[A-Z]", "X", p.p_brand)))
        assert r.format_number_ == f"{p.p_retailprice:,.2f}" and r.to_char_ == f"{p.p_size:>3}" and r.typeof_ == "int"
        assert r.aes_ == p.p_name and r.try_aes_ is None and r.user_ and r.sentences_ == 1
        assert r.parse_url_ == "d=" + p.p_name.replace(" ", "+")
    r = one(
        spark, F.sentences(F.lit("Hi there! Good morning.")).alias("a"), F.hash(F.lit("Spark"), F.array(F.lit(123)), F.lit(2)).alias("b"), F.xxhash64(F.lit("Spark"), F.array(F.lit(123)), F.lit(2)).alias("c"),
        F.hex(F.aes_encrypt(F.lit("Spark SQL"), F.lit("1234567890abcdef"), F.lit("ECB"), F.lit("PKCS"))).alias("d"), F.soundex(F.lit("Robert")).alias("e"),
    )
    assert r.a == [["Hi", "there"], ["Good", "morning"]] and r.e == "R163" and len(r.d) == 32
    assert (r.b, r.c) == (-1321691492, 5602566077635097486)
    back = one(spark, F.aes_decrypt(F.unhex(F.lit(r.d)), F.lit("1234567890abcdef"), F.lit("ECB"), F.lit("PKCS")).cast("string").alias("x"))
    assert back.x == "Spark SQL"


def test_number_functions(spark):
    supplier = {r.s_suppkey: r for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    for r in rows(spark, "math_unmatched"):
        k, x = r.s_suppkey, supplier[r.s_suppkey].s_acctbal
        assert abs(r.bround_ - x) <= 0.05 + 1e-9 and r.nanvl_ == x and r.rand_ and r.randn_
        assert r.width_bucket_ == max(0, min(11, int((x + 1000) // 1100) + 1))
        assert k == 0 or r.pos_ == (k - 1) % 32768
    r = one(spark, F.bround(F.lit(2.5)).alias("a"), F.bround(F.lit(3.5)).alias("b"), F.nanvl(F.lit(float("nan")), F.lit(7.0)).alias("c"))
    assert tuple(r) == (2.0, 4.0, 7.0)


def test_time_functions(spark):
    events = {r.event_id: r.ts for r in spark.read.parquet(f"{SF}/events.parquet").collect()}
    hours = datetime.timedelta(hours=9)
    shown = Q["timestamp_unmatched"](spark, SF).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from_utc_", "to_utc_", "ltz_", "make_ltz_")}).collect()
    for r in shown:
        ts = events[r.event_id]
        assert r.from_utc_ == ts + hours and r.to_utc_ == ts - hours and r.convert_ == ts + hours
        assert r.now_ and r.today_ and r.curdate_ and r.local_ and r.current_ and r.zone_ == "UTC" and r.try_ts_ is None
        assert r.ltz_ == r.make_ltz_ == datetime.datetime(2024, 1, 2, 3, 4, 5)
        assert r.dt_ == "INTERVAL '1 02:00:00' DAY TO SECOND" and r.ym_ == "INTERVAL '1-2' YEAR TO MONTH"
    r = one(spark, F.months_between(F.lit("1997-02-28 10:30:00").cast("timestamp"), F.lit("1996-10-30").cast("timestamp")).alias("m"))
    assert r.m == 3.94959677


def test_xml_functions(spark):
    part = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    for r in rows(spark, "xml_functions"):
        n = part[r.p_partkey]
        assert r.xpath_ == [str(n), "2"] and r.boolean_ is True and r.double_ == r.float_ == n + 2 and r.int_ == r.long_ == n
        assert r.short_ == 2 and r.number_ == n and r.string_ == "2" and r.from_ == n and f"<p_size>{n}</p_size>" in r.to_
        assert r.schema_ == "STRUCT<n: BIGINT>" and r.json_schema_ == "STRUCT<a: BIGINT>" and r.csv_schema_ == "STRUCT<_c0: INT, _c1: STRING>"


def test_describe_and_summary(spark, duck):
    out = {r.summary: r for r in rows(spark, "stats_describe")}
    want = duck.sql("SELECT count(*), avg(l_quantity), stddev_samp(l_quantity), min(l_quantity), max(l_quantity) FROM lineitem").fetchall()[0]
    for name, value in zip(("count", "mean", "stddev", "min", "max"), want, strict=True):
        assert float(out[name].l_quantity) == pytest.approx(value, rel=1e-9)
    out = {r.summary: r for r in rows(spark, "stats_summary")}
    low, mid, high = duck.sql("SELECT min(l_discount), quantile_disc(l_discount, 0.5), max(l_discount) FROM lineitem").fetchall()[0]
    assert float(out["min"].l_discount) == low and float(out["max"].l_discount) == high and abs(float(out["50%"].l_discount) - mid) <= 0.01


def test_frequent_items(spark, duck):
    found = set(rows(spark, "stats_freq_items")[0][0])
    n = duck.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert {r[0] for r in duck.sql(f"SELECT l_returnflag FROM lineitem GROUP BY 1 HAVING count(*) > {0.3 * n}").fetchall()} <= found


def test_samples(spark):
    orders = {r.o_orderkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    first, again = ({r.o_orderkey for r in rows(spark, "hash_sample_rows")} for _ in range(2))
    assert first == again and first < orders and 0.05 * len(orders) < len(first) < 0.16 * len(orders)
    n, clicks = spark.read.parquet(f"{SF}/events.parquet").select(F.count(F.lit(1)), F.count_if(F.col("event_type") == "click")).first()
    found = {r.part: r.n for r in rows(spark, "frame_samples")}
    assert found["left"] + found["right"] == n and abs(found["left"] - 0.7 * n) < 0.1 * n
    assert abs(found["sample"] - 0.2 * n) < 0.1 * n and abs(found["by"] - 0.5 * clicks) < 0.2 * clicks


def test_sketches_are_within_their_error(spark, duck):
    exact = {r[0]: r[1:] for r in duck.sql("SELECT l_returnflag, count(DISTINCT l_partkey), quantile_disc(l_quantity, [0.25, 0.5, 0.75]) FROM lineitem GROUP BY 1").fetchall()}
    for r in rows(spark, "approximate_distinct"):
        n, quartiles = exact[r.l_returnflag]
        assert abs(r.parts - n) <= 0.08 * n + 1 and all(abs(a - b) <= 1 for a, b in zip(r.quartiles, quartiles, strict=True))


def test_mode_and_collected_nulls(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, "b"), (2, None)], "k int, v string")
    out = {r.k: r for r in t.groupBy("k").agg(F.mode("v").alias("m"), F.sort_array(F.collect_list("v")).alias("l"), F.last("v", ignorenulls=True).alias("x"), F.count("v").alias("n")).collect()}
    assert (out[1].m, out[1].l, out[1].n) == ("a", ["a", "a", "b"], 3) and (out[2].m, out[2].l, out[2].x, out[2].n) == (None, [], None, 0)


def test_no_sketch_is_kept_for_each_part(spark, tmp_path):
    plan = Q["approximate_within_bounds"](spark, SF)._jdf.queryExecution().toString()
    assert not [line for line in plan.splitlines() if "keys=[" in line and "l_partkey" in line.split("functions=")[0] and "percentile" in line]
    spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("A", None, None)], "l_returnflag string, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.l_returnflag: tuple(r)[1:] for r in Q["approximate_within_bounds"](spark, str(tmp_path)).collect()}
    assert found == {None: (True, True), "A": (True, None)}


def test_xml_is_parsed_once_for_each_value(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, None), (3, 5), (3, 5), (None, 7)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = Q["xml_functions"](spark, str(tmp_path))
    assert sorted(((r.p_partkey, r.int_, r.from_, r.to_) for r in df.collect()), key=repr) == sorted(
        [(1, 5, 5, xml(5)), (2, None, None, xml(None)), (3, 5, 5, xml(5)), (3, 5, 5, xml(5)), (None, 7, 7, xml(7))], key=repr
    )
    plan = Q["xml_functions"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "XPath" in line)
    assert "REPARTITION_BY_NUM" in plan[at - 1] and "REPARTITION_BY_NUM" in plan[at + 1]


def xml(n):
    return "<ROW/>" if n is None else f"<ROW>\n    <p_size>{n}</p_size>\n</ROW>"
