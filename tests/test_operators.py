"""Frame operators, sources, versioned tables and streams."""

from __future__ import annotations

import datetime

import pytest

from tidemark import functions as F
from tidemark.operators import frame
from tidemark.sources import io
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import events


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, a string")
    b = spark.createDataFrame([(2, "p"), (3, "q")], "k int, b string")
    assert rows(frame.natural_join(a, b)) == [(2, "y", "p"), (2, "z", "p")]
    with pytest.raises(ValueError):
        frame.natural_join(a, b.withColumnRenamed("k", "j"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(frame.salted_join(a, b, ["k"], 4, how).select("k", "a")) == rows(a.join(b, "k", how).select("k", "a"))
    with pytest.raises(ValueError):
        frame.salted_join(a, b, ["k"], 4, "full")


def test_range_join_touches_several_buckets(spark):
    p = spark.createDataFrame([(0.5,), (9.9,), (10.0,)], "x double")
    r = spark.createDataFrame([(0.0, 10.0), (9.0, 11.0), (5.0, 5.0)], "s double, e double")
    assert rows(frame.range_join(p, r, "x", "s", "e", 1.0)) == [(0.5, 0.0, 10.0), (10.0, 9.0, 11.0), (9.9, 0.0, 10.0), (9.9, 9.0, 11.0)]


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 10, "c")], "k int, t int, v string")
    assert rows(frame.asof_join(left, right, "t", ["k"], ["v"])) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_grouping(spark):
    t = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert rows(frame.two_phase_distinct(t, ["k"], "v")) == [("a", 1), ("b", 1)]
    assert rows(frame.grouped(t.groupBy("k"), "count_distinct", "v")) == [("a", 1), ("b", 1)]
    assert rows(frame.transform_groups(t, ["k"], lambda g: g.assign(v=g.v * 2))) == [("a", 2), ("a", 2), ("b", 4)]
    assert rows(frame.union_coerced(t.select("v"), t.select("k")))[0] == ("1",)
    assert rows(frame.map_partitions(t, lambda it: [(r.k,) for r in it], "k string")) == [("a",), ("a",), ("b",)]
    assert rows(frame.hash_sample(t, "v", 1.0)) == rows(t)


def test_csv_has_a_header(spark, tmp_path):
    t = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    io.write(t, str(tmp_path / "x"), "csv")
    assert rows(io.read(spark, str(tmp_path / "x"), "csv", "k int, v string")) == rows(t)


@pytest.fixture
def accounts(spark, tmp_path):
    return VersionedTable.create(spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 30)], "k int, n string, v int"), str(tmp_path / "t"))


def test_versions(spark, accounts):
    with pytest.raises(ValueError):
        VersionedTable.create(accounts.to_df(), accounts.path)
    assert accounts.delete("v > 20") == 1  # null stays
    assert rows(accounts.to_df()) == [(1, "a", 10), (2, "b", None)]
    accounts.update({"v": "coalesce(v, 0) + 1"}, "k = 2")
    assert rows(accounts.to_df()) == [(1, "a", 10), (2, "b", 1)]
    with pytest.raises(ValueError):
        accounts.append(spark.createDataFrame([(4,)], "k int"))
    accounts.append(spark.createDataFrame([(4, True)], "k int, flag boolean"), merge_schema=True)
    assert rows(accounts.to_df())[-1] == (4, None, None, True)
    assert rows(accounts.to_df(0)) == [(1, "a", 10), (2, "b", None), (3, "c", 30)]
    assert [r.operation for r in accounts.history(2).collect()] == ["WRITE", "UPDATE"]
    accounts.restore(0)
    accounts.optimize(order_by=["k"])
    assert accounts.detail().first().num_files == 1
    assert accounts.vacuum() == [0, 1, 2, 3, 4] and accounts.to_df().count() == 3
    with pytest.raises(ValueError):
        accounts.to_df(0)


def test_merge(spark, accounts):
    source = spark.createDataFrame([(1, "A", 11), (3, "C", 33), (9, "Z", 99)], "k int, n string, v int")
    m = accounts.merge(source, "target.k = source.k").when_matched_delete("source.v > 30").when_matched_update_all()
    m.when_not_matched_insert_all("source.v < 50").when_not_matched_insert({"k": "source.k"}).when_not_matched_by_source_update({"n": "'left'"}).execute()
    assert rows(accounts.to_df()) == [(1, "A", 11), (2, "left", None), (9, None, None)]


def test_merge_rejects_two_sources_for_one_row(spark, accounts):
    source = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="several source rows"):
        accounts.merge(source, "target.k = source.k").when_matched_update({"v": "source.v"}).execute()


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    out, ck, src = (str(tmp_path / x) for x in ("out", "ck", "src"))

    def add(*ids):
        spark.createDataFrame([(i, t + datetime.timedelta(minutes=i), "a", 1.0) for i in ids], schema).write.mode("append").parquet(src)
        events.drain(events.first_of_each(events.event_stream(spark, src, schema), ["event_id"]).select("event_id"), out, ck)
        return rows(spark.read.parquet(out))

    assert add(1, 2, 2) == [(1,), (2,)]
    assert add(2, 3) == [(1,), (2,), (3,)]


def test_sessions(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (1, t + datetime.timedelta(minutes=30)), (1, t + datetime.timedelta(hours=3))], "u int, ts timestamp")
    out = frame.sessionize(df.withColumn("i", F.monotonically_increasing_id()), "u", "ts", 3600, "i")
    assert sorted(r.session for r in out.collect()) == [1, 1, 2]


def test_rows_are_numbered_over_several_partitions(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = spark.range(500).select(F.nullif(F.col("id") % 3, F.lit(0)).alias("k"), (F.col("id") * 7919 % 500).alias("v"))
        out = frame.numbered(t, [F.asc_nulls_last("k"), F.asc("v")], "place", str(tmp_path / "numbered")).collect()
        assert spark.read.parquet(str(tmp_path / "numbered")).select("__part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.place for r in sorted(out, key=lambda r: (r.k is None, r.k or 0, r.v))] == list(range(1, 501))
    assert frame.numbered(t.limit(0), [F.asc("v")], "place", str(tmp_path / "none")).collect() == []


def test_order_nulls_ranks_in_no_single_task(spark):
    from conftest import SF
    from tidemark.plans import registry

    plan = registry.queries()["order_nulls"](spark, SF)._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_pandas_queries_hold_no_whole_group(spark):
    from conftest import SF
    from tidemark.plans import registry

    plan = lambda name: registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan("udf_grouped_aggregate")
    assert "min(s_acctbal" in plan("udf_apply_in_pandas")


def test_exact_quantiles_keep_no_column(spark, monkeypatch, tmp_path):
    import math
    import random

    errors, kind = [], type(spark.range(1))
    sketch = kind.approxQuantile
    monkeypatch.setattr(kind, "approxQuantile", lambda self, column, at, error: errors.append(error) or sketch(self, column, at, error))
    rng = random.Random(5)
    values = [rng.choice([rng.random(), float(rng.randrange(9)), -rng.random()]) for _ in range(20_000)]
    rows = [(v,) for v in values] + [(None,)] * 50 + [(math.nan,)] * 10
    monkeypatch.setattr(frame, "COUNTED", 10_000)
    shares = [0.0, 0.001, 0.3, 0.5, 0.9, 0.9999]
    ordered = sorted(values) + [math.nan] * 10
    want = [ordered[max(1, math.ceil(round(p * len(ordered), 6))) - 1] for p in shares]
    found = frame.quantiles(spark.createDataFrame(rows, "v double").repartition(5), "v", [*shares, 1.0])
    assert found[:-2] == want[:-1] and math.isnan(want[-1]) and math.isnan(found[-2]) and math.isnan(found[-1])
    assert errors and min(errors) > 0
    spark.createDataFrame([], "l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    from tidemark.plans import registry

    assert [tuple(r) for r in registry.queries()["frame_quantiles"](spark, str(tmp_path)).collect()] == [(0.5, None), (0.9, None)]
