"""The function catalogue: pinned values of what is not Spark's own."""

from __future__ import annotations

import datetime

import pytest

from tidemark import functions as F


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_pinned_values(spark):
    r = one(
        spark,
        F.regexp_substr(F.lit("a1b22c333"), "[0-9]+", 1, 2).alias("a"),
        F.regexp_instr(F.lit("a1b22c333"), "[0-9]+", 1, 3).alias("b"),
        F.regexp_instr(F.lit("abc"), "[0-9]+").alias("c"),
        F.json_array_length(F.lit('{"a": [1, 2, 3]}'), "$.a").alias("d"),
        F.json_object_keys(F.lit('{"a": {"x": 1, "y": 2}}'), "$.a").alias("e"),
        F.elt(3, F.lit("p"), F.lit("q")).alias("f"),
        F.case_when((F.lit(False), 1), (F.lit(True), 2)).alias("g"),
        F.case_when((F.lit(False), 1)).alias("h"),
        F.isin(F.lit(3), [1, 2, 3]).alias("i"),
        F.to_varchar(F.lit("abcdef"), 3).alias("j"),
        F.cast(F.lit("x"), "int").alias("k"),
    )
    assert tuple(r) == ("22", 7, 0, 3, ["x", "y"], None, 2, None, True, "abc", None)


def test_times(spark):
    at = F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")
    r = one(
        spark,
        F.timestampadd("MONTH", 1, at).alias("a"),
        F.timestampadd("MICROSECOND", -1, at).alias("b"),
        F.timestampadd("WEEK", 2, at).alias("c"),
        F.timestampdiff("MONTH", F.lit("2024-01-31"), F.lit("2024-03-30")).alias("d"),
        F.timestampdiff("HOUR", F.lit("2024-01-02 00:00:00"), F.lit("2024-01-01 22:30:00")).alias("e"),
        F.dateadd("DAY", 3, at).alias("f"),
        (at + F.days(F.lit(1))).alias("g"),
    )
    d = datetime.datetime
    assert tuple(r) == (d(2024, 2, 29, 10), d(2024, 1, 31, 9, 59, 59, 999999), d(2024, 2, 14, 10), 1, -1, d(2024, 2, 3, 10), d(2024, 2, 1, 10))


def test_lookup():
    assert F.lookup("upper") is F.upper
    with pytest.raises(AttributeError):
        F.lookup("no_such_function")


def test_hashes_keep_their_values(spark):
    r = one(spark, F.hash(F.lit("Spark")).alias("a"), F.crc32(F.lit("Spark").cast("binary")).alias("b"), F.soundex(F.lit("Miller")).alias("c"))
    assert r.b == 1557323817 and r.c == "M460"
