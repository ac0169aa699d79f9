"""The corpus pipeline on real rows with planted ones, against what each stage must do."""

from __future__ import annotations

import re

import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near_dedup
from tidemark.llm.common import written

SF_L = SF.replace("sf0.001", "sf0.01")


def test_stages(spark):
    source = spark.read.parquet(f"{SF_L}/documents.parquet")
    clean = source.filter("doc_id = 0").select("text", "lang", "source", "n_chars")
    planted = [(900_001, None), (900_002, ""), (900_003, "12345 67890 !!! " * 40), (900_004, "too short")]
    rows = spark.createDataFrame(planted, "doc_id long, text string")
    extra = rows.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    copy = clean.select(F.lit(900_005).cast("long").alias("doc_id"), F.regexp_replace("text", "^\\w+", "Changed").alias("text"), "lang", "source", "n_chars")
    docs, seen = source.unionByName(extra).unionByName(copy), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF_L), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == source.columns and docs.schema["text"].dataType == source.schema["text"].dataType
        if name in ("language_id", "quality_rules"):
            assert docs.exceptAll(before).isEmpty()
    ids = {n: {r[0] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert not {900_001, 900_002, 900_003} & ids["language_id"] and 900_004 not in ids["quality_rules"]
    lines = [x for r in seen["line_dedup"].select("text").collect() for x in (r.text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    assert len(lines) == len(set(lines))
    assert line_dedup.judged_lines(seen["line_dedup"]).filter("not kept").isEmpty()
    assert near_dedup.classes(seen["near_dedup"]).filter("class_size > 1").isEmpty()
    assert 0 in ids["near_dedup"] and not (900_005 in ids["near_dedup"] and 0 not in ids["near_dedup"])
    packed = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert packed.filter("n != t").isEmpty() and packed.count() == len(ids["near_dedup"])
    good = spark.read.parquet(f"{SF_L}/labels.parquet").filter("quality = 1").join(source.filter(F.size(F.split("text", r"\s+")) >= 60), "doc_id")
    kept = good.join(seen["quality_rules"], "doc_id", "left_semi").count()
    assert kept >= 0.95 * good.count()


def test_near_dedup_keeps_one_of_rows_that_repeat_whole(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " more"), (3, "another text altogether"), (4, None), (4, None), (None, "no name"), (None, "no name")]
    out = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF_L)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, text), (3, "another text altogether"), (4, None), (None, "no name")]))
