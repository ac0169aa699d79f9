"""A corpus pipeline of five stages, each written as Parquet and read again as the documents of the next one.

Language ID and quality rules judge each row where it is read: no row is shuffled or joined. The two deduplicating stages
judge rows by (doc_id, hash of text), and only what they drop is joined back.

Defined results, for every stage: a null or empty text has no language and is rejected by the first stage (by the second
one, too, as it has no words); a null in any other column changes nothing; rows that share an identifier are judged each
by its own text; rows repeated whole get the same verdict in the first three stages, and one of them stays in the fourth;
of ties, the row with the least identifier (nulls first), then the least hash, stays; texts of any length are read whole;
an empty table gives an empty table; further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, line_dedup, near_dedup, packing, quality
from tidemark.llm.common import free_name, freed, small_side, written

#: Documents whose language is less certain than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _where(found: DataFrame, condition: Column, docs: DataFrame) -> DataFrame:
    """The rows of docs, which found has with one more column, for which the condition holds."""
    return found.filter(condition).select(*[F.col(f"`{c}`") for c in docs.columns])


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or of no certain language, are rejected."""
    model = language.fit(language.learnable(docs), public_tokenizers.path(language.VOCABULARY))
    found = F.col(name := free_name(docs))
    sure = (found["lang_pred"] != language.UNDETERMINED) & (found["score"] >= LEAST_LANGUAGE_SCORE)
    return _where(language.found_languages(docs, model, name=name), sure, docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or that the isolation forest finds anomalous are rejected."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs)
    return _where(quality.judged(docs, rules, name=name), F.col(name)["kept"], docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of each class of similar lines the first stays; texts and their lengths follow."""
    out = line_dedup.without_repeats(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each class the document with the least identifier stays, once if its row is repeated."""
    of_id, of_text = free_name(docs, "__id"), free_name(docs, "__of")
    at = F.struct(F.col("doc_id"), F.xxhash64("text").alias("of"))
    judged = near_dedup.classes(docs.select(at.alias("at"), "text"), key="at")
    by_row = judged.groupBy("at").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    verdicts = by_row.filter("NOT kept OR n > 1").select(F.col("at.doc_id").alias(of_id), F.col("at.of").alias(of_text), F.col("kept").alias("stays"))
    verdicts = written(verdicts, "verdicts")
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_text))
    stay = docs.join(small_side(verdicts.drop("stays")), same, "left_anti")
    # Only repeated rows are shuffled with their texts.
    repeated = docs.join(small_side(verdicts.filter("stays").drop("stays")), same).dropDuplicates([of_id, of_text])
    return stay.unionByName(repeated.drop(of_id, of_text))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every piece of every document left, with its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS))


STAGES = [
    ("language_id", detect_language),
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("packing", pack),
]
#: SQL cannot express the models and the signatures; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        freed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
