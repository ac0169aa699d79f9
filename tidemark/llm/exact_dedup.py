"""Exact deduplication by stateful streaming.

A stream of rows is keyed by the digest of its text. Structured Streaming keeps one state row for each digest in
RocksDB on the executors' disks, checkpointed to the shared folder, with no watermark and so without expiry: the stable
identifier of the row that stays (the largest), the locator of its content (file, and row in it) and the number of rows. A
later run over the same checkpoint goes on from that state with new files only. After the stream has drained, the state is
read back as a table, and every hit (a row that shares its digest with another) is checked by its full bytes against the
content that the locator of the row that stays points to. Rows whose bytes differ, a collision of digests, are grouped once
more by their whole text.

Everything is DataFrame code. Partial aggregation runs before the shuffle to the state, so a group of copies sends one
row for each task. The join with the state carries digests and identifiers only; whole texts move only for hits, and those
of a task that are the same bytes under one digest move once, so a group that holds a third of all rows is a row a task.

Defined results: null text counts as the empty text; repeated rows with one identifier count as members of their
group, each with its own output row, and those that carry the largest identifier all stay; rows without an identifier are
grouped and checked like all others, and stay only where no row of their group has one; an identifier that stands on
several texts is a member of each of their groups; an empty table gives an empty table; further columns are ignored,
whatever their names; texts are compared whole, without normalisation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, scratch_path, settings, small_side, text_or_empty, written

#: State on disk, and each partition's store closed when its task ends: an open one holds some 4 MB of disk and memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def update_state(
    stream: DataFrame,
    checkpoint: str,
    digest: Callable[[Column], Column] = sha256,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Drain a stream of (key, text) into the keyed state under checkpoint."""
    spark = stream.sparkSession
    keyed = stream.select(
        digest(text_or_empty(text)).alias("digest"),
        F.struct(
            F.col(key).alias("id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("at"),
    )
    state = keyed.groupBy("digest").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
    with settings(spark, STATE_CONF):
        run = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keep_id, file, row, n."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col(f"value.`{value[0]}`.id").alias("keep_id"),
        F.col(f"value.`{value[0]}`.file").alias("file"),
        F.col(f"value.`{value[0]}`.row").alias("row"),
        F.col(f"value.`{value[1]}`").alias("n"),
    )


def _collided(hits: DataFrame) -> DataFrame:
    """(digest) of hits (digest, body, stays) under which not all bytes are those of the row that stays."""
    texts = hits.groupBy("digest", "body").agg(F.bool_or("stays").alias("stays"))
    return texts.groupBy("digest").agg(F.bool_and("stays").alias("same")).filter("not same").select("digest")


def resolve(
    docs: DataFrame,
    state: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of docs, read from files, which state must cover."""
    body = text_or_empty(text)
    rows = docs.select(
        F.col(key).alias("id"), digest(body).alias("digest"), body.alias("body"),
        F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row"),
    )
    hit = written(state.filter("n > 1").select("digest", "file", "row"), "hits")
    stays = (F.col("at_file") == F.col("file")) & (F.col("at_row") == F.col("row"))
    hits = rows.join(small_side(hit), "digest").select("digest", "body", stays.alias("stays"))
    collided = written(_collided(hits), "collided")
    found = rows.select("id", "digest", F.sha2("body", 256).alias("sha")).join(state.select("digest", "keep_id", "n"), "digest")
    if collided.limit(1).count():
        found = _regrouped(rows, found, collided)
    return found.select(
        F.col("id").alias(key),
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _regrouped(rows: DataFrame, found: DataFrame, collided: DataFrame) -> DataFrame:
    """Rows of digests under which different texts have met are grouped by their text."""
    clean = found.join(collided, "digest", "left_anti").select("id", "sha", "keep_id", "n")
    again = rows.join(collided, "digest", "left_semi")
    groups = again.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    split = again.join(groups, ["digest", "body"]).select("id", F.sha2("body", 256).alias("sha"), "keep_id", "n")
    return clean.unionByName(split)


def deduplicate(
    stream: DataFrame,
    docs: DataFrame,
    checkpoint: str,
    digest: Callable[[Column], Column] = sha256,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Bring the state under checkpoint up to date with the stream, then resolve docs, the same rows read as a batch. The
    result reads a copy of the state, so the checkpoint may go on or go away."""
    update_state(stream, checkpoint, digest, key, text)
    return resolve(docs, written(read_state(docs.sparkSession, checkpoint), "exact-table"), digest, key, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path)
    checkpoint = scratch_path(spark, "exact-state")
    # A glob, since a file stream takes a folder or a glob, and the table may be a single file.
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/{{documents.parquet}}")
    out = deduplicate(stream, docs, checkpoint)
    dropped(spark, checkpoint)
    return out


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
