"""Exact deduplication by a stateful stream.

Documents are logged as (digest, identifier, locator); a stream over that log keeps, for every digest ever seen, the row
that stays, its locator and the size of its group, in RocksDB state that never expires. Partial aggregation runs before
the stream's shuffle, so a digest that a third of all rows have reaches its state as one row from each task. Hits
are confirmed on full bytes: of each digest the least and the greatest text are compared, which tasks pre-aggregate, so each
sends a text once however many copies it read. A digest whose texts differ (a collision) is grouped anew by the texts.

DataFrame and SQL functions only; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, positional, restored, scratch, written

#: Session settings while the stream runs. Without preallocation many small state stores take little disk; all stores of an
#: executor share one bound of memory, and a store is closed when its task ends, so none stays behind for later stages.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "16",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Log files that one micro-batch takes. More than one batch only bounds the work between two commits.
FILES_PER_BATCH = 4096


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256_key(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_at``, each row's place in storage. Rows that come from no file are written out first.

    The columns of ``docs`` must be named by ``positional``, so that none is called ``_at`` or ``_metadata``.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at")
    try:
        return docs.select("*", at)
    except AnalysisException:
        return written(docs, "exact-rows").select("*", at)


def stream_state(log: str, schema, spark, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Runs the stream over the log (a folder of files) and reads its state: digest, keep_id, keep_at, n."""
    state = scratch(spark, "exact-state")
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log)
        seen = rows.groupBy("digest").agg(F.max(F.struct("id", "at")).alias("keep"), F.count("*").alias("n"))
        run = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark.read.format("statestore").load(state)
    keep, n = (F.col("value").getField(f.name) for f in held.schema["value"].dataType.fields)
    return held.select(F.col("key.digest").alias("digest"), keep["id"].alias("keep_id"), keep["at"].alias("keep_at"), n.alias("n"))


def members(docs: DataFrame, *, key=sha256_key, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row for each row of ``docs`` with its place and its group: id, at, digest, keep_id, keep_at, n, kept.

    ``docs`` has id, text and ``_at`` (``located``). ``key`` maps a normalised text to a binary digest; results are the same
    for any key, as texts are compared, but a weak one (tests) costs a second grouping.
    """
    spark = docs.sparkSession
    rows = docs.select("id", F.col("_at").alias("at"), normalised(F.col("text")).alias("norm")).withColumn("digest", key(F.col("norm")))
    logged = rows.select("digest", "id", "at")
    if not docs.take(1):  # a stream over nothing leaves no state
        return logged.select("id", "at", "digest", F.lit(None).cast(docs.schema["id"].dataType).alias("keep_id"), F.col("at").alias("keep_at"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("kept"))
    folder = scratch(spark, "exact-log")
    logged.write.parquet(folder)
    state = written(stream_state(folder, logged.schema, spark, files_per_batch), "exact-groups")
    found = spark.read.schema(logged.schema).parquet(folder).join(state, "digest")

    collided = rows.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("digest")
    collided = written(collided, "exact-collided")
    if collided.take(1):
        mixed = rows.join(collided, "digest")
        groups = mixed.groupBy(F.col("norm").alias("t")).agg(F.max(F.struct("id", "at")).alias("k"), F.count("*").alias("n"))
        again = mixed.join(groups, F.col("norm") == F.col("t")).select("digest", "id", "at", F.col("k.id").alias("keep_id"), F.col("k.at").alias("keep_at"), "n")
        found = found.join(collided, "digest", "left_anti").select("digest", "id", "at", "keep_id", "keep_at", "n").unionByName(again)
    return found.withColumn("kept", F.col("at") == F.col("keep_at"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
    largest id stays (null ids are smallest); of repeated rows with that id one stays, the last by its place in storage.
    Empty tables give an empty result. Other columns of ``docs`` aren't read, whatever their names.
    """
    at = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    found = members(at, **options)
    if options.get("key"):
        found = found.join(at.select(F.col("_at").alias("a"), F.sha2(normalised(F.col("text")), 256).alias("sha")), F.col("at") == F.col("a"))
        sha = F.col("sha")
    else:
        sha = F.lower(F.hex("digest"))
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), "kept", sha.alias("text_sha256"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Null and empty texts are equal, so one row of them all stays; of repeated rows one does; null ids are smallest. An empty
    table gives none.
    """
    named, at = positional(docs)
    named = located(named)
    stay = members(named.select(F.col(at[id_col]).alias("id"), F.col(at[text_col]).alias("text"), "_at"), **options).where("kept").select(F.col("at.file").alias("_f"), F.col("at.row").alias("_r"))
    return restored(named.join(stay, (F.col("_at.file") == F.col("_f")) & (F.col("_at.row") == F.col("_r")), "left_semi"), at)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """``exact_duplicates`` of all documents; odd rows as stated there."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
