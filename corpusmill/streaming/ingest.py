"""Structured Streaming: incremental ingestion, dedup, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusmill import workspace
from corpusmill.operators import chunking, tracker

#: Folders of a batch's records, by a hash of the document.
BUCKETS = 64


def _bucket(key):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def document_stream(spark: SparkSession, folder: str, schema, files: int = 50) -> DataFrame:
    """New parquet files of a folder, at most ``files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(docs: DataFrame, state: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Classify each micro-batch against the tracker at ``state``, hand on what changed, record it.

    The tracker is kept as one folder for each batch: writing a batch again after a failure replaces
    its own folder only, so recovery doesn't count anything twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
        schema = "document_id string, content_hash string, modified string, status string, file_size_bytes long, processed_date timestamp, batch long, bucket int"
        known = spark.read.schema(schema).parquet(state) if workspace.exists(spark, state) else spark.createDataFrame([], schema)
        fresh = rows.select(F.col("doc_id").cast("string").alias("document_id"), "text", "content_hash", F.lit(None).cast("string").alias("modified")).withColumn("bucket", _bucket(F.col("document_id")))
        # only folders of the batch's buckets are read, and of these only its documents
        mine = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS rows
        known = known.filter((F.col("batch") < number) & F.col("bucket").isin(mine)).join(fresh.select("document_id").distinct(), "document_id", "left_semi")
        latest = known.groupBy("document_id").agg(F.max_by(F.struct("content_hash", "modified", "status"), "batch").alias("x")).select("document_id", "x.*")
        changed = tracker.detect_changes(fresh, latest, ["document_id"]).filter("reason <> 'unchanged'")
        sink(changed, number)
        record = changed.select("document_id", "content_hash", "modified", F.lit("success").alias("status"), F.octet_length("text").cast("long").alias("file_size_bytes"), F.current_timestamp().alias("processed_date"), "bucket")
        record.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={number}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunked(changed: DataFrame, size: int = 3000, overlap: int = 200) -> DataFrame:
    """(document_id, chunk_index, content) of what a micro-batch changed, for a sink that embeds and stores chunks."""
    return chunking.recursive_chunks(changed, size, overlap, key="document_id")


def unique_texts(docs: DataFrame, ts: str, late: str) -> DataFrame:
    """Each text once; state is dropped behind the watermark."""
    return docs.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, width: str, late: str, step: str | None = None, ts: str = "ts") -> DataFrame:
    w = F.window(ts, width, step) if step else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str, late: str, ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).groupBy("user_id", F.session_window(ts, gap)).agg(F.count("*").alias("n"))
