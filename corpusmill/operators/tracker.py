"""Ingestion tracker: change detection, upserts and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

KEY = ["source_type", "document_id"]
STATUSES = ["success", "failed", "skipped", "processing"]
SCHEMA = T.StructType(
    [
        T.StructField("source_type", T.StringType(), False),
        T.StructField("document_id", T.StringType(), False),
        *(T.StructField(n, T.StringType()) for n in ("source_location", "source_branch", "content_hash", "last_modified_date", "last_modified_by", "processed_date", "processed_by")),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("document_title", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("processing_time_seconds", T.DoubleType()),
        T.StructField("file_size_bytes", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def valid(rows: DataFrame) -> DataFrame:
    """Rows that the table's constraints admit."""
    return rows.filter(F.col("status").isin(STATUSES) & F.col("source_type").isNotNull() & F.col("document_id").isNotNull())


def change_reason(known: Column, old_hash: Column, new_hash: Column, old_date: Column, new_date: Column, status: Column) -> Column:
    """The first that holds: new, other content, other date (where one is given), failed before; else unchanged."""
    return (
        F.when(~known, "new_document")
        .when(~old_hash.eqNullSafe(new_hash), "content_changed")
        .when(new_date.isNotNull() & ~new_date.eqNullSafe(old_date), "modified_date_changed")
        .when(status == "failed", "retry_failed")
        .otherwise("unchanged")
    )


def detect_changes(docs: DataFrame, tracker: DataFrame, key: Sequence[str] = tuple(KEY)) -> DataFrame:
    """``docs(key, content_hash, modified)`` with ``reason``: one equi-join with the tracker."""
    old = tracker.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("content_hash").alias("_hash"), F.col("modified").alias("_modified"), F.col("status").alias("_status"), F.lit(True).alias("_known"))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    reason = change_reason(F.coalesce("_known", F.lit(False)), F.col("_hash"), F.col("content_hash"), F.col("_modified"), F.col("modified"), F.col("_status"))
    return docs.join(old, on, "left").withColumn("reason", reason).select(*docs.columns, "reason")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("reason").agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], preserved: Sequence[str] = (), order: str = "updated_at") -> DataFrame:
    """Old rows replaced by the newest new row of their key; ``preserved`` columns keep an old row's value."""
    newest = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
    joined = old.alias("o").join(newest.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    fresh = F.col(f"n.{key[0]}").isNotNull()
    had = F.col(f"o.{key[0]}").isNotNull()
    value = lambda c: F.when(fresh & ~(had if c in preserved else F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return joined.select(*(value(c) for c in old.columns))


def partial_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], updated: Sequence[str]) -> DataFrame:
    """Only ``updated`` columns change in rows that exist; new keys are inserted whole."""
    joined = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")
    had = F.col(f"o.{key[0]}").isNotNull()
    value = lambda c: (F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in updated else F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c)
    return joined.select(*(value(c) for c in old.columns))


def delete(rows: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*key), list(key), "left_anti")


def stats(tracker: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts by status, chunks, mean time and last run; one row, or one for each group."""
    measures = [
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("n_chunks"),
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.round(F.avg("seconds"), 6).alias("avg_seconds"),
        F.max("processed").alias("last_processed"),
    ]
    return tracker.groupBy(*by).agg(*measures) if by else tracker.agg(F.countDistinct("source").alias("n_sources"), *measures)


def recent(tracker: DataFrame, n: int, order: str = "processed", key: str = "document_id") -> DataFrame:
    return tracker.orderBy(F.desc(order), key).limit(n)


def top_per_group(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their ``rank``; Spark cuts groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def success_rates(tracker: DataFrame, by: str) -> DataFrame:
    """(by, n, success_rate) of finished documents: successes among successes and failures."""
    done = tracker.filter(F.col("status").isin("success", "failed"))
    return done.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "success").cast("double")), 6).alias("success_rate"))


def largest(tracker: DataFrame, by: str, size: str, n: int, key: str = "document_id") -> DataFrame:
    """The n largest documents of each group with their rank."""
    return top_per_group(tracker, by, [F.desc(size), F.col(key)], n)


def corpus_status(docs: DataFrame, chunks: DataFrame, tracker: DataFrame) -> DataFrame:
    """One row: documents, chunks, documents with chunks, tracked and failed documents."""
    parts = [docs.agg(F.count("*").alias("n_documents")), chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_chunked")), tracker.agg(F.count("*").alias("n_tracked"), F.count_if(F.col("status") == "failed").alias("n_failed"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
