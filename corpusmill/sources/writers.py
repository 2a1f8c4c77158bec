"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusmill.functions import text as T


def write_vectors(chunks: DataFrame, path: str, replace: bool = False) -> None:
    """Vector rows in a folder for each source type, so that scans of one type read only it."""
    chunks.write.mode("overwrite" if replace else "append").partitionBy("source_type").parquet(path)


def delete_documents(spark: SparkSession, path: str, gone: DataFrame, key: list[str], staging: str) -> None:
    """Rewrite a vector table without some documents: written beside it, then put in its place.

    The old table is moved aside first and deleted last, so a failure at any point leaves a whole one.
    """
    spark.read.parquet(path).join(gone.select(*key), key, "left_anti").write.mode("overwrite").partitionBy("source_type").parquet(staging)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    live, new, old = hadoop(path), hadoop(staging), hadoop(f"{path.rstrip('/')}.old")
    fs = live.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(live, old) or not fs.rename(new, live):
        raise OSError(f"{path}: the new table is at {staging}, the old one at {old}")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def flat_metadata(meta: Column) -> Column:
    """A map of JSON texts to plain strings: lists joined by commas, all else as it is."""
    return F.transform_values(meta, lambda _, v: F.when(F.startswith(v, F.lit("[")), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v))


def summaries(chunks: DataFrame, by: str = "source", most: int = 300) -> DataFrame:
    """(source, summary, chunk_count): the start of each source's chunks in order, joined by blank lines.

    Each chunk but the first adds two characters at least, so the start of the joined text is in the
    starts of the first ``most // 2 + 2`` chunks; no more text than that is gathered. Which chunks a
    summary stands for is in the chunks (``hierarchy``), not in a list beside it.
    """
    lead = chunks.filter("content IS NOT NULL").select(F.col(by).alias("_by"), "chunk_index", "chunk_id", F.substring("content", 1, most + 1).alias("content"))
    first = F.row_number().over(Window.partitionBy("_by").orderBy("chunk_index", "chunk_id", "content"))
    lead = lead.withColumn("_n", first).filter(F.col("_n") <= most // 2 + 2)
    text = lead.groupBy("_by").agg(F.sort_array(F.collect_list(F.struct("_n", "content"))).alias("c")).select("_by", F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("_text"))
    counted = chunks.groupBy(by).agg(F.count("*").cast("int").alias("chunk_count"))
    joined = counted.join(text, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.select(by, T.preview(F.coalesce("_text", F.lit("")), most).alias("summary"), "chunk_count")


def summary_id(by: Column) -> Column:
    return F.concat(F.lit("summary_"), F.md5(F.coalesce(by.cast("string"), F.lit(""))))


def hierarchy(chunks: DataFrame, by: str = "source", most: int = 300) -> tuple[DataFrame, DataFrame]:
    """Two tables: summaries with their ids, and the chunks with the id of the summary that covers them."""
    top = summaries(chunks, by, most).withColumn("summary_id", summary_id(F.col(by)))
    return top, chunks.withColumn("summary_id", summary_id(F.col(by)))


def write_hierarchy(chunks: DataFrame, path: str, by: str = "source", most: int = 300) -> None:
    """Both tables of ``hierarchy`` in folders of their own."""
    top, rows = hierarchy(chunks, by, most)
    top.write.mode("overwrite").parquet(f"{path}/summaries")
    rows.write.mode("overwrite").parquet(f"{path}/chunks")


def summary_documents(answered: DataFrame) -> DataFrame:
    """Rows for the summary index from ``answered(doc_id, filename, file_path, document_type, source_type, answer)``.

    ``answer`` is a model's text; documents whose answer isn't usable are skipped.
    """
    rows = answered.withColumn("_a", T.summary_answer(F.col("answer"))).filter("_a IS NOT NULL")
    listed = lambda n: F.array_join(F.col(f"_a.{n}"), ", ").alias(n)
    return rows.select(
        F.col("doc_id").alias("original_doc_id"), F.lit(True).alias("is_summary"), "filename", "file_path", "document_type", "source_type",
        F.col("_a.summary").alias("document_summary"), listed("keywords"), listed("topics"), F.col("_a.business_context").alias("business_context"),
        T.flat_details(F.col("_a.technical_details")).alias("details"), T.summary_text(F.col("filename"), F.col("document_type"), F.col("_a")).alias("content"), F.lit(0).alias("chunk_index"),
    )


def write_activity(events: DataFrame, folder: str) -> None:
    """JSON lines in a folder for each day."""
    events.withColumn("event_date", F.to_date("timestamp")).write.mode("append").partitionBy("event_date").json(folder)


def search_events(queries: DataFrame) -> DataFrame:
    """``queries(session_id, query, num_results, seconds)`` as activity events."""
    return queries.select(F.uuid().alias("event_id"), F.current_timestamp().cast("string").alias("timestamp"), "session_id", F.lit("search").alias("event_type"), "query", F.struct(F.col("num_results"), (F.col("seconds") * 1000).cast("long").alias("total_time_ms")).alias("results"))


def feedback_events(feedback: DataFrame) -> DataFrame:
    return feedback.select(F.uuid().alias("event_id"), F.current_timestamp().cast("string").alias("timestamp"), "session_id", F.concat(F.lit("feedback_"), "kind").alias("event_type"), "query", F.struct(F.col("kind").alias("type"), "comment").alias("feedback"))


def source_click_events(clicks: DataFrame) -> DataFrame:
    """``clicks(session_id, query, source, source_type)`` as activity events."""
    doc = F.struct("source", "source_type", F.element_at(F.split("source", "/"), -1).alias("filename"))
    return clicks.select(F.uuid().alias("event_id"), F.current_timestamp().cast("string").alias("timestamp"), "session_id", F.lit("source_click").alias("event_type"), "query", F.array(doc).alias("retrieved_docs"))


def evaluation_events(results: DataFrame, bounds: dict[str, float]) -> DataFrame:
    """One event for each evaluated query: its scores, whether each keeps its bound, and how many don't."""
    scores = F.create_map(*(x for n in bounds for x in (F.lit(n), F.col(n).cast("double"))))
    flags = F.create_map(*(x for n, b in bounds.items() for x in (F.lit(n), F.coalesce(F.col(n) >= b, F.lit(False)))))
    failed = F.size(F.map_filter(flags, lambda _, ok: ~ok))
    return results.select("event_id", "query", scores.alias("scores"), flags.alias("within"), failed.alias("n_violations"))


def metric_logs(events: DataFrame) -> DataFrame:
    """(event_id, log, metric, value): each score under the log that it belongs to, violations under alerts as well."""
    rows = events.select("event_id", F.explode("scores").alias("metric", "value"), "within")
    log = F.when(F.startswith("metric", F.lit("context_")), "retrieval").otherwise("generation")
    alerts = rows.filter(~F.col("within")[F.col("metric")]).select("event_id", F.lit("alerts").alias("log"), "metric", "value")
    return rows.select("event_id", log.alias("log"), "metric", "value").unionByName(alerts)


def write_logs(logs: DataFrame, folder: str) -> None:
    """JSON lines in a folder for each log."""
    logs.write.mode("append").partitionBy("log").json(folder)


def export_csv(rows: DataFrame, path: str, order: str) -> None:
    rows.orderBy(F.desc(order)).write.mode("overwrite").csv(path, header=True)


def export_metrics(metrics: DataFrame, path: str, kind: str = "json") -> None:
    if kind != "json":
        raise ValueError(f"unknown export format: {kind}")
    metrics.write.mode("overwrite").json(path)
