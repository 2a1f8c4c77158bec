"""Retrieval, generation and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as T

# Word lists, weights and bounds that results depend on.
DISCLAIMERS = ["consult", "healthcare professional", "medical advice", "professional", "expert", "not a substitute"]
SENSITIVE = ["advice", "recommendation", "decision", "critical", "important", "urgent", "guidance"]
CERTAIN = ["definitely", "certainly", "always", "never", "guaranteed"]
CITING = ["based on", "according to"]
QUALITY_WEIGHTS = {"faithfulness": 0.30, "answer_relevancy": 0.25, "context_precision": 0.20, "context_recall": 0.15, "answer_correctness": 0.10}


def precision_at_k(results: DataFrame, k: int, query: str = "query_index") -> DataFrame:
    """Rows (query_index, rank, relevant) to the share of relevant rows in the first k that exist."""
    n = F.count("*")
    hits = F.sum(F.when((F.col("rank") <= k) & F.col("relevant"), 1).otherwise(0))
    return results.groupBy(query).agg(F.round(hits / F.least(n, F.lit(k)), 6).alias("precision_at_k"))


def mean_reciprocal_rank(results: DataFrame, query: str = "query_index") -> DataFrame:
    first = results.groupBy(query).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return first.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def hit_rate_at_k(results: DataFrame, k: int, query: str = "query_index") -> DataFrame:
    hit = results.groupBy(query).agg(F.max(F.when((F.col("rank") <= k) & F.col("relevant"), 1.0).otherwise(0.0)).alias("hit"))
    return hit.agg(F.count("*").alias("n_queries"), F.round(F.avg("hit"), 6).alias("hit_rate"))


def chunk_overlap(results: DataFrame, query: str = "query_index", source: str = "source") -> DataFrame:
    """Share of results beyond the first of their source; 0 for fewer than two."""
    per = results.groupBy(query, source).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return per.groupBy(query).agg(F.round(F.when(total < 2, 0.0).otherwise(F.sum(F.col("n") - 1) / F.greatest(total - 1, F.lit(1))), 6).alias("chunk_overlap"))


def citation_coverage(response: Column, sources: Column) -> Column:
    """Share of sources (arrays of names) with a name of more than three characters in the response."""
    low = F.lower(response)
    cited = F.filter(sources, lambda names: F.exists(names, lambda x: (F.length(x) > 3) & F.contains(low, F.lower(x))))
    return F.when(F.size(sources) > 0, F.round(F.size(cited) / F.size(sources), 6)).otherwise(0.0)


def safety_score(response: Column, query: Column) -> Column:
    r, q = F.lower(response), F.lower(query)
    total = F.lit(1.0) - F.when(T.contains_any(q, SENSITIVE) & ~T.contains_any(r, DISCLAIMERS), 0.3).otherwise(0.0)
    total = total - F.when(T.contains_any(r, CERTAIN), 0.2).otherwise(0.0) + F.when(T.contains_any(r, CITING), 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def generation_metrics(response: Column) -> dict[str, Column]:
    return {"response_length": F.length(response).cast("long"), "token_count": F.round(F.size(T.tokens(response)) * 1.3, 6)}


def overall_quality(weights: dict[str, float] = QUALITY_WEIGHTS) -> Column:
    """Weighted mean of the scores above 0; 0 where there is none."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        there = F.coalesce(F.col(name), F.lit(0.0)) > 0
        total = total + F.when(there, w * F.col(name)).otherwise(0.0)
        weight = weight + F.when(there, w).otherwise(0.0)
    return F.round(F.when(weight > 0, total / weight).otherwise(0.0), 6)


def threshold_flags(bounds: dict[str, float]) -> list[Column]:
    return [(F.col(n) >= b).alias(f"{n}_ok") for n, b in bounds.items()]


def violations(flags: DataFrame, names: list[str]) -> DataFrame:
    """(metric, n): rows of false flags."""
    rows = flags.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("ok")) for n in names))).alias("x"))
    return rows.groupBy("x.metric").agg(F.count_if(~F.col("x.ok")).alias("n"))


def confidence(sources: Column, unique: Column, seconds: Column) -> Column:
    raw = 0.3 + F.least(sources / 5, F.lit(1.0)) * 0.3 + F.least(unique / 3, F.lit(1.0)) * 0.3 + F.greatest(1 - seconds / 20, F.lit(0.0)) * 0.1
    return F.round(F.greatest(F.lit(0.5), F.least(F.lit(1.0), raw)), 6)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")


def session_summary(events: DataFrame, by: str = "session") -> DataFrame:
    """Per session: events, mean of what isn't null, share of failures, minutes from first to last."""
    minutes = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6
    return events.groupBy(by).agg(F.count("*").alias("n_events"), F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("error_rate"), F.round(minutes, 6).alias("minutes"))


def rated_summary(rows: DataFrame, session: str, rating: str, value: str) -> DataFrame:
    """Per session and rating: rows, mean value, and the rating's share of the session's rows."""
    counted = rows.groupBy(session, rating).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    total = F.sum("n").over(Window.partitionBy(session))
    return counted.withColumn("share", F.round(F.col("n") / total, 6))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg(F.when(F.col("rating") != 0, F.col("rating"))), 2), F.lit(0.0)).alias("avg_rating"), F.count_if(F.col("helpful")).alias("n_helpful"))


def sampled(rows: DataFrame, key: str, per_mille: int) -> DataFrame:
    """A sample that depends on the key alone: the same rows whatever the partitioning."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % 1000
    return rows.filter(bucket < per_mille)


def attach_first(feedback: DataFrame, events: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Feedback with the first event of its key."""
    first = events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
    return feedback.join(first, key, "left")


def attach_by_position(feedback: DataFrame, turns: DataFrame, session: str, position: str, order: str) -> DataFrame:
    """``feedback(session, position, ...)`` with the turn at that place (from 0) of the session, also for places that aren't there."""
    numbered = turns.withColumn(position, (F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1).cast("long"))
    return feedback.join(numbered, [session, position], "left")
