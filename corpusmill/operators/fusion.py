"""Fusion of ranked lists and aggregation over several queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

METHODS = ("frequency", "max", "average")


def rank_score(order: list[Column], partition: list[Column | str] = ()) -> Column:
    """(n - i) / n for the i-th row (from 0) of its list."""
    w = Window.partitionBy(*partition)
    return (F.count("*").over(w) - F.row_number().over(w.orderBy(*order)) + 1) / F.count("*").over(w)


def by_position(ranked: DataFrame, out: str, key: str = "doc_id", score: str = "score") -> DataFrame:
    """A retrieved list (already cut to k rows) with its position scores."""
    return ranked.select(key, rank_score([F.desc(score), F.col(key)]).alias(out))


def fuse(semantic: DataFrame, keyword: DataFrame, weights: tuple[float, float], key: str = "doc_id") -> DataFrame:
    """Weighted sum of ``s`` and ``k``; a row missing on one side has 0 there."""
    joined = semantic.join(keyword, key, "full_outer").fillna(0.0, ["s", "k"])
    return joined.withColumn("fused", F.round(weights[0] * F.col("s") + weights[1] * F.col("k"), 6))


def fuse_normalised(semantic: DataFrame, keyword: DataFrame, weights: tuple[float, float] = (0.6, 0.4), key: str = "doc_id") -> DataFrame:
    """Like ``fuse``, with keyword scores divided by their largest."""
    top = F.max("k").over(Window.partitionBy())  # the list was cut to k rows before
    return fuse(semantic, keyword.withColumn("k", F.when(top > 0, F.col("k") / top).otherwise(0.0)), weights, key)


def reciprocal_rank_fusion(lists: DataFrame, c: int = 60) -> DataFrame:
    """(doc_id, fused) from rows (doc_id, rank, weight)."""
    return lists.groupBy("doc_id").agg(F.round(F.sum(F.col("weight") / (c + F.col("rank"))), 6).alias("fused"))


def frequency_relevance(hits: DataFrame, least: int = 2, k: int | None = 10, method: str = "frequency", key: str = "chunk_id") -> DataFrame:
    """Rows (query_index, chunk_id, score) to chunks found by at least ``least`` queries, best first.

    The final score is frequency times mean score, or the largest or mean one; without ``k`` all are returned.
    """
    final = {"max": F.max("score"), "average": F.avg("score")}.get(method, F.count("*") * F.avg("score"))
    found = hits.groupBy(key).agg(
        F.count("*").alias("frequency"),
        F.round(F.avg("score"), 9).alias("avg_score"),
        F.round(final, 9).alias("final_score"),
        F.sort_array(F.collect_list("query_index")).alias("query_indices"),
    )
    found = found.filter(F.col("frequency") >= least)
    return found if k is None else found.orderBy(F.desc("final_score"), key).limit(k)


#: What an aggregation goes by; any other name stands for the first.
AGGREGATIONS = ("frequency_relevance", "max", "average")


def aggregate(hits: DataFrame, method: str = AGGREGATIONS[0], k: int | None = 10, least: int = 2, key: str = "chunk_id") -> DataFrame:
    """Hits of several queries in one list by the named method."""
    known = method if method in AGGREGATIONS else AGGREGATIONS[0]
    return frequency_relevance(hits, least, k, "frequency" if known == AGGREGATIONS[0] else known, key)


def above(aggregated: DataFrame, frequency: int | None = None, average: float | None = None, final: float | None = None) -> DataFrame:
    for column, bound in (("frequency", frequency), ("avg_score", average), ("final_score", final)):
        if bound is not None:
            aggregated = aggregated.filter(F.col(column) >= bound)
    return aggregated


def aggregation_stats(aggregated: DataFrame) -> DataFrame:
    zero = lambda c, name: F.coalesce(F.round(c.cast("double"), 9), F.lit(0.0)).alias(name)
    of = [("frequency", "freq"), ("avg_score", "avg"), ("final_score", "final")]
    return aggregated.agg(F.count("*").alias("n"), *(zero(f(c), f"{p}_{n}") for c, n in of for f, p in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))))


def frequency_histogram(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    return hits.groupBy(key).agg(F.count("*").alias("frequency")).groupBy("frequency").agg(F.count("*").alias("n"))


def multi_query_stats(hits: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: results, distinct chunks, results per query, most and least often found."""
    per = hits.groupBy(key).agg(F.count("*").alias("f"))
    total = hits.agg(F.count("*").alias("n_results"), F.countDistinct("query_index").alias("n_queries"))
    chunks = per.agg(F.count("*").alias("n_chunks"), F.coalesce(F.max("f"), F.lit(0)).alias("max_frequency"), F.coalesce(F.min("f"), F.lit(0)).alias("min_frequency"))
    both = total.crossJoin(chunks)  # one row each
    return both.withColumn("per_query", F.when(F.col("n_queries") > 0, F.round(F.col("n_results") / F.col("n_queries"), 6)).otherwise(0.0))


def hybrid_context(semantic: DataFrame, keyword: DataFrame, total: int = 10, weights: tuple[float, float] = (0.7, 0.3), key: str = "doc_id") -> DataFrame:
    """(doc_id, origin, position): the semantic share, then keyword hits not in it, then more semantic ones.

    Both inputs have a ``rank`` from 1. A row lost to rounding goes to the semantic share.
    """
    if abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must add up to 1")
    ns, nk = int(total * weights[0]), int(total * weights[1])
    ns += total - ns - nk
    first = semantic.filter(F.col("rank") <= ns).select(key, "rank", F.lit(0).alias("part"))
    fresh = keyword.join(first.select(key), key, "left_anti")
    order = Window.partitionBy().orderBy("rank", key)  # ranked lists have k rows
    fresh = fresh.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= nk).select(key, "rank", F.lit(1).alias("part"))
    rest = semantic.filter(F.col("rank") > ns).select(key, "rank", F.lit(2).alias("part"))
    every = first.unionByName(fresh).unionByName(rest)
    placed = every.withColumn("position", F.row_number().over(Window.partitionBy().orderBy("part", "rank", key)))
    names = F.element_at(F.array(F.lit("semantic"), F.lit("keyword"), F.lit("backfill")), F.col("part") + 1)
    return placed.filter(F.col("position") <= total).select(key, names.alias("origin"), "position")


def context_shares(context: DataFrame) -> DataFrame:
    n = F.count("*")
    share = lambda o: F.round(F.coalesce(F.count_if(F.col("origin") == o) * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)), 6)
    return context.agg(n.alias("n"), share("semantic").alias("semantic_pct"), share("keyword").alias("keyword_pct"), share("backfill").alias("backfill_pct"))


def context_report(context: DataFrame, keyword: DataFrame, semantic: DataFrame, weights: tuple[float, float] = (0.7, 0.3), key: str = "doc_id") -> DataFrame:
    """One row: rows of each origin, keyword hits that the semantic share had already, wanted and actual split."""
    n = F.count("*")
    share = lambda *o: F.format_string("%.0f%%", F.coalesce(F.count_if(F.col("origin").isin(*o)) * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0)))
    chosen = context.filter("origin = 'semantic'").select(key)
    twice = keyword.join(chosen, key, "left_semi").agg(F.count("*").alias("duplicates_removed"))
    target = "/".join(f"{w:.0%}" for w in weights)
    counted = context.agg(F.count_if(F.col("origin") != "keyword").alias("n_semantic"), F.count_if(F.col("origin") == "keyword").alias("n_keyword"), F.concat(share("semantic", "backfill"), F.lit("/"), share("keyword")).alias("actual_split"))
    return counted.crossJoin(twice).withColumn("target_split", F.lit(target))  # one row each


def most_found(hits: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """(chunk_id, frequency, rank): the chunks that most queries found."""
    found = hits.groupBy(key).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), key).limit(k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("frequency"), key)))  # k rows
