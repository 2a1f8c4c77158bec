"""Whole retrieval and evaluation flows, put together from the operators.

Lists have (doc_id, score) and a bounded number of rows; ``docs`` has (doc_id, text, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as T
from corpusmill.operators import boosting, context, evaluation, fusion, hooks, lexical
from corpusmill.workspace import Workspace

Leg = Callable[[int], DataFrame]


def extended(k: int) -> int:
    """How many rows each list fetches for a merged one of k."""
    return min(2 * k, 50)


def _texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of a bounded list with their documents' columns."""
    return docs.join(F.broadcast(found), "doc_id")  # a list of at most some dozens of rows


def retrieve(strategy: str, semantic: Leg, keyword: Leg, k: int, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """(doc_id, score) by strategy: hybrid merges both lists by position, semantic and keyword take one; any
    other name means semantic."""
    if strategy == "hybrid":
        n = extended(k)
        merged = fusion.fuse(fusion.by_position(semantic(n), "s"), fusion.by_position(keyword(n), "k"), weights)
        return lexical.top_k(merged.select("doc_id", F.col("fused").alias("score")), k)
    return keyword(k) if strategy == "keyword" else semantic(k)


def fused_and_reranked(semantic: DataFrame, keyword: DataFrame, docs: DataFrame, query: str, first: int, last: int, threshold: float = 0.0, weights: tuple[float, float] = (0.7, 0.3), model=None) -> DataFrame:
    """(doc_id, score): score fusion with the domain boost, the ``first`` best of it, reranked, the ``last`` best of those."""
    both = fusion.fuse(semantic.withColumnRenamed("score", "s"), keyword.withColumnRenamed("score", "k"), weights)
    boost = F.when(T.contains_any(F.lower("text"), boosting.FUSION_TERMS), 1.2).otherwise(1.0)
    scored = _texts(docs.filter("text IS NOT NULL"), both).select("doc_id", "text", F.round((weights[0] * F.col("s") + weights[1] * F.col("k")) * boost, 6).alias("fused"))
    best = lexical.top_k(scored, first, "fused").select("doc_id", "text")
    return hooks.rerank(best, query, last, threshold, model).select("doc_id", "score")


def multi_query_context(hits: DataFrame, keyword: DataFrame, total: int = 10, k: int = 10) -> DataFrame:
    """(doc_id, origin, position, frequency): chunks that several variations of a question found, by frequency
    times relevance, mixed with keyword hits. ``hits`` has (query_index, chunk_id, score) of all variations."""
    found = fusion.frequency_relevance(hits, k=k).select(F.col("chunk_id").alias("doc_id"), "frequency", "final_score")
    ranked = found.select("doc_id", F.row_number().over(Window.partitionBy().orderBy(F.desc("final_score"), "doc_id")).alias("rank"))  # k rows
    words = keyword.select("doc_id", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "doc_id")).alias("rank")).filter(F.col("rank") <= k)  # a list
    mixed = fusion.hybrid_context(ranked, words, total)
    return mixed.join(found.select("doc_id", "frequency"), "doc_id", "left").select("doc_id", "origin", "position", "frequency")


def as_documents(aggregated: DataFrame, docs: DataFrame) -> DataFrame:
    """Aggregated chunks as documents with what the aggregation found out."""
    names = {"frequency": "aggregation_frequency", "avg_score": "aggregation_avg_score", "final_score": "aggregation_final_score", "query_indices": "aggregation_query_indices"}
    return _texts(docs, aggregated.withColumnsRenamed(names | {"chunk_id": "doc_id"}))


def hierarchical(summaries: DataFrame, chunks: DataFrame, score: Callable[[Column], Column], groups: int = 5, least: float = 0.3, each: int = 5) -> DataFrame:
    """(summary_id, summary, chunk_id, score, rank): the best summaries over the threshold, then each one's best chunks.

    ``summaries(summary_id, summary, embedding)`` and ``chunks(summary_id, chunk_id, embedding)``; ``score``
    makes a similarity to the question of a vector column.
    """
    best = summaries.select("summary_id", "summary", score(F.col("embedding")).alias("_s")).orderBy(F.desc("_s"), "summary_id").limit(groups).filter(F.col("_s") >= least)
    rows = chunks.join(F.broadcast(best.select("summary_id", "summary")), "summary_id").withColumn("score", score(F.col("embedding")))  # ``groups`` rows
    rank = F.row_number().over(Window.partitionBy("summary_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= each).select("summary_id", "summary", "chunk_id", "score", "rank")


#: A word of the question has the first of these types of documents, and their boost.
TYPE_WORDS = (("sql", "sql"), ("python", "python"), ("config", "yaml"))
KEYWORD_BOOST, TYPE_BOOST = 0.1, 0.15


def summary_relevance(score: Column, keywords: Column, kind: Column, question: str) -> Column:
    """A summary's similarity, a tenth for each word of the question in its keywords, and a boost for the kind asked for."""
    low = question.lower()
    found = F.lit(0.0)
    for word in low.split():
        found = found + F.when(F.contains(F.lower(F.coalesce(keywords, F.lit(""))), F.lit(word)), KEYWORD_BOOST).otherwise(0.0)
    boost = F.lit(0.0)
    for word, name in reversed(TYPE_WORDS):
        if word in low:
            boost = F.when(F.contains(F.coalesce(kind, F.lit("")), F.lit(name)), TYPE_BOOST).otherwise(boost)
    return F.round(score + found + boost, 6)


def hierarchical_scored(summaries: DataFrame, chunks: DataFrame, question: str, top_k: int = 5, threshold: float = 0.7, each: int = 5) -> DataFrame:
    """(position, kind, summary_id, doc_id, chunk_id, content, keywords, relevance) of the best texts for a question.

    ``summaries(summary_id, doc_id, content, keywords, document_type, score)`` and ``chunks(doc_id, chunk_id, content, score)``,
    scored for the question. Of the three times ``top_k`` most similar summaries (15 at most), the ``top_k`` most
    relevant branch: at the threshold or above to the document's ``each`` best chunks, or, where it has
    none, to the summary itself. A document is branched to once. Where no branch leads to a chunk, the
    summaries below the threshold are the result too. Equal contents stay once, where they come first.
    """
    near = summaries.filter("score IS NOT NULL").orderBy(F.desc("score"), "summary_id").limit(min(3 * top_k, 15))
    relevance = summary_relevance(F.col("score"), F.col("keywords"), F.col("document_type"), question)
    near = near.withColumn("relevance", relevance).orderBy(F.desc("relevance"), F.desc("score"), "summary_id").limit(top_k)
    near = near.withColumn("branch", F.row_number().over(Window.partitionBy().orderBy(F.desc("relevance"), F.desc("score"), "summary_id")))  # ``top_k`` rows
    near = near.withColumn("routed", F.col("relevance") >= threshold)
    near = near.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "routed").orderBy("branch"))).filter("NOT routed OR again = 1")
    ws = Workspace(summaries.sparkSession, "hierarchical")
    near = ws.save(near, "near")  # all summaries are scored for these rows, once
    branches = near.filter("routed").select("branch", "summary_id", "doc_id", "keywords", "relevance")
    routed = [r["doc_id"] for r in branches.select("doc_id").collect()]  # at most ``top_k``: chunks of others needn't be scored
    rows = chunks.filter(F.col("doc_id").isin(routed)).join(F.broadcast(branches), "doc_id")  # ``top_k`` rows
    best = F.row_number().over(Window.partitionBy("branch").orderBy(F.desc("score"), "chunk_id"))
    details = rows.withColumn("place", best).filter(F.col("place") <= each).select("branch", "place", F.lit("chunk").alias("kind"), "summary_id", "doc_id", "chunk_id", "content", "keywords", "relevance")
    details = ws.save(details, "details")
    alone = near.join(details.select("branch").distinct(), "branch", "left_anti")
    some = details.agg((F.count("*") > 0).alias("some"))
    alone = alone.crossJoin(F.broadcast(some)).filter("routed OR NOT some")  # one row
    alone = alone.select("branch", F.lit(1).alias("place"), F.lit("summary").alias("kind"), "summary_id", "doc_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id"), "content", "keywords", "relevance")
    every = details.unionByName(alone).withColumn("first", F.row_number().over(Window.partitionBy(F.md5("content")).orderBy("branch", "place"))).filter("first = 1")
    order = F.row_number().over(Window.partitionBy().orderBy("branch", "place"))  # at most ``top_k * each`` rows
    return every.withColumn("position", order).filter(F.col("position") <= top_k).select("position", "kind", "summary_id", "doc_id", "chunk_id", "content", "keywords", "relevance")


def evaluate(scores: DataFrame, bounds: dict[str, float], per_mille: int, key: str = "event_id") -> DataFrame:
    """(key, overall, n_violations, alerts): sampled rows with their weighted quality and the bounds they don't keep."""
    rows = evaluation.sampled(scores, key, per_mille)
    broken = F.array_compact(F.array(*(F.when(F.coalesce(F.col(n), F.lit(0.0)) < b, F.lit(n)) for n, b in bounds.items())))
    return rows.select(key, evaluation.overall_quality().alias("overall"), F.size(broken).alias("n_violations"), F.array_join(broken, ",").alias("alerts"))


def answer(docs: DataFrame, query: str, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(doc_id, answer) without a model: key sentences where there are any, else excerpts, else a note."""
    sentences = context.key_sentences(docs, query, most, key).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "sentence"))), lambda x: x["sentence"]), " ").alias("_s"))
    rows = docs.join(sentences, key, "left")
    parts = F.array_join(context.excerpts(F.col("text"), query, most), " ")
    return rows.select(key, F.coalesce("_s", F.nullif(parts, F.lit("")), F.lit("No relevant information found.")).alias("answer"))


SOURCE_KEYS = {
    # source type: names it goes by, then the first present of: id, location, branch
    "repo_file": (["repo_file"], ["file_path", "source"], "repository", "unknown", "branch"),
    "wiki_page": (["wiki_page"], ["page_id", "source"], "space_key", "", None),
    "local_file": (["local_file", "local_files"], ["source", "filename"], None, "local", None),
}


def source_keys(meta: Column) -> Column:
    """Struct (source_type, document_id, location, branch) that tracks a chunk; null for unknown types."""
    kind = F.coalesce(meta["type"], meta["source_type"])
    out = F.lit(None).cast("struct<source_type: string, document_id: string, location: string, branch: string>")
    for name, (names, ids, place, default, branch) in SOURCE_KEYS.items():
        location = F.coalesce(meta[place], F.lit(default)) if place else F.lit(default)
        made = F.struct(F.lit(name).alias("source_type"), F.coalesce(*(meta[i] for i in ids), F.lit("unknown")).alias("document_id"), location.alias("location"), (F.coalesce(meta[branch], F.lit("")) if branch else F.lit("")).alias("branch"))
        out = F.when(kind.isin(names), made).otherwise(out)
    return out


def for_audience(rows: DataFrame, audience: str = "business") -> DataFrame:
    """``rows(response, sources, confidence_score, safety_score, metadata)`` as shown: plain for business, with details else."""
    shown = rows.select(F.coalesce("response", F.lit("")).alias("content"), "sources", F.coalesce("confidence_score", F.lit(0.0)).alias("confidence"), F.coalesce("safety_score", F.lit(0.0)).alias("safety_score"), F.lit(audience).alias("audience"), "metadata")
    return shown.withColumn("simplified", F.lit(True)).drop("metadata") if audience == "business" else shown.withColumnRenamed("metadata", "technical_details")


def log_rows(results: DataFrame, by: Sequence[str], most: int = 10) -> DataFrame:
    """The first ``most`` documents of each result for the log: source, source_type, filename."""
    top = results.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter(F.col("_n") <= most)
    return top.select(*by, F.col("_n").alias("rank"), "source", "source_type", F.element_at(F.split("source", "/"), -1).alias("filename"))


def fresh_results(cache: DataFrame, now: Column, seconds: int = 300, most: int = 100) -> DataFrame:
    """Entries of ``cache(key, at, ...)`` that are still good: the newest of each key, younger than the lifetime, the ``most`` newest."""
    newest = cache.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))).filter("_n = 1").drop("_n")
    return newest.filter(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp")) < seconds).orderBy(F.desc("at"), "key").limit(most)


def cached_results(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """Every row of ``asked(key)`` with the newest entry of ``cache(key, at, ...)`` and a status: 200, or 404 where there is none."""
    newest = cache.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at")))).filter("_n = 1").drop("_n")
    return asked.join(newest, "key", "left").withColumn("status", F.when(F.col("at").isNotNull(), 200).otherwise(404))


def projects(rows: DataFrame, column: str = "project_tag", default: Sequence[str] = ("general",)) -> DataFrame:
    """(project): the distinct tags of the rows, or the default ones where there are none."""
    found = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("project")).distinct()
    none = found.agg((F.count("*") == 0).alias("none"))  # one row
    given = none.filter("none").select(F.explode(F.array(*(F.lit(d) for d in default))).alias("project"))
    return found.unionByName(given).orderBy("project")
