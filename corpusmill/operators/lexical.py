"""Keyword retrieval: postings, BM25, overlap scoring, lexical reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as T

K1, B, EPSILON = 1.5, 0.75, 0.25


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def _has(term: str) -> Callable[[Column], Column]:
    return lambda x: F.contains(x, F.lit(term))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """(doc_id, term, tf) of all documents; ``drop`` leaves stop words out."""
    words = T.tokens(F.col(text))
    if drop:
        words = F.filter(words, lambda x: ~x.isin(list(drop)))
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(words).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    words = T.tokens(F.col(text))
    if drop:
        words = F.filter(words, lambda x: ~x.isin(list(drop)))
    return docs.select(F.col(key).alias("doc_id"), F.size(words).cast("long").alias("dl"))


def _words(text: str, drop: Sequence[str]) -> Column:
    words = T.tokens(F.col(text))
    return F.filter(words, lambda x: ~x.isin(list(drop))) if drop else words


def corpus_figures(docs: DataFrame, text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """One row: number of documents and their mean length in terms."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(_words(text, drop))).alias("avgdl"))


def term_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", drop: Sequence[str] = (), figures: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) over the whole corpus, idf not floored."""
    df = docs.select(F.explode(F.array_distinct(_words(text, drop))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = (figures or docs.agg(F.count("*").alias("n_docs"))).select("n_docs")
    return df.crossJoin(F.broadcast(total)).select("term", "df", (F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("idf"))  # one row


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score) of documents that have a query term. A term repeated in the query counts again.

    Only rows of query terms are exploded; document frequencies of all terms are needed once, for the
    mean idf that replaces negative ones, and come down to one row together with those of the query.
    """
    wanted = [w for w in query.lower().split() if w not in set(drop)]
    weights = {w: wanted.count(w) for w in wanted}
    figures = corpus_figures(docs, text, drop)
    stats = term_statistics(docs, key, text, drop, figures)
    mine = F.map_from_entries(F.collect_list(F.when(F.col("term").isin(list(weights)), F.struct("term", "idf"))))
    known = stats.agg(F.avg("idf").alias("mean_idf"), mine.alias("idfs")).crossJoin(figures)  # one row each
    hits = docs.select(F.col(key).alias("doc_id"), _words(text, drop).alias("w"))
    per = [F.struct(F.lit(t).alias("term"), F.size(F.filter("w", _equals(t))).alias("tf"), F.lit(n).alias("qn")) for t, n in weights.items()]
    hits = hits.select("doc_id", F.size("w").alias("dl"), F.explode(F.array(*per)).alias("h")).filter("h.tf > 0").select("doc_id", "dl", "h.*")
    joined = hits.crossJoin(F.broadcast(known)).withColumn("idf", F.element_at("idfs", F.col("term")))  # one row
    idf = F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf"))
    part = F.col("qn") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def overlap_score(text: Column, query: str, is_sql_file: Column | None = None) -> Column:
    """Share of query terms in the text, exact-match boost, and a fifth for SQL files."""
    terms = T.query_terms(query)
    words = F.array_distinct(T.tokens(text))
    share = F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) / len(terms) if terms else F.lit(0.0)
    total = share + T.exact_match_boost(text, query)
    return total + F.when(is_sql_file, 0.2).otherwise(0.0) if is_sql_file is not None else total


def rerank_score(text: Column, query: str) -> Column:
    """A tenth for each occurrence of each term, and up to a fifth for the first of 50 words that has it."""

    def score(low: Column) -> Column:
        def total(head: Column) -> Column:
            found = F.lit(0.0)
            for term in query.lower().split():
                place = F.array_position(F.transform(head, _has(term)), F.lit(True))
                found = found + T.occurrences(low, term) * 0.1 + F.when(place > 0, (51 - place) / 50.0 * 0.2).otherwise(0.0)
            return found

        return F.get(F.transform(F.array(T.first_words(low, 50)), total), F.lit(0))

    return F.get(F.transform(F.array(F.lower(text)), score), F.lit(0))  # lowered and split once, however many terms there are


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best, ties by key: one sort-and-take per task and a merge of k rows from each."""
    return scored.orderBy(F.desc(score), key).limit(k)
