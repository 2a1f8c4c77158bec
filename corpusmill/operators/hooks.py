"""Plug points for models. Each has a default that needs none and gives the same result everywhere."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as T
from corpusmill.operators import context, lexical

WHITE = " \n\t\r"
# Labels that models put before an answer.
LABELS = ["Assistant:", "AI:", "Response:", "Answer:", "Human:", "User:", "Query:"]


def hashed_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """Bag of words hashed to ``dim`` signed counts, unit length."""
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1.0)


def with_fallback(*models: Callable[[list], object]) -> Callable[[list], object]:
    """A model that asks each in turn until one answers; the last one's error is raised if none does."""

    def ask(texts: list):
        for i, model in enumerate(models):
            try:
                return model(texts)
            except Exception:
                if i + 1 == len(models):
                    raise

    return ask


def with_retries(model: Callable[[list], object], tries: int = 3, wait: float = 1.0, factor: float = 2.0, per_second: float | None = None) -> Callable[[list], object]:
    """A model that is asked again after ``wait`` seconds, longer each time, and no more than ``per_second`` times a
    second by one worker; the last error is raised."""
    import time

    last = [0.0]

    def ask(texts: list):
        pause = wait
        for i in range(tries):
            if per_second:
                time.sleep(max(0.0, last[0] + 1 / per_second - time.monotonic()))
            last[0] = time.monotonic()
            try:
                return model(texts)
            except Exception:
                if i + 1 == tries:
                    raise
                time.sleep(pause)
                pause *= factor

    return ask


def embed(docs: DataFrame, text: str = "text", out: str = "embedding", model: Callable[[list[str]], np.ndarray] = hashed_vectors) -> DataFrame:
    """Add vectors of a text column by a model that takes a list of texts; one Arrow batch at a time."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(model(b.fillna("").tolist())))

    return docs.withColumn(out, run(F.col(text)))


def rerank(rows: DataFrame, query: str, top_k: int, threshold: float = 0.0, model: Callable[[str, list[str]], list[float]] | None = None, key: str = "doc_id") -> DataFrame:
    """Score query and the first 512 characters of each row, drop what is below the threshold, keep the best."""
    head = F.substring("text", 1, 512)
    if model is None:
        score = F.round(lexical.rerank_score(head, query), 6)
    else:

        @F.pandas_udf("double")
        def run(column: pd.Series) -> pd.Series:
            return pd.Series(model(query, column.tolist()), dtype="float64")

        score = run(head)
    scored = rows.withColumn("score", score)
    return (scored.filter(F.col("score") >= threshold) if threshold > 0 else scored).orderBy(F.desc("score"), key).limit(top_k)


def summarise(docs: DataFrame, text: str = "text", model: Callable[[list[str]], list[str]] | None = None, key: str = "doc_id", k: int = 10) -> DataFrame:
    """Add a summary: a model's, or the ``k`` most frequent words of the whole text, most frequent first."""
    if model is None:
        found = context.keywords(docs, k, key, text).groupBy(F.col(key).alias("_key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), ", ").alias("summary"))
        return docs.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(model(column.fillna("").tolist()))

    return docs.withColumn("summary", run(F.col(text)))


def compare_groups(scored: DataFrame, group: str, k: int, key: str = "doc_id") -> DataFrame:
    """The k best rows of each project, side by side."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)


def clean_response(c: Column) -> Column:
    """A model's answer without leading labels, each of which is taken off once, in list order."""
    c = F.trim(c, F.lit(WHITE))
    for label in LABELS:
        c = F.when(F.startswith(c, F.lit(label)), F.trim(F.substring(c, F.lit(len(label) + 1), F.length(c)), F.lit(WHITE))).otherwise(c)
    return c


def structured_response(c: Column) -> Column:
    """Long answers in less than four lines get a paragraph break after every third sentence."""
    parts = F.split(c, r"\. ")
    last = F.element_at(parts, -1)
    line = lambda s, i: F.concat(s, F.when(F.endswith(s, F.lit(".")), "").otherwise("."), F.when(((i + 1) % 3 == 0) & (s != last), "\n\n").otherwise(" "))
    flat = (F.length(c) > 500) & (F.size(F.split(c, "\n")) < 4)
    return F.when(flat, F.trim(F.array_join(F.transform(parts, line), ""), F.lit(WHITE))).otherwise(c)
