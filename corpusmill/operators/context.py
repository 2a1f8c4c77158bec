"""Contexts under a size budget and deterministic answers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from corpusmill.functions import text as T
from corpusmill.workspace import Workspace

# Fixed values.
TECHNICAL = [
    "configuration", "setup", "database", "server", "deployment", "api",
    "integration", "system", "architecture", "implementation", "framework",
    "protocol", "authentication", "endpoint", "middleware", "repository",
]
KEYWORD_STOPS = ["and", "the", "for", "with", "from", "this", "that", "are", "have"]
SEPARATOR = "\n\n--- Document ---\n"
CUT = "...[truncated]"


def relevance(text: Column, query: str, technical: bool = False) -> Column:
    """Two for each occurrence of a query term, 1.5 for technical ones, less length / 10,000; at least 0."""
    low = F.lower(text)
    total = F.lit(0.0)
    for term in sorted(set(query.lower().split())):
        total = total + T.occurrences(low, term) * 2.0
    for term in TECHNICAL if technical else ():
        total = total + T.occurrences(low, term) * 1.5
    return F.greatest(total - F.length(text) / 10000, F.lit(0.0))


def pack(ranked: DataFrame, budget: int, partial: bool = True, by: str | None = None) -> DataFrame:
    """``ranked(rank, text)`` to the rows that fit, best first; the first that doesn't is cut or dropped and ends it.

    A running sum over the ranking decides; ``by`` packs one context for each group.
    """
    need = F.length("text") + len(SEPARATOR)
    w = (Window.partitionBy(by) if by else Window.partitionBy()).orderBy("rank")
    rows = ranked.withColumn("used", F.sum(need).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("used") - need).withColumn("fits", F.col("used") <= budget)
    rows = rows.withColumn("overflows", F.sum(F.when(F.col("fits"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = budget - F.col("before")
    cut = F.concat(F.substring("text", F.lit(1), (left - len(SEPARATOR) - 20).cast("int")), F.lit(CUT))
    kept = F.col("fits") & (F.col("overflows") == 0)
    first_over = (F.col("overflows") == 1) & ~F.col("fits") & (left > 500) & F.lit(partial)
    return rows.filter(kept | first_over).withColumn("content", F.when(kept, F.col("text")).otherwise(cut)).drop("used", "before", "fits", "overflows")


def context_string(rows: DataFrame, by: list[str] = [], separator: str = "\n\n---\n\n") -> DataFrame:  # noqa: B006
    """One text from ``rows(rank, content)``, each document under its number and, where there are such columns
    with a value, its source, file (``file_path``) and project (``project_tag``)."""
    lines = [(label, c) for label, c in (("Source", "source"), ("File", "file_path"), ("Project", "project_tag")) if c in rows.columns]
    head = lambda x: F.concat(F.lit("[Document "), x["rank"].cast("string"), F.lit("]"), *(F.coalesce(F.concat(F.lit(f"\n{label}: "), x[c]), F.lit("")) for label, c in lines), F.lit("\n\n"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", *(c for _, c in lines), "content"))), lambda x: F.concat(head(x), x["content"]))
    return rows.groupBy(*by).agg(F.array_join(parts, separator).alias("context"))


def token_estimate(text: Column) -> Column:
    """About four characters make a token."""
    return F.floor(F.length(text) / 4)


def truncated(contexts: DataFrame, query: str, max_tokens: int, buffer: int, technical: bool = False, key: str = "id") -> DataFrame:
    """``contexts(id, context)`` within a token budget: those that fit as they are, of the others the documents that
    matter most for the query, in that order, until the first that doesn't fit."""
    budget = (max_tokens - buffer) * 4
    fits = F.length("context") <= budget
    parts = contexts.filter(~fits).select(key, F.posexplode(T.split_context(F.col("context"))).alias("at", "text"))
    order = Window.partitionBy(key).orderBy(F.desc(F.round(relevance(F.col("text"), query, technical), 6)), "at")
    packed = pack(parts.withColumn("rank", F.row_number().over(order)), budget, by=key)
    joined = packed.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), SEPARATOR).alias("context"))
    return contexts.filter(fits).select(key, "context").unionByName(joined)


def truncate_lines(text: Column, budget: int) -> Column:
    """Leading lines whose total length stays within the budget."""
    lines = F.split(text, "\n")
    state = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    step = lambda s, x: F.when(s["open"] & (s["used"] + F.length(x) + 1 <= budget), F.struct((s["used"] + F.length(x) + 1).alias("used"), (s["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(F.struct(s["used"].alias("used"), s["n"].alias("n"), F.lit(False).alias("open")))
    return F.array_join(F.slice(lines, F.lit(1), F.aggregate(lines, state, step, lambda s: s["n"])), "\n")


def key_sentences(docs: DataFrame, query: str, k: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, position, sentence, overlap): the k sentences of at least 20 characters sharing most words (over 2 characters) with the query."""
    words = sorted({w for w in query.lower().split() if len(w) > 2})
    rows = docs.select(F.col(key), F.posexplode(T.sentences(F.col(text))).alias("position", "sentence")).filter(F.length("sentence") >= 20)
    shared = F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("sentence"))), F.array(*map(F.lit, words))))
    rows = rows.withColumn("overlap", shared).filter("overlap > 0")
    order = Window.partitionBy(key).orderBy(F.desc("overlap"), "position")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "position", F.concat("sentence", F.lit(".")).alias("sentence"), "overlap")


def excerpts(text: Column, query: str, k: int = 4) -> Column:
    """The first k distinct sentences of at least 30 characters with a query word of more than 3."""
    words = [w for w in query.lower().split() if len(w) > 3]
    found = F.filter(T.sentences(text), lambda s: (F.length(s) >= 30) & T.contains_any(F.lower(s), words))
    return F.slice(F.array_distinct(found), 1, k)


def keywords(docs: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word, n, rank): most frequent words of 3 letters or more, ties by first place.

    Words are counted inside each text, where they lie. Texts that share a key are one document: keys are counted first,
    and only texts of those that repeat are dealt out by word.
    """
    runs = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.filter(runs, lambda x: F.rlike(x, F.lit("^[a-z_]{3,}$")) & ~x.isin(KEYWORD_STOPS))
    repeated = docs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key", F.lit(True).alias("_known"))
    repeated = Workspace(docs.sparkSession, "keywords").save(repeated, "repeated")
    some = not repeated.isEmpty()
    single = docs.join(repeated, F.col(key).eqNullSafe(F.col("_key")), "left_anti") if some else docs
    joined = single.select(F.col(key), F.array_join(words, " ").alias("_words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                best = [Counter(w.split(" ")).most_common(k) if w else [] for w in batch["_words"].to_pylist()]  # ties stay in order
                sizes = [len(b) for b in best]
                columns = [
                    batch[key].take(pa.array(np.repeat(np.arange(len(best)), sizes))),
                    pa.array([w for b in best for w, _ in b], pa.string()),
                    pa.array([n for b in best for _, n in b], pa.int64()),
                    pa.array([r for size in sizes for r in range(1, size + 1)], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "word", "n", "rank"])

    found = joined.mapInArrow(count, StructType([joined.schema[key], *StructType.fromDDL("word string, n long, rank int")]))
    if not some:
        return found
    rows = docs.join(repeated, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(F.col(key), F.posexplode(words).alias("pos", "word"))
    counted = rows.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return found.unionByName(counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "word", "n", "rank"))
