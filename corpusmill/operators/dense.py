"""Vector retrieval and duplicate vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import vectors as V
from corpusmill.workspace import Workspace

#: Queries that are sent to every task at most; more are joined block by block.
QUERIES_AT_ONCE = 1000
#: Vectors that are scored against these in one product.
ROWS_AT_ONCE = 1024
#: Signs in a mark.
MARK = 62


def nearest(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """(vec_id, score): the k rows most similar to one vector; ``where`` filters before ranking."""
    rows = vectors if where is None else vectors.filter(where)
    scored = rows.select(F.col(key), F.round(V.cosine(F.col(vector), V.literal(query)), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_index, vec_id, score, rank): the k nearest for every row of ``queries(query_index, q)``.

    Some vectors at a time are scored against a block of queries as one matrix product and merged with the k
    best per query so far, so a task holds one such product and no pair is shuffled that can't win; the final ranking
    merges k rows from each task. The number of queries is checked, blocks above the bound run one after the other.
    """
    rows = [(r["query_index"], np.array(r["q"], dtype=np.float64)) for r in queries.select("query_index", "q").orderBy("query_index").limit(QUERIES_AT_ONCE + 1).collect()]
    if len(rows) > QUERIES_AT_ONCE:
        parts = -(-queries.count() // QUERIES_AT_ONCE)
        block = F.pmod(F.xxhash64("query_index"), F.lit(2 * parts))
        found = [nearest_many(vectors, queries.filter(block == i), k, key, vector) for i in range(2 * parts)]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out
    names = np.array([r[0] for r in rows], dtype=np.int64)
    matrix = np.stack([r[1] for r in rows]) if rows else np.zeros((0, 1))
    sizes = np.linalg.norm(matrix, axis=1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(names):
            return
        scores, found = np.empty((len(names), 0)), np.empty((len(names), 0), np.int64)  # the best so far
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                data = np.asarray(batch["v"].flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                keys = batch["key"].to_numpy()
                new = np.round(matrix @ data.T / np.outer(sizes, np.linalg.norm(data, axis=1)), 6)
                kept = min(k, scores.shape[1] + len(keys))
                after, names_after = np.empty((len(names), kept)), np.empty((len(names), kept), np.int64)
                full = scores.shape[1] == k > 0
                for j in range(len(names)):
                    if full and new[j].max() < scores[j].min():
                        after[j], names_after[j] = scores[j], found[j]
                        continue
                    both, either = np.concatenate([scores[j], new[j]]), np.concatenate([found[j], keys])
                    order = np.lexsort((either, -both))[:k]
                    after[j], names_after[j] = both[order], either[order]
                scores, found = after, names_after
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, scores.shape[1])), pa.array(found.ravel()), pa.array(scores.ravel())], names=["query_index", key, "score"])

    best = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).filter("v IS NOT NULL").mapInArrow(score, f"query_index long, {key} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_index").orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def vector_classes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, first_id): every vector and the smallest id with an equal one."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    first = rows.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("id").alias("first_id"))
    return rows.withColumn("h", F.xxhash64("v")).join(first, ["h", "v"]).select("id", "first_id")


def sign_bands(least: float, rows: int, missed: float = 1e-9, most: int = 256) -> tuple[int, int]:
    """(bits, bands) of sign codes: about as many bits as tell the rows apart, and so many bands that a pair at
    cosine ``least`` shares none with probability ``missed``; fewer bits where that takes over ``most`` bands."""
    same = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    bits = min(62, max(8, math.ceil(math.log2(max(2, rows)))))
    while bits > 1:
        bands = 1 if same >= 1 else math.ceil(math.log(missed) / math.log1p(-(same**bits)))
        if bands <= most:
            return bits, bands
        bits -= 1
    raise ValueError(f"no banding for cosine {least}")


def mark_limit(least: float, missed: float = 1e-10) -> int:
    """Of ``MARK`` further signs, the most that may differ: a pair at cosine ``least`` has more with probability ``missed``."""
    other = math.acos(max(-1.0, min(1.0, least))) / math.pi
    limit, left = MARK, 0.0
    while limit > 0:
        left += math.comb(MARK, limit) * other**limit * (1 - other) ** (MARK - limit)
        if left > missed:
            break
        limit -= 1
    return limit


def similar_pairs(vectors: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, score) of pairs of different vectors with cosine over ``least``, a < b.

    Equal vectors are one row with the smallest id (``vector_classes`` has the others), so copies don't
    multiply. Candidates share a band of signs against fixed random planes, see ``sign_bands``; bands get
    longer with the number of rows, so that unlike vectors share few. Each row of a band also has a mark of
    further signs, and the join itself leaves out pairs whose marks are too unlike, see ``mark_limit``: only
    pairs that are left meet their vectors, on which they are confirmed.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).filter("v IS NOT NULL AND key IS NOT NULL")
    rows = rows.groupBy(F.xxhash64("v").alias("h"), "v").agg(F.min("key").alias("key")).select("key", "v")
    rows = Workspace(vectors.sparkSession, "similar-pairs").save(rows, "rows")
    bits, bands = sign_bands(least, rows.count())

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, weights = None, np.int64(1) << np.arange(max(bits, MARK), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                data = np.asarray(batch["v"].flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
                if planes is None or len(planes) != data.shape[1]:
                    planes = np.random.default_rng(20240101).standard_normal((data.shape[1], bands * bits + MARK))
                signs = data @ planes > 0
                codes = (signs[:, :-MARK].reshape(len(data), bands, bits) * weights[:bits]).sum(axis=2)
                marks = (signs[:, -MARK:] * weights[:MARK]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch["key"], pa.ListArray.from_arrays(pa.array(np.arange(len(data) + 1, dtype=np.int32) * bands), pa.array(codes.ravel())), pa.array(marks)], names=["key", "codes", "mark"])

    coded = rows.mapInArrow(sign, "key long, codes array<long>, mark long")
    banded = coded.select("key", "mark", F.posexplode("codes").alias("band", "code"))
    alike = F.bit_count(F.col("x.mark").bitwiseXOR(F.col("y.mark"))) <= mark_limit(least)
    # merged, as the planner takes the bands of a small file for small
    pairs = banded.alias("x").hint("merge").join(banded.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.code") == F.col("y.code")) & (F.col("x.key") < F.col("y.key")) & alike)
    pairs = pairs.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    full = pairs.join(rows.select(F.col("key").alias("a"), F.col("v").alias("va")), "a").join(rows.select(F.col("key").alias("b"), F.col("v").alias("vb")), "b")
    return full.select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("score")).filter(F.col("score") > least)
