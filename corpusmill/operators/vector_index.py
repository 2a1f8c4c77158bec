"""An inverted-file index of vectors: rows lie in cells around centroids, queries read the cells near them.

Centroids are fitted on a bounded sample; every row is assigned and written once, to the folder of its
cell. A search probes as many cells as reached the wanted recall on the sample. The exact search goes on: a
cell's radius bounds the cosine of all its rows, and cells whose bound reaches a query's k-th best are read as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Numbers in the sample that centroids and probes are fitted on, at most (in the mean).
SAMPLE = 4_000_000
#: Cells at most; below, as many as the square root of the rows.
CELLS = 4096
#: Turns of the fit, and sample rows that serve as queries when probes are chosen.
TURNS, ASKED = 12, 200
#: Recall at ten on the sample that the number of probes has to reach.
RECALL = 0.96
#: Rows of a cell that are scored in one task.
PART = 100_000
#: Scores are compared after rounding to so many digits.
DIGITS = 6


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _parts(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten(), dtype=np.float64) for c in column.chunks]) if isinstance(column, pa.ChunkedArray) and column.num_chunks else np.zeros(0)


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means; a cell that empties starts anew at the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    rows = _unit(sample)
    centres = rows[rng.permutation(len(rows))[:cells]].copy()
    for _ in range(TURNS):
        near, fit = _nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centres)) == 0)
        sums[empty] = rows[np.argsort(fit, kind="stable")[: len(empty)]]
        moved = _unit(sums)
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near, fit = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    for low in range(0, len(rows), 4096):
        scores = rows[low : low + 4096] @ centres.T
        near[low : low + 4096] = scores.argmax(axis=1)
        fit[low : low + 4096] = scores.max(axis=1)
    return near, fit


def choose_probes(sample: np.ndarray, centres: np.ndarray, k: int = 10, recall: float = RECALL) -> int:
    """The fewest cells that hold the wanted share of the sample's true neighbours, over some of its rows as queries."""
    rows = _unit(sample)
    asked = rows[np.linspace(0, len(rows) - 1, min(ASKED, len(rows))).astype(int)]
    near, _ = _nearest(rows, centres)
    true = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, near[true], axis=1).ravel()) + 1
    return int(needed[int(np.ceil(recall * len(needed))) - 1])


class VectorIndex:
    """What ``build`` wrote to a folder: ``rows`` by cell, and ``cells`` with centroid, rows and radius.

    Null and empty vectors, and those of length zero, have no direction and are left out; so are rows without a key.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        head = json.loads(spark.read.text(f"{folder}/head").first()[0])
        self.probes, self.key_type = head["probes"], head["key_type"]
        cells = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()  # at most CELLS rows
        self.centres = np.array([r["centre"] for r in cells]).reshape(len(cells), -1) if cells else np.zeros((0, 1))

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 7) -> VectorIndex:
        spark = vectors.sparkSession
        rows = _usable(vectors, key, vector)
        known = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("low")).first()
        if known["n"] and known["low"] != known["width"]:
            raise ValueError("vectors differ in length")
        n, width = known["n"], known["width"] or 1
        most = max(1, SAMPLE // width)
        some = rows if n <= most else rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int((1 << 40) * most / n))
        sample = np.array([r["v"] for r in some.select("v").collect()], dtype=np.float64).reshape(-1, width)  # SAMPLE numbers
        cells = min(cells or int(np.sqrt(n)), CELLS, len(sample))
        sample = sample[np.lexsort(sample.T[::-1])] if len(sample) else sample  # whatever order tasks ended in
        centres = fit_centroids(sample, cells, seed) if len(sample) else np.zeros((0, width))
        probes = choose_probes(sample, centres) if len(sample) else 0
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
        head = json.dumps({"probes": probes, "key_type": rows.schema["key"].dataType.simpleString()})
        spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/head")
        found = cls(spark, folder)
        found._write(rows, "overwrite")
        return found

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Further rows, in the cells that are there."""
        self._write(_usable(vectors, key, vector), "append")

    def _write(self, rows: DataFrame, mode: str) -> None:
        centres = self.centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near, fit = _nearest(_unit(_matrix(batch["v"], centres.shape[1])), centres)
                    yield pa.RecordBatch.from_arrays([batch["key"], batch["v"], pa.array(np.arccos(np.clip(fit, -1, 1))), pa.array(near.astype(np.int32))], names=["key", "v", "angle", "cell"])

        schema = f"key {self.key_type}, v array<float>, angle double, cell int"
        dealt = rows.mapInArrow(assign, schema).hint("rebalance", "cell")  # a cell with many rows is split
        dealt.write.mode(mode).partitionBy("cell").parquet(f"{self.folder}/rows")
        radius = self._rows().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        radius.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/cells")

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"key {self.key_type}, v array<float>, angle double, cell int").parquet(f"{self.folder}/rows")

    def _cells(self) -> dict[int, tuple[int, float]]:
        return {r["cell"]: (r["n"], r["radius"]) for r in self.spark.read.schema("cell int, n long, radius double").parquet(f"{self.folder}/cells").collect()}  # at most CELLS rows

    def _visits(self, queries: DataFrame, probes: int, beyond: bool) -> DataFrame:
        """(query_index, q, cell, part): the nearest cells of each query, or those beyond whose bound reaches ``kth``."""
        centres, cells = self.centres, self._cells()
        radius = np.array([cells.get(i, (0, 0.0))[1] for i in range(len(centres))])
        parts = np.array([-(-cells.get(i, (0, 0.0))[0] // PART) for i in range(len(centres))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(centres):
                    continue
                scores = _unit(_matrix(batch["q"], centres.shape[1])) @ centres.T
                order = np.argsort(-scores, axis=1, kind="stable")
                place = np.argsort(order, axis=1)
                wanted = (place < probes) if not beyond else place >= probes
                if beyond:
                    bound = np.cos(np.maximum(np.arccos(np.clip(scores, -1, 1)) - radius, 0))
                    wanted &= bound >= batch["kth"].to_numpy()[:, None] - 10.0**-DIGITS
                i, cell = np.nonzero(wanted & (parts > 0))
                again = parts[cell]
                part = np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again)
                i, cell = np.repeat(i, again), np.repeat(cell, again)
                taken = batch.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([taken["query_index"], taken["q"], pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["query_index", "q", "cell", "part"])

        return queries.mapInArrow(run, "query_index long, q array<float>, cell int, part int")

    def _scored(self, visits: DataFrame, k: int) -> DataFrame:
        """(query_index, key, score): the best k of each visit; rows of a cell meet its queries in parts."""
        width, key_type = self.centres.shape[1], self.key_type
        counts = self._cells()
        parts = F.create_map(*(F.lit(x) for c, (n, _) in counts.items() for x in (c, -(-n // PART)))) if counts else F.create_map(F.lit(0), F.lit(1))
        # the cells that no query visits aren't read: the visits' cells prune the folders
        rows = self._rows().join(visits.select("cell").distinct(), "cell", "left_semi").withColumn("part", F.pmod(F.xxhash64("key"), parts[F.col("cell")]).cast("int"))

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [[], [], []]
            if left.num_rows and right.num_rows:
                data, asked = _unit(_parts(left["v"]).reshape(-1, width)), _unit(_parts(right["q"]).reshape(-1, width))
                keys, names = left["key"].to_numpy(), right["query_index"].to_numpy()
                for low in range(0, len(asked), 256):
                    scores = np.round(asked[low : low + 256] @ data.T, DIGITS)
                    for j, row in enumerate(scores):
                        near = np.argpartition(-row, k)[:k] if len(row) > k else np.arange(len(row))
                        near = np.flatnonzero(row >= row[near].min())  # all ties at the k-th place
                        near = near[np.lexsort((keys[near], -row[near]))][:k]
                        found[0].append(np.full(len(near), names[low + j]))
                        found[1].append(keys[near])
                        found[2].append(row[near])
            joined = [np.concatenate(x) if x else [] for x in found]
            return pa.table([pa.array(joined[0], pa.int64()), pa.array(joined[1], left["key"].type), pa.array(joined[2], pa.float64())], names=["query_index", "key", "score"])

        return rows.groupBy("cell", "part").cogroup(visits.groupBy("cell", "part")).applyInArrow(score, f"query_index long, key {key_type}, score double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, ws=None) -> DataFrame:
        """(query_index, key, score, rank) of the k rows nearest to each row of ``queries(query_index, q)``.

        Ranks go by cosine, rounded, then key. With ``exact``, cells beyond the probes are read for the
        queries whose k-th score their bound reaches, so no row is missed; this needs a workspace.
        """
        asked = queries.select(F.col("query_index").cast("long").alias("query_index"), F.col("q").cast("array<float>").alias("q")).filter("q IS NOT NULL AND size(q) > 0")
        probes = self.probes if probes is None else probes
        order = Window.partitionBy("query_index").orderBy(F.desc("score"), "key")
        ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        first = ranked(self._scored(self._visits(asked, probes, False), k))
        if not exact:
            return first
        first = ws.save(first, "probed")
        kth = first.filter(F.col("rank") == k).select("query_index", F.col("score").alias("kth"))
        open_ = asked.join(kth, "query_index", "left").fillna(-2.0, ["kth"])
        more = self._scored(self._visits(open_, probes, True), k)
        return ranked(first.drop("rank").unionByName(more))


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    return rows.filter("key IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0) AND forall(v, x -> x IS NOT NULL AND NOT isnan(x))")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: queries, and the mean share of the true neighbours that were found."""
    hits = true.join(found.select("query_index", "key", F.lit(1).alias("hit")), ["query_index", "key"], "left")
    each = hits.groupBy("query_index").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r"))
    return each.agg(F.count("*").alias("n_queries"), F.avg("r").alias("recall"))
