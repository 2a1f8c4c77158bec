"""The inverted-file index against all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from corpusmill.operators import vector_index
from corpusmill.workspace import Workspace


def brute(rows, queries, k):
    keys = np.array([r[0] for r in rows])
    data = vector_index._unit(np.array([r[1] for r in rows], dtype=np.float32).astype(float))
    out = set()
    for name, q in queries:
        score = np.round(vector_index._unit(np.array([q], dtype=np.float32).astype(float))[0] @ data.T, 6)
        out |= {(name, int(keys[i]), float(score[i]), r) for r, i in enumerate(np.lexsort((keys, -score))[:k], 1)}
    return out


def got(df):
    return {(r["query_index"], r["key"], r["score"], r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((12, 16)) * 3
    rows = [(i, (middles[i % 12] + rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(5000 + i, rows[0][1]) for i in range(600)]  # one vector very often: ties, and a cell of several parts
    return rows, [(int(i), rows[i][1]) for i in range(0, 1500, 50)] + [(9999, (-middles[3]).tolist())]


def test_search(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 100)
    rows, queries = clustered
    ws = Workspace(spark, "index-test")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("x")).repartition(5)
    index = vector_index.VectorIndex.build(df, ws.folder("index"))
    asked = spark.createDataFrame(queries, "query_index long, q array<float>")
    true = brute(rows, queries, 10)
    assert got(index.search(asked, 10, exact=True, ws=ws)) == true
    assert got(index.search(asked, 10, probes=len(index.centres))) == true
    near = got(index.search(asked, 10))
    assert index.probes < len(index.centres) / 2 and len({x[:2] for x in near & true}) >= 0.9 * len(true)
    # rows added later lie in the cells that are there, and are found; nothing that was written changes
    before = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(ws.folder("index") + "/rows").select("path").collect()}
    more = [(7000 + i, q[1]) for i, q in enumerate(queries)]
    index.add(spark.createDataFrame(more, "vec_id long, embedding array<float>"))
    again = vector_index.VectorIndex(spark, ws.folder("index"))
    assert got(again.search(asked, 10, exact=True, ws=ws)) == brute(rows + more, queries, 10)
    after = {f.path for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(ws.folder("index") + "/rows").select("path").collect()}
    assert before < after
    # a single cell is read for a single probe
    one = index.search(asked.limit(1), 3, probes=1).collect()
    assert len(one) == 3


def test_recall_on_given_vectors(spark):
    """At ten, for every fiftieth vector against all rows."""
    ws = Workspace(spark, "index-recall")
    e = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    index = vector_index.VectorIndex.build(e, ws.folder("index"))
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_index"), F.col("embedding").alias("q"))
    true = ws.save(index.search(asked, 10, exact=True, ws=ws), "true")
    row = vector_index.recall(index.search(asked, 10), true).first()
    assert row["n_queries"] == asked.count() and row["recall"] >= 0.9


def test_odd_vectors(spark):
    ws = Workspace(spark, "index-odd")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [float("nan"), 1.0]), (7, [0.5, 2.0])]
    index = vector_index.VectorIndex.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ws.folder("a"))
    asked = spark.createDataFrame([(0, [1.0, 0.1]), (1, None)], "query_index long, q array<float>")
    assert [r["key"] for r in index.search(asked, 5, exact=True, ws=ws).orderBy("rank").collect()] == [1, 1, 7]
    empty = vector_index.VectorIndex.build(spark.createDataFrame([], "vec_id long, embedding array<float>"), ws.folder("b"))
    assert empty.search(asked, 5).count() == 0
