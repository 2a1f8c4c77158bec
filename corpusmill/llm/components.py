"""Connected components of a table of undirected edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` to ``(v, component)``: the smallest vertex that each touched vertex can reach.

    Each round maps every vertex to the smallest of itself and its neighbours and contracts the
    edges by that map; a round removes every vertex that has a smaller neighbour. Each round's
    tables are written to the shared folder, so lineage stays short and lost executors cost one round.
    """
    edges = ws.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e0")
    labels = ws.save(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("component")), f"{name}-l0")
    step = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = ws.save(both.groupBy("a").agg(F.min("b").alias("b")).filter("b < a").select(F.col("a").alias("child"), F.col("b").alias("parent")), f"{name}-p{step}")
        up = parent.select(F.col("child").alias("x"), F.col("parent").alias("top"))
        mapped = edges.join(up, edges["a"] == up["x"], "left").select(F.coalesce("top", "a").alias("a"), "b")
        mapped = mapped.join(up, mapped["b"] == up["x"], "left").select("a", F.coalesce("top", "b").alias("b"))
        done = [f"{name}-e{step}", f"{name}-l{step}", f"{name}-p{step}"]
        step += 1
        edges = ws.save(mapped.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-e{step}")
        labels = ws.save(labels.join(up, labels["component"] == up["x"], "left").select("v", F.coalesce("top", "component").alias("component")), f"{name}-l{step}")
        ws.drop(*done)
    out = ws.save(labels, f"{name}-labels")
    ws.drop(f"{name}-e{step}", f"{name}-l{step}")
    return out
