"""Lineage graphs as tables of nodes(id, name, type) and edges(src, dst)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.workspace import Workspace

#: Frontiers that are looked up one by one before the older ones are written as one.
FRONTS = 8


def neighbours(edges: DataFrame, start: DataFrame, up: bool = False) -> DataFrame:
    """(start, node): direct successors, or predecessors, of each row of ``start(start)``."""
    a, b = ("dst", "src") if up else ("src", "dst")
    return edges.join(start, F.col(a) == F.col("start")).select("start", F.col(b).alias("node"))


def reachable(edges: DataFrame, start: DataFrame, up: bool = False, most: int | None = None, ws: Workspace | None = None) -> DataFrame:
    """(start, node, depth): everything reachable, with the least number of steps.

    The frontier grows by one join a round and leaves visited nodes behind, so cycles end; with ``most``,
    a frontier left after so many rounds is an error. Each round writes its own frontier and nothing else;
    visited nodes are the frontiers so far, compacted as they grow in number.
    """
    ws = ws or Workspace(edges.sparkSession, "reach")
    a, b = ("dst", "src") if up else ("src", "dst")
    steps = ws.save(edges.select(F.col(a).alias("_from"), F.col(b).alias("node")).distinct(), "steps")
    seen = [ws.save(start.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "front0")]
    for depth in itertools.count(1):
        step = seen[-1].select("start", F.col("node").alias("_from")).join(steps, "_from").select("start", "node").distinct()
        for part in seen:
            step = step.join(part.select("start", "node"), ["start", "node"], "left_anti")
        front = ws.save(step.withColumn("depth", F.lit(depth)), f"front{depth}")
        if front.isEmpty():
            break
        if most is not None and depth > most:
            raise ValueError(f"nodes more than {most} steps from a start")
        if len(seen) >= FRONTS:
            old = seen[0]
            for part in seen[1:-1]:
                old = old.unionByName(part)
            seen = [ws.save(old, f"seen{depth}"), seen[-1]]
        seen.append(front)
    found = seen[0]
    for part in seen[1:]:
        found = found.unionByName(part)
    return found.filter("depth > 0")


def traversed(edges: DataFrame, start: DataFrame, up: bool = False) -> DataFrame:
    """(start, node): the head of every edge passed on the way, so diamonds repeat nodes."""
    a, b = ("dst", "src") if up else ("src", "dst")
    inside = reachable(edges, start, up).select("start", F.col("node").alias("_from")).unionByName(start.select("start", F.col("start").alias("_from")))
    return inside.join(edges, F.col("_from") == F.col(a)).select("start", F.col(b).alias("node"))


def of_type(nodes: DataFrame, found: DataFrame, kind: str | None = None) -> DataFrame:
    joined = found.join(nodes.select(F.col("id").alias("node"), "name", "type"), "node")
    return joined if kind is None else joined.filter(F.col("type") == kind)


def node_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, direct_up, direct_down) of every node."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("direct_down"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct_up"))
    return nodes.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("direct_up", F.lit(0)).alias("direct_up"), F.coalesce("direct_down", F.lit(0)).alias("direct_down"))


def node_statistics(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, model: str = "model", test: str = "test", source: str = "source") -> DataFrame:
    """Eight counts of each row of ``wanted(id)``: direct and total on both sides, and of some kinds among the totals.

    Totals count the edges passed on the way, so a node that several paths reach counts as often as it is entered.
    """
    start = wanted.select(F.col("id").alias("start"))
    kinds = nodes.select(F.col("id").alias("node"), "type")

    def side(up: bool, tag: str, counted: dict[str, str]) -> DataFrame:
        direct = neighbours(edges, start, up).groupBy("start").agg(F.count("*").alias(f"direct_{tag}"))
        every = traversed(edges, start, up).join(kinds, "node", "left")
        total = every.groupBy("start").agg(F.count("*").alias(f"total_{tag}"), *(F.count_if(F.col("type") == k).alias(n) for n, k in counted.items()))
        return direct.join(total, "start", "full_outer")

    down = side(False, "downstream", {"downstream_models": model, "downstream_tests": test})
    up = side(True, "upstream", {"upstream_models": model, "upstream_sources": source})
    names = ["direct_downstream", "direct_upstream", "total_downstream", "total_upstream", "downstream_models", "downstream_tests", "upstream_models", "upstream_sources"]
    joined = start.join(down, "start", "left").join(up, "start", "left")
    return joined.select(F.col("start").alias("id"), *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(type, n_nodes, n_edges): nodes of each type and the edges that leave them."""
    counted = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("e")), "id", "left")
    return counted.groupBy("type").agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"))


def merge_columns(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Column metadata of both artifacts: (node, column, description, type, index)."""
    return manifest.join(catalog, ["node", "column"], "full_outer").select("node", "column", F.coalesce("description", F.lit("")).alias("description"), "type", "index")


def references(models: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, models, n): for each seed the sorted names of models that depend on it, also for none."""
    used = models.select("model", F.explode("depends_on").alias("dep")).filter(F.startswith("dep", F.lit("seed."))).select("model", F.element_at(F.split("dep", r"\."), -1).alias("seed")).distinct()
    grouped = used.groupBy("seed").agg(F.sort_array(F.collect_list("model")).alias("models"))
    return seeds.join(grouped, "seed", "left").select("seed", F.coalesce("models", F.array().cast("array<string>")).alias("models"), F.coalesce(F.size("models"), F.lit(0)).cast("long").alias("n"))


def seed_text(lines: Column, whole: int = 100, head: int = 10) -> Column:
    """Text of a CSV seed: all of it up to 100 rows, else header, ten rows and a note."""
    n = F.size(lines) - 1
    note = F.concat(F.lit("... ("), (n - head).cast("string"), F.lit(" more rows)"))
    return F.when(n <= whole, F.array_join(lines, "\n")).otherwise(F.concat(F.array_join(F.slice(lines, 1, head + 1), "\n"), F.lit("\n"), note))


def artifact_root(paths: DataFrame, manifest: str = "manifest.json", project: str = "dbt_project.yml") -> DataFrame:
    """One row: the folder of the manifest if both required files are there, else null."""
    parent = F.regexp_replace("path", r"/[^/]+$", "")
    return paths.agg(F.when(F.bool_or(F.endswith("path", F.lit(project))), F.min(F.when(F.endswith("path", F.lit(manifest)), parent))).alias("root"))


def sql_documents(nodes: DataFrame) -> DataFrame:
    """(node, kind, text) of models, tests and macros with any SQL; compiled code is preferred."""
    sql = F.coalesce(F.nullif(F.col("compiled_code"), F.lit("")), F.nullif(F.col("raw_code"), F.lit("")), F.nullif(F.col("macro_sql"), F.lit("")))
    return nodes.filter(F.col("resource_type").isin("model", "test", "macro")).select("node", F.col("resource_type").alias("kind"), sql.alias("text")).filter("text IS NOT NULL")
