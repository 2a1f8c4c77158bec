"""Project artifacts: manifest, catalog, project file, graph and seeds, as tables.

Everything works on tables of ``(path, content)`` rows, so files read from a folder and files fetched
from a repository go the same way. A manifest is exploded once into a row for each node.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as T
from corpusmill.operators import lineage
from corpusmill.workspace import Workspace

NODE = (
    "struct<name: string, resource_type: string, description: string, tags: array<string>, schema: string, database: string, package_name: string, "
    "original_file_path: string, raw_code: string, compiled_code: string, macro_sql: string, config: struct<materialized: string>, meta: struct<owner: string>, "
    "depends_on: struct<nodes: array<string>>, arguments: array<struct<name: string>>, columns: map<string, struct<name: string, description: string, data_type: string>>>"
)
ARTIFACTS = {"manifest": "manifest.json", "catalog": "catalog.json", "graph": "graph_summary.json", "project": "dbt_project.yml"}


def kind_of(path: Column) -> Column:
    """What a fetched file is for a project: one of ``ARTIFACTS``, a seed (CSV below a data folder), or null."""
    out = F.when(F.endswith(path, F.lit(".csv")) & F.contains(path, F.lit("/data/")), "seed")
    for kind, name in ARTIFACTS.items():
        out = F.when(F.endswith(path, F.lit(name)), kind).otherwise(out)
    return out


def collected(files: DataFrame) -> DataFrame:
    """(kind, path, content) of a project's files; none unless both manifest and project file are among them."""
    found = files.select(kind_of(F.col("path")).alias("kind"), "path", "content").filter("kind IS NOT NULL")
    whole = found.agg((F.count_if(F.col("kind") == "manifest") > 0) & (F.count_if(F.col("kind") == "project") > 0)).toDF("whole")
    return found.crossJoin(F.broadcast(whole)).filter("whole").drop("whole")  # one row


def nodes(manifests: DataFrame) -> DataFrame:
    """A row for each node, source and macro of ``manifests(content)``: unique_id, kind and the node's fields."""
    m = f"map<string, {NODE}>"
    raw = manifests.select(F.from_json("content", f"nodes {m}, sources {m}, macros {m}").alias("m"))
    part = lambda name: raw.select(F.explode(f"m.{name}").alias("unique_id", "n"), F.lit(name).alias("part"))
    rows = part("nodes").unionByName(part("sources")).unionByName(part("macros"))
    kind = F.coalesce("n.resource_type", F.when(F.col("part") == "macros", "macro").when(F.col("part") == "sources", "source"))
    return rows.select(
        "unique_id", kind.alias("kind"), "n.name", F.coalesce("n.description", F.lit("")).alias("description"), F.coalesce("n.tags", F.array().cast("array<string>")).alias("tags"),
        "n.schema", "n.database", "n.package_name", F.coalesce("n.original_file_path", F.lit("")).alias("file_path"), F.coalesce("n.meta.owner", F.lit("")).alias("owner"),
        F.coalesce("n.config.materialized", F.lit("view")).alias("materialization"), "n.raw_code", "n.compiled_code", "n.macro_sql",
        F.coalesce("n.depends_on.nodes", F.array().cast("array<string>")).alias("depends_on"), F.array_compact(F.transform("n.arguments", lambda a: a["name"])).alias("arguments"), F.col("n.columns").alias("columns"),
    )


def manifest_columns(found: DataFrame) -> DataFrame:
    """(node, column, description) of all nodes' documented columns."""
    return found.select(F.col("unique_id").alias("node"), F.explode("columns").alias("column", "c")).select("node", "column", "c.description")


def catalog_columns(catalogs: DataFrame) -> DataFrame:
    """(node, column, type, index) of ``catalogs(content)``; a catalog that isn't JSON has no rows."""
    kind = "nodes map<string, struct<columns: map<string, struct<type: string, index: int>>>>"
    rows = catalogs.select(F.explode(F.from_json("content", kind)["nodes"]).alias("node", "n"))
    return rows.select("node", F.explode("n.columns").alias("column", "c")).select("node", "column", "c.type", "c.index")


def project_settings(content: str) -> dict:
    """A project file; one that can't be read has no settings."""
    import yaml

    try:
        found = yaml.safe_load(content)
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def lookup(found: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes that ``names(asked)`` mean: by unique id, else by plain name, the first id where several have that name."""
    by_id = names.join(found, F.col("asked") == F.col("unique_id")).withColumn("_exact", F.lit(0))
    by_name = names.join(found.filter("kind <> 'macro' AND kind <> 'source'"), F.col("asked") == F.col("name")).withColumn("_exact", F.lit(1))
    first = F.row_number().over(Window.partitionBy("asked").orderBy("_exact", "unique_id"))
    return by_id.unionByName(by_name).withColumn("_n", first).filter("_n = 1").drop("_n", "_exact")


def _listed(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    return rows.groupBy(F.col(by).alias("unique_id")).agg(F.sort_array(F.collect_set(value)).alias(out))


def model_metadata(found: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Models with upstream models and sources, downstream models and tests, and the depth of their lineage.

    With ``edges(src, dst)`` over unique ids the graph answers; without, the dependencies that models name
    do, and nothing is known downstream. The depth counts the edges passed upstream.
    """
    models = found.filter("kind = 'model'")
    none = F.array().cast("array<string>")
    if edges is None:
        of = lambda prefix: F.filter("depends_on", lambda d: F.startswith(d, F.lit(prefix)))
        return models.select("*", of("model.").alias("upstream_models"), of("source.").alias("upstream_sources"), none.alias("downstream_models"), none.alias("downstream_tests"), F.lit(0).cast("long").alias("lineage_depth"))
    start = models.select(F.col("unique_id").alias("start"))
    kinds = found.select(F.col("unique_id").alias("id"), F.col("unique_id").alias("name"), F.col("kind").alias("type"))
    up, down = (lineage.of_type(kinds, lineage.neighbours(edges, start, u)) for u in (True, False))
    out = models
    for rows, kind, name in ((up, "model", "upstream_models"), (up, "source", "upstream_sources"), (down, "model", "downstream_models"), (down, "test", "downstream_tests")):
        out = out.join(_listed(rows.filter(F.col("type") == kind), "start", "node", name), "unique_id", "left")
    depth = lineage.traversed(edges, start, up=True).groupBy(F.col("start").alias("unique_id")).agg(F.count("*").alias("lineage_depth"))
    out = out.join(depth, "unique_id", "left")
    return out.withColumns({n: F.coalesce(n, none) for n in ("upstream_models", "upstream_sources", "downstream_models", "downstream_tests")} | {"lineage_depth": F.coalesce("lineage_depth", F.lit(0))})


def _lines(*lines: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _line(label: str, value: Column, when: Column | None = None) -> Column:
    text = F.concat(F.lit(f"{label}: "), value)
    return F.when(F.coalesce(value, F.lit("")) != "", text) if when is None else F.when(when, text)


def _few(values: Column, n: int) -> Column:
    return F.array_join(F.slice(values, 1, n), ", ")


def tested_model(depends_on: Column) -> Column:
    """Plain name of the first model among a test's dependencies."""
    return F.get(F.transform(F.filter(depends_on, lambda d: F.startswith(d, F.lit("model."))), T.last_dotted), F.lit(0))


def sql_documents(found: DataFrame, edges: DataFrame | None = None, compiled: bool = True) -> DataFrame:
    """(unique_id, kind, code_type, content, summary) of models, tests and macros with any SQL.

    A model's compiled code goes before its raw code where wanted. The summary tells name, kind and the first
    few neighbours of a model, the model that a test is for, or the arguments of a macro.
    """
    code = lambda c: F.nullif(F.col(c), F.lit(""))
    models = model_metadata(found, edges).withColumn("_compiled", code("compiled_code") if compiled else F.lit(None).cast("string"))
    model = models.select(
        "unique_id", "kind", F.when(F.col("_compiled").isNotNull(), "compiled").otherwise("raw").alias("code_type"), F.coalesce("_compiled", code("raw_code")).alias("content"),
        _lines(_line("DBT Model", F.col("name")), _line("Type", F.col("materialization")), _line("Schema", F.coalesce("schema", F.lit("N/A"))), _line("Description", F.col("description")),
               _line("Depends on models", _few(F.col("upstream_models"), 5)), _line("Depends on sources", _few(F.col("upstream_sources"), 5)), _line("Used by", _few(F.col("downstream_models"), 3))).alias("summary"),
    )
    test = found.filter("kind = 'test'").select("unique_id", "kind", F.lit("raw").alias("code_type"), code("raw_code").alias("content"), _lines(_line("DBT Test", F.col("name")), _line("Validates", F.coalesce(tested_model(F.col("depends_on")), F.lit("N/A"))), _line("Purpose", F.col("description"))).alias("summary"))
    macro = found.filter("kind = 'macro'").select("unique_id", "kind", F.lit("raw").alias("code_type"), code("macro_sql").alias("content"), _lines(_line("DBT Macro", F.col("name")), _line("Arguments", F.array_join("arguments", ", ")), _line("Description", F.col("description"))).alias("summary"))
    return model.unionByName(test).unionByName(macro).filter("content IS NOT NULL")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def csv_shape(files: DataFrame) -> DataFrame:
    """``files(path, content)`` with the header's columns, the number of rows and the first ten rows as CSV."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                records = csv.reader(io.StringIO(content or ""))
                header = next(records, [])
                head, n = io.StringIO(), 0
                writer = csv.writer(head)
                writer.writerow(header)
                for record in records:
                    if record:
                        n += 1
                        if n <= 10:
                            writer.writerow([*record, *[""] * (len(header) - len(record))][: len(header)])
                rows.append((path, content, header, n, head.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content", "columns", "n_rows", "head"])

    return files.select("path", "content").mapInPandas(read, "path string, content string, columns array<string>, n_rows long, head string")


def seed_documents(found: DataFrame, files: DataFrame, whole: int = 100) -> DataFrame:
    """(unique_id, seed, n_rows, is_sample, content, summary) of CSV files that are seeds of the project.

    A file belongs to the seed of its name. Up to ``whole`` rows are the content as they are, of more the
    header, ten rows and a note. The summary has the columns, the rows and the first five models that use it.
    """
    shaped = csv_shape(files).withColumn("_stem", stem(F.col("path")))
    seeds = found.filter("kind = 'seed'").select("unique_id", F.col("name").alias("seed"), "description", F.col("file_path").alias("_file"))
    first = F.row_number().over(Window.partitionBy("seed").orderBy("unique_id"))
    seeds = seeds.withColumn("_n", first).filter("_n = 1").drop("_n")
    models = found.filter("kind = 'model'").select(F.col("name").alias("model"), "depends_on")
    used = lineage.references(models, seeds.select("seed")).select("seed", "models", F.col("n").alias("n_models"))
    rows = shaped.join(seeds, F.col("_stem") == F.col("seed")).join(used, "seed", "left")
    more = F.when(F.col("n_models") > 5, F.concat(F.lit("... and "), (F.col("n_models") - 5).cast("string"), F.lit(" more")))
    note = F.concat(F.col("head"), F.lit("\n\n[Note: Showing 10 of "), F.col("n_rows").cast("string"), F.lit(" rows]"))
    listed = F.when(F.size("columns") > 0, F.concat(F.lit("Columns ("), F.size("columns").cast("string"), F.lit("): "), F.array_join("columns", ", ")))
    summary = _lines(_line("DBT Seed", F.col("seed")), _line("File", F.coalesce(F.nullif(F.col("_file"), F.lit("")), F.col("path"))), _line("Description", F.col("description")), listed, _line("Rows", F.col("n_rows").cast("string"), F.col("n_rows") > 0), _line("Used by models", _few(F.col("models"), 5)), more)
    return rows.select("unique_id", "seed", "n_rows", (F.col("n_rows") > whole).alias("is_sample"), F.when(F.col("n_rows") > whole, note).otherwise(F.col("content")).alias("content"), summary.alias("summary"))


def project_documents(files: DataFrame) -> DataFrame:
    """SQL and seed documents of a project's fetched files, under one schema, keyed by unique id."""
    found = collected(files)
    of = Workspace(files.sparkSession, "project").save(nodes(found.filter("kind = 'manifest'")), "nodes")  # read several times
    sql = sql_documents(of).select("unique_id", "kind", "content", "summary")
    seeds = seed_documents(of, found.filter("kind = 'seed'")).select("unique_id", F.lit("seed").alias("kind"), "content", "summary")
    return sql.unionByName(seeds)


def listing(found: DataFrame, kind: str) -> DataFrame:
    """Unique ids of one kind."""
    return found.filter(F.col("kind") == kind).select("unique_id")
