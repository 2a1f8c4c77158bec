"""Scans of files and landed records into document tables."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusmill.functions import text as X
from corpusmill.operators import predicates as P

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "source_type", "source", "title", "text", "url")] + [T.StructField("date", T.TimestampType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
COMMIT = T.StructType([T.StructField(n, T.StringType()) for n in ("commit_id", "short_id", "message", "author_name", "author_email", "author_date", "committer_name", "committer_date", "url", "remote_url")])
REPO_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("file_path", "repository", "branch", "content", "organization", "project")] + [T.StructField("commits", T.ArrayType(COMMIT))])
ACTIVITY = T.StructType(
    [
        *(T.StructField(n, T.StringType()) for n in ("event_id", "timestamp", "session_id", "event_type", "query")),
        T.StructField("results", T.StructType([T.StructField(n, T.LongType()) for n in ("num_results", "retrieval_time_ms", "generation_time_ms", "total_time_ms")])),
        T.StructField("retrieved_docs", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("source", "source_type", "filename")]))),
        T.StructField("feedback", T.StructType([T.StructField("type", T.StringType()), T.StructField("comment", T.StringType())])),
    ]
)


def decoded(content) -> Any:
    """UTF-8 text, or Latin-1 where the bytes are not UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def local_files(spark: SparkSession, root: str, extensions: Sequence[str] = (".txt", ".md", ".html"), recursive: bool = True) -> DataFrame:
    """Text and HTML files below a folder as documents; blank ones are dropped, other kinds have no text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    raw = raw.filter(P.extension(F.col("path")).isin([e.lower() for e in extensions]))
    text = decoded(F.col("content"))
    is_html = F.lower("path").rlike(r"\.html?$")
    rows = raw.select(
        F.col("path").alias("doc_id"),
        F.lit("local_files").alias("source_type"),
        F.col("path").alias("source"),
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "").alias("title"),
        F.when(is_html, X.html_text(text)).otherwise(text).alias("text"),
        F.col("path").alias("url"),
        F.col("modificationTime").alias("date"),
        F.create_map(F.lit("file_type"), P.extension(F.col("path")), F.lit("filename"), F.element_at(F.split("path", "/"), -1)).alias("meta"),
    )
    return rows.filter(P.not_blank(F.col("text")))


def is_code(path) -> Any:
    """Whether the suffix is that of a language that is chunked as code."""
    return X.language_of(path).isin("python", "sql", "yaml")


def repo_files(spark: SparkSession, landed: str, include: Sequence[str] = (), exclude: Sequence[str] = (), types: Sequence[str] = (), history: int = 10) -> DataFrame:
    """Landed repository files (JSON, one object for each file) as documents with their latest commits."""
    return repo_documents(spark.read.schema(REPO_FILE).json(landed), include, exclude, types, history)


def repo_documents(raw: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), types: Sequence[str] = (), history: int = 10) -> DataFrame:
    """Rows of ``REPO_FILE``, landed or read from a service (``sources.repository``), as documents with their latest commits."""
    raw = raw.filter(P.path_allowed(F.col("file_path"), include, exclude) & P.type_allowed(F.col("file_path"), types))
    ordered = F.slice(F.reverse(F.array_sort(F.transform("commits", lambda c: F.struct(c["author_date"].alias("d"), c.alias("c"))))), 1, history)
    raw = raw.withColumn("commits", F.transform(ordered, lambda x: x["c"]))
    brief = F.transform("commits", lambda c: F.struct(c["author_date"].alias("date"), c["short_id"].alias("short_id"), c["author_name"].alias("author"), c["message"].alias("message")))
    language = X.language_of(F.col("file_path"))
    return raw.select(
        F.col("file_path").alias("doc_id"),
        F.lit("repo_file").alias("source_type"),
        F.concat_ws("/", "repository", "file_path").alias("source"),
        F.element_at(F.split("file_path", "/"), -1).alias("title"),
        F.col("content").alias("text"),
        "repository",
        "branch",
        language.alias("language"),
        language.isin("python", "sql", "yaml").alias("is_code"),
        X.line_count(F.col("content")).alias("total_lines"),
        "commits",
        F.size("commits").alias("commit_count"),
        F.coalesce(F.get("commits", F.lit(0))["author_name"], F.lit("unknown")).alias("last_modified_by"),
        F.coalesce(F.get("commits", F.lit(0))["author_date"], F.lit("unknown")).alias("last_modified_date"),
        X.commit_summary(brief).alias("commit_history_summary"),
    )


def repositories(listed: DataFrame, most: int | None = None) -> DataFrame:
    """``listed(id, name, default_branch, url)`` by name, without a branch's prefix; ``main`` where none is given."""
    branch = F.coalesce(F.regexp_replace("default_branch", "^refs/heads/", ""), F.lit("main"))
    rows = listed.select("id", "name", branch.alias("default_branch"), "url")
    return rows.orderBy("name", "id").limit(most) if most else rows


def repository_id(listed: DataFrame, name: str) -> str:
    """The id of the repository of that name; an error where there is none."""
    found = listed.filter(F.col("name") == name).select("id").first()
    if found is None:
        raise LookupError(f"no repository {name}")
    return found["id"]


def repo_items(landed: DataFrame, repository: str, branch: str = "main", below: str = "/", recursive: bool = True) -> DataFrame:
    """Paths of a repository's files on a branch below a folder, in order; direct children only unless recursive."""
    folder = below.rstrip("/") + "/"
    rows = landed.filter((F.col("repository") == repository) & (F.regexp_replace("branch", "^refs/heads/", "") == branch) & F.startswith("file_path", F.lit(folder)))
    rest = F.substring("file_path", F.lit(len(folder) + 1), F.length("file_path"))
    rows = rows if recursive else rows.filter(~F.contains(rest, F.lit("/")))
    return rows.select("file_path").distinct().orderBy("file_path")


def repo_batches(spark: SparkSession, landed: str, files: int = 50) -> DataFrame:
    """Landed repository files as a stream, ``files`` landed files in a batch."""
    return spark.readStream.schema(REPO_FILE).option("maxFilesPerTrigger", files).json(landed)


def every_path(spark: SparkSession, landed: str, paths: Sequence[str], **filters) -> DataFrame:
    """Files below any of the paths, each once."""
    return repo_files(spark, landed, include=paths, **filters)


def wiki_pages(pages: DataFrame, titles: Sequence[str] = (), least: int = 1) -> DataFrame:
    """``pages(page_id, url, html)`` as documents with stripped text; empty ones are dropped."""
    title = F.trim(X.strip_tags(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    rows = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.lit("wiki_page").alias("source_type"), F.col("url").alias("source"), title.alias("title"), X.strip_tags(F.col("html")).alias("text"), "url")
    return rows.filter(P.title_matches(F.col("title"), titles) & (F.length("text") >= least))


def wiki_spaces(pages: DataFrame, spaces: Sequence[str], parent: str | None = None, titles: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Documents of ``pages(page_id, space_key, parent_id, url, html)`` in the spaces, below a parent page if one is given;
    ``most`` of each space, in order of their ids."""
    from corpusmill.operators import tracker

    rows = pages.filter(F.col("space_key").isin(list(spaces)))
    if parent is not None:
        rows = rows.join(child_pages(pages, parent).select("page_id"), "page_id", "left_semi")
    if most:
        rows = tracker.top_per_group(rows, "space_key", [F.col("page_id")], most).drop("rank")
    found = wiki_pages(rows, titles)
    return found.join(rows.select(F.col("page_id").cast("string").alias("doc_id"), "space_key"), "doc_id")


def page_by_title(pages: DataFrame, space: str, title: str) -> DataFrame:
    """The page of a space with exactly that title, the one with the least id if there are several; or no row."""
    rows = wiki_pages(pages.filter(F.col("space_key") == space)).filter(F.col("title") == title)
    return rows.orderBy(F.col("doc_id").cast("long"), "doc_id").limit(1)


def child_pages(pages: DataFrame, parent: str, recursive: bool = True) -> DataFrame:
    """(page_id, depth) of the pages below one, direct children at depth 1."""
    from corpusmill.operators import lineage

    edges = pages.filter("parent_id IS NOT NULL").select(F.col("parent_id").cast("string").alias("src"), F.col("page_id").cast("string").alias("dst"))
    start = pages.sparkSession.createDataFrame([(parent,)], "start string")
    found = lineage.reachable(edges, start) if recursive else lineage.neighbours(edges, start).select("node", F.lit(1).alias("depth"))
    kind = pages.schema["page_id"].dataType
    return found.select(F.col("node").cast(kind).alias("page_id"), "depth")


def tickets(spark: SparkSession) -> DataFrame:
    """The ticket source has a schema and no rows."""
    return spark.createDataFrame([], DOCUMENT)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All sources under one schema; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def manifest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node, name, resource_type, raw_code, compiled_code, macro_sql, depends_on) of a manifest file."""
    node = "map<string, struct<name: string, resource_type: string, raw_code: string, compiled_code: string, macro_sql: string, depends_on: struct<nodes: array<string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"nodes {node}, macros {node}").alias("m"))
    rows = raw.select(F.explode(F.map_concat(F.coalesce("m.nodes", F.create_map().cast(node)), F.coalesce("m.macros", F.create_map().cast(node)))).alias("node", "n"))
    kind = F.coalesce("n.resource_type", F.when(F.startswith("node", F.lit("macro.")), F.lit("macro")))
    return rows.select("node", "n.name", kind.alias("resource_type"), "n.raw_code", "n.compiled_code", "n.macro_sql", F.col("n.depends_on.nodes").alias("depends_on"))


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, name, type) and edges(src, dst) of a linked graph file."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "linked map<string, struct<name: string, type: string, succ: array<bigint>>>").alias("g"))
    rows = raw.select(F.explode("g.linked").alias("id", "n"))
    nodes = rows.select(F.col("id").cast("long").alias("id"), "n.name", "n.type")
    return nodes, rows.select(F.col("id").cast("long").alias("src"), F.explode("n.succ").alias("dst"))


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """Activity events from JSON lines; malformed lines are skipped."""
    return spark.read.schema(ACTIVITY).option("mode", "DROPMALFORMED").json(folder)


def activity_stats(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.text(folder).select(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n_events"), F.countDistinct("file").alias("n_files"))


def tracker_csv(spark: SparkSession, path: str) -> DataFrame:
    from corpusmill.operators import tracker

    return spark.read.csv(path, header=True, schema=tracker.SCHEMA)


def local_documents(spark: SparkSession, root: str, extensions: Sequence[str] = (".txt", ".md", ".html", ".pdf"), recursive: bool = True) -> DataFrame:
    """Like ``local_files``, with the text of PDF files under banners for their pages."""
    rows = local_files(spark, root, [e for e in extensions if e.lower() != ".pdf"], recursive)
    if ".pdf" not in [e.lower() for e in extensions]:
        return rows
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).filter(P.extension(F.col("path")) == ".pdf")
    name = F.element_at(F.split("path", "/"), -1)
    pdf = pdf_pages(raw).select(F.col("path").alias("doc_id"), F.lit("local_files").alias("source_type"), F.col("path").alias("source"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), "text", F.col("path").alias("url"), F.lit(None).cast("timestamp").alias("date"), F.create_map(F.lit("file_type"), F.lit(".pdf"), F.lit("filename"), name).alias("meta"))
    return rows.unionByName(pdf.filter(P.not_blank(F.col("text"))))


def pdf_pages(files: DataFrame) -> DataFrame:
    """(path, text) of PDF files, pages under banners; needs the optional package pypdf on the executors."""

    def pages(batches):
        import io

        import pandas as pd
        from pypdf import PdfReader

        for batch in batches:
            texts = ["\n\n".join(f"--- Page {i} ---\n{p.extract_text() or ''}" for i, p in enumerate(PdfReader(io.BytesIO(c)).pages, 1)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return files.select("path", "content").mapInPandas(pages, "path string, text string")


def settings(path: str) -> dict:
    """A YAML file with whole values of the form ``${NAME}`` taken from the environment."""
    import yaml

    def filled(x):
        if isinstance(x, dict):
            return {k: filled(v) for k, v in x.items()}
        if isinstance(x, list):
            return [filled(v) for v in x]
        m = re.fullmatch(r"\$\{(\w+)\}", x) if isinstance(x, str) else None
        return os.environ.get(m[1], x) if m else x

    with open(path, encoding="utf-8") as f:
        return filled(yaml.safe_load(f) or {})


def written_settings(path: str, values: dict, given: Sequence[str]) -> None:
    """Write back those top-level settings that were given explicitly, and no defaults."""
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({k: values[k] for k in given if k in values}, f, allow_unicode=True)


def template(path: str | None, default: str) -> str:
    """A prompt template from a file, or the default where there is no such file or it is blank."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if text.strip():
            return text
    return default


def ingest_sources(spark: SparkSession, sources: Sequence[dict]) -> DataFrame:
    """Documents of all enabled sources under one schema, each source routed by its type."""
    kinds = {
        "local_files": lambda s: local_files(spark, s["path"], s.get("extensions", (".txt", ".md", ".html"))).select(*DOCUMENT.names),
        "repository": lambda s: repo_files(spark, s["landed"], s.get("include", ()), s.get("exclude", ()), s.get("types", ())).select("doc_id", "source_type", "source", "title", "text"),
        "wiki": lambda s: wiki_spaces(spark.read.parquet(s["pages"]), s["spaces"]).select("doc_id", "source_type", "source", "title", "text", "url"),
        "tickets": lambda s: tickets(spark),
    }
    frames = []
    for s in enabled(sources):
        if s["type"] not in kinds:
            raise ValueError(f"unknown source type: {s['type']}")
        frames.append(kinds[s["type"]](s))
    return union_sources([tickets(spark), *frames])


def enabled(sources: Sequence[dict]) -> list[dict]:
    return [s for s in sources if s.get("enabled", True)]
