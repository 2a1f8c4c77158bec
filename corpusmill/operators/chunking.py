"""Splitting of texts into chunks. SQL forms where the result has a closed form, scanners where it hasn't."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

# Section marks, in the order in which they cut.
BOUNDARIES = [
    "## Overview", "## Configuration", "## Implementation", "## Results",
    "SUMMARY:", "DETAILS:", "FINDINGS:", "CONCLUSION:",
    "Abstract", "Introduction", "Methods", "Results", "Discussion",
]
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
_MARK = "\x01"
_WHITE = " \t\n\x0b\f\r"


def fixed(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, ``size - overlap`` apart, until one reaches the end."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def by_lines(text: Column, size: int = 800, overlap: int = 160) -> Column:
    """Line windows (start, end, content): T = size / 80 lines each, O = overlap / 80 shared."""
    t, o = size // 80, overlap // 80
    lines = F.split(text, "\n")
    count = F.lit(1) + F.greatest(F.lit(0), F.floor((F.size(lines) - o) / (t - o)).cast("int"))
    at = lambda i: i * (t - o)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((at(i) + 1).alias("start"), F.least(F.size(lines), at(i) + t).alias("end"), F.array_join(F.slice(lines, at(i) + 1, F.lit(t)), "\n").alias("content")))


def sections(text: Column) -> Column:
    """Texts between section marks; a mark stays with what follows it."""
    for b in BOUNDARIES:
        text = F.replace(text, F.lit(b), F.lit(_MARK + b))
    return F.filter(F.transform(F.split(text, _MARK), lambda x: F.trim(x, F.lit(_WHITE))), lambda x: x != "")


def by_headers(text: Column) -> Column:
    """Parts between headers, rules and blank lines."""
    marked = F.regexp_replace(text, r"\n(#{1,6} |---+\n|\n)", f"{_MARK}$1")
    return F.filter(F.transform(F.split(marked, _MARK), lambda x: F.trim(x, F.lit(_WHITE))), lambda x: x != "")


def exploded(docs: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """(doc_id, chunk_index, content)."""
    return docs.select(F.col(key), F.posexplode(chunks).alias("chunk_index", "content"))


def with_metadata(chunks: DataFrame, method: str, key: str = "doc_id") -> DataFrame:
    return chunks.select("*", F.lit(method).alias("chunk_method"), F.length("content").alias("chunk_size"), F.concat_ws("_", F.col(key), F.col("chunk_index")).alias("chunk_id"))


def prepended(content: Column, **metadata: Column) -> Column:
    """A chunk under lines of its document's metadata."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in metadata.items()), content)


def split_recursively(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that occurs; pieces keep theirs."""
    if not text.strip():
        return []
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = "".join(held).strip()
        if joined:
            out.append(joined)

    total = 0
    for p in parts:
        if len(p) > size and finer:
            flush()
            held, total = [], 0
            out += split_recursively(p, size, overlap, finer)
            continue
        if held and total + len(p) > size:
            flush()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    flush()
    return out


class Mark(NamedTuple):
    """What a line does to the chunk: ``over``: ends the one before it if that has more characters; ``drops``: else
    drops that; ``kind``: what the chunk is from here on; ``limit``: ends the chunk after it if that has more
    characters; ``then``: the kind after that."""

    over: int | None = None
    drops: bool = False
    kind: str | None = None
    limit: int | None = None
    then: str | None = None


def _first_match(table: Sequence[tuple[str, str]], lines: Sequence[str]) -> list[tuple[str, re.Match] | None]:
    """For each line the first (class, match) of a pattern table."""
    tried = [(name, re.compile(pattern, re.IGNORECASE)) for name, pattern in table]
    return [next(((name, m) for name, p in tried if (m := p.search(line))), None) for line in lines]


# Line patterns, and sizes under which a class, a statement or a macro doesn't end a chunk.
PYTHON_LINES = [("class", r"^\s*(?-i:class)\s+\w"), ("function", r"^\s*(?-i:def)\s+\w"), ("decorator", r"^\s*@\w")]
SQL_STARTS = [("statement", r"^\s*(select|insert|update|delete|create|with|alter|drop)")]
SQL_ENDS = [("end", r";\s*$|^\s*go\s*$")]
MACRO_LINES = [("end", r"\{%\s*(?-i:endmacro)\s*%\}"), ("macro", r"\{%\s*(?-i:macro)\s+\w")]
CLASS_OVER, STATEMENT_OVER, MACRO_OVER = 100, 200, 100


def python_marks(lines: Sequence[str], size: int) -> list[Mark]:
    of = {"class": Mark(over=CLASS_OVER, drops=True, kind="class"), "function": Mark(over=size, kind="function"), "decorator": Mark()}
    return [of[m[0]] if m else Mark(limit=size) for m in _first_match(PYTHON_LINES, lines)]


def sql_marks(lines: Sequence[str], size: int) -> list[Mark]:
    starts, ends = _first_match(SQL_STARTS, lines), _first_match(SQL_ENDS, lines)
    return [Mark(over=size if s else None, kind=s[1][1].lower() if s else None, limit=STATEMENT_OVER if e else None) for s, e in zip(starts, ends, strict=True)]


def yaml_marks(lines: Sequence[str], size: int) -> list[Mark]:
    """Lines of a macro have no limit; its last one always ends the chunk."""
    found = [m[0] if m else None for m in _first_match(MACRO_LINES, lines)]
    last = itertools.accumulate(found, lambda before, now: now or before, initial="")  # the last mark before each line
    of = {"macro": Mark(over=MACRO_OVER, kind="macro"), None: Mark(limit=size)}
    out = []
    for now, before in zip(found, last):
        inside = before == "macro"
        if now == "end":
            out.append(Mark(limit=-1, then="config") if inside else Mark())
        else:
            out.append(Mark() if inside and now is None else of[now])
    return out


def spans(lengths: Sequence[int], marks: Sequence[Mark], kind: str, shared: int = 0) -> list[tuple[int, int, str]]:
    """(first line, line behind the last, kind) of the chunks that marks and running sizes give; a chunk that its
    limit ends shares its last lines with the next one."""
    ends = list(itertools.accumulate((n + 1 for n in lengths), initial=0))
    chars = lambda a, b: ends[b] - ends[a] - 1
    out, first = [], 0
    for n, mark in enumerate(marks):
        if mark.over is not None and n > first and chars(first, n) > mark.over:
            out.append((first, n, kind))
            first = n
        elif mark.drops:
            first = n
        kind = mark.kind or kind
        if mark.limit is not None and chars(first, n + 1) > mark.limit:
            out.append((first, n + 1, kind))
            first, kind = max(first, n + 1 - shared), mark.then or kind
    return out + ([(first, len(marks), kind)] if first < len(marks) else [])


#: Language: marks of its lines, first kind, and characters of overlap for each shared line (0: none is shared).
LANGUAGES = {"python": (python_marks, "module", 50), "sql": (sql_marks, "sql", 0), "yaml": (yaml_marks, "config", 0)}


def scan(language: str, text: str, size: int, overlap: int = 0) -> list[tuple[str, int, int, str]]:
    """(content, first line, last line, kind) of a file's chunks."""
    marks, kind, per = LANGUAGES[language]
    lines = text.split("\n")
    found = spans([len(x) for x in lines], marks(lines, size), kind, max(1, overlap // per) if per else 0)
    return [("\n".join(lines[a:b]), a + 1, b, k) for a, b, k in found]


def by_bytes(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes in a text column, or of one row: what a task holds beside its batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def code_chunks(files: DataFrame, size: int = 3000, overlap: int = 200) -> DataFrame:
    """``files(path, language, text)`` to (path, chunk_index, content, start_line, end_line, chunk_type).

    Other languages get line windows. Where a chunk ends depends on where the last one did, hence Python;
    files are independent and stream through in Arrow batches.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, "text"):
                rows = []
                for path, language, text in zip(*(some[c].to_pylist() for c in ("path", "language", "text")), strict=True):
                    if language in LANGUAGES:
                        found = scan(language, text or "", size, overlap)
                    else:
                        lines, t, o = (text or "").split("\n"), max(2, size // 80), overlap // 80
                        o = min(o, t - 1)
                        found = [("\n".join(lines[a : a + t]), a + 1, min(len(lines), a + t), "code") for a in range(0, max(1, len(lines) - o + (t - o)), t - o) if a < max(1, len(lines))]
                    rows += [(path, i, *f) for i, f in enumerate(found)]
                if rows:
                    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["path", "chunk_index", "content", "start_line", "end_line", "chunk_type"])

    return files.select("path", "language", "text").mapInArrow(chunked, "path string, chunk_index int, content string, start_line int, end_line int, chunk_type string")


def syntax_chunks(files: DataFrame) -> DataFrame:
    """``files(path, text)`` of Python sources to (path, chunk_index, name, start_line, end_line, content): top-level
    functions and classes with their decorators by the syntax tree, and what lies between; a text that can't be
    parsed is one chunk without a name."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ast

        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                lines = (text or "").split("\n")
                try:
                    body = ast.parse(text or "").body
                except (SyntaxError, ValueError):
                    body = []
                named = [(min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1, n.end_lineno, n.name) for n in body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
                found, at = [], 0
                for first, last, name in named:
                    found += [(at, first, None), (first, last, name)]
                    at = last
                found = [(a, b, name) for a, b, name in [*found, (at, len(lines), None)] if name or any(x.strip() for x in lines[a:b])]
                rows += [(path, i, name, a + 1, b, "\n".join(lines[a:b])) for i, (a, b, name) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "name", "start_line", "end_line", "content"])

    return files.select("path", "text").mapInPandas(cut, "path string, chunk_index int, name string, start_line int, end_line int, content string")


def recursive_chunks(docs: DataFrame, size: int = 3000, overlap: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk_index, content) by ``split_recursively``."""

    @F.pandas_udf("array<string>")
    def split(column: pd.Series) -> pd.Series:
        return column.map(lambda t: split_recursively(t or "", size, overlap))

    return docs.select(F.col(key), F.posexplode(split(F.col(text))).alias("chunk_index", "content"))


def semantic_chunks(docs: DataFrame, size: int = 3000, overlap: int = 200, key: str = "doc_id", text: str = "text", source: str | None = None) -> DataFrame:
    """(doc_id, chunk_index, content, section_id, chunk_id): sections, and the parts of those over the size.

    A whole section's id is the source and its number, a part's has the part's number as well.
    """
    source_of = F.coalesce(F.col(source).cast("string"), F.lit("unknown")) if source else F.col(key).cast("string")
    rows = docs.select(F.col(key), source_of.alias("_source"), F.posexplode(sections(F.col(text))).alias("section_id", "section"))
    kind = docs.schema[key].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in by_bytes(batch, "section"):
                found = [split_recursively(t, size, overlap) if len(t) > size else None for t in some["section"].to_pylist()]
                parts = [[t] if f is None else f for t, f in zip(some["section"].to_pylist(), found)]
                row = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                held = [some[c].take(row) for c in (key, "_source", "section_id")]
                cut = pa.array([f is not None for f in found]).take(row)
                part = pa.array([i for p in parts for i in range(len(p))], pa.int32())
                yield pa.RecordBatch.from_arrays([*held, cut, part, pa.array([x for p in parts for x in p], pa.string())], names=[key, "_source", "section_id", "_cut", "_part", "content"])

    rows = rows.mapInArrow(split, StructType([StructField(key, kind), *StructType.fromDDL("_source string, section_id int, _cut boolean, _part int, content string")]))
    name = F.concat_ws("_", "_source", "section_id", F.when(F.col("_cut"), F.col("_part").cast("string")))
    order = Window.partitionBy(key).orderBy("section_id", "_part")
    return rows.select(key, (F.row_number().over(order) - 1).alias("chunk_index"), "content", "section_id", name.alias("chunk_id"))


def chunk(docs: DataFrame, strategy: str, size: int = 3000, overlap: int = 200, most: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Router over strategies: recursive, semantic, fixed; at most ``most`` chunks in all, in document order."""
    if strategy == "recursive":
        out = recursive_chunks(docs, size, overlap, key, text)
    elif strategy == "semantic":
        out = semantic_chunks(docs, size, overlap, key, text).select(key, "chunk_index", "content")
    elif strategy == "fixed":
        out = exploded(docs, fixed(F.col(text), size, overlap), key)
    else:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return out.orderBy(key, "chunk_index").limit(most) if most else out


def chunks_by_document(docs: DataFrame, chunks: DataFrame, key: str = "file_path") -> DataFrame:
    """Documents with the number of their chunks, the first chunk's id and the metadata of the first; those without chunks have 0."""
    first = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.min_by(F.struct("chunk_id", "meta"), "chunk_index").alias("first"))
    return docs.join(first, key, "left").select(*docs.columns, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.col("first.chunk_id").alias("first_chunk"), F.col("first.meta").alias("first_meta"))


def with_summaries(chunks: DataFrame, summaries: DataFrame, key: str = "summary_id") -> DataFrame:
    """Chunks with the summary, keywords and topics of their document, where it has a summary."""
    return chunks.join(summaries.select(key, "summary", "keywords", "topics"), key, "left")
