"""Filters over paths and metadata. Each is a plain column, so it reaches the scan where it can."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def path_allowed(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Starts with any of ``include`` (all, if empty) and none of ``exclude``."""
    inside, outside = F.lit(not include), F.lit(False)
    for p in include:
        inside = inside | F.startswith(path, F.lit(p))
    for p in exclude:
        outside = outside | F.startswith(path, F.lit(p))
    return inside & ~outside


def type_allowed(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    inside, outside = F.lit(not include), F.lit(False)
    for p in include:
        inside = inside | F.endswith(path, F.lit(p))
    for p in exclude:
        outside = outside | F.endswith(path, F.lit(p))
    return inside & ~outside


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def metadata_matches(meta: Column, wanted: Mapping[str, str]) -> Column:
    """Each key is absent or has the value."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (~F.map_contains_key(meta, F.lit(k)) | F.coalesce(meta[k] == v, F.lit(False)))
    return out


def title_matches(title: Column, terms: Sequence[str]) -> Column:
    out = F.lit(not terms)
    for t in terms:
        out = out | F.contains(F.lower(title), F.lit(t.lower()))
    return out


def not_blank(text: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) > 0


def metadata_filter(sources: Sequence[str] | None = None, since: str | None = None, until: str | None = None, kinds: Sequence[str] | None = None, source: str = "source", date: str = "date", kind: str = "kind") -> Column:
    """Documented retrieval filters: source list, date range, kind list."""
    out = F.lit(True)
    if sources:
        out = out & F.col(source).isin(list(sources))
    if since:
        out = out & (F.col(date) >= F.lit(since))
    if until:
        out = out & (F.col(date) <= F.lit(until))
    if kinds:
        out = out & F.col(kind).isin(list(kinds))
    return out
