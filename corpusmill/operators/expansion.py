"""Query expansion and routing: one query string in, rows or columns out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.functions import text as T

# Concepts with the synonyms that replace them.
CONCEPTS = {
    "qm1": ["qm-1", "quality measure 1"],
    "qm2": ["qm-2", "quality measure 2"],
    "qm3": ["qm-3", "quality measure 3"],
    "qm4": ["qm-4", "quality measure 4"],
    "qm5": ["qm-5", "quality measure 5"],
    "classification": ["category", "type"],
    "classifications": ["categories", "types"],
    "logic": ["calculation", "formula"],
    "anthem": ["anthem blue cross", "anthem bcbs"],
    "table": ["dataset", "data table"],
    "model": ["data model", "dbt model"],
    "query": ["sql query", "database query"],
}
QUESTIONS = {"do we have": "there are", "what is": "definition of", "how does": "mechanism of", "where is": "location of"}
NUMBERS = {"three": "3", "five": "5", "two": "2", "four": "4"}


def expand(query: str, most: int = 5) -> list[str]:
    """The normalised query and what replacing a concept, question form or number word makes of it."""
    base = " ".join(query.lower().split())[:1000]
    if len(base) < 3:
        raise ValueError("a query has at least three characters")
    swaps = [(c, s) for c, synonyms in CONCEPTS.items() for s in synonyms] + [*QUESTIONS.items(), *NUMBERS.items()]
    return list(dict.fromkeys([base, *(base.replace(a, b) for a, b in swaps if a in base)]))[:most]


def expanded(spark: SparkSession, query: str, most: int = 5) -> DataFrame:
    """(query_index, query_text)."""
    return spark.createDataFrame(list(enumerate(expand(query, most))), "query_index int, query_text string")


def expand_column(query: Column, most: int = 5) -> Column:
    """The same for a column of queries."""
    base = T.normalise_query(query)
    swaps = [(c, s) for c, synonyms in CONCEPTS.items() for s in synonyms] + [*QUESTIONS.items(), *NUMBERS.items()]
    every = [F.when(F.contains(base, F.lit(a)), F.replace(base, F.lit(a), F.lit(b))) for a, b in swaps]
    return F.slice(F.array_distinct(F.array_compact(F.array(base, *every))), 1, most)


def enhance(query: Column) -> Column:
    """Suffixes that treatment and staging questions get."""
    low = F.lower(query)
    low = F.when(F.contains(low, F.lit("cancer")) & ~F.contains(low, F.lit("treatment")), F.concat(low, F.lit(" treatment therapy"))).otherwise(low)
    return F.when(F.contains(low, F.lit("tumor")) & ~F.contains(low, F.lit("stage")), F.concat(low, F.lit(" staging classification"))).otherwise(low)


# Kinds of questions with the words that tell them, in the order in which they are tried.
ROUTES = {
    "overview": ["what is", "overview", "explain", "summary"],
    "specific": ["how to", "step by step", "configure", "setup"],
    "troubleshoot": ["error", "fix", "troubleshoot", "issue"],
}


def route(query: Column) -> Column:
    """overview, specific, troubleshoot or general, by the first list with a phrase in the query."""
    out = F.lit("general")
    for name, words in reversed(ROUTES.items()):
        out = F.when(T.contains_any(F.lower(query), words), name).otherwise(out)
    return out


def detect_project(query: Column, projects: Sequence[str]) -> Column:
    """The first project (longest name first) that the query names, or ``general``."""
    out = F.lit("general")
    for p in sorted(projects, key=lambda p: (len(p), p)):
        out = F.when(F.contains(F.lower(query), F.lit(p.lower())), p).otherwise(out)
    return out
