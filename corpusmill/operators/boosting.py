"""Boosts over retrieved rows, reranking, and the ranking pipeline."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.functions import text as T
from corpusmill.operators import fusion, lexical

# Word lists and weights that results depend on.
LOGIC_WORDS = ["logic", "calculation", "formula", "rule", "algorithm", "methodology"]
SQL_STRUCTURES = ["with", "select", "from", "join", "where", "group by", "having"]
DOMAIN_TERMS = [
    "cancer", "oncology", "tumor", "chemotherapy", "radiation", "immunotherapy",
    "metastasis", "carcinoma", "lymphoma", "leukemia", "biopsy", "malignant",
    "benign", "staging", "prognosis", "diagnosis", "treatment", "therapy",
    "clinical", "patient", "medical", "healthcare", "disease", "symptom",
    "eom", "enhancing oncology model",
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ANSWER_WORDS = ["started", "began", "launched", "implemented", "established", "initiated", "effective", "beginning", "since", "from", "in 2", "20", "year", *MONTHS]
DATE_WORDS = [*MONTHS, "2019", "2020", "2021", "2022", "2023", "2024", "2025", "q1", "q2", "q3", "q4", "quarter"]
CODE_SYSTEMS = ["icd-o", "snomed-ct", "mesh", "icd-10", "cpt"]
WHEN_WORDS = ["when", "start", "began", "launch", "implement"]
DIRECT_PHRASES = ["the program started", "began in", "launched in", "effective"]
#: Terms that raise a score-based fusion by a fifth.
FUSION_TERMS = [
    "oncology", "cancer", "tumor", "malignant", "benign", "chemotherapy", "radiation", "metastasis", "carcinoma",
    "sarcoma", "leukemia", "lymphoma", "biopsy", "staging", "prognosis", "treatment", "therapy",
]


def has_any(query: str, words: list[str]) -> bool:
    return any(w in query.lower() for w in words)


def sql_boost(text: Column, query: str, is_sql_file: Column, is_dbt: Column) -> Column:
    low, q = F.lower(text), query.lower()
    total = F.lit(1.0) + F.when(is_sql_file, 0.3).otherwise(0.0) + F.when(is_dbt, 0.2).otherwise(0.0)
    if has_any(q, LOGIC_WORDS):
        total = total + F.when(T.contains_any(low, LOGIC_WORDS), 0.4).otherwise(0.0)
    mine = sum(s in q for s in SQL_STRUCTURES)
    if mine:
        theirs = T.count_terms(low, SQL_STRUCTURES)
        total = total + F.when(theirs > 0, F.least(theirs, F.lit(mine)) / F.greatest(theirs, F.lit(mine)) * 0.3).otherwise(0.0)
    for code in re.findall(r"\b[a-z]{2,4}\d{1,3}\b", q):
        total = total + F.when(F.contains(low, F.lit(code)), 0.6).otherwise(0.0)
    return total


def domain_boost(text: Column, query: str) -> Column:
    low = F.lower(text)
    total = 1.0 + F.least(T.count_terms(low, DOMAIN_TERMS) * 0.1, F.lit(0.5)) + F.least(T.count_terms(low, CODE_SYSTEMS) * 0.2, F.lit(0.3))
    if has_any(query, WHEN_WORDS):
        total = total + F.least(T.count_terms(low, ANSWER_WORDS) * 0.3 + T.count_terms(low, DATE_WORDS) * 0.4, F.lit(1.0))
    return total + F.when(T.contains_any(low, DIRECT_PHRASES), 0.8).otherwise(0.0)


def model_boost(name: Column, query: str) -> Column:
    """Two if the name has the number of a quality measure that the query asks for."""
    found = F.lit(False)
    for n in re.findall(r"qm[-\s]?(\d+)", query.lower()):
        found = found | F.contains(F.lower(name), F.lit(f"qm{n}")) | F.contains(F.lower(name), F.lit(f"qm_{n}"))
    return F.when(found, 2.0).otherwise(0.0)


def code_boost(text: Column, score: Column, query: str) -> Column:
    """Half as much again where the text has a code of the query."""
    codes = [c.lower() for p in T.CODE_PATTERNS for c in re.findall(p, query, re.IGNORECASE)]
    return F.when(T.contains_any(F.lower(text), codes), score * 1.5).otherwise(score)


def rank_pipeline(semantic: DataFrame, keyword: DataFrame, docs: DataFrame, query: str, top_k: int, weights: tuple[float, float] = (0.7, 0.3), is_sql_file: Column | None = None, is_dbt: Column | None = None) -> DataFrame:
    """Fusion, SQL boost, cut, domain boost, rerank, removal of repeated texts, in that order.

    The stages are stable sorts, so the final order is lexicographic: the last stage's score first,
    then the one before, down to insertion order. All scores are columns and two sorts suffice. The
    candidate lists have (doc_id, score) and at most 50 rows each, so only their texts are read.
    """
    is_sql = any(k in query.lower() for k in T.SQL_KEYWORDS)
    weights = (0.4, 0.6) if is_sql else weights
    s = fusion.by_position(semantic, "s").withColumn("si", F.row_number().over(Window.partitionBy().orderBy(F.desc("s"), "doc_id")))
    k = fusion.by_position(keyword, "k").withColumn("ki", F.row_number().over(Window.partitionBy().orderBy(F.desc("k"), "doc_id")))
    fused = fusion.fuse(s, k, weights).withColumn("inserted", F.coalesce(F.col("si"), F.col("ki") + 1000))
    rows = docs.join(F.broadcast(fused), "doc_id")  # two lists of at most 50 rows
    no = F.lit(False)
    sql = F.round(sql_boost(F.col("text"), query, is_sql_file if is_sql_file is not None else no, is_dbt if is_dbt is not None else no), 6) if is_sql else F.lit(1.0)
    rows = rows.select("doc_id", "text", "fused", "inserted", sql.alias("sql_boost")).orderBy(F.desc("sql_boost"), F.desc("fused"), "inserted").limit(top_k)
    rows = rows.select("*", F.round(domain_boost(F.col("text"), query), 6).alias("domain_boost"), F.round(lexical.rerank_score(F.col("text"), query), 6).alias("rerank"), F.md5("text").alias("digest"))
    order = [F.desc("rerank"), F.desc("domain_boost"), F.desc("sql_boost"), F.desc("fused"), F.col("inserted")]
    first = F.row_number().over(Window.partitionBy("digest").orderBy(*order))
    rows = rows.withColumn("seen", first).filter("seen = 1")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order))).select("doc_id", "fused", "sql_boost", "domain_boost", "rerank", "position")
