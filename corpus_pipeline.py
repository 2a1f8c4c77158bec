"""Documents to packed training sequences: quality rules, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusmill.llm.line_dedup import dedup_lines
from corpusmill.llm.near_dedup import near_components
from corpusmill.llm.packing import pack_documents
from corpusmill.llm.quality import keep_good
from corpusmill.llm.workspace import Workspace, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go. Rows are judged one by one, so rows
    of one id, or without one, keep or lose their place by their own texts. An empty table stays empty."""
    return keep_good(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least ten of them share; n_chars follows the text.

    Null texts stay null; rows of one id are one document, rows without one are documents of their own.
    An empty table stays empty.
    """
    found = dedup_lines(docs.select(*COLUMNS))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 0.8 or more): the one with the smallest id, once.

    Documents without words stay. Rows of one id are one document, of which the row with the first text
    stays; rows without an id stay unless their words equal those of a document with one. An empty table
    stays empty.
    """
    docs = docs.select(*COLUMNS)
    ws = Workspace(spark, "near-stage")
    kept = ws.save(near_components(docs).filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    out = docs.join(kept.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if not kept.filter("n > 1 AND doc_id IS NOT NULL").isEmpty():
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        out = out.withColumn("_n", order).filter("_n = 1 OR doc_id IS NULL").drop("_n")
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 1024 tokens; null and empty texts are a piece
    with the end id alone, repeated rows are packed as often as they occur. An empty table gives no rows."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("packing", packing)]

#: Tokens, fitted patterns and similarity components are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with Workspace.scope():  # what a stage wrote for itself goes once its result is written
            docs = ws.save(stage(spark, docs, sf_dir), f"stage{i}")
        ws.drop(f"stage{i - 1}")
    return docs
