"""A keyword index that is written once and read by terms.

Postings and term statistics lie in folders by a hash of the term, sorted by term inside, so that a query
reads the folders of its terms only and skips row groups without them; nothing of the texts is read again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmill.operators.lexical import B, EPSILON, K1, _words
from corpusmill.workspace import delete, exists

BUCKETS = 64
#: Bucket of the rows that hold documents' lengths.
LENGTHS = -1
#: Words of rows that are counted together.
TOKENS = 1 << 21
BLOCKS = "term string, doc_id array<long>, tf array<long>, dl array<long>"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def term_blocks(docs: DataFrame, key: str, text: str, drop: Sequence[str]) -> DataFrame:
    """(term, doc_id, tf, dl, bucket): for each term of some rows that lie together, lists of the rows that have it.

    Terms are counted where the rows lie, so a term is shuffled and sorted once for very many rows. All rows are listed
    under the empty term, in a bucket of its own, with their lengths (of no text: none).
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.list_value_length(batch["w"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENS, "right")))
                some, n = batch.slice(at, end - at), end - at
                length = pc.list_value_length(some["w"]).cast(pa.int64())
                words = some["w"].flatten().dictionary_encode()
                place = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), sizes[at:end])
                found, tf = np.unique(place, return_counts=True)
                yield _blocks(pa.array([""]), np.array([0, n]), some["doc_id"], np.zeros(n, np.int64), length)
                yield _blocks(words.dictionary, np.searchsorted(found, np.arange(len(words.dictionary) + 1) * n), some["doc_id"].take(pa.array(found % n)), tf, length.take(pa.array(found % n)))
                at = end

    words = docs.select(F.col(key).cast("long").alias("doc_id"), _words(text, drop).alias("w"))
    return words.mapInArrow(block, BLOCKS).withColumn("bucket", F.when(F.col("term") == "", LENGTHS).otherwise(bucket_of(F.col("term"))))


def _blocks(terms: pa.Array, starts: np.ndarray, ids: pa.Array, tf: np.ndarray, dl: pa.Array) -> pa.RecordBatch:
    at = pa.array(starts.astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, x) for x in (ids, pa.array(tf.astype(np.int64)), dl)]
    return pa.RecordBatch.from_arrays([terms, *lists], names=["term", "doc_id", "tf", "dl"])


def blocks_again(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, term, tf, dl, bucket) as blocks: of a term's rows that follow each other, up to a batch."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["term"].dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts, order = np.searchsorted(codes[order], np.arange(len(words.dictionary) + 1)), pa.array(order)
            yield _blocks(words.dictionary, starts, batch["doc_id"].take(order), batch["tf"].take(order).to_numpy(zero_copy_only=False), batch["dl"].take(order))

    found = rows.select("term", "doc_id", "tf", "dl").mapInArrow(block, BLOCKS)
    return found.withColumn("bucket", F.when(F.col("term") == "", LENGTHS).otherwise(bucket_of(F.col("term"))))


def rows_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl, bucket), and what else there is beside the lists."""
    return blocks.select(*(c for c in blocks.columns if c not in ("doc_id", "tf", "dl")), F.inline(F.arrays_zip("doc_id", "tf", "dl")))


def write_postings(blocks: DataFrame, folder: str) -> None:
    """Folders by bucket, sorted by term; one shuffle, in which buckets of more than a task's share are split."""
    dealt = blocks.hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(folder)


def term_counts(blocks: DataFrame) -> DataFrame:
    """(bucket, term, df): documents of each term."""
    return blocks.filter(F.col("bucket") != LENGTHS).groupBy("bucket", "term").agg(F.sum(F.size("doc_id")).alias("df"))


def write_figures(found: KeywordIndex, counts: DataFrame | None = None) -> KeywordIndex:
    """Term statistics and the row of corpus figures, from the postings (or from ``counts`` of documents of each term)."""
    folder = found.folder
    every = found.postings()
    totals = every.filter(F.col("bucket") == LENGTHS).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = (term_counts(found.blocks()) if counts is None else counts).crossJoin(F.broadcast(totals.select("n_docs")))  # one row
    idf = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    terms = df.select("bucket", "term", "df", idf.alias("idf"))
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    totals.crossJoin(found.terms().agg(F.avg("idf").alias("mean_idf"))).write.mode("overwrite").parquet(f"{folder}/figures")  # one row each
    return found


def build_index(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", drop: Sequence[str] = ()) -> KeywordIndex:
    """Write postings (term, and lists of doc_id, tf and dl), term statistics (term, df, idf) and one row of corpus figures.

    The texts are read and tokenised once, all else comes from the postings. Rows without text count as
    documents and have no terms. Rows are documents; where several have one key, their scores are added up.
    """
    write_postings(term_blocks(docs, key, text, drop), f"{folder}/postings")
    return write_figures(KeywordIndex(docs.sparkSession, folder))


class KeywordIndex:
    """What ``build_index`` wrote to a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}
        self._rows: DataFrame | None = None

    def _read(self, name: str, schema: str) -> DataFrame:
        if name not in self._tables:  # files are listed once
            self._tables[name] = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return self._tables[name]

    def blocks(self) -> DataFrame:
        return self._read("postings", f"{BLOCKS}, bucket int")

    def postings(self) -> DataFrame:
        return self._rows if self._rows is not None else rows_of(self.blocks())

    def terms(self) -> DataFrame:
        return self._read("terms", "term string, df long, idf double, bucket int")

    def figures(self) -> DataFrame:
        return self._read("figures", "n_docs long, avgdl double, mean_idf double")

    def bm25(self, query: str, drop: Sequence[str] = ()) -> DataFrame:
        """(doc_id, score) of documents that have a query term. A term repeated in the query counts again."""
        wanted = [w for w in query.lower().split() if w not in set(drop)]
        weights = {w: wanted.count(w) for w in wanted}
        if not weights:
            return self.spark.createDataFrame([], "doc_id long, score double")
        buckets = sorted(set(self.spark.sql("SELECT 1").select(*(bucket_of(F.lit(w)) for w in weights)).first()))
        mine = F.col("bucket").isin(buckets) & F.col("term").isin(list(weights))
        figures = self.figures().first()
        idfs = {r["term"]: r["idf"] for r in self.terms().filter(mine).collect()}  # at most a row for each word of the query
        if not idfs:
            return self.spark.createDataFrame([], "doc_id long, score double")
        gain = {t: weights[t] * (EPSILON * figures["mean_idf"] if i < 0 else i) for t, i in idfs.items()}
        weight = F.create_map(*(F.lit(x) for t, g in gain.items() for x in (t, float(g))))
        part = weight[F.col("term")] * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(figures["avgdl"])))
        hits = self.postings().filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(idfs)))
        return hits.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))


class SegmentedIndex:
    """A keyword index that grows: segments that never change, and marks of deleted documents.

    ``add`` writes a segment of the new documents alone. ``FANOUT`` segments of a level are merged into one of the
    next, without deleted documents, so a posting is written again once a level. A mark has the number of the newest segment
    at its time: a document that is added again lies behind it. Each change writes a state of its own, and
    a reader keeps the one that it began with; a change that fails leaves the last state in force.
    """

    FANOUT = 4

    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", text: str = "text", drop: Sequence[str] = ()):
        self.spark, self.folder, self.key, self.text, self.drop = spark, folder.rstrip("/"), key, text, tuple(drop)

    def _states(self) -> DataFrame | None:
        return self.spark.read.schema("number long, newest long, segments map<long,int>, marks long").parquet(f"{self.folder}/state") if exists(self.spark, f"{self.folder}/state") else None

    def _state(self) -> dict:
        found = self._states()
        row = found.orderBy(F.desc("number")).first() if found is not None else None
        return row.asDict() if row else {"number": 0, "newest": 0, "segments": {}, "marks": 0}

    def _commit(self, state: dict) -> None:
        """``segments``: level of each; ``newest``: the last number given; ``marks``: writes of marks so far."""
        state = state | {"number": state["number"] + 1}
        rows = self.spark.createDataFrame([(state["number"], state["newest"], state["segments"], state["marks"])], "number long, newest long, segments map<long,int>, marks long")
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/state")

    def _segment(self, number: int) -> DataFrame:
        found = self.spark.read.schema(f"{BLOCKS}, bucket int").parquet(f"{self.folder}/segment{number}/postings")
        return found.withColumn("segment", F.lit(number).cast("long"))

    def _joined(self, parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _marked(self, state: dict) -> DataFrame | None:
        if not state["marks"]:
            return None
        marks = self.spark.read.schema("gone long, upto long").parquet(*(f"{self.folder}/marks{i}" for i in range(state["marks"])))
        return marks.groupBy("gone").agg(F.max("upto").alias("upto"))

    def _postings(self, state: dict, numbers: Sequence[int], alive: bool = True) -> DataFrame:
        """Postings of segments that are alive, or those that are marked."""
        rows = rows_of(self._joined([self._segment(n) for n in sorted(numbers)]))
        marked = self._marked(state)
        if marked is not None:
            rows = rows.join(marked, (F.col("doc_id") == F.col("gone")) & (F.col("segment") <= F.col("upto")), "left_anti" if alive else "left_semi")
        return rows.select("doc_id", "term", "tf", "dl", "bucket")

    def _marked_counts(self, state: dict, numbers: Sequence[int]) -> DataFrame:
        gone = self._postings(state, numbers, alive=False).filter(F.col("bucket") != LENGTHS)
        return gone.groupBy("bucket", "term").agg((-F.count("*")).alias("df"))

    def _write(self, blocks: DataFrame, number: int) -> None:
        write_postings(blocks, f"{self.folder}/segment{number}/postings")
        term_counts(self._segment(number)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/segment{number}/counts")

    def add(self, docs: DataFrame) -> None:
        state = self._state()
        number = state["newest"] + 1
        self._write(term_blocks(docs, self.key, self.text, self.drop), number)
        state = state | {"newest": number, "segments": state["segments"] | {number: 0}}
        while True:
            levels = list(state["segments"].values())
            full = next((x for x in sorted(set(levels)) if levels.count(x) >= self.FANOUT), None)
            if full is None:
                break
            old = [n for n, level in state["segments"].items() if level == full]
            number = state["newest"] + 1
            whole = self._joined([self._segment(n) for n in sorted(old)]).drop("segment")
            self._write(blocks_again(self._postings(state, old)) if state["marks"] else whole, number)
            state = state | {"newest": number, "segments": {n: x for n, x in state["segments"].items() if n not in old} | {number: full + 1}}
        self._commit(state)

    def delete(self, gone: DataFrame) -> None:
        """Mark the documents of these keys; their postings go with the next merge of their segment."""
        state = self._state()
        gone.select(F.col(self.key).cast("long").alias("gone"), F.lit(state["newest"]).cast("long").alias("upto")).distinct().write.mode("overwrite").parquet(f"{self.folder}/marks{state['marks']}")
        self._commit(state | {"marks": state["marks"] + 1})

    def view(self) -> KeywordIndex:
        """The index as it is now. Counts of terms are added up over segments, less those of marked documents; they are written once a state."""
        state = self._state()
        if not state["segments"]:
            raise LookupError(f"{self.folder}: nothing was added yet")
        numbers = list(state["segments"])
        found = KeywordIndex(self.spark, f"{self.folder}/view{state['number']}")
        found._rows = self._postings(state, numbers)
        if not exists(self.spark, f"{found.folder}/figures/_SUCCESS"):
            counts = self._joined([self.spark.read.schema("term string, df long, bucket int").parquet(f"{self.folder}/segment{n}/counts") for n in numbers])
            if state["marks"]:
                counts = counts.unionByName(self._marked_counts(state, numbers))
            write_figures(found, counts.groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df > 0"))
        return found

    def bm25(self, query: str) -> DataFrame:
        return self.view().bm25(query, self.drop)

    def sweep(self) -> None:
        """Delete folders of segments and views that the state in force has no use for; no reader may be on an older one."""
        state = self._state()
        for n in range(1, state["newest"] + 1):
            if n not in state["segments"]:
                delete(self.spark, f"{self.folder}/segment{n}")
        for n in range(state["number"]):
            delete(self.spark, f"{self.folder}/view{n}")
