"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a bucketed table of (k1, k2, n), each bucket one file sorted by key: 128-bit hashes of lines
and in how many documents each was found. Keys that reach the threshold inside a run go into a settled
run as well. A new batch of documents is merge-anti-joined with the settled runs (those lines go
whatever follows) and the rest is added as a run of its own. When a level holds ``FANOUT`` runs they
are merged into one run of the next level, counts added. All runs have the same buckets, so joins and
merges between runs need neither an exchange nor a sort, and every key is rewritten once a level.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import Workspace, delete, exists, table

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FANOUT = 4
#: Bytes of input (as Spark estimates them) in a batch, and the batches that smaller inputs are dealt into.
BATCH_BYTES = 256 << 30
LEAST_BATCHES = 5
#: A key with more than this share of the frequent lines' counts is hot: there are at most 1 / share of them.
HOT_SHARE = 1e-4
_RUN = "k1 BIGINT, k2 BIGINT, n BIGINT"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased (other letters as they are)."""
    inner = F.trim(line, F.lit(SPACE))
    return F.when(F.length(inner) == F.octet_length(inner), F.lower(inner)).otherwise(F.translate(inner, UPPER, LOWER))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Let scans of bucketed tables tell the planner that their buckets are sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled runs of line hashes with document counts, in a folder that later calls can open again.

    The list of runs is written as a new version after each change, before replaced runs are deleted, so
    a lost driver leaves the runs of the last version. The number of buckets is fixed when a folder is
    first used. Adding the same documents twice counts them twice.
    """

    def __init__(self, spark: SparkSession, folder: str, threshold: int, fanout: int = FANOUT, buckets: int | None = None, keep: bool = True):
        self.spark, self.folder, self.threshold, self.fanout, self.keep = spark, folder.rstrip("/"), threshold, fanout, keep
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.settled: list[list[str]] = []
        self._version = 0
        if keep and exists(spark, f"{self.folder}/versions"):
            last = spark.read.json(f"{self.folder}/versions", schema="version long, state string").orderBy(F.desc("version")).first()
            state = json.loads(last["state"])
            self._version, self.buckets, self.levels, self.settled = last["version"], state["buckets"], state["levels"], state["settled"]
            for name in self.runs() + self._names(self.settled):
                self._register(name)

    @staticmethod
    def _names(levels: list[list[str]]) -> list[str]:
        return [x for level in levels for x in level]

    def runs(self) -> list[str]:
        return self._names(self.levels)

    def _register(self, name: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_RUN}) USING parquet CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = counts.select("k1", "k2", "n").repartition(self.buckets, "k1", "k2")
        dealt.write.format("parquet").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _commit(self, gone: list[str]) -> None:
        if self.keep:
            self._version += 1
            state = json.dumps({"buckets": self.buckets, "levels": self.levels, "settled": self.settled})
            row = self.spark.createDataFrame([(self._version, state)], "version long, state string")
            row.coalesce(1).write.mode("append").json(f"{self.folder}/versions")
        for name in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self.spark, f"{self.folder}/{name}")

    def _union(self, names: list[str]) -> DataFrame:
        # the filter passes every row and makes the scans row-wise: a union of columnar scans claims its
        # children's buckets (Spark 4.1) but doesn't put equal buckets together
        parts = [self.spark.table(name).filter("n > 0") for name in names]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        return out

    def merged(self, names: list[str]) -> DataFrame:
        """The runs as one, counts of equal keys added: bucket by bucket, without an exchange."""
        return self._union(names).groupBy("k1", "k2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """(k1, k2, n) of lines found in at least ``threshold`` documents so far; n as far as it was counted."""
        if not self.runs():
            return self.spark.createDataFrame([], _RUN)
        return self.merged(self.runs()).filter(F.col("n") >= self.threshold)

    def unsettled(self, counts: DataFrame) -> DataFrame:
        """Rows of ``counts(k1, k2, ...)`` whose keys are in no settled run, by one merge join with each of these."""
        for name in self._names(self.settled):
            counts = counts.join(self.spark.table(name).select("k1", "k2").hint("merge"), ["k1", "k2"], "left_anti")
        return counts

    def _place(self, levels: list[list[str]], name: str, level: int) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(name)

    def add(self, keys: DataFrame, last: bool = False) -> None:
        """Add a batch: ``keys(k1, k2)`` has a row for each document and distinct line of it.

        After the ``last`` batch of runs that are not kept, nothing is settled any more.
        """
        with _sorted_scans(self.spark):
            counts = keys.groupBy("k1", "k2").agg(F.count("*").alias("n"))
            new, level, gone = self._write(self.unsettled(counts)), 0, []
            while True:
                if self.keep or not last:
                    ripe = self.unsettled(self.spark.table(new).filter(F.col("n") >= self.threshold))
                    self._place(self.settled, self._write(ripe), 0)
                self._place(self.levels, new, level)
                if len(self.levels[level]) < self.fanout:
                    break
                names, self.levels[level] = self.levels[level], []
                new, level = self._write(self.merged(names)), level + 1
                gone += names
            at = 0
            while at < len(self.settled) and len(self.settled[at]) >= self.fanout:
                names, self.settled[at] = self.settled[at], []
                self._place(self.settled, self._write(self._union(names)), at + 1)  # no key is settled twice
                gone += names
                at += 1
            self._commit(gone)

    def close(self) -> None:
        """Forget the tables' names, and delete the folder unless it is kept."""
        for name in self.runs() + self._names(self.settled):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not self.keep:
            delete(self.spark, self.folder)


def _lines_by_document(batch: DataFrame, again: DataFrame | None) -> DataFrame:
    """(k1, k2): a row for each document and distinct line; rows of a key in ``again(d)`` are one document."""
    lines = lambda rows, *more: rows.select(*more, F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("h")).select(*more, "h.k1", "h.k2")
    if again is None:
        return lines(batch)
    single = lines(batch.join(again, "d", "left_anti"))
    return single.unionAll(lines(batch.join(again, "d", "left_semi"), "d").distinct().select("k1", "k2"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int | None = None, store: str | None = None, ws: Workspace | None = None) -> DataFrame:
    """Drop every line whose key is found in at least ``min_docs`` documents; other lines stay in order.

    Returns ``docs`` with all its columns and ``kept_text``, ``n_lines`` and ``n_dropped``, which replace
    input columns of these names. Null and empty texts are one empty line. Keys shorter than
    ``min_chars`` code points (blank lines) stay. Rows that share a key value are one document, a row
    with a null key is one of its own. Rows are dealt by document into ``batches``: by default one for
    each ``BATCH_BYTES``, and a few for less; the result is the same for any number. With ``store``, a
    shared folder, the runs stay there and lines of earlier calls count as well (texts returned before
    stay as they are). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "lines")
    if batches is None:
        size = int(str(docs.select(text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        batches = max(LEAST_BATCHES, math.ceil(size / BATCH_BYTES)) if size < 1 << 60 else LEAST_BATCHES  # unknown sizes are huge
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = [F.xxhash64(F.col(key), t).alias("r1"), F.xxhash64(F.lit(1), F.col(key), t).alias("r2")]
    batch_of = F.pmod(F.when(F.col("d").isNull(), F.col("r1")).otherwise(F.xxhash64("d")), F.lit(batches)).cast("int")
    keyed = docs.select(F.col(key).alias("d"), *row, F.transform(F.split(t, "\n"), line_key).alias("keys"))
    hashed = keyed.select("d", "r1", "r2", batch_of.alias("batch"), F.transform("keys", lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(1), k).alias("k2")))).alias("hashes"))
    path = ws.folder("hashes")
    hashed.write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema(hashed.schema).parquet(path)
    again = ws.save(hashed.filter("d IS NOT NULL").groupBy("d").count().filter("count > 1").select("d"), "again")
    again = None if again.isEmpty() else again

    runs = LineRuns(spark, store or ws.folder("runs"), min_docs, keep=store is not None)
    for b in range(batches):
        runs.add(_lines_by_document(hashed.filter(F.col("batch") == b), again), b == batches - 1)
    with _sorted_scans(spark):
        frequent = ws.save(runs.frequent(), "frequent")
    runs.close()

    # hot keys need no partner, so their places are dealt by row and not by key
    least = frequent.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * HOT_SHARE
    hot = frequent.filter(F.col("n") > least).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"))  # at most 1 / HOT_SHARE rows
    places = hashed.select("r1", "r2", F.posexplode("hashes").alias("at", "h")).filter("h IS NOT NULL").select("r1", "r2", "at", "h.k1", "h.k2")
    places = places.join(F.broadcast(hot), (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    is_hot = F.col("h1").isNotNull()
    places = places.select("r1", "r2", "at", is_hot.alias("hot"), F.when(is_hot, F.xxhash64("r1", "at")).otherwise(F.col("k1")).alias("j1"), F.when(is_hot, F.col("r2")).otherwise(F.col("k2")).alias("j2"))
    known = frequent.filter(F.col("n") <= least).select(F.col("k1").alias("f1"), F.col("k2").alias("f2"))
    found = places.join(known, (F.col("j1") == F.col("f1")) & (F.col("j2") == F.col("f2")), "left").filter("hot OR f1 IS NOT NULL")
    hits = ws.save(found.groupBy(F.col("r1").alias("_ld_r1"), F.col("r2").alias("_ld_r2")).agg(F.sort_array(F.collect_set("at")).alias("_ld_gone")), "hits")
    ws.drop("hashes", "again", "frequent")

    mine = ("kept_text", "n_lines", "n_dropped")
    full = docs.select(*(F.col(f"`{c}`").alias(f"_ld_c{i}") for i, c in enumerate(docs.columns)), *(c.alias(f"_ld_{n}") for c, n in zip(row, ("a1", "a2"), strict=True)), t.alias("_ld_text"), F.split(t, "\n").alias("_ld_lines"))
    joined = full.join(hits, (F.col("_ld_a1") == F.col("_ld_r1")) & (F.col("_ld_a2") == F.col("_ld_r2")), "left")
    # the stretches between dropped lines: each line is copied once, however many are dropped
    start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get("_ld_gone", j - 1) + 1)
    end = lambda j: F.coalesce(F.get("_ld_gone", j), F.size("_ld_lines"))
    stretches = F.transform(F.sequence(F.lit(0), F.size("_ld_gone")), lambda j: F.slice("_ld_lines", start(j) + 1, end(j) - start(j)))
    kept = F.when(F.col("_ld_gone").isNull(), F.col("_ld_text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    columns = [F.col(f"_ld_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in mine]
    return joined.select(*columns, kept.alias("kept_text"), F.size("_ld_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, p, l[p] AS line, translate(regexp_replace(regexp_replace(l[p], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM base), unnest(range(1, len(l) + 1)) AS u(p)),
often AS (SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (often.k IS NOT NULL))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (often.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (k) GROUP BY doc_id"""
