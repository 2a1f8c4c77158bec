"""A table kept by key: changes rewrite the buckets of the keys that change, and nothing else.

Rows lie in a folder for each bucket, a hash of the key. A change reads the buckets that it touches, deals their rows and
the new ones by bucket, writes them once beside the table, and moves the folders that differ in place. Buckets whose rows would stay as
they are aren't touched: a change made twice rewrites nothing the second time, which also makes a
failed one safe to repeat.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusmill import workspace

#: Buckets of a new table; more keys than a task can hold in a bucket need more of them.
BUCKETS = 256


class KeyedStore:
    """A table of one row for each key. Rows with a null in the key aren't kept."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        head = json.loads(spark.read.text(f"{self.folder}/head").first()[0])
        self.key, self.buckets, self.schema = head["key"], head["buckets"], head["schema"]

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: Sequence[str], order: str | None = None, buckets: int = BUCKETS) -> KeyedStore:
        """Write ``rows``; of those of one key the one that is last by ``order`` (any other columns, without it)."""
        head = json.dumps({"key": list(key), "buckets": buckets, "schema": rows.schema.json()})
        rows.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/head")
        found = cls(rows.sparkSession, folder)
        found._put(found._merged(rows, lambda c, had, old, new: new, order), "rows")
        return found

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _names(self) -> list[str]:
        return [f["name"] for f in json.loads(self.schema)["fields"]]

    def _merged(self, new: DataFrame, value: Callable[[str, Column, Column, Column], Column], order: str | None = None, old: DataFrame | None = None, kept: str = "true") -> DataFrame:
        """One row for each key of ``old`` and ``new``, with its bucket: rows are dealt by bucket once and lie as they are written.

        ``value`` has a column's value, from its name, whether the key has an old row, the old value and the one of the new
        row that is last by ``order`` (any other columns, without it). ``kept`` is a condition on ``_old`` and ``_new``, null where a key has no such row.
        """
        others = [c for c in self._names() if c not in self.key]
        by = F.struct(*([F.col(order).alias("_order")] if order else []), *others, F.lit(True).alias("_known"))
        same = F.struct(*others, F.lit(True).alias("_known"))
        known = " AND ".join(f"`{k}` IS NOT NULL" for k in self.key)
        rows = new.select(*self._names()).filter(known).select(*self.key, F.lit(None).cast(old.select(same.alias("s")).schema["s"].dataType if old else "boolean").alias("_old"), by.alias("_new"))
        if old:
            rows = old.select(*self.key, same.alias("_old"), F.lit(None).cast(rows.schema["_new"].dataType).alias("_new")).unionByName(rows)
        dealt = rows.withColumn("_bucket", self._bucket()).repartition("_bucket")
        found = dealt.groupBy("_bucket", *self.key).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new")).filter(kept)
        had = F.col("_old").isNotNull()
        return found.select("_bucket", *(F.col(c) if c in self.key else value(c, had, F.col(f"_old.{c}") if old else F.lit(None), F.col(f"_new.{c}")).alias(c) for c in self._names()))

    def _put(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.folder}/{folder}")

    def _all(self, folder: str = "rows") -> DataFrame:
        schema = StructType.fromJson(json.loads(self.schema)).add(StructField("_bucket", IntegerType()))
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{folder}")

    def rows(self) -> DataFrame:
        return self._all().drop("_bucket")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys``: the join reads only the folders of their buckets."""
        asked = keys.select(*self.key).distinct().withColumn("_bucket", self._bucket())
        return self._all().join(asked, ["_bucket", *self.key], "left_semi").drop("_bucket")

    def _changed(self, new: DataFrame, value: Callable[[str, Column, Column, Column], Column], order: str | None = None, kept: str = "true") -> list[int]:
        """Merge ``new`` into the buckets of its keys; the buckets that it rewrote."""
        touched = [r[0] for r in new.select(*self.key).dropna().select(self._bucket().alias("b")).distinct().collect()]  # at most as many as buckets
        if not touched:
            return []
        old, staged = self._all().filter(F.col("_bucket").isin(touched)), f"changed-{uuid.uuid4().hex}"
        try:
            self._put(self._merged(new, value, order, old, kept), staged)
            digest = lambda d: d.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.struct(c) for c in self._names())).cast("decimal(38,0)")).alias("h"))
            was, now = digest(old).select(F.col("_bucket").alias("_was"), F.col("n").alias("m"), F.col("h").alias("g")), digest(self._all(staged))
            both = was.join(now, F.col("_was") == F.col("_bucket"), "full_outer").filter("NOT (n <=> m AND h <=> g)")
            found = {r["b"]: r["empty"] for r in both.select(F.coalesce("_bucket", "_was").alias("b"), F.col("n").isNull().alias("empty")).collect()}
            for b, empty in found.items():
                workspace.delete(self.spark, f"{self.folder}/rows/_bucket={b}")
                if not empty:
                    workspace.move(self.spark, f"{self.folder}/{staged}/_bucket={b}", f"{self.folder}/rows/_bucket={b}")
        finally:
            workspace.delete(self.spark, f"{self.folder}/{staged}")
        self.spark.catalog.refreshByPath(f"{self.folder}/rows")
        return sorted(found)

    def upsert(self, new: DataFrame, preserved: Sequence[str] = (), order: str | None = None) -> list[int]:
        """Replace rows of known keys (but for ``preserved`` columns) and add others; the buckets rewritten."""
        fresh = F.col("_new").isNotNull()
        return self._changed(new, lambda c, had, old, new: F.when(fresh & ~(had if c in preserved else F.lit(False)), new).otherwise(old), order)

    def update(self, new: DataFrame, updated: Sequence[str], order: str | None = None) -> list[int]:
        """Change only ``updated`` columns of known keys, and add others whole; the buckets rewritten."""
        return self._changed(new, lambda c, had, old, new: F.coalesce(new, old) if c in updated else F.when(had, old).otherwise(new), order)

    def delete(self, gone: DataFrame) -> list[int]:
        """Drop the rows of these keys; the buckets rewritten."""
        others = [f for f in json.loads(self.schema)["fields"] if f["name"] not in self.key]
        types = StructType.fromJson({"type": "struct", "fields": others})
        keys = gone.select(*self.key, *(F.lit(None).cast(f.dataType).alias(f.name) for f in types))
        return self._changed(keys, lambda c, had, old, new: old, kept="_new IS NULL")
