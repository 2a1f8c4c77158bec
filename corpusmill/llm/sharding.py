"""Weighted rendezvous hashing of record keys over shards, with gapless places inside each shard.

A key's score in a shard is ``-weight / ln(u)`` for a hash ``u`` of key and shard in (0, 1); it goes
to the shard with the highest score. A new shard can only win keys for itself, and takes its weight's
share of them; nothing moves between other shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .workspace import Workspace, table

SHARDS = 40
#: Rows that one window group is meant to hold at most.
GROUP_ROWS = 100_000


def score(key: Column, shard: Column | int, weight: Column | float) -> Column:
    shard = shard if isinstance(shard, Column) else F.lit(shard)
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    u = (F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -weight / F.ln(u)


def winner(key: Column, weights: Sequence[float]) -> Column:
    """Struct (score, shard) of the shard that holds the key."""
    shards = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0))
    return F.array_max(F.transform(shards, lambda s: F.struct(score(key, s["i"], s["w"]).alias("score"), s["i"].alias("shard"))))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0, ws: Workspace | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``grown_shard`` is where the key lies once a shard of ``grown_weight`` is added. Rows of one key
    share a shard, null keys too. Places (``slot``) are counted in two levels: within groups of a
    shard's rows that are dealt by hash, then over the groups, so no shard is ranked in one task.
    Null texts have size 16; extra columns are ignored; an empty table gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "shards")
    data = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), winner(F.col(key), weights).alias("best"))
    added = score(F.col("doc_id"), len(weights), grown_weight) > F.col("best.score")
    rows = rows.select("doc_id", "size", "text_crc32", F.col("best.shard").cast("int").alias("shard"), F.when(added, len(weights)).otherwise(F.col("best.shard")).cast("int").alias("grown_shard"))
    rows = ws.save(rows, "rows")
    groups = max(8, -(-rows.count() // (len(weights) * GROUP_ROWS)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(groups)).cast("int"))
    counts = ws.save(rows.groupBy("shard", "part").agg(F.count("*").alias("n")), "counts")  # shards times groups rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(F.col("shard").alias("_shard"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.withColumn("place", place).join(ahead, (F.col("shard") == F.col("_shard")) & (F.col("part") == F.col("_part")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("ahead") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
