"""Ordered computations: running and sliding means, trends, cooldowns, histories, time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def running(rows: DataFrame, by: str, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Mean of all rows so far in the group."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.round(F.avg(value).over(w), 9))


def sliding(rows: DataFrame, by: str, order: list[Column | str], value: Column, n: int, out: str) -> DataFrame:
    """Mean of the last n rows."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(-n + 1, 0)
    return rows.withColumn(out, F.round(F.avg(value).over(w), 9))


def trend(rows: DataFrame, by: str, order: list[Column], value: str) -> DataFrame:
    """Per group with at least ten rows: mean of the last 5 against that of up to 15 before, and the verdict."""
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_n <= 20")
    means = last.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.when(F.col("_n") <= 5, F.col(value))).alias("a"), F.avg(F.when(F.col("_n") > 5, F.col(value))).alias("b")).filter("n >= 10")
    change = F.round(F.when(F.col("b") > 0, (F.col("a") - F.col("b")) / F.col("b") * 100).otherwise(0.0), 6)
    out = means.select(by, F.round("a", 6).alias("recent"), F.round("b", 6).alias("baseline"), change.alias("change_pct"))
    verdict = F.when(F.abs("change_pct") < 2, "stable").when(F.col("change_pct") > 0, "improving").otherwise("declining")
    return out.select("*", verdict.alias("trend"), (F.col("change_pct") < -10).alias("alert"))


def cooldown(alerts: DataFrame, by: str, seconds: Column, gap: int) -> DataFrame:
    """(by, second): alerts kept when none was kept in the ``gap`` seconds before: a greedy fold in time order.

    After a quiet time of ``gap`` the next alert is kept whatever was before, so such runs are folded one by
    one and a key's runs go to many tasks. Rows of a run stream through in order; its only state is the last
    time kept.
    """
    times = alerts.select(F.col(by).alias("_by"), seconds.cast("long").alias("second")).distinct()
    kind = alerts.schema[by].dataType.simpleString()
    before = F.lag("second").over(Window.partitionBy("_by").orderBy("second"))
    runs = times.withColumn("_new", (before.isNull() | (F.col("second") - before >= gap)).cast("long"))
    runs = runs.withColumn("_run", F.sum("_new").over(Window.partitionBy("_by").orderBy("second")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            kept = []
            for i, (key, run, t) in enumerate(zip(*(batch[c].to_pylist() for c in ("_by", "_run", "second")), strict=True)):
                if held != (key, run) or last is None or t - last >= gap:
                    held, last = (key, run), t
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(kept, pa.int64())) for c in ("_by", "second")], names=["_by", "second"])

    dealt = runs.select("_by", "_run", "second").repartition("_by", "_run").sortWithinPartitions("_by", "_run", "second")
    return dealt.mapInArrow(fold, f"_by {kind}, second long").select(F.col("_by").alias(by), "second")


def tumbling(events: DataFrame, width: str, by: str = "event_type", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding_window(events: DataFrame, width: str, step: str, by: str = "event_type", ts: str = "ts") -> DataFrame:
    return events.groupBy(F.window(ts, width, step).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """(by, start, n): runs of events with less than ``gap`` between neighbours."""
    return events.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def history(rows: DataFrame, by: str, what: str, order: str, n: int) -> DataFrame:
    """Per group the n last distinct entries, newest first."""
    newest = rows.groupBy(by, what).agg(F.max(order).alias(order))
    return newest.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), what))).filter(F.col("rank") <= n)


def previous_turns(turns: DataFrame, n: int = 3, most: int = 200) -> DataFrame:
    """Each turn with the last n turns before it as context, each cut at ``most`` characters."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.substring("text", 1, most))
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(line).over(w), "\n").alias("context"))
