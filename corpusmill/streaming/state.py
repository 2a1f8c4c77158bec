"""Stateful streaming operators with bounded state: last evaluations by metric with trends on timers, and alert cooldown.

State lives in the RocksDB store, in the folder of the query's checkpoint: on the cluster's shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are kept, rows that a mean covers, and rows of a trend's two sides.
KEPT, MEAN, RECENT, BEFORE, LEAST = 100, 50, 5, 15, 10
#: Percent of change under which a trend is stable, and below which it is an alert.
STABLE, ALERT = 2.0, -10.0

EVALUATED = "key string, kind string, id long, at long, mean double, recent double, baseline double, change_pct double, trend string, alert boolean"
_COLUMNS = [c.split()[0] for c in EVALUATED.split(", ")]


def rocks(spark: SparkSession) -> None:
    """Stateful processors need this store; queries that run already keep the one of their checkpoint."""
    spark.conf.set(PROVIDER, ROCKS)


def trend_of(values: list[float]) -> dict | None:
    """Mean of the last five values against that of up to fifteen before them; None for fewer than ten."""
    last = values[-(RECENT + BEFORE) :]
    if len(last) < LEAST:
        return None
    new, old = last[-RECENT:], last[:-RECENT]
    a, b = sum(new) / len(new), sum(old) / len(old)
    change = round((a - b) / b * 100 if b > 0 else 0.0, 6)
    verdict = "stable" if abs(change) < STABLE else "improving" if change > 0 else "declining"
    return {"recent": round(a, 6), "baseline": round(b, 6), "change_pct": change, "trend": verdict, "alert": change < ALERT}


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows with None where a column has no value, whatever its type."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in _COLUMNS})


class LastEvaluations(StatefulProcessor):
    """The last values of each key as a list state.

    Each row gives the mean of the key's last values up to it. A timer at every multiple of ``every``
    milliseconds of event time gives the trend of what lies before it; a key without new rows has no timer.
    """

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "at long, id long, value double")

    def _held(self) -> list[tuple[int, int, float]]:
        return [(int(a), int(i), float(v)) for a, i, v in self.values.get()]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        new = sorted((int(a), int(i), float(v)) for batch in rows for a, i, v in zip(batch["at"], batch["id"], batch["value"], strict=True))
        out = []
        for row in new:  # late rows find their place among those held
            held.append(row)
            if len(held) > 1 and held[-2] > row:
                held.sort()
            upto = [v for *_, v in held[: held.index(row) + 1]][-MEAN:]
            out.append({"key": key[0], "kind": "mean", "id": row[1], "at": row[0], "mean": round(sum(upto) / len(upto), 9)})
        self.values.put(held[-KEPT:])
        # micro to milliseconds; the timer after the newest row
        after = (new[-1][0] // 1000 // self.every + 1) * self.every
        if after not in {int(t) for t in self.handle.listTimers()}:
            self.handle.registerTimer(after)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        found = trend_of([v for a, _, v in sorted(self._held()) if a < end * 1000])
        if found:
            yield _frame([{"key": key[0], "kind": "trend", "at": end * 1000, **found}])

    def close(self) -> None:
        pass


def evaluated(events: DataFrame, every: str, late: str, key: str = "user_id", ident: str = "event_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """See ``EVALUATED``: a mean for each row of ``events`` and, at each interval of event time, a trend for each key with new rows.

    Rows without key, time or value say nothing and are left out. Rows behind the watermark are dropped, as everywhere.
    """
    rocks(events.sparkSession)
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col(ident), F.lit(-1)).cast("long").alias("id"), F.col(value).cast("double").alias("value"))
    step = int(pd.Timedelta(every).total_seconds() * 1000)
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(LastEvaluations(step), EVALUATED, "Append", "EventTime")


class Cooldown(StatefulProcessor):
    """The time of a key's last alert that was let through, as a value state that expires ``gap`` seconds after."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.gap * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for t in sorted({int(t) for batch in rows for t in batch["at"]}):
            if last is None or t - last >= self.gap:
                kept.append(t)
                last = t
        if kept:
            self.last.update((last,))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "at": kept})

    def close(self) -> None:
        pass


def cooled_alerts(alerts: DataFrame, gap: int, ts: str = "ts") -> DataFrame:
    """(key, at): alerts at least ``gap`` seconds after the last one let through for their key.

    The only state of a key is the time of that alert, and it goes when ``gap`` seconds have passed since it was
    written: an alert that comes later is let through whatever was before.
    """
    rocks(alerts.sparkSession)
    rows = alerts.select("key", F.unix_seconds(F.col(ts).cast("timestamp")).alias("at")).filter("at IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(Cooldown(gap), "key string, at long", "Append", "ProcessingTime")
