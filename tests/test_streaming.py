"""Streaming operators on file streams that run to their end."""

import time

from pyspark.sql import functions as F

from conftest import SF
from corpusmill.streaming import ingest as S, state


def run(query):
    query.processAllAvailable()
    query.stop()


def test_incremental_ingest(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    src = f"file://{tmp_path}/src"
    docs.coalesce(1).write.mode("append").parquet(src)
    seen = []

    def go():
        q = S.ingest(S.document_stream(spark, src, docs.schema), f"file://{tmp_path}/state", lambda d, n: seen.append(d.count()), f"file://{tmp_path}/cp")
        q.awaitTermination()

    go()
    docs.coalesce(1).write.mode("append").parquet(src)  # the same again
    go()
    assert seen == [50, 0]


def test_windows_and_cooldown(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = f"file://{tmp_path}/events"
    events.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    run(S.windowed_counts(stream, "1 hour", "0 seconds").writeStream.format("memory").queryName("wins").outputMode("complete").start())
    assert spark.table("wins").agg(F.sum("n")).first()[0] == events.count()
    alerts = stream.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("key"), "ts")
    q = state.cooled_alerts(alerts, 86400).writeStream.format("parquet").option("path", f"{src}-out").option("checkpointLocation", f"{src}-cp").outputMode("append").start()
    from corpusmill.operators import ordered

    want = ordered.cooldown(events.filter("event_type = 'error'"), "user_id", F.unix_seconds("ts"), 86400)
    end = time.time() + 100  # a query with timers on the clock never stops by itself
    while time.time() < end and not sum(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.2)
    q.stop()
    assert spark.read.parquet(f"{src}-out").count() == want.count()


def test_unique_texts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:02")], "text string, t string").withColumn("ts", F.to_timestamp("t"))
    src = f"file://{tmp_path}/docs"
    docs.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(docs.schema).parquet(src)
    run(S.unique_texts(stream, "ts", "1 hour").writeStream.format("memory").queryName("uniq").outputMode("append").start())
    assert spark.table("uniq").count() == 2


def test_cooldown_forgets_keys(spark, tmp_path):
    """State rows fall once the gap has passed, and a key is let through again."""
    src = f"file://{tmp_path}/alerts"
    spark.createDataFrame([], "key string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("key string, ts timestamp").parquet(src)
    q = state.cooled_alerts(stream, 8).writeStream.format("memory").queryName("cooled").outputMode("append").start()

    def put(keys):
        spark.createDataFrame([(k,) for k in keys], "key string").withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(src)

    def until(done):
        end = time.time() + 100
        while time.time() < end and not done():
            time.sleep(0.2)
        return done()

    total = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    put([f"k{i}" for i in range(20)])
    assert until(lambda: max(total(), default=0) >= 20)
    assert until(lambda: total()[-1] == 0)  # without any new alert
    put(["k1", "k1"])
    assert until(lambda: total()[-1] > 0)
    q.stop()
    assert spark.table("cooled").count() == 21


def test_last_evaluations_are_those_of_the_batch(spark, tmp_path):
    """Means of every row and the last trend of every key, over several micro-batches and a restart."""
    from corpusmill.operators import ordered

    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = f"file://{tmp_path}/events", f"file://{tmp_path}/out"
    cuts = events.select(F.expr("percentile(unix_micros(ts), array(0.3, 0.6))")).first()[0]
    at = F.unix_micros("ts")
    parts = [events.filter(at < cuts[0]), events.filter((at >= cuts[0]) & (at < cuts[1])), events.filter(at >= cuts[1])]
    end = spark.createDataFrame([(10**12, -1, "end", 0.0)], "event_id long, user_id long, event_type string, value double").withColumn("ts", F.lit("2100-01-01").cast("timestamp"))

    def go():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = state.evaluated(stream, "1 day", "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for part in [*parts, end.select(*[c for c in events.columns if c in end.columns])]:
        part.coalesce(1).write.mode("append").parquet(src)
        go()
    got = spark.read.parquet(out).filter("key <> '-1'").cache()
    means = {r["id"]: r["mean"] for r in got.filter("kind = 'mean'").collect()}
    want = {r["event_id"]: r["mean"] for r in ordered.sliding(events, "user_id", ["ts", "event_id"], F.col("value"), 50, "mean").collect()}
    assert means.keys() == want.keys() and all(abs(means[k] - want[k]) < 1e-6 for k in want)
    last = got.filter("kind = 'trend'").groupBy("key").agg(F.max_by(F.struct("recent", "baseline", "change_pct", "trend", "alert"), "at").alias("x")).select("key", "x.*")
    got_trends = {r["key"]: r for r in last.collect()}
    batch = {str(r["user_id"]): r for r in ordered.trend(events, "user_id", [F.desc("ts"), F.desc("event_id")], "value").collect()}
    assert got_trends.keys() == batch.keys()
    for k, r in batch.items():
        assert all(abs(got_trends[k][c] - r[c]) < 1e-4 for c in ("recent", "baseline", "change_pct")) and (got_trends[k]["trend"], got_trends[k]["alert"]) == (r["trend"], r["alert"])
