"""The store by key: what is rewritten, and what rows come out."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources.keyed import KeyedStore
from corpusmill.workspace import Workspace


@pytest.fixture()
def store(spark):
    ws = Workspace(spark, "keyed-test")
    rows = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("kind"), F.col("id"), F.concat(F.lit("v"), "id").alias("v"), F.lit("old").alias("note"))
    yield KeyedStore.create(rows, ws.folder("store"), ["kind", "id"], buckets=64)
    ws.close()


def files(store):
    found = store.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{store.folder}/rows").select("path").collect()
    out = {}
    for r in found:
        out.setdefault(int(r["path"].split("_bucket=")[1].split("/")[0]), set()).add(r["path"])
    return out


def touched(before, after):
    return {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)}


def some(spark, ids, v="new", note=None):
    return spark.createDataFrame([(str(i % 3), i, v, note) for i in ids], "kind string, id long, v string, note string")


def test_changes_rewrite_their_buckets_only(spark, store):
    def buckets_of(ids):
        return {r[0] for r in some(spark, ids).select(F.pmod(F.xxhash64("kind", "id"), F.lit(64)).cast("int")).collect()}

    ten = [5, 77, 1234, 4000, 9999, 10_001, 12_345, 15_000, 19_000, 19_999]
    start = files(store)
    assert len(start) == 64
    assert set(store.delete(some(spark, ten).select("kind", "id"))) == buckets_of(ten) == touched(start, files(store))
    assert store.rows().count() == 19_990 and store.lookup(some(spark, ten)).count() == 0
    held = files(store)
    assert store.delete(some(spark, ten)) == [] and not touched(held, files(store))
    back = [*ten[:5], 50_000]
    assert set(store.upsert(some(spark, back))) == buckets_of(back) == touched(held, files(store))
    held = files(store)
    assert store.upsert(some(spark, back)) == [] and not touched(held, files(store))
    assert {(r["id"], r["v"]) for r in store.lookup(some(spark, back)).collect()} == {(i, "new") for i in back}
    assert store.rows().count() == 19_996


def test_partial_and_preserved_columns(spark, store):
    store.update(some(spark, [6, 60_000], "changed", "fresh"), ["v"])
    store.upsert(some(spark, [9], "changed", "fresh"), preserved=["note"])
    got = {r["id"]: (r["v"], r["note"]) for r in store.lookup(some(spark, [6, 9, 60_000])).collect()}
    assert got == {6: ("changed", "old"), 9: ("changed", "old"), 60_000: ("changed", "fresh")}


def test_odd_rows(spark):
    ws = Workspace(spark, "keyed-odd")
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), (None, 3, "y"), ("b", 1, "z")], "k string, n long, v string")
    store = KeyedStore.create(rows, ws.folder("s"), ["k"], order="n", buckets=4)
    assert {tuple(r) for r in store.rows().collect()} == {("a", 2, "x"), ("b", 1, "z")}
    store.delete(spark.createDataFrame([("a",), ("b",), (None,)], "k string"))
    assert store.rows().count() == 0 and store.upsert(rows.limit(0)) == []
    store.upsert(rows, order="n")
    assert {tuple(r) for r in store.rows().collect()} == {("a", 2, "x"), ("b", 1, "z")}
    again = KeyedStore(spark, ws.folder("s"))
    assert again.key == ["k"] and again.rows().count() == 2


def moved(spark):
    """Bytes shuffled and written so far, by the stages that Spark still knows."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in stages), sum(s.outputBytes() for s in stages)


def test_a_change_moves_rows_once(spark):
    ws = Workspace(spark, "keyed-moved")
    rows = spark.range(0, 4000, 1, 4).select("id", F.concat(*(F.sha2(F.concat(F.lit(str(i)), F.col("id").cast("string")), 512) for i in range(8))).alias("v"))
    size = 4000 * 8 * 64  # bytes of the digits, two in a byte
    for step in ("create", "upsert", "delete"):
        before = moved(spark)
        if step == "create":
            store = KeyedStore.create(rows, ws.folder("s"), ["id"], buckets=4)
        elif step == "upsert":
            store.upsert(rows.filter("id < 40").withColumn("v", F.reverse("v")))
        else:
            store.delete(rows.filter("id >= 3960"))
        shuffled, written = (b - a for a, b in zip(before, moved(spark)))
        assert shuffled < 2.4 * size and written < 1.4 * size, step  # zstd packs digits, lz4 doesn't
    assert store.rows().count() == 3960
    ws.close()
