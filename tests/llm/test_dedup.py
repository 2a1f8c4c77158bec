"""Line dedup, fingerprints and near duplicates against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fingerprints, line_dedup, near_dedup
from corpusmill.llm.shingles import OnePermutation, shingle_sets
from helpers import SCHEMA, awkward, components, line_dedup as brute_lines, prose, shingles


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


def test_shingle_sets_are_those_of_words():
    texts = [r[1] for r in awkward()] + ["a " * 700_000 + "b", prose(9, 300_000)]
    got = shingle_sets(pa.array(texts, pa.string()))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    assert (got[6] == got[7]).all() and all((np.diff(s.astype(object)) > 0).all() for s in got)


@pytest.mark.parametrize("n", [1, 2, 7, 50, 3000])
def test_samples_agree_as_often_as_sets_are_alike(n):
    rng, op = np.random.default_rng(n), OnePermutation(512)
    a, b = [], []
    for _ in range(60):
        x = rng.integers(0, 2**64, 3 * n, dtype=np.uint64)
        a.append(np.sort(x[: 2 * n]))
        b.append(np.sort(x[n:]))
    same = (op.samples(a)[0] == op.samples(b)[0]).mean()
    assert abs(same - 1 / 3) < 0.12 if n < 10 else abs(same - 1 / 3) < 0.03


def test_line_dedup(docs):
    rows = [(r[0], r[1]) for r in awkward()]
    for batches in (1, 7):
        got = line_dedup.dedup_lines(docs, batches=batches)
        assert got.columns[: len(docs.columns)] == docs.columns
        assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == sorted(brute_lines(rows))


def test_runs_are_compacted_and_counted(spark):
    """Equal keys of several runs meet although no exchange brings them together."""
    from corpusmill.llm.workspace import Workspace

    runs = line_dedup.LineRuns(spark, Workspace(spark, "runs").folder("r"), 3, fanout=2)
    for i in range(5):
        runs.add(spark.createDataFrame([(1, 1), (2, i)], "k1 long, k2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert [tuple(r)[:2] for r in runs.frequent().collect()] == [(1, 1)]
    many = line_dedup.LineRuns(spark, Workspace(spark, "runs").folder("r"), 100, fanout=3)
    for i in range(7):
        many.add(spark.range(i * 500, i * 500 + 2000).select((F.col("id") % 2500).alias("k1"), F.col("id").alias("k2")))
    counts = many.merged(many.runs()).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in counts} == {1: 1000, 2: 1000, 3: 1000, 4: 2000}


def test_runs_meet_without_exchange_or_sort(spark):
    from corpusmill.llm.workspace import Workspace

    runs = line_dedup.LineRuns(spark, Workspace(spark, "runs").folder("r"), 2, fanout=3)
    for i in range(2):
        runs.add(spark.createDataFrame([(1, 1), (1, 1), (2, i)], "k1 long, k2 long"))
    with line_dedup._sorted_scans(spark):
        for df in (runs.merged(runs.runs()), runs.unsettled(spark.table(runs.runs()[0]))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Sort " not in plan and "Bucketed: true" in plan


def test_line_dedup_against_a_kept_store(spark):
    from corpusmill.llm.workspace import Workspace

    store, before = Workspace(spark, "store").folder("lines"), {t.name for t in spark.catalog.listTables()}
    crawl = lambda low, high: spark.createDataFrame([(i, f"own {i}\nshared") for i in range(low, high)], "doc_id long, text string")
    first = line_dedup.dedup_lines(crawl(0, 6), batches=2, store=store)
    assert first.agg(F.sum("n_dropped")).first()[0] == 0
    second = line_dedup.dedup_lines(crawl(6, 10), batches=2, store=store)
    assert {r["kept_text"] for r in second.collect()} == {f"own {i}" for i in range(6, 10)}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_lines_of_repeated_ids_hot_lines_and_clashing_columns(spark):
    """Rows of one id are one document, rows without an id are documents of their own; a line in all rows goes."""
    rows = [(1, "twelve rows\nx")] * 12 + [(i, "nine\neverywhere") for i in range(2, 11)] + [(None, f"ten {i}\neverywhere\nnulls") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit("mine"), "kept_text": F.lit(1), "r1": F.lit(2), "hashes": F.lit(3), "h1": F.lit(4)})
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "r1", "hashes", "h1", "kept_text", "n_lines", "n_dropped"]
    got = sorted({r["kept_text"] for r in out.select("kept_text").collect()})
    assert got == sorted(["twelve rows\nx", "nine", *(f"ten {i}" for i in range(10))])


def test_near_components(docs):
    rows = {r[0]: r[1] for r in awkward()}
    want = components(rows)
    got = near_dedup.near_components(docs, num=85).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(shingles(rows[r["doc_id"]])), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_chain_and_group_at_the_threshold(spark):
    """Members edited to lie on both sides of the threshold; links within and across stars."""
    rng = np.random.default_rng(3)
    words = prose(4, 150).split()
    texts = {}
    for i in range(120):
        w = list(words)
        for j in rng.choice(len(w), size=int(rng.integers(1, 9)), replace=False):
            w[j] = f"e{i}_{j}"
        texts[i] = " ".join(w)
    got = near_dedup.near_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), num=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(texts)


def test_rows_of_one_id_are_one_vertex(spark):
    a, b, c = prose(21, 80), prose(22, 80), prose(23, 80)
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (9, None), (9, c), (4, "")]
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True), (9, 8, False), (9, 9, True)]


def test_one_lead_in_very_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_PAIRS", 7)
    words = prose(31, 120).split()
    texts = {i: " ".join([*words[:100], f"t{i}", *words[100:]]) for i in range(90)}
    got = near_dedup.near_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(texts, 80)


@pytest.mark.parametrize("least, n", [(0.85, 1500), (0.80, 1500)])
def test_no_pair_at_the_threshold_is_missed(least, n):
    """Pairs of 7 to 2,000 shingles just above the threshold share a band and pass the sketch."""
    rng = np.random.default_rng(int(least * 100))
    rows, bands, margin = near_dedup.banding(least)
    sampler, sketch = OnePermutation(near_dedup.SAMPLES), near_dedup.OddSketch(near_dedup.SAMPLES)
    apart, within = near_dedup.SAMPLES // (rows * bands), sketch.most_differing(least - margin)
    for at in range(0, n, 100):
        sets = []
        for _ in range(100):
            size = int(np.exp(rng.uniform(np.log(7), np.log(2000))))
            own = max(0, int((size * (1 - least) / (1 + least))))  # of ``size`` shingles each side has so many of its own
            x = rng.integers(0, 2**64, size + own, dtype=np.uint64)
            sets += [np.unique(x[:size]), np.unique(x[own:])]
        samples, _ = sampler.samples(sets)
        banded = samples[:, : apart * rows * bands : apart].reshape(len(sets), bands, rows)
        assert (banded[::2] == banded[1::2]).all(axis=2).any(axis=1).all()
        odd = sketch.fold(samples)
        assert (np.bitwise_count(odd[::2] ^ odd[1::2]).sum(axis=1) <= within).all()


def test_null_ids(spark):
    df = spark.createDataFrame([(None, prose(1, 60)), (3, prose(1, 60)), (None, prose(2, 60))], "doc_id long, text string")
    assert sorted(((r["component_id"], r["kept"]) for r in near_dedup.near_components(df).collect()), key=str) == [(3, False), (3, True), (None, True)]


def test_edited_fingerprints(docs):
    rows = sorted(((r[0], r[1] or "") for r in awkward()))
    got = sorted(fingerprints.edited_fingerprints(docs, partitions=4).collect(), key=lambda r: (r["doc_id"], r["edited_sha256"]))
    want = []
    for i, (d, t) in enumerate(rows):
        h, following = len(t) // 2, rows[(i + 1) % len(rows)][1]
        want.append((d, len(t), hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()))
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == sorted(want, key=lambda w: (w[0], w[2]))
    by = {}
    for r in got:
        by.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by.values())
    texts = dict(rows)
    like = lambda a, b: 1.0 if not (a or b) else len(a & b) / len(a | b)
    for i, (d, t) in enumerate(rows):
        h, following = len(t) // 2, rows[(i + 1) % len(rows)][1]
        want = like(shingles(t), shingles(t[: len(t) - h] + following[:h]))
        sha = hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()
        for r in got:
            if (r["doc_id"], r["edited_sha256"]) == (d, sha):
                assert abs(r["near_edited"] - want) < 0.1
    assert texts


def test_rows_without_a_key_or_of_one_key_are_dealt_out(spark):
    texts = [prose(50 + i, 30) for i in range(60)]
    df = spark.createDataFrame([(None if i % 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("fingerprint", F.lit("old"))
    dealt = fingerprints.consecutive(df, "doc_id", "text", 6)
    assert dealt.filter("NOT extra").groupBy("p").count().agg(F.max("count")).first()[0] < 30
    got = fingerprints.edited_fingerprints(df, partitions=6).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in got) == sorted((bool(i % 2), len(t)) for i, t in enumerate(texts))
    assert "old" not in {r["fingerprint"] for r in fingerprints.fingerprint_texts(df).collect()}


def test_likeness_is_near_jaccard():
    f = fingerprints.Fingerprinter()
    base = prose(5, 400).split()
    for n in (0, 20, 100, 399):
        other = " ".join(base[: 400 - n] + [f"z{i}" for i in range(n)])
        a, b = shingles(" ".join(base)), shingles(other)
        x, y = f.pack(*f.codes(pa.array([" ".join(base), other])))
        assert abs(f.likeness(x, y) - len(a & b) / len(a | b)) < 0.08
    assert f.likeness("", "") == 1.0 and f.likeness("", x) == 0.0


def test_fingerprint_column_keeps_rows(docs):
    out = fingerprints.fingerprint_texts(docs)
    assert out.columns == [*docs.columns, "fingerprint"] and out.filter("fingerprint IS NULL").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup_lines(none).count() == 0
    assert near_dedup.near_components(none).count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f", None, None, None, None, None, None, None)], SCHEMA)
    assert fingerprints.edited_fingerprints(one).first()["near_next"] == 1.0
    assert F  # used by plans
