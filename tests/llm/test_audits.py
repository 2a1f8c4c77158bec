"""Toxicity, whitening and divergence."""

import decimal
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from corpusmill.llm import divergence, toxicity, whitening
from helpers import SCHEMA, awkward

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


# --- toxicity


@pytest.mark.parametrize(
    "text, words",
    [
        ("You Idiot", ["you", "idiot"]),
        ("уou аrе іdiоt", ["you", "are", "idiot"]),
        ("ＩＤＩＯＴ id​iot", ["idiot", "idiot"]),
        ("m0r0n $tup1d tr@sh", ["moron", "stupid", "stupld", "trash"]),
        ("c1own", ["ciown", "clown"]),
        ("WITH!! A 2024 3 réeux", ["with", "a", "réeux"]),
        ("", []),
    ],
)
def test_folding(text, words):
    assert toxicity.folded(text) == words


def brute_hits(words, weights, exceptions):
    """Longest entry at every word outside exception phrases, by trying all entries at all words."""
    out, shielded = [], set()
    for p in exceptions:
        q = p.split()
        for i in range(len(words) - len(q) + 1):
            if words[i : i + len(q)] == q:
                shielded |= set(range(i, i + len(q)))
    for i, w in enumerate(words):
        fits = [e for e in weights if (w == e[:-1] if e.endswith(" ") else w.startswith(e))]
        if fits and i not in shielded:
            out.append(max(fits, key=len))
    return out


def test_hits_against_brute_force():
    rng = random.Random(3)
    syllables = ["ab", "ba", "bab", "a", "cab"]
    weights = {"ab": 1.0, "aba": 2.0, "abab ": 3.0, "cab ": 0.5, "b": 0.25}
    lexicon = toxicity.Lexicon(weights, ["cab ab", "bab cab"])
    automaton = lexicon.automaton()
    for _ in range(300):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 12))]
        assert [e for _, e, _ in toxicity.hits(words, automaton)] == brute_hits(words, weights, lexicon.exceptions)


def labelled_corpus(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "ne", "ru", "ta"], k=3))
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 200))]
        toxic = i % 3 == 0
        for _ in range(max(2, len(words) // 20) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vermin", "grubling", "grubster"])
        if i % 9 == 1:
            words[3:5] = ["vermin", "control"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_learns_entries_starts_and_exceptions(spark):
    docs, labels = labelled_corpus(spark)
    lexicon = toxicity.learn(docs, labels, exceptions=())
    assert lexicon.weights.get("grubling ", 0) > 0 and "vermin control" in lexicon.exceptions
    marked = toxicity.toxicity(docs, lexicon).join(labels, "doc_id").filter("held_out").collect()
    assert len(marked) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in marked)
    right = [r["predicted"] == r["toxic"] for r in marked]
    assert sum(right) >= 0.97 * len(right)
    planted = spark.createDataFrame([(1, "a grub1ing and a grubst3r " + "ka lo mi " * 10), (2, "vermin control " + "kalomi neruta " * 10)], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(planted, lexicon).collect()} == {1: 1, 2: 0}


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled_corpus(spark)
    other = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, other)


def test_toxicity_is_found_on_held_out_rows(spark):
    """On the tables of sf0.1: finds toxic rows and leaves clean ones alone. (4 % of rows without a sign are labelled toxic.)"""
    sf = SF.replace("sf0.001", "sf0.1")
    rows = toxicity.op11_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert above > 0.93 and sum(b >= 0.5 for b in bad) >= 0.85 * len(bad) and sum(g >= 0.5 for g in good) <= 0.005 * len(good)


def test_toxicity_of_awkward_rows(spark, docs):
    lexicon = toxicity.Lexicon({"same ": 2.0}, ["same words"], [-1.0, 1.0, 1.0, 0.0])
    got = toxicity.toxicity(docs, lexicon).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in awkward())
    assert all(0 < r["score"] < 1 and r["weight"] == 0 for r in got)
    assert len({r["score"] for r in got if r["words"] == 0}) == 1
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    nothing = toxicity.learn(docs, empty, exceptions=())
    assert nothing.weights == {} and {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.5}
    assert toxicity.toxicity(spark.createDataFrame([], SCHEMA), lexicon).count() == 0
    lone = toxicity.toxicity(spark.createDataFrame([(None, "x")], "doc_id long, text string"), lexicon).first()
    assert lone["doc_id"] is None and lone["held_out"]


# --- whitening


def brute_whitening(vectors, most=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(np.float64) / n
    values, u = np.linalg.eigh(centred.T @ centred / n)
    values, u = values[::-1][:most], u[:, ::-1][:, :most]
    return n, [int(((n * r - s) ** 2).sum()) for r in x], centred @ u / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_whitening_against_a_library(spark):
    df = whitening.op12_whitening(spark, SF)
    assert [f"{n} {t}" for n, t in df.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, deviation, w, explained = brute_whitening([r["embedding"] for r in rows])
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = df.collect()
    assert len(got) == 32 * len(rows)
    signs = {}
    for r in sorted(got, key=lambda r: (r["component"], -abs(r["whitened"]))):
        i, k = at[r["vec_id"]], r["component"] - 1
        sign = signs.setdefault(k, math.copysign(1, r["whitened"] * w[i, k]))
        assert abs(r["whitened"] - sign * w[i, k]) < 1e-8 and r["deviation"] == deviation[i] and r["n"] == n
        assert abs(r["explained"] - explained[k]) < 1e-12 and r["identity_error"] < 1e-9


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 33):
        scale = np.logspace(0, -9, n)
        b = rng.standard_normal((n, n)) + 3 * np.eye(n)
        m = (b.T @ b) * np.outer(scale, scale)
        values, u = whitening.jacobi(m)
        assert np.abs(u.T @ u - np.eye(n)).max() < 1e-13 and (np.diff(values) <= 0).all()
        exact = np.linalg.svd(b * scale, compute_uv=False) ** 2 if n < 3 else None
        if exact is not None:
            assert np.allclose(values, exact, rtol=1e-10)
        # residuals relative to each eigenvalue's own scale
        assert np.abs((m @ u - u * values) / np.sqrt(np.outer(np.diag(m), values))).max() < 1e-12


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [0.5, -1.0]), (2, [0.5, -1.0]), (None, [3.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [1.0, -inf]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit("x")).withColumn("whitened", F.lit(1)).repartition(3)
    got = whitening.whitened_vectors(df).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2}
    _, deviation, w, _ = brute_whitening([rows[i][1] for i in range(4)])
    assert {r["deviation"] for r in got if r["vec_id"] == 1} == {deviation[0]}
    assert sorted(abs(r["whitened"]) for r in got) == pytest.approx(sorted(np.abs(w).ravel()), abs=1e-9)
    none = [spark.createDataFrame(r, "vec_id long, embedding array<float>") for r in ([], [(1, [2.0, 2.0])], [(i, [2.0, 2.0]) for i in range(5)])]
    assert [whitening.whitened_vectors(d).count() for d in none] == [0, 0, 0]
    flat = spark.createDataFrame([(i, [float(i), 7.0, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whitening.whitened_vectors(flat).collect()} == {1}  # the others have no variance
    with pytest.raises(ValueError):
        whitening.whitened_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_products_beyond_doubles():
    z = np.array([[2**40, -(2**41)], [3, 2**45]], dtype=np.int64)
    o = z.astype(object)
    assert (whitening._products(z) == o.T @ o).all()


# --- divergence


def brute_divergence(rows, least, top):
    """From (lang, source, text) rows."""
    count, df, total, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        c = Counter(TERM.findall((text or "").translate(LOWER)))
        count[lang, source].update(c)
        total[lang].update(c)
        df[lang].update(c.keys())
    out = []
    unit = 1_000_000_000
    for lang in {g[0] for g in groups}:
        kept = [t for t in df[lang] if df[lang][t] >= least]
        of = lambda c: {t: 1 + unit * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        own, whole = {s: of(count[lang, s]) for ln, s in groups if ln == lang}, of(total[lang])
        f = lambda p, q: (p - q) ** 2 // q
        for s in own:
            pairs = sorted(((-sum(f(own[s][t], own[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-f(own[s][t], whole[t]), t) for t in kept if count[lang, s][t] and own[s][t] > whole[t]), key=lambda x: (x[0], x[1].encode()))[:top]
            out += [(lang, s, part, t, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, t) in enumerate(found, 1)]
    return sorted(out)


def got_divergence(df, **kw):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.divergence(df, **kw).collect())


def test_divergence_of_awkward_rows(spark, docs):
    for least in (1, 3, 1000):
        assert got_divergence(docs, least=least) == brute_divergence([(r[2], r[3], r[1]) for r in awkward()], least, 200)
    assert got_divergence(spark.createDataFrame([], SCHEMA)) == []
    lone = spark.createDataFrame([("en", "a", "x y"), ("en", "b", None), ("de", "a", "")], "lang string, source string, text string")
    assert got_divergence(lone, least=1) == brute_divergence([("en", "a", "x y"), ("en", "b", None), ("de", "a", "")], 1, 200)


def test_divergence_search_is_exact_with_ties(spark, monkeypatch):
    """Small tops, so that bounds leave buckets out and several rounds are needed; ties at the last rank."""
    rng = random.Random(5)
    words = ["é" + "".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(120)]
    rows = [("l", f"s{rng.choice([0, 0, 0, 1, 2, 3])}", " ".join(rng.choices(words[: rng.choice([10, 60, 120])], k=rng.randint(5, 80)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "WIDEN", 2)
    for top in (1, 4, 20):
        assert got_divergence(df, least=2, top=top) == brute_divergence(rows, 2, top)


def test_shares_are_exact_beyond_long_products(spark):
    for n, whole in [(1, 1), (7, 9), (80_000_000_000_001, 89_999_999_999_999), (12_345_678_901, 12_345_678_907)]:
        got = spark.range(1).select(F.expr(divergence.share(f"{n}L", f"{whole}L"))).first()[0]
        assert got == 1 + 1_000_000_000 * n // whole
