"""Near-duplicate documents: banded MinHash candidates, odd-sketch screening, exact confirmation.

Plan, for ``n`` documents:

1. one pass over the texts gives each document its set size, a 128-bit digest of its shingle set,
   ``BANDS`` band hashes and an odd sketch; documents with equal sets are collapsed by digest;
2. in every band bucket with two or more sets, each set is paired with the bucket's smallest id (a
   star, so a bucket of m sets makes m - 1 pairs); pairs that the sketches leave possible are
   confirmed on full sets, and confirmed links give first components;
3. only buckets that still hold several components are looked at again: their sets outside the
   bucket's largest component meet the bucket's other sets of like size, sketches are compared inside
   the join, and what is left is confirmed on full sets as well. After that every pair that shares a band is
   either inside one component or was tested.

Two sets at similarity s share no band with probability ``(1 - s**8) ** 48``: 2e-7 at 0.85. Lower
thresholds take shorter bands and more of them, so that no more is missed there (see ``banding``).
The sketch only rejects pairs estimated ``MARGIN`` below the threshold: five standard deviations of
the estimate (0.012 at 0.85 with these sizes, measured on sets of 7 to 400 shingles), and more below
0.85, where the estimate spreads further.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .components import components
from .shingles import OnePermutation, mix, shingle_sets
from .workspace import Workspace, table

ROWS = 8
BANDS = 48
MOST_BANDS = 64
MISSED = 3e-7
SAMPLES = 1536
SKETCH_WORDS = 32
MARGIN = 0.06
#: Pairs of one lead that are confirmed together.
PART_PAIRS = 2000
_U = np.uint64


class OddSketch:
    """Parity bitmap of ``64 * words`` bits over k samples; each sample flips the bit it hashes to.

    Samples that two sets share cancel in the XOR of their sketches, so its population count tells
    how many differ: ``J = 1 + m / (4 k) * ln(1 - 2 d / m)`` for m bits and d differing ones.
    """

    def __init__(self, k: int, words: int = SKETCH_WORDS):
        self.k, self.words, self.m = k, words, 64 * words
        self._salt = mix(np.arange(k, dtype=_U) + _U(0xC0FFEE))

    def fold(self, samples: np.ndarray) -> np.ndarray:
        """(n, words) uint64 parity bitmaps of (n, k) samples."""
        n = len(samples)
        bit = (mix(samples ^ self._salt) % _U(self.m)).astype(np.int64)
        odd = np.bincount((bit + np.arange(n)[:, None] * self.m).ravel(), minlength=n * self.m).reshape(n, self.m) & 1
        return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<u8")

    def most_differing(self, least_similarity: float) -> int:
        """The largest number of differing bits that an estimate of ``least_similarity`` allows."""
        return int(np.floor(self.m / 2 * (1 - np.exp(4 * self.k * (least_similarity - 1) / self.m))))


def banding(least: float) -> tuple[int, int, float]:
    """(rows, bands, margin) for a threshold.

    The longest bands with which at most ``MOST_BANDS`` leave a pair at the threshold without a shared
    one with probability ``MISSED``; the margin grows with the estimate's spread.
    """
    if least >= 1:
        return ROWS, BANDS, MARGIN
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-(least**rows)))
        if bands <= MOST_BANDS:
            return rows, max(bands, BANDS), MARGIN * max(1.0, (1 - least) / (1 - 0.85))
    raise ValueError(f"no banding for similarity {least}")


def _longs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, rows: int = ROWS, bands: int = BANDS, k: int = SAMPLES, words: int = SKETCH_WORDS) -> DataFrame:
    """(id, n_shingles, d1, d2, bands, odd) of every row; null and empty texts have n_shingles 0.

    All ``k`` samples are folded into the sketch; every ``k // (rows * bands)``-th goes into a band.
    """
    apart = k // (rows * bands)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, sketch = OnePermutation(k), OddSketch(k, words)
        place = mix(np.arange(rows, dtype=_U) + _U(11)) | _U(1)
        band = mix(np.arange(bands, dtype=_U) + _U(1 << 20))
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                sets = shingle_sets(batch["text"])
                samples, some = sampler.samples(sets)
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
                keys = mix((samples[:, : apart * rows * bands : apart].reshape(-1, bands, rows) * place).sum(axis=2, dtype=_U) + band)
                odd = sketch.fold(samples)
                spread = lambda x, w: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w), pa.array(_longs(x).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), spread(keys, bands), spread(odd, words)],
                    names=["id", "n_shingles", "d1", "d2", "bands", "odd"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(sign, "id long, n_shingles long, d1 long, d2 long, bands array<long>, odd array<long>")


def _full_sets(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = shingle_sets(batch["text"])
                ends = np.cumsum([0, *(len(s) for s in found)]).astype(np.int32)
                values = np.concatenate(found) if found else np.empty(0, _U)
                yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(_longs(values)))], names=["id", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.join(wanted, "id", "left_semi").mapInArrow(sets, "id long, shingles array<long>")


def _differing(x: str, y: str, words: int) -> Column:
    total = F.lit(0)
    for i in range(words):
        total = total + F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))))
    return total


def _linked_sets(signed: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(a, b): representatives of the sets of rows that share an id; None where no id has two rows."""
    again = signed.filter("id IS NOT NULL AND n_shingles > 0").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if again.isEmpty():
        return None
    sets = signed.filter("n_shingles > 0").join(again, "id", "left_semi").select("id", "d1", "d2").distinct().join(reps.select("d1", "d2", "rep"), ["d1", "d2"])
    lead = sets.groupBy("id").agg(F.min("rep").alias("a"))
    return sets.join(lead, "id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100, ws: Workspace | None = None) -> DataFrame:
    """Components of documents linked by ``den * |A & B| >= num * |A | B|`` on their shingle sets.

    Returns doc_id, n_shingles, component_id, kept. Documents without words link with nothing and
    are kept. Rows with words that share a doc_id form one vertex, whatever their texts; a null doc_id
    has a component only through an equal set that has one, and is kept otherwise. Extra columns are ignored.
    An empty table gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "near")
    sketch = OddSketch(SAMPLES, SKETCH_WORDS)
    rows, bands, margin = banding(num / den)
    within = sketch.most_differing(num / den - margin)
    signed = ws.save(signatures(docs, key, text, rows, bands), "signed")
    some = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    reps = some.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd"))
    reps = ws.save(reps, "reps")

    buckets = reps.select(F.posexplode("bands").alias("band", "bucket"), "rep")
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").select("bucket", "lead")
    members = ws.save(buckets.join(shared, "bucket"), "members")
    wanted = ws.save(members.select(F.col("rep").alias("id")).distinct(), "wanted")
    sets = ws.save(_full_sets(docs, key, text, wanted).dropDuplicates(["id", "shingles"]), "sets")
    sketches = ws.save(reps.select("rep", "n", "odd", "bands").join(wanted, reps["rep"] == wanted["id"], "left_semi"), "sketches")

    def side(letter: str, *more: str) -> DataFrame:
        return sketches.select(F.col("rep").alias(letter), F.col("n").alias(f"n{letter}"), F.col("odd").alias(f"o{letter}"), *(F.col(m).alias(f"{m}_{letter}") for m in more))

    possible = (_differing("oa", "ob", SKETCH_WORDS) <= within) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose full sets are alike enough. ``a`` may be in very many: its pairs are dealt into parts.

        The set of ``b`` travels with the pair, that of ``a`` once to each part, and no set is shuffled after that.
        """
        pairs = ws.save(pairs, f"{name}-pairs")
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_PAIRS).alias("parts"))
        dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
        left = dealt.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        copies = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")).join(parts, "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "sa")
        common = F.size(F.array_intersect("sa", "sb"))
        both = left.join(copies, ["a", "part"]).filter(den * common >= num * (F.size("sa") + F.size("sb") - common)).select("a", "b")
        return ws.save(both.distinct(), name)

    star = members.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    star = star.join(side("a"), "a").join(side("b"), "b").filter(possible).select("a", "b").distinct()
    links = confirmed(star, "links")
    same_id = _linked_sets(signed, reps)
    labels = components(links if same_id is None else links.unionByName(same_id), ws, "first")

    placed = members.join(labels, members["rep"] == labels["v"], "left").select("band", "bucket", "rep", F.coalesce("component", "rep").alias("c"))
    placed = ws.save(placed, "placed")
    counted = placed.groupBy("bucket", "c").count()
    split = counted.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max_by("c", F.struct("count", "c")).alias("main")).filter("low < high").select("bucket", "main")
    mixed = ws.save(placed.join(split, "bucket"), "mixed")
    # sets that are alike enough lie in the same or neighbouring cells of a logarithmic scale of sizes
    cell = lambda n: F.floor(F.ln(F.col(n)) / -math.log(num / den)).cast("int") if num < den else F.col(n).cast("int")
    few = mixed.filter("c <> main").select("band", "bucket", F.col("rep").alias("a"), F.col("c").alias("ca")).join(side("a", "bands"), "a")
    few = few.withColumn("cell", F.explode(F.array(cell("na") - 1, cell("na"), cell("na") + 1)))
    all_ = mixed.select(F.col("bucket").alias("bucket_b"), F.col("rep").alias("b"), F.col("c").alias("cb")).join(side("b", "bands"), "b").withColumn("cell_b", cell("nb"))
    # a pair that shares several bands is reported in the first of them only
    first_shared = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), F.lit(True)) == F.col("band") + 1
    cross = few.join(all_, (few["bucket"] == all_["bucket_b"]) & (F.col("cell") == F.col("cell_b")) & (F.col("ca") != F.col("cb")) & possible & first_shared)
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = confirmed(cross, "more")
    joined = more.join(labels.select(F.col("v").alias("a"), F.col("component").alias("ca")), "a", "left").join(labels.select(F.col("v").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), ws, "second")

    final = reps.select("d1", "d2", "rep").join(labels, F.col("rep") == F.col("v"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("c"))
    final = ws.save(final.join(merged, F.col("c") == F.col("v"), "left").select("d1", "d2", F.coalesce("component", "c").alias("component_id")), "final")
    out = signed.select("id", "n_shingles", "d1", "d2").join(final, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    out = ws.save(out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")), "result")
    ws.drop("signed", "members", "wanted", "sketches", "sets", "links", "links-pairs", "placed", "mixed", "more", "more-pairs", "reps", "final", "first-labels", "second-labels")
    return out


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), num=85)
