"""Document fingerprints: one-permutation MinHash kept as packed low-order bits.

``fingerprint_texts`` is the operator on a text column, ``likeness`` compares two fingerprints, and
``consecutive`` deals rows so that every row meets the next one in key order without a global window.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shingles import OnePermutation, mix, shingle_sets
from .workspace import table

BINS = 512
BITS = 4
#: Bytes of text whose shingles are held at once.
CHUNK = 4 << 20


class Fingerprinter:
    """Fingerprints of ``bins`` samples with ``bits`` (1, 2, 4 or 8) low-order bits each, as base64 text.

    The empty set's fingerprint is the empty string: it is like itself (1.0) and like nothing else (0.0).
    """

    def __init__(self, bins: int = BINS, bits: int = BITS):
        if bits not in (1, 2, 4, 8) or bins * bits % 8:
            raise ValueError("bits must be 1, 2, 4 or 8 and fill whole bytes")
        self.bins, self.bits = bins, bits
        self.sampler = OnePermutation(bins)
        # each bin keeps bits of its own hash of the sample: a small set fills many bins with one sample
        self._salt = mix(np.arange(bins, dtype=np.uint64) + np.uint64(0xF1))

    def codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A (n, bins) matrix of low-order bits, and which texts have any shingle."""
        parts, some, at = [], [], 0
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))
        while at < len(texts):
            end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
            samples, filled = self.sampler.samples(shingle_sets(texts.slice(at, end - at)))
            parts.append((mix(samples ^ self._salt) & np.uint64((1 << self.bits) - 1)).astype(np.uint8))
            some.append(filled)
            at = end
        if not parts:
            return np.zeros((0, self.bins), dtype=np.uint8), np.zeros(0, dtype=bool)
        return np.concatenate(parts), np.concatenate(some)

    def pack(self, codes: np.ndarray, some: np.ndarray) -> list[str]:
        each = 8 // self.bits
        lanes = codes.reshape(len(codes), -1, each)
        packed = np.zeros(lanes.shape[:2], dtype=np.uint8)
        for j in range(each):
            packed |= lanes[:, :, j] << np.uint8(j * self.bits)
        return [base64.b64encode(p.tobytes()).decode() if s else "" for p, s in zip(packed, some, strict=True)]

    def unpack(self, fingerprint: str) -> np.ndarray:
        raw = np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8)
        mask = np.uint8((1 << self.bits) - 1)
        return np.stack([raw >> np.uint8(j * self.bits) & mask for j in range(8 // self.bits)], axis=1).ravel()

    def likeness_of_codes(self, a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarity row by row: chance agreement of the kept bits is taken out."""
        chance = 2.0**-self.bits
        match = (a == b).mean(axis=1) if len(a) else np.zeros(0)
        value = np.clip((match - chance) / (1 - chance), 0.0, 1.0)
        return np.where(a_some & b_some, value, np.where(a_some | b_some, 0.0, 1.0))

    def likeness(self, a: str, b: str) -> float:
        if not a or not b:
            return float(a == b)
        yes = np.ones(1, dtype=bool)
        return float(self.likeness_of_codes(self.unpack(a)[None], yes, self.unpack(b)[None], yes)[0])


def fingerprint_texts(docs: DataFrame, text: str = "text", out: str = "fingerprint", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` with a fingerprint column, in place of one of that name; null texts count as empty, other columns are left alone."""

    @F.pandas_udf("string")
    def of(column):
        f = Fingerprinter(bins, bits)
        return column.__class__(f.pack(*f.codes(pa.array(column, type=pa.large_string(), from_pandas=True))))

    return docs.withColumn(out, of(F.col(text).cast("string")))


def consecutive(docs: DataFrame, key: str, text: str, partitions: int) -> DataFrame:
    """Rows (p, extra, there, key, h, text) dealt by ranges of the key, in key order within each partition p.

    Each partition ends with an extra copy of the row that begins the next one (the last with the
    first of all), so a scan of one partition sees every row beside its successor. Only the first
    key of each partition reaches the driver. Null keys come first; rows of one key, or without one, go by
    a hash of the text (``h``) and are dealt over partitions by it as well.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = ["there", "key", "h"]
    keyed = docs.select(F.col(key).isNotNull().alias("there"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.xxhash64(t).alias("h"), t.alias("text"))
    firsts = keyed.select(*order).repartitionByRange(partitions, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("f")).collect()
    bounds = sorted({tuple(r["f"]) for r in firsts})
    n = max(1, len(bounds))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "extra", *order, "text"]
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in order), strict=True))
            p = [max(bisect_right(bounds, r) - 1, 0) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(np.zeros(len(p), bool)), *batch.columns], names=names)
            first = [i for i, r in enumerate(rows) if bounds[p[i]] == r]
            if first:
                again = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([(p[i] - 1) % n for i in first], pa.int32()), pa.array(np.ones(len(first), bool)), *again.columns], names=names)

    dealt = keyed.mapInArrow(deal, "p int, extra boolean, there boolean, key long, h long, text string")
    return dealt.repartitionById(n, F.col("p")).sortWithinPartitions("p", "extra", *order, "text")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", bins: int = BINS, bits: int = BITS, partitions: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text, whose second half comes from the next text's start.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Nulls and empty texts have the empty fingerprint; an only row is its own successor; an empty
    table gives an empty result.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Fingerprinter(bins, bits)
        held = None  # the last row so far, which waits for its successor
        for batch in batches:
            at, sizes = 0, np.asarray(pa.compute.binary_length(batch["text"]))
            while at < batch.num_rows:
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK)))
                rows = batch.slice(at, end - at)
                at = end
                codes, some = f.codes(rows["text"])
                keys, extra, texts = rows["key"].to_pylist(), rows["extra"].to_pylist(), rows["text"].to_pylist()
                absent = [not x for x in rows["there"].to_pylist()]
                if held:
                    keys, extra, texts, absent = held[0] + keys, held[1] + extra, held[2] + texts, held[3] + absent
                    codes, some = np.concatenate([held[4], codes]), np.concatenate([held[5], some])
                held = [keys[-1:], extra[-1:], texts[-1:], absent[-1:], codes[-1:], some[-1:]]
                use = [i for i in range(len(keys) - 1) if not extra[i]]
                if not use:
                    continue
                edited = []
                for i in use:
                    t = texts[i]
                    half = len(t) // 2
                    edited.append(t[: len(t) - half] + texts[i + 1][:half])
                e_codes, e_some = f.codes(pa.array(edited, pa.large_string()))
                u = np.array(use)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if absent[i] else keys[i] for i in use], pa.int64()),
                        pa.array([len(texts[i]) for i in use], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                        pa.array(f.pack(codes[u], some[u])),
                        pa.array(f.pack(e_codes, e_some)),
                        pa.array(f.likeness_of_codes(codes[u], some[u], e_codes, e_some)),
                        pa.array(f.likeness_of_codes(codes[u], some[u], codes[u + 1], some[u + 1])),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return consecutive(docs, key, text, partitions).mapInArrow(compute, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
