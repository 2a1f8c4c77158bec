"""Byte-level BPE by a segment tree over byte positions, and decoding.

Each pair of neighbouring parts has the rank of their joined bytes. The tree's leaves are the pairs,
by the position of their left part, and each node keeps its subtree's least (rank, position), so the
root is the leftmost pair of minimum rank. A merge sets at most three leaves, in logarithmic time each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .pretokens import PieceCache, in_blocks, split_flat
from .workspace import table


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    size = 1
    while size < n - 1:
        size *= 2
    none = 1 << 62
    shift = n.bit_length()
    get = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    after = list(range(1, n + 1))  # where the part that begins at i ends, which is where the next begins
    before = list(range(-1, n - 1))
    mask = (1 << shift) - 1

    def put(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a < b else b
            if tree[node] == low:
                break
            tree[node] = low
            node >>= 1

    while tree[1] != none:
        i = tree[1] & mask
        j = after[i]
        end = after[j]
        after[i] = end
        if j < n - 1:
            put(j, none)
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            put(i, none if r is None else r << shift | i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = get(piece[h:end])
            put(h, none if r is None else r << shift | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token, blank, rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self._lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self._cache = PieceCache(self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        out = []
        for p in pieces:
            ids = merge_piece(p.encode(), self.ranks)
            out.append((np.array(ids, dtype="<u4").tobytes(), " ".join(map(str, ids)).encode()))
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """For each text its ids, and the same as decimals joined by blanks."""
        for block in in_blocks(texts):
            pieces, counts = split_flat(block)
            values = self._cache.values(pieces)
            at = 0
            for n in counts:
                mine = values[at : at + n]
                at += n
                yield np.frombuffer(b"".join([v[0] for v in mine]), dtype="<u4"), b" ".join([v[1] for v in mine])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self._bytes[np.repeat(self._starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()


@lru_cache(4)
def encoder(path: str) -> ByteBPE:
    """One encoder for each worker process and file."""
    return ByteBPE(path)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts are empty (no ids). Rows are independent: repeated keys, ties and extra columns
    change nothing, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for ids, decimals in bpe.encode([t or "" for t in batch["text"].to_pylist()]):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(decimals).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
