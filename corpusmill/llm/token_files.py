"""Token ids in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, in blocks of 256 ids:

    block    least id u32 | ids u16 | width u8 | exceptions u8 | packed low bits | places u8 each | ids u32 each
    index    documents' keys i64 each, their id counts i64 each, u8 each (1: no key), starts of blocks u64 each
    trailer  documents u64 | ids u64 | blocks u64 | start of the index u64 | "PFORIDS1"

The least id of a block is subtracted, the rest is packed at the width that the 90th percentile needs,
and ids that need more bits are listed as exceptions, with the place and the whole id of each. (An id
is packed as its low bits all the same; the list then replaces it.) Texts are encoded where they are
read, so that ids and not texts are shuffled into key order; files are closed at ``ROLL_IDS`` ids or
``ROLL_DOCS`` documents, which bounds a writer's and a reader's memory, and are read in splits.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .token_ids import tokenizer
from .workspace import Workspace, table

BLOCK = 256
PERCENTILE = 90
#: A file is closed once it has so many ids or documents, and read in splits of about so many ids.
ROLL_IDS = 1 << 26
ROLL_DOCS = 1 << 20
SPLIT_IDS = 1 << 22
MAGIC = b"PFORIDS1"
_HEAD = struct.Struct("<IHBB")
_TRAILER = struct.Struct("<QQQQ8s")


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``ids`` (uint32); the last may be short."""
    n = len(ids)
    if n == 0:
        return []
    count = -(-n // BLOCK)
    grid = np.full(count * BLOCK, ids[-1], dtype=np.uint32)
    grid[:n] = ids
    grid = grid.reshape(count, BLOCK)
    least = grid.min(axis=1)
    above = grid - least[:, None]
    typical = np.partition(above, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    widths = np.zeros(count, dtype=np.int64)
    for bit in range(32):
        widths[typical >> np.uint32(bit) > 0] = bit + 1
    # at 90 % no block has more exceptions than a byte can count
    high = (above.astype(np.uint64) >> widths.astype(np.uint64)[:, None]) > 0
    out: list[bytes] = [b""] * count
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if width:
            low = above[rows] & np.uint32((1 << width) - 1)
            bits = ((low[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        else:
            packed = np.zeros((len(rows), 0), dtype=np.uint8)
        for r, payload in zip(rows.tolist(), packed, strict=True):
            size = min(BLOCK, n - r * BLOCK)
            places = np.flatnonzero(high[r, :size])
            body = payload[: -(-size * width // 8)].tobytes()
            out[r] = _HEAD.pack(int(least[r]), size, width, len(places)) + body + places.astype(np.uint8).tobytes() + grid[r, places].astype("<u4").tobytes()
    return out


def decode_block(data: memoryview | bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at ``at``, and where it ends."""
    least, size, width, exceptions = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    length = -(-size * width // 8)
    ids = np.full(size, least, dtype=np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, length, at), bitorder="little", count=size * width).reshape(size, width)
        padded = np.zeros((size, 32), dtype=np.uint8)
        padded[:, :width] = bits
        ids += np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()
    at += length
    places = np.frombuffer(data, np.uint8, exceptions, at)
    at += exceptions
    ids[places] = np.frombuffer(data, "<u4", exceptions, at)
    return ids, at + 4 * exceptions


@lru_cache(64)
def _lanes(width: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and shift of each id of a full block at a width."""
    at = np.arange(BLOCK) * width
    return at // 8, (at % 8).astype(np.uint64)


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks that begin at ``starts`` in ``data``; full blocks of one width at once."""
    bytes_ = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)
    heads = [_HEAD.unpack_from(data, at) for at in starts.tolist()]
    out = np.zeros((len(heads), BLOCK), dtype="<u4")
    tail: np.ndarray | None = None
    by_width: dict[int, list[int]] = {}
    for i, (_, size, width, _) in enumerate(heads):
        if size == BLOCK:
            by_width.setdefault(width, []).append(i)
        else:
            tail = decode_block(data, int(starts[i]))[0]  # only a file's last block is short
    for width, rows in by_width.items():
        if width:
            first, shift = _lanes(width)
            at = starts[rows][:, None] + _HEAD.size + first[None, :]
            value = bytes_[at].astype(np.uint64)
            for j in range(1, (width + 14) // 8):
                value |= bytes_[at + j].astype(np.uint64) << np.uint64(8 * j)
            out[rows] = (value >> shift & np.uint64((1 << width) - 1)).astype("<u4")
        out[rows] += np.array([heads[i][0] for i in rows], dtype="<u4")[:, None]
        for i in rows:
            n = heads[i][3]
            if n:
                at_ = int(starts[i]) + _HEAD.size + -(-BLOCK * width // 8)
                out[i, np.frombuffer(data, np.uint8, n, at_)] = np.frombuffer(data, "<u4", n, at_ + n)
    flat = out.ravel()
    return flat if tail is None else np.concatenate([flat[: -BLOCK or None], tail])


class TokenFileWriter:
    """Writes beside the path and moves into place at the end, so that a retried task does no harm."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self._draft = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self._out = self.fs.open_output_stream(self._draft)
        self._at, self._starts, self._keys, self._counts = 0, [], [], []
        self._rest = np.empty(0, dtype="<u4")
        self.ids = self.docs = 0

    def _put(self, blocks: list[bytes]) -> None:
        for b in blocks:
            self._starts.append(self._at)
            self._at += len(b)
        self._out.write(b"".join(blocks))

    def add(self, keys: list[int | None], ids_of_each: list[np.ndarray]) -> None:
        self._keys += keys
        self._counts += [len(x) for x in ids_of_each]
        self.docs += len(keys)
        ids = np.concatenate([self._rest, *ids_of_each])
        self.ids += len(ids) - len(self._rest)
        whole = len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK * 256):
            self._put(encode_blocks(ids[at : min(at + BLOCK * 256, whole)]))
        self._rest = ids[whole:].astype("<u4")

    def close(self) -> list[tuple[int, int, int, int]]:
        """Finish the file; its splits, as (first document, documents, first id, ids)."""
        self._put(encode_blocks(self._rest))
        keys = np.array([0 if k is None else k for k in self._keys], "<i8").tobytes() + np.array(self._counts, "<i8").tobytes()
        self._out.write(keys + bytes(k is None for k in self._keys) + np.array(self._starts, "<u8").tobytes())
        self._out.write(_TRAILER.pack(self.docs, self.ids, len(self._starts), self._at, MAGIC))
        self._out.close()
        self.fs.move(self._draft, self.path)
        ends, splits, i = np.cumsum(self._counts), [], 0
        while i < self.docs:
            begin = int(ends[i]) - self._counts[i]
            j = max(i + 1, int(np.searchsorted(ends, begin + SPLIT_IDS, side="right")))
            splits.append((i, j - i, begin, int(ends[j - 1]) - begin))
            i = j
        return splits


class TokenFile:
    """Reads a file by parts; the index gives any id or document without reading what is before it."""

    def __init__(self, uri: str):
        self.fs, path = pafs.FileSystem.from_uri(uri)
        self._in = self.fs.open_input_file(path)
        size = self._in.size()
        self.docs, self.ids, self.blocks, self._index, magic = _TRAILER.unpack(self._in.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")

    def _column(self, before: int, width: int, first: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._in.read_at(width * n, self._index + before + width * first), kind)

    def read(self, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of the file."""
        if low >= high:
            return np.empty(0, dtype="<u4")
        first, last = low // BLOCK, (high - 1) // BLOCK
        starts = self._column(17 * self.docs, 8, first, min(last + 2, self.blocks) - first, "<u8").astype(np.int64)
        end = self._index if last + 1 == self.blocks else int(starts[-1])
        starts = starts[: last + 1 - first]
        data = self._in.read_at(end - int(starts[0]), int(starts[0]))
        return decode_blocks(data, starts - starts[0])[low - first * BLOCK : high - first * BLOCK]

    def documents(self, first: int = 0, docs: int | None = None, start: int = 0, ids_at_once: int = 1 << 18) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
        """Keys and ids of consecutive documents, about so many ids at a time; document ``first`` starts at id ``start``."""
        docs = self.docs - first if docs is None else docs
        keys, counts = self._column(0, 8, first, docs, "<i8").tolist(), self._column(8 * self.docs, 8, first, docs, "<i8")
        absent = self._column(16 * self.docs, 1, first, docs, "u1").tolist()
        ends = start + np.cumsum(counts)
        i = 0
        while i < docs:
            begin = int(ends[i] - counts[i])
            j = max(i + 1, int(np.searchsorted(ends, begin + ids_at_once, side="right")))
            ids = self.read(begin, int(ends[j - 1]))
            yield [None if a else k for k, a in zip(keys[i:j], absent[i:j])], np.split(ids, (ends[i : j - 1] - begin).tolist())
            i = j


def write_token_files(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end: int = 0, partitions: int | None = None) -> DataFrame:
    """Write files in ascending key order; (part, uri, first_doc, docs, first_id, ids, start), a row for each split.

    Texts are encoded in place, each with the ``end`` id, and their ids dealt by ranges of the key and of a
    hash of the text, so rows of one key, or without one, go to many parts. ``start`` counts the ids of the
    part before the split. Null texts are empty, null keys come first, equal keys go by hash. Only one key
    for each part reaches the driver. The result has to be saved: computing it writes the files.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = ["there", "key", "h"]
    rows = docs.select(F.col(key).isNotNull().alias("there"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"), F.xxhash64(t).alias("h"), t.alias("text"))
    firsts = rows.select(*order).repartitionByRange(partitions, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("f")).collect()
    bounds = sorted({tuple(r["f"]) for r in firsts})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path)
        kind, tail = ids_of.kind, np.array([end], dtype=ids_of.kind).tobytes()
        for batch in batches:
            held, at, size = [], 0, 0
            for i, ids in enumerate(ids_of.encode(batch["text"].to_pylist())):
                held.append(np.frombuffer(ids, "<u4").astype(kind).tobytes() + tail)
                size += len(held[-1])
                if size > 1 << 22 or i + 1 == batch.num_rows:
                    there, keys, h = (batch[c].slice(at, len(held)) for c in order)
                    part = [max(bisect_right(bounds, x) - 1, 0) for x in zip(there.to_pylist(), keys.to_pylist(), h.to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), there, keys, h, pa.array(held, pa.binary())], names=["part", *order, "ids"])
                    held, at, size = [], i + 1, 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = tokenizer(path).kind
        writer, turn, start, listed = None, 0, 0, []

        def finished() -> list[tuple]:
            return [(part, writer.uri, first, n, at, ids, start + at) for first, n, at, ids in writer.close()]

        for batch in batches:
            part = batch["part"][0].as_py() if batch.num_rows else None
            keys = [k if t else None for k, t in zip(batch["key"].to_pylist(), batch["there"].to_pylist())]
            held = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for x in batch["ids"]]
            for at in range(0, len(keys), 1024):
                if writer is None:
                    writer = TokenFileWriter(f"{folder}/ids-{part:06d}-{turn:05d}.pfor")
                writer.add(keys[at : at + 1024], held[at : at + 1024])
                if writer.ids >= ROLL_IDS or writer.docs >= ROLL_DOCS:
                    listed += finished()
                    start, turn, writer = start + writer.ids, turn + 1, None
        if writer is not None:
            listed += finished()
        kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in listed], k) for i, k in enumerate(kinds)], names=_LISTING)

    dealt = rows.mapInArrow(encode, "part int, there boolean, key long, h long, ids binary").repartitionById(max(1, len(bounds)), F.col("part"))
    return dealt.sortWithinPartitions(*order, "ids").mapInArrow(write, ", ".join(f"{n} {'string' if n == 'uri' else 'long'}" for n in _LISTING))


_LISTING = ["part", "uri", "first_doc", "docs", "first_id", "ids", "start"]


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the splits that ``write_token_files`` listed."""
    parts = files.groupBy("part").agg(F.sum("ids").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    ahead = parts.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("ahead"))
    listed = files.join(ahead, F.col("part") == F.col("_part")).select("uri", "first_doc", "docs", "first_id", (F.col("start") + F.col("ahead")).alias("start"))
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first, docs, first_id, start in zip(*(batch[c].to_pylist() for c in ("uri", "first_doc", "docs", "first_id", "start")), strict=True):
                for keys, texts in TokenFile(uri).documents(first, docs, first_id):
                    sizes = np.array([len(t) for t in texts], dtype=np.int64)
                    starts = start + np.cumsum(sizes) - sizes
                    start += int(sizes.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(starts), pa.array(sizes), pa.array([zlib.crc32(np.ascontiguousarray(t, dtype="<u4")) for t in texts], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return listed.repartition(spread, "uri", "first_doc").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ws = Workspace(spark, "token-files")
    written = write_token_files(table(spark, sf_dir, "documents"), ws.folder("files"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(ws.save(written, "listing"))
