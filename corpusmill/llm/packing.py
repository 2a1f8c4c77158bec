"""Packing of documents into sequences by patterns of few lengths and non-negative least squares.

Only the histogram of piece lengths (at most ``size`` counts) reaches the driver. There, repeat counts of
patterns (a few lengths that fill a sequence, but for a small gap) are fitted by
non-negative least squares, to the histogram and to the least possible gap over all sequences. There are far
more patterns than can be listed, so the best ones around each length are enumerated against the residual,
and those that would lower it are added until none would. Repeats are rounded (down, then up by largest remainder as long as pieces are there) and all kept;
the fit is repeated on what is left, and what no pattern takes is packed best-fit. The plan depends on
``size`` alone in its bound, and is sent to every task; a piece finds its place from its length and its
rank among the pieces of that length, which is counted in two levels (within a task's chunk, then over
chunks), so no length, however common, is ranked in one task.
"""

from __future__ import annotations

import math
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .token_ids import tokenizer
from .workspace import Workspace, table

SIZE = 1024
#: A pattern has up to ``1 + 2 ** DOUBLINGS`` documents: few beside the thousand that short ones could be in a sequence.
DOUBLINGS = 4
#: A pattern leaves at most this share of a sequence free; looser sequences are for the residuals.
FREE = 1 / 64
#: Weight of the gap, in sequences, beside the histogram.
GAP_WEIGHT = 5.0
#: Patterns that would change the fit by less than this share of a length's mean count aren't added.
TRACE = 0.05
#: Share of the pieces that is left to best fit, and the least share of those left that another fit must have taken.
LEFT, GAIN = 0.05, 0.1
END = 2


def best_patterns(value: np.ndarray, size: int, doublings: int = DOUBLINGS) -> tuple[np.ndarray, np.ndarray]:
    """For each length with a value, the pattern around it with the largest total value.

    ``value[l]`` is a length's value, -inf for lengths that aren't there. A pattern has that length and up
    to ``2 ** doublings`` more. Returns (n, 1 + 2 ** doublings) lengths, 0 for none, and the totals.
    ``best[s]`` is the largest total of so many lengths in s tokens: of twice as many, it is the best split of s.
    """
    lengths = np.flatnonzero(np.isfinite(value))
    single = np.zeros(size + 1, dtype=np.int64)
    best, top = np.zeros(size + 1), 0
    worth = np.where(np.isfinite(value), value, -np.inf)
    for s in range(1, size + 1):
        if worth[s] > 0 and (not top or worth[s] > worth[top]):
            top = s
        single[s] = top
        best[s] = worth[top] if top else 0.0
    room = np.arange(size + 1)[:, None] - np.arange(size + 1)[None, :]
    inside, splits = np.maximum(room, 0), []
    for _ in range(doublings):
        total = np.where(room >= 0, best[None, :] + best[inside], -np.inf)
        splits.append(np.argmax(total, axis=1))
        best = total[np.arange(size + 1), splits[-1]]
    spaces = (size - lengths)[:, None]
    for split in reversed(splits):
        spaces = np.concatenate([split[spaces], spaces - split[spaces]], axis=1)
    return np.concatenate([lengths[:, None], single[spaces]], axis=1), value[lengths] + best[size - lengths]


class NonNegative:
    """Non-negative least squares over a growing list of patterns, by the active set method of Lawson and Hanson.

    Minimises ``|A x - b|^2``: a column of A counts a pattern's lengths and has its gap, as a share of a
    sequence times ``GAP_WEIGHT``, in the last place; b has the histogram and the least possible gap. The inverse of the Gram matrix of the positive columns is kept up to date, so a
    column comes or goes in the square of their number. Columns that depend on positive ones stay out.
    """

    def __init__(self, counts: np.ndarray, size: int):
        self.lengths, self.size = np.flatnonzero(counts), size
        self.row = np.zeros(len(counts), dtype=np.int64)
        self.row[self.lengths] = np.arange(len(self.lengths))
        gap = -int((counts * np.arange(len(counts))).sum()) % size / size
        self.wanted = np.append(counts[self.lengths].astype(float), GAP_WEIGHT * gap)
        self.patterns: list[tuple[int, ...]] = []
        self.columns = np.zeros((0, len(self.wanted)))
        self.on: list[int] = []
        self.x = np.zeros(0)
        self._inverse = np.zeros((0, 0))
        self._spare = np.zeros((0, 0))
        self._held = np.zeros((0, len(self.wanted)))  # the positive columns, in their order

    def add(self, patterns: list[tuple[int, ...]]) -> None:
        rows = np.zeros((len(patterns), len(self.wanted)))
        for i, p in enumerate(patterns):
            np.add.at(rows[i], self.row[list(p)], 1.0)
            rows[i, -1] = GAP_WEIGHT * (self.size - sum(p)) / self.size
        self.patterns += patterns
        self.columns = np.concatenate([self.columns, rows])

    def prune(self) -> None:
        """Keep positive columns only: whoever prices patterns finds the others again when they are worth it."""
        n = len(self.on)
        self.patterns, self.columns, self.on = [self.patterns[j] for j in self.on], self._held[:n].copy(), list(range(n))

    def _room(self, n: int) -> None:
        if n > len(self._inverse):
            grown = np.zeros((2 * n, 2 * n))
            old = len(self._inverse)
            grown[:old, :old] = self._inverse
            self._inverse, self._spare = grown, np.empty_like(grown)
            held = np.zeros((2 * n, len(self.wanted)))
            held[:old] = self._held
            self._held = held

    def _change(self, n: int, vector: np.ndarray, by: float) -> None:
        np.multiply(vector[:, None], (vector * by)[None, :], out=self._spare[:n, :n])
        self._inverse[:n, :n] += self._spare[:n, :n]

    def _drop(self, at: int) -> None:
        n, m = len(self.on) - 1, self._inverse
        if at != n:  # the last column takes its place
            m[[at, n], : n + 1] = m[[n, at], : n + 1]
            m[: n + 1, [at, n]] = m[: n + 1, [n, at]]
            self.on[at] = self.on[n]
            self.x[at] = self.x[n]
            self._held[at] = self._held[n]
        self.on.pop()
        self.x = self.x[:n]
        self._change(n, m[:n, n].copy(), -1 / m[n, n])

    def _solved(self) -> np.ndarray:
        n = len(self.on)
        return self._inverse[:n, :n] @ (self._held[:n] @ self.wanted)

    def _rest(self) -> np.ndarray:
        return self.wanted - self.x @ self._held[: len(self.on)]

    def solve(self, trace: float) -> np.ndarray:
        """Turn columns positive, steepest first, until none would lower the squares by more than a trace; the residual."""
        n = len(self.on)
        positive = self._held[:n]
        if n:  # afresh, against rounding errors
            self._inverse[:n, :n] = np.linalg.inv(positive @ positive.T)
            self.x = self._solved()
        while True:
            rest = self._rest()
            slope = self.columns @ rest
            slope[self.on] = -np.inf
            near = np.argsort(-slope, kind="stable")[:200]
            near = near[slope[near] > trace]  # looked at until all are spent, and then all columns again
            before = len(near)
            if not before or not self._turn(near, trace):
                return rest

    def _turn(self, near: np.ndarray, trace: float) -> bool:
        some, open_, columns = False, np.ones(len(near), dtype=bool), self.columns[near]
        while True:
            slope = np.where(open_, columns @ self._rest(), -np.inf)
            i = int(np.argmax(slope))
            if not slope[i] > trace:
                return some
            open_[i] = False
            j, n = int(near[i]), len(self.on)
            shared = self._held[:n] @ self.columns[j]
            u = self._inverse[:n, :n] @ shared
            schur = float(self.columns[j] @ self.columns[j]) - float(shared @ u)
            if schur < 1e-7:
                continue
            some = True
            step = float(slope[i]) / schur
            self._room(n + 1)
            self._change(n, u, 1 / schur)
            self._inverse[:n, n] = self._inverse[n, :n] = -u / schur
            self._inverse[n, n] = 1 / schur
            self._held[n] = self.columns[j]
            aim = np.append(self.x - u * step, step)
            self.x = np.append(self.x, 0.0)
            self.on.append(j)
            while (aim <= 0).any():  # go as far as all stay positive, and leave out one that reaches 0
                low = np.flatnonzero(aim <= 0)
                far = self.x[low] / np.maximum(self.x[low] - aim[low], 1e-300)
                self.x = np.maximum(self.x + min(float(far.min()), 1.0) * (aim - self.x), 0.0)
                self._drop(int(low[np.argmin(far)]))
                aim = self._solved()
            self.x = aim


def fit(counts: np.ndarray, size: int, known: list[tuple[int, ...]]) -> dict[tuple[int, ...], float]:
    """Patterns with positive repeat counts that come nearest to ``counts`` with the least gap.

    ``known`` are patterns of an earlier fit. Each turn solves the squares over the patterns at hand and adds
    the best new one around each length, until none would lower them by more than a trace.
    """
    squares = NonNegative(counts, size)
    lengths = squares.lengths
    trace = TRACE * max(1.0, float(counts.sum()) / max(1, len(lengths)))
    seen = {p for p in known if all(counts[q] for q in p)}
    squares.add(sorted(seen))
    found = math.inf
    while True:
        rest = squares.solve(trace)
        found, before = float(rest @ rest), found
        squares.prune()
        seen = set(squares.patterns)
        gap = GAP_WEIGHT * float(rest[-1])  # what a sequence that is all gap would add to the slope
        value = np.full(size + 1, -np.inf)
        value[lengths] = rest[:-1] - gap * lengths / size
        parts, totals = best_patterns(value, size)
        fresh = {tuple(sorted(q for q in p if q)) for p in parts[(totals + gap > 2 * trace) & (size - parts.sum(axis=1) <= FREE * size)].tolist()} - seen
        if not fresh or found >= before:
            return {squares.patterns[j]: float(v) for j, v in zip(squares.on, squares.x.tolist(), strict=True)}
        squares.add(sorted(fresh))


def best_fit(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on a histogram; equal sequences are held as (lengths, how many)."""
    room: dict[int, list[list]] = {}
    open_rooms: list[int] = []

    def put(parts: list[int], n: int, free: int) -> None:
        if free not in room:
            room[free] = []
            insort(open_rooms, free)
        room[free].append([parts, n])

    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            at = next((r for r in open_rooms if r >= length), None)
            if at is None:
                fill = size // length
                if left >= fill:
                    put([length] * fill, left // fill, size - fill * length)
                    left %= fill
                else:
                    put([length] * left, 1, size - left * length)
                    left = 0
                continue
            group = room[at][-1]
            fill = min(at // length, left)
            n = min(group[1], left // fill)
            group[1] -= n
            parts = group[0]
            if not group[1]:
                room[at].pop()
                if not room[at]:
                    del room[at]
                    open_rooms.remove(at)
            put(parts + [length] * fill, n, at - fill * length)
            left -= n * fill
    return [(parts, n) for groups in room.values() for parts, n in groups]


def plan(counts: np.ndarray, size: int) -> tuple[list[tuple[list[int], int]], int]:
    """(lengths, repeats) of sequences that hold exactly ``counts[length]`` pieces of each length, and how many pieces patterns took.

    All fitted repeats are kept: rounded down, and up in the order of their remainders, down to a half,
    where the pieces are there. What is left is fitted again while that takes a fair part of it, and
    packed best-fit in the end.
    """
    rest = counts.astype(np.int64).copy()
    found = [([size], int(counts[size]))] if counts[size] else []
    rest[size] = 0
    every, taken = int(rest.sum()), 0
    known: list[tuple[int, ...]] = []
    while rest.sum() > LEFT * every:
        fitted = fit(rest, size, known)
        order = sorted(fitted, key=lambda p: (fitted[p] // 1 - fitted[p], p))
        some, left = 0, int(rest.sum())
        for up in (False, True):
            for p in order:
                n = int(fitted[p]) if not up else int(fitted[p] % 1 >= 0.5)
                n = min([n, *(int(rest[q]) // p.count(q) for q in set(p))])
                if n:
                    found.append((list(p), n))
                    some += n * len(p)
                    for q in p:
                        rest[q] -= n
        taken += some
        if some < GAIN * left:
            break
        known = list(fitted)
    return found + best_fit(rest, size), taken


def pieces_of(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first have ``size`` tokens if there is more than one."""
    if total <= size:
        return [(0, total)]
    first = total % size or size
    return [(0, first), *((s, size) for s in range(first, total, size))]


def token_pieces(docs: DataFrame, path: str, key: str, text: str, size: int, end: int) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, chunk and rank in (chunk, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, ranks, chunk = tokenizer(path), np.zeros(size + 1, dtype=np.int64), TaskContext.get().partitionId()
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), ids_of.encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                ids += tail
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, size)):
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), chunk, int(ranks[length])))
                    ranks[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, rank long")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, end: int = END, ws: Workspace | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``size`` tokens.

    Null ids stay null and their documents are packed like others. Null and empty texts are a piece with the end id alone. Repeated rows are packed as often as they
    occur; extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "packing")
    pieces = ws.save(token_pieces(docs, path, key, text, size, end), "pieces")
    found = ws.save(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")), "counts")
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in found.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    lows: list[list[int]] = [[] for _ in range(size + 1)]
    bases: list[list[int]] = [[] for _ in range(size + 1)]
    offsets: list[list[int]] = [[] for _ in range(size + 1)]
    used, sequences = np.zeros(size + 1, dtype=np.int64), 0
    for lengths, n in plan(counts, size)[0]:
        offset = 0
        for length in lengths:
            lows[length].append(int(used[length]))
            bases[length].append(sequences)
            offsets[length].append(offset)
            used[length] += n
            offset += length
        sequences += n
    shared = spark.sparkContext.broadcast([tuple(np.array(x[i], dtype=np.int64) for x in (lows, bases, offsets)) for i in range(size + 1)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["place"].to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, edges) if len(order) else []:
                low, base, at = places[length[rows[0]]]
                i = np.searchsorted(low, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[i] + rank[rows] - low[i], at[i]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # up to ``size`` rows for each task that read documents: too many to send to all tasks
    ahead = found.select(F.col("length").alias("l"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead.hint("merge"), (pieces["length"] == ahead["l"]) & (pieces["chunk"] == ahead["c"])).withColumn("place", F.col("rank") + F.col("ahead"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place").mapInArrow(place, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
