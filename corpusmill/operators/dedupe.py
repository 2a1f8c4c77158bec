"""Exact and fuzzy duplicates and the registry of content hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusmill.workspace import Workspace

PREFIX = 500
#: Hashes that grams are counted by.
LEVELS = 1 << 20
#: Sketches of heads: the length of their grams, and their words of 64 bits.
SHORT, WORDS = 3, 8
#: Heads that are measured against each other in one place, and pairs measured at once.
TILE, AT_ONCE = 128, 2048


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(content_hash, first_id, n) of texts that occur more than once; counts combine before the shuffle."""
    hashed = docs.select(F.col(key).alias("id"), content_hash(F.col(text)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of rows that are the first of their text."""
    return docs.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(F.min(key).alias(key))


def register(hashed: DataFrame) -> DataFrame:
    """Insert-or-touch: rows (content_hash, source, seen) to one row for each hash.

    First sighting and its source stay, the last one moves on.
    """
    return hashed.groupBy("content_hash").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_updated"), F.min_by("source", "seen").alias("source"))


def unseen(docs: DataFrame, registry: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text isn't in the registry."""
    hashed = docs.withColumn("_hash", content_hash(F.col(text)))
    return hashed.join(registry.select(F.col("content_hash").alias("_hash")), "_hash", "left_anti").drop("_hash")


def already_seen(docs: DataFrame, registry: DataFrame, text: str = "text") -> DataFrame:
    hashed = docs.withColumn("_hash", content_hash(F.col(text)))
    return hashed.join(registry.select(F.col("content_hash").alias("_hash")), "_hash", "left_semi").drop("_hash")


def most_edits(length: int, least: float) -> int:
    """The most edits that leave a text of that length, the longer one, with similarity over ``least``."""
    d = int(length * (1 - least)) + 1
    while d > 0 and not (1 - d / length > least or round(1 - d / length, 6) > least):
        d -= 1
    return d


@lru_cache(maxsize=50_000)
def _edits(length: int, least: float) -> int:
    """The most edits between a text of that length and one that is as long or longer."""
    longer = length
    while longer < PREFIX and longer + 1 - length <= most_edits(longer + 1, least):
        longer += 1
    return most_edits(longer, least)


@lru_cache(maxsize=1000)
def gram_length(least: float, most: int = 12) -> int:
    """The longest grams of which a text of any length has one more, apart from each other, than it has edits; 0 if there are none."""
    return min([most, *(n // (_edits(n, least) + 1) for n in range(1, PREFIX + 1) if _edits(n, least))])


def _grams(head: str, q: int) -> np.ndarray:
    """A hash of the gram at each place."""
    base = 0x9E3779B97F4A7C15
    chars = np.frombuffer(head.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    value = np.zeros(max(0, len(chars) - q + 1), np.uint64)
    for i in range(q):
        value = value * np.uint64(base) + chars[i : i + len(value)]
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(32))


def _apart(starts: list[int], q: int, enough: int) -> bool:
    """Whether so many of the sorted grams don't overlap: it takes as many edits to change them all."""
    at, found = 0, 0
    while found < enough and at < len(starts):
        found += 1
        at = bisect_left(starts, starts[at] + q, at)
    return found >= enough


def _rarest(grams: np.ndarray, levels: np.ndarray, q: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, first place, last place): the rarest grams, so many that ``edits`` edits can't change them all."""
    ranks = (levels[grams & np.uint64(LEVELS - 1)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))
    order = np.argsort(ranks, kind="stable")
    low, high = min(edits, len(order) - 1) + 1, len(order)
    while low < high:
        middle = (low + high) // 2
        if _apart(np.sort(order[:middle]).tolist(), q, edits + 1):
            high = middle
        else:
            low = middle + 1
    ranks = ranks[order]
    take = int(np.searchsorted(ranks, ranks[low - 1], "right"))  # equal grams stay together
    first = np.flatnonzero(np.concatenate([[True], ranks[1:take] != ranks[: take - 1]]))
    last = np.append(first[1:], take) - 1
    return ranks[first], order[first], order[last]


def _gram_levels(rows: DataFrame, q: int) -> np.ndarray:
    """How common grams are, as the logarithm of a count by hash over some of the heads. It only decides on the order
    in which grams are taken, and any order finds all pairs."""
    parts = max(1, rows.count() // 30_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = [np.unique(_grams(head, q)) for head in batch["head"].slice(at, 1024).to_pylist()]
                total += np.bincount((np.concatenate(found) & np.uint64(LEVELS - 1)).astype(np.int64), minlength=LEVELS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    some = rows.filter(F.pmod(F.xxhash64("head"), F.lit(parts)) == 0).select("head").mapInArrow(count, "place long, n long")
    counts = some.groupBy("place").agg(F.sum("n").alias("n")).filter("n > 3").toArrow()  # at most ``LEVELS`` rows
    levels = np.zeros(LEVELS, np.uint8)
    levels[counts["place"].to_numpy()] = np.log2(counts["n"].to_numpy()).astype(np.uint8)
    return levels


def _sketch(head: str) -> np.ndarray:
    """Of each bit whether an odd number of short grams falls on it. An edit takes as many grams as they are long and
    puts as many in their place, so it changes twice as many bits at most."""
    places = (_grams(head, SHORT) % np.uint64(64 * WORDS)).astype(np.int64)
    odd = np.bincount(places, minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _before(grams: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the gram that comes before by place, and of how far off it is; 0 if there is none or one of both has several places."""
    order = np.argsort(low, kind="stable")
    once = (low == high)[order]
    off = np.diff(low[order]).astype(np.uint64)
    value = (grams[order][:-1] ^ (off * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(len(order), np.uint64)
    out[order[1:]] = np.where(once[1:] & once[:-1], value ^ (value >> np.uint64(31)), 0)
    return out


def _blocks(rows: DataFrame, least: float) -> DataFrame:
    """(id, block, before, low, high, n, edits, s0, s1, ...): each head's rarest grams with the one before and their first
    and last places, its length, the edits between it and a shorter one at most, and its sketch."""
    q = gram_length(least)
    levels = rows.sparkSession.sparkContext.broadcast(_gram_levels(rows, q)) if q else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * len(names)]
                for key, head in zip(batch["id"].to_pylist(), batch["head"].to_pylist()):
                    edits = _edits(len(head), least)
                    if edits:  # else no different text is that near
                        # with edits of half a text and more there is nothing that has to stay: all pairs are candidates
                        value, low, high = _rarest(_grams(head, q), levels.value, q, edits) if q else (np.zeros(1, np.uint64), np.zeros(1), np.full(1, PREFIX))
                        same = [len(head), most_edits(len(head), least), *_sketch(head)]
                        out.append((np.full(len(value), key), value.view(np.int64), _before(value, low, high).view(np.int64), low, high, *(np.full(len(value), x) for x in same)))
                columns = [np.concatenate(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)).cast(t) for c, t in zip(columns, types)], names=names)

    sketch = [f"s{i}" for i in range(WORDS)]
    names = ["id", "block", "before", "low", "high", "n", "edits", *sketch]
    types = [*[pa.int64()] * 3, *[pa.int16()] * 4, *[pa.int64()] * WORDS]
    schema = ", ".join(["id long, block long, before long, low short, high short, n short, edits short", *(f"{s} long" for s in sketch)])
    return rows.select(F.col("id").cast("long").alias("id"), "head").mapInArrow(cut, schema)


def _candidates(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) of heads that have one of their rarest grams in common at a like place and don't differ by too much in
    their sketches. Both are asked inside the join, so other pairs make no rows. Where the gram before is the same, as far
    off, in both heads, it makes the pair already."""
    edits = most_edits(PREFIX, least)
    blocks = _blocks(rows, least)
    x, y = blocks.alias("x"), blocks.alias("y")
    near = (F.col("x.low") - edits <= F.col("y.high")) & (F.col("y.low") - edits <= F.col("x.high")) & (F.abs(F.col("x.n") - F.col("y.n")) <= edits)
    apart = reduce(add, (F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(WORDS)))
    like = apart <= 2 * SHORT * F.greatest("x.edits", "y.edits")
    first = (F.col("x.before") != F.col("y.before")) | (F.col("x.before") == 0)
    pairs = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id")) & first & near & like)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _tiles(pairs: DataFrame) -> DataFrame:
    """(place, a, b): pairs of like heads are measured in one place, which gets each head once and not once for each pair.

    A head goes with the smallest one that it is a candidate with, up to about ``TILE`` heads together; a place has
    the pairs between two such tiles. Where hashes of tiles are equal, a place has more of them.
    """
    lead = pairs.select(F.explode(F.array(F.struct(F.col("b").alias("id"), F.col("a").alias("lead")), F.struct(F.col("a").alias("id"), F.col("a").alias("lead")))).alias("l"))
    lead = lead.select("l.*").groupBy("id").agg(F.min("lead").alias("lead"))
    parts = lead.groupBy("lead").agg(F.ceil(F.count("*") / TILE).alias("parts"))
    tile = lead.join(parts, "lead").select("id", F.xxhash64("lead", F.pmod(F.xxhash64("id"), "parts")).alias("tile"))
    of = pairs.join(tile.select(F.col("id").alias("a"), F.col("tile").alias("ta")), "a").join(tile.select(F.col("id").alias("b"), F.col("tile").alias("tb")), "b")
    return of.select(F.xxhash64(F.least("ta", "tb"), F.greatest("ta", "tb")).alias("place"), "a", "b")


def _distances(xs: list[str], ys: list[str], edits: int) -> np.ndarray:
    """Edit distances of pairs, ``edits`` + 1 for all above: by the diagonals where i + j is the same, of all pairs at once."""
    lengths = np.array([[len(t) for t in xs], [len(t) for t in ys]])
    longest, n, none = int(lengths.max(initial=0)), len(xs), edits + 1
    codes = [[np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in side] for side in (xs, ys)]
    small = all(c.max(initial=0) < 0xFFF0 for side in codes for c in side)
    kind, ends = (np.uint16, (0xFFFE, 0xFFFF)) if small else (np.uint32, (0xFFFFFFFE, 0xFFFFFFFF))
    left, right = (np.full((n, longest + 1), e, kind) for e in ends)
    for at, (x, y) in enumerate(zip(*codes)):
        left[at, longest - len(x) : longest] = x[::-1]  # place longest - i has character i of x, from 1 on
        right[at, 1 : len(y) + 1] = y
    left, right = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    row = np.full((2 * edits + 3, n), none, np.uint8 if edits < 250 else np.uint16)  # by j - i, with an edge on both sides
    row[none] = 0
    out, who, last = np.full(n, none), np.arange(n), lengths.sum(0)
    at_end = none + lengths[1] - lengths[0]
    inside = np.abs(lengths[1] - lengths[0]) <= edits
    ended = set(last[inside].tolist())
    for s in range(2 * longest + 1):
        if s:
            low = max(-edits, -s, s - 2 * longest)
            low += (low + s) % 2
            high = min(edits, s, 2 * longest - s)
            high -= (high + s) % 2
            if low <= high:
                i, j, many = (s - low) // 2, (s + low) // 2, (high - low) // 2 + 1
                cells = row[none + low : none + high + 1 : 2]
                sides = np.minimum(row[edits + low : edits + high + 1 : 2], row[edits + 2 + low : edits + 3 + high : 2])
                sides += 1
                cells += left[longest - i : longest - i + many] != right[j : j + many]
                np.minimum(cells, sides, out=cells)
                np.minimum(cells, none, out=cells)
        if s in ended:
            done = np.flatnonzero((last == s) & inside)
            out[who[done]] = row[at_end[done], done]
        if s % 64 == 63:
            going = (row.min(0) <= edits) & (last > s)
            if not going.any():
                break
            if going.mean() < 0.7:
                left, right, row = left[:, going], right[:, going], row[:, going]
                who, last, at_end, inside = who[going], last[going], at_end[going], inside[going]
    return out


def _measured(pairs: DataFrame, rows: DataFrame, edits: int) -> DataFrame:
    """(a, b, edits, longest) of the pairs with at most so many edits."""
    heads = pairs.select("place", F.explode(F.array("a", "b")).alias("id")).distinct().join(rows, "id")
    both = heads.select("place", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "head").unionByName(pairs.select("place", "a", "b", F.lit(None).cast("string").alias("head")))

    def some(todo: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
        a, b, x, y = zip(*todo)
        found = _distances(list(x), list(y), edits)
        keep = np.flatnonzero(found <= edits)
        longest = [max(len(x[i]), len(y[i])) for i in keep]
        return pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64()), pa.array(found[keep], pa.int32()), pa.array(longest, pa.int32())], names=["a", "b", "edits", "longest"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, todo = None, {}, []
        for batch in batches:
            for p, a, b, head in zip(*(batch[c].to_pylist() for c in ("place", "a", "b", "head"))):
                if p != place:
                    place, held = p, {}
                if b is None:  # a place's heads come first
                    held[a] = head
                    continue
                todo.append((a, b, held[a], held[b]))
                if len(todo) == AT_ONCE:
                    yield some(todo)
                    todo = []
        if todo:
            yield some(todo)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a pair costs much more than its bytes
    return both.repartition(parts, "place").sortWithinPartitions("place", F.col("b").asc_nulls_first()).mapInArrow(measure, "a long, b long, edits int, longest int")


def head_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, first_id): every row with a text and the smallest id with the same first 500 characters.

    ``fuzzy_pairs`` links first ids, so a pair holds for all members of both classes.
    """
    rows = docs.select(F.col(key).alias("id"), F.substring(text, 1, PREFIX).alias("head")).filter("length(head) > 0 AND id IS NOT NULL")
    first = rows.groupBy("head").agg(F.min("id").alias("first_id"))
    return rows.join(first, "head").select("id", "first_id")


def fuzzy_pairs(docs: DataFrame, least: float = 0.95, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, ratio) of different prefixes of 500 characters with edit similarity over ``least``.

    The measure is on these heads, not on whole texts. Equal heads are one row with the smallest id,
    so copies don't multiply. Grams are put in one order for all heads, rare ones first, and of each head so many
    are taken that the edits allowed can't change them all: of two heads that near, the one whose last
    gram comes first has a gram left that the other one took too. So no pair is lost, and a passage that very many heads
    share makes no candidates where they have enough beside it. Candidates are sifted by sketches and confirmed on the full heads.
    """
    rows = docs.select(F.col(key).alias("id"), F.substring(text, 1, PREFIX).alias("head")).groupBy("head").agg(F.min("id").alias("id")).filter("length(head) > 0 AND id IS NOT NULL")
    ws = Workspace(docs.sparkSession, "fuzzy-pairs")
    rows = ws.save(rows.select(F.col("id").cast("long").alias("id"), "head"), "heads")
    pairs = ws.save(_tiles(ws.save(_candidates(rows, least), "candidates")), "pairs")
    ws.drop("candidates")
    found = _measured(pairs, rows, most_edits(PREFIX, least))
    return found.select("a", "b", F.round(1 - F.col("edits") / F.col("longest"), 6).alias("ratio")).filter(F.col("ratio") > least)


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
