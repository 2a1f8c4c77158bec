"""Word shingles of whole texts as 64-bit hashes, and samples drawn from them by one permutation.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased. A shingle is five consecutive
words; a text with one to four words has its whole word sequence as its only shingle; a text without
words has none. Hashes are computed on whole byte buffers with numpy: a word's hash comes from
differences of one running sum, so nothing loops over characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes hashed at once; a longer text is cut at white space into blocks of about this size.
BLOCK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, dtype=_U), np.ones(1, dtype=_U))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(seed * 2 + 1)) | _U(1)


_PLACE = _odd_constants(WORDS, 77)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK)
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, pow(_BASE, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 4 * BLOCK:
            return tables
        _powers = tables
    return _powers


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts ``data[bounds[i]:bounds[i+1]]``, and words per text."""
    n = len(data)
    if n == 0:
        return np.empty(0, dtype=_U), np.zeros(len(bounds) - 1, dtype=np.int64)
    up, down = _power_tables(n)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after)
    terms = (_LOWER[data].astype(_U) + _U(1)) * up[:n]
    running = np.cumsum(terms, dtype=_U)
    hashes = (running[ends] - running[starts] + terms[starts]) * down[starts]
    counts = np.diff(np.searchsorted(starts, bounds))
    return mix(hashes + _U(0x51ED2701)), counts


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, block by block; blocks end at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + BLOCK, len(data))
        parts.append(_word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=_U)


def _shingles(words: np.ndarray) -> np.ndarray:
    if len(words) >= WORDS:
        total = words[: len(words) - WORDS + 1] * _PLACE[0]
        for j in range(1, WORDS):
            total += words[j : len(words) - WORDS + 1 + j] * _PLACE[j]
        return mix(total)
    if len(words):
        return mix((words * _PLACE[: len(words)]).sum(dtype=_U, keepdims=True) + _U(len(words)))
    return words


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8), bounds


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order (uint64)."""
    if len(texts) == 0:
        return []
    data, bounds = _buffers(texts)
    out: list[np.ndarray] = []
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, side="right")) - 1)
        if j == i + 1 and bounds[j] - bounds[i] > BLOCK:
            out.append(np.unique(_shingles(_long_text(data[bounds[i] : bounds[j]]))))
        else:
            hashes, counts = _word_hashes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            at = 0
            whole = _shingles(hashes) if len(hashes) >= WORDS else None
            for c in counts.tolist():
                if c >= WORDS:
                    s = np.sort(whole[at : at + c - WORDS + 1])
                    keep = np.empty(len(s), dtype=bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    out.append(s if keep.all() else s[keep])
                else:
                    out.append(_shingles(hashes[at : at + c]))
                at += c
        i = j
    return out


class OnePermutation:
    """One-permutation MinHash with optimal densification.

    The hash range is cut into ``k`` bins; a set's sample in a bin is its smallest hash there. A bin
    without any takes the sample of the filled bin that comes first in its own fixed pseudo-random
    order of bins (the same order for every set), so that bins of two sets agree with probability
    equal to their Jaccard similarity. Sets without elements have no samples.
    """

    #: Bins of the order that are tried one by one; sets that fill few bins then compare all they fill.
    TRIES = 64

    def __init__(self, k: int):
        self.k = k
        bins = np.arange(k, dtype=_U)
        self._order = [((mix(bins * _U(0xD1342543DE82EF95) + _U((t + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)) >> _U(32)) * _U(k) >> _U(32)).astype(np.int64) for t in range(self.TRIES)]

    def _later(self, empty: np.ndarray, full: np.ndarray) -> np.ndarray:
        """For each empty bin the filled one that comes first in the rest of its order."""
        keys = mix((empty.astype(_U)[:, None] * _U(self.k) + full.astype(_U)) ^ _U(0x5851F42D4C957F2D))
        return full[np.argmin(keys, axis=1)]

    def samples(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Samples of each set as rows of a (len(sets), k) matrix, and which sets are not empty."""
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        out = np.zeros((len(sets), self.k), dtype=_U)
        filled = np.zeros((len(sets), self.k), dtype=bool)
        some = sizes > 0
        if not some.any():
            return out, some
        row = np.repeat(np.arange(len(sets)), sizes)
        hashes = np.concatenate(sets)
        bins = ((hashes >> _U(32)) * _U(self.k) >> _U(32)).astype(np.int64)
        place = row * self.k + bins
        first = np.empty(len(place), dtype=bool)
        first[0] = True
        np.not_equal(place[1:], place[:-1], out=first[1:])
        out.ravel()[place[first]] = hashes[first]
        filled.ravel()[place[first]] = True
        rows, cols = np.nonzero(~filled & some[:, None])
        for order in self._order:
            source = order[cols]
            hit = filled[rows, source]
            out[rows[hit], cols[hit]] = out[rows[hit], source[hit]]
            rows, cols = rows[~hit], cols[~hit]
            if not len(rows):
                break
        for r in np.unique(rows):
            empty = cols[rows == r]
            out[r, empty] = out[r, self._later(empty, np.flatnonzero(filled[r]))]
        return out, some
