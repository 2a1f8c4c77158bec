"""Splitting of texts into the pieces that byte-level BPE merges in, on whole buffers.

Same result as finding all matches of

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

but from the classes of code points with numpy. Also the cache that keeps what was computed for
frequent pieces.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np

#: Code points with the White_Space property (fixed by Unicode).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    index = np.array(points)
    table = np.zeros(0x110000, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            table[index[m.start() : m.end()]] = kind
    table[WHITE_SPACE] = SPACE
    return table


def split_flat(texts: list[str]) -> tuple[list[str], list[int]]:
    """The pieces of all texts in order, and how many each text has."""
    joined = "".join(texts)
    n = len(joined)
    if n == 0:
        return [], [0] * len(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    kind = _classes()[points]
    ends = np.cumsum([len(t) for t in texts])
    begins = np.concatenate([[0], ends[:-1]])
    first = np.zeros(n + 1, dtype=bool)
    first[begins] = True
    first[n] = True
    last = first[1:]
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    solid = kind != SPACE
    # the last white space before anything else stands alone or, if a blank, goes with what follows
    before_solid = np.zeros(n, dtype=bool)
    before_solid[:-1] = ~solid[:-1] & solid[1:] & ~first[1:]
    start |= before_solid
    taken = np.flatnonzero(before_solid & (points == 0x20)) + 1
    start[taken] = False
    for i in np.flatnonzero((points == 0x27) & start & ~last).tolist():
        if kind[i + 1] != LETTER:
            continue
        c = joined[i + 1]
        if c in "stmd":
            size = 2
        elif joined[i + 1 : i + 3] in ("re", "ve", "ll") and not last[i + 1]:
            size = 3
        else:
            continue
        start[i + 1] = False
        if not last[i + size - 1]:
            start[i + size] = True
    at = np.flatnonzero(start)
    counts = np.searchsorted(at, ends) - np.searchsorted(at, begins)
    bounds = at.tolist()
    bounds.append(n)
    return [joined[a:b] for a, b in pairwise(bounds)], counts.tolist()


def split_texts(texts: list[str]) -> list[list[str]]:
    """The pieces of each text."""
    pieces, counts = split_flat(texts)
    ends = list(accumulate(counts, initial=0))
    return [pieces[a:b] for a, b in pairwise(ends)]


class PieceCache:
    """What ``compute`` made of pieces, kept in two generations of at most ``size`` entries each.

    A full generation becomes the old one, and the entries used from it move on, so memory is
    bounded and frequent pieces stay. ``compute`` takes a list of pieces and returns a list.
    """

    def __init__(self, compute: Callable[[list[str]], list], size: int = 400_000, longest: int = 64):
        self.compute, self.size, self.longest = compute, size, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def values(self, pieces: list[str]) -> list:
        found = list(map(self.young.get, pieces))
        gaps, at = [], -1
        with contextlib.suppress(ValueError):  # index() ends the search that way
            while True:
                at = found.index(None, at + 1)
                gaps.append(at)
        if not gaps:
            return found
        fresh: dict[str, object] = dict.fromkeys(pieces[i] for i in gaps)
        for p in fresh:
            fresh[p] = self.old.get(p)
        unknown = [p for p, v in fresh.items() if v is None]
        fresh.update(zip(unknown, self.compute(unknown), strict=True))
        for i in gaps:
            found[i] = fresh[pieces[i]]
        self.young.update((p, v) for p, v in fresh.items() if len(p) <= self.longest)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        return found


def in_blocks(texts: list[str], chars: int = 1 << 19):
    """Consecutive slices of ``texts`` with about so many code points; a longer text stands alone."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end]) <= chars):
            total += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end
