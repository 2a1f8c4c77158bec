"""Brute-force versions and a fixture of awkward rows."""

import decimal
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 long, key string, bands string, `rank` int"


def prose(seed: int, n: int) -> str:
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def awkward(repeat: bool = True) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, copies and near copies, repeated rows."""
    base = prose(1, 200)
    texts = [
        None,
        "",
        "   \n\t ",
        "one",
        "one two three",
        "ONE Two three",
        base,
        base,
        base.replace("w5", "X5", 1),
        " ".join(base.split()[:190]),
        " ".join(base.split()[:150]),
        prose(2, 120) + "\nshared line\n\nShared LINE  ",
        *(prose(10 + i, 60) + "\n  Shared Line\t" for i in range(12)),
        prose(3, 40_000),
        "x" * 50_000,
        "a\rb\n\nÉté é　z #*$% it's I'll <|endoftext|> 12 ３ 漢字 😀",
        "same words " * 80,
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", None if t is None else len(t), 1, "k", None, 3) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[12]] if repeat else rows


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def components(texts: dict, num: int = 85, den: int = 100) -> dict:
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def line_dedup(rows, least=10):
    """(lines, dropped, kept text) of each (id, text) row."""
    key = lambda line: line.strip("\x20\t\n\x0b\x0c\r").translate(LOWER)
    found = {}
    for i, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            found.setdefault(key(line), set()).add(i)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(found[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def plain(v):
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 6) + 0.0
    return None if v is None else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)
