"""Toxicity by a weighted lexicon that is learnt from labelled rows and matched by an Aho-Corasick automaton.

Texts are folded first: case, letters of other scripts that look Latin, characters without width, and
digits or signs that stand for letters inside words. Lexicon entries are words or starts of words; at the start of a
word the longest entry counts, with its weight. A hit inside an exception phrase doesn't count. The score
is a logistic function of the hits' weights, alone and by length of the text.

Learning looks at three disjoint sets of labelled rows: entries and exceptions come from one, the logistic
function from the second, the third is held out. Only a text is ever an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import Workspace, table

#: Labelled rows that the fit uses at most (in the mean: rows are taken by a hash of their key).
FIT_ROWS = 30_000
#: Remainders of crc32(key) by FOLDS: 0 is held out, LEXICON learn entries and exceptions, the other is for the logistic function.
FOLDS, LEXICON = 5, (1, 2, 3)
#: Toxic rows that an entry is in at least, and the standard errors by which its weight has to be positive.
LEAST, ERRORS = 5, 3.0
#: Lengths of word starts that may be entries.
STARTS = range(3, 10)
#: Words added to a text's length, so that one hit in a very short text isn't all.
SLACK = 20
#: Phrases of two words that contain an entry and aren't toxic in themselves, beside those learnt.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "class clown", "sore loser")
#: Letters of other scripts with the Latin ones that they look like.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w", "ϲ": "c", "ϳ": "j",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "հ": "h", "ⅰ": "i", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Digits and signs inside words with the letters that they stand for; 1, ! and | may be l as well.
DIGITS = {"0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g"}
#: Characters without width.
HIDDEN = "­​‌‍⁠﻿"

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {ord(c): None for c in HIDDEN}
_TO_I, _TO_L = (str.maketrans(DIGITS | {c: letter for c in "1!|"}) for letter in "il")
#: Letters as ranges, which are matched faster than by class: signs, spaces and digits of other scripts are left out.
_LETTER = "a-zªµºß-öø-῿Ⰰ-ⷿ぀-퟿豈-﷿ﹰ-﻾ｦ-ￜ\U00010000-\U0010ffff"
_SIGN = r"0134578@$9!|"
_LETTERS = re.compile(f"[{_LETTER}]+")
_ODD = re.compile(f"[{''.join(map(chr, _FOLD))}]")
_SIGNED = re.compile(f"[{_SIGN}]")
#: Words with signs inside or before letters, or digits and dollars behind them.
_MIXED = re.compile(f"[{_LETTER}{_SIGN}]*(?:[{_LETTER}][{_SIGN}]+[{_LETTER}]|[0134578@$9][{_LETTER}]|[{_LETTER}][0134578$9])[{_LETTER}{_SIGN}]*")
_EITHER = re.compile(r"[1!|]")


def _spelt(token: str) -> str:
    """A word of letters and signs in letters; in both forms if a sign may be i or l. Marks behind it stay marks."""
    core = token.rstrip("!|@")
    both = [core.translate(_TO_I), core.translate(_TO_L)] if _EITHER.search(core) else [core.translate(_TO_I)]
    return f" {' '.join(both)} "


def folded(text: str) -> list[str]:
    """Words of a text after folding. A word with a sign for i or l comes in both forms."""
    plain = text.lower()
    if not plain.isascii() and _ODD.search(plain):
        plain = plain.translate(_FOLD)
    if not _SIGNED.search(plain):
        return _LETTERS.findall(plain)
    out, at = [], 0
    for m in _SIGNED.finditer(plain):  # only what lies around a sign is looked at closely
        if m.start() < at:
            continue
        low, high = m.start(), m.end()
        while low > at and (_LETTERS.match(plain, low - 1) or _SIGNED.match(plain, low - 1)):
            low -= 1
        while high < len(plain) and (_LETTERS.match(plain, high) or _SIGNED.match(plain, high)):
            high += 1
        out.append(plain[at:low])
        token = plain[low:high]
        out.append(_spelt(token) if _MIXED.fullmatch(token) else token)
        at = high
    out.append(plain[at:])
    return _LETTERS.findall("".join(out))


def entries_of(words: list[str]) -> set[str]:
    """What may become an entry: each word, closed by a space, and the starts of words."""
    different = set(words)
    return {f"{w} " for w in different} | {w[:k] for w in different for k in STARTS if k <= len(w)}


@dataclass
class Lexicon:
    """Weights of entries, exception phrases, and the logistic function over ``features``."""

    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    logistic: list[float] = field(default_factory=lambda: [0.0] * 4)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(f" {entry}", (entry, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (phrase, None))
        if len(found):
            found.make_automaton()
        return found


def hits(words: list[str], automaton) -> list[tuple[int, str, float]]:
    """(start, entry, weight) of the longest entry at each word's start outside exception phrases, in `` word word ``."""
    if not len(automaton) or not words:
        return []
    best: dict[int, tuple[str, float]] = {}
    shielded: list[tuple[int, int]] = []
    for end, (entry, weight) in automaton.iter(f" {' '.join(words)} "):
        if weight is None:
            shielded.append((end - len(entry), end))
        elif (start := end - len(entry) + 1) not in best or len(best[start][0]) < len(entry):
            best[start] = (entry, weight)
    inside = {s for a, b in shielded for s in range(a, b)}
    return sorted((start, *x) for start, x in best.items() if start not in inside)


def features(text: str, automaton) -> tuple[float, int]:
    words = folded(text)
    return sum(w for _, _, w in hits(words, automaton)), len(words)


def design(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(weight)), np.log1p(100 * weight / (words + SLACK)), np.log1p(weight), np.log1p(words)])


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Coefficients by Newton's steps; all rows of one kind give a flat function."""
    beta = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        beta[0] = 0.0 if not len(y) else math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return beta.tolist()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta.tolist()


def fold_of(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _counted(rows: DataFrame, of, name: str) -> DataFrame:
    """(name, clean, toxic): rows of ``rows(text, toxic)`` that have each item that ``of`` finds in a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            items = list(counts[0] | counts[1])
            return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), *(pa.array([c[i] for i in items], pa.int64()) for c in counts)], names=[name, "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
                counts[toxic].update(of(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 1_000_000:
                yield out()
                counts = (Counter(), Counter())
        yield out()

    return rows.mapInArrow(run, f"{name} string, clean long, toxic long").groupBy(name).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _matched(lexicon: Lexicon, of):
    """What ``of(words, hits)`` finds in a text; the automaton is made once in each worker."""
    held: list = []

    def run(text: str) -> set[str]:
        if not held:
            held.append(lexicon.automaton())
        words = folded(text)
        return of(words, hits(words, held[0]))

    return run


def _weight(clean: str, toxic: str, n: tuple[int, int]) -> tuple[str, str]:
    """SQL of the log ratio of shares, and of its standard error."""
    return f"ln(({toxic} + 0.5) / {n[1] + 1}) - ln(({clean} + 0.5) / {n[0] + 1})", f"sqrt(1 / ({toxic} + 0.5) + 1 / ({clean} + 0.5))"


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, rows: int) -> DataFrame:
    """(fold, text, toxic) of labelled rows that aren't held out, ``rows`` at most in the mean."""
    marked = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("toxic")).filter("_key IS NOT NULL AND toxic IN (0, 1)").withColumn("fold", fold_of(F.col("_key"))).filter("fold <> 0")
    n = marked.count()
    if n > rows:
        marked = marked.filter(F.pmod(F.xxhash64("_key"), F.lit(1 << 40)) < int((1 << 40) * rows / n))
    # no more than the bound, so it can be sent to the texts wherever these are
    return docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(marked), F.col("_doc") == F.col("_key")).select("fold", "text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, exceptions: Sequence[str] = EXCEPTIONS, ws: Workspace | None = None) -> Lexicon:
    """A lexicon from at most ``rows`` labelled rows outside the held-out fold.

    Words and starts that are more frequent in toxic rows than chance allows are candidates. Counted again
    where they are the longest candidate at a word, they get the log ratio of their shares among toxic and clean rows
    less one standard error as their weight: a start has no weight from the words that are candidates themselves.
    Entries, phrases and the second set's sums of weights reach the driver: all bounded by ``rows``.
    """
    ws = ws or Workspace(docs.sparkSession, "toxicity")
    fit = ws.save(labelled(docs, labels, key, text, label, rows), "fit")
    first = fit.filter(F.col("fold").isin(*LEXICON)).select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = (sizes.get(0, 0), sizes.get(1, 0))
    weight, error = _weight("clean", "toxic", n)
    def signs(counts: DataFrame) -> dict[str, float]:
        """Weight less its error of each counted item; 0 where it may be chance."""
        found = counts.filter(F.col("toxic") >= LEAST).withColumn("w", F.expr(weight)).withColumn("e", F.expr(error)).filter(F.col("w") > ERRORS * F.col("e"))
        return {r[0]: r["w"] - r["e"] for r in found.collect()}

    candidates = signs(_counted(first, lambda t: entries_of(folded(t)), "entry"))
    seen = _counted(first, _matched(Lexicon(candidates), lambda words, found: {e for _, e, _ in found}), "entry")
    own = signs(seen)
    lexicon = Lexicon({e: own.get(e, 0.0) for e in candidates}, list(exceptions))

    def phrases(words: list[str], found: list[tuple[int, str, float]]) -> set[str]:
        starts = np.cumsum([1, *(len(w) + 1 for w in words)])
        at = [int(np.searchsorted(starts, start)) for start, _, w in found if w > 0]
        return {" ".join(words[j : j + 2]) for i in at for j in (i - 1, i) if 0 <= j < len(words) - 1}

    harmless = _counted(first, _matched(lexicon, phrases), "phrase").filter(F.col("clean") >= LEAST).withColumn("w", F.expr(weight)).filter("w < 0")
    lexicon.exceptions += sorted(r["phrase"] for r in harmless.collect())
    second = scored(fit.filter(~F.col("fold").isin(*LEXICON)).select(F.col("toxic").cast("long").alias("key"), "text"), lexicon).select("key", "weight", "words").collect()
    x, y = np.array([[r["weight"], r["words"]] for r in second]).reshape(-1, 2), np.array([r["key"] for r in second], dtype=float)
    lexicon.logistic = logistic_fit(design(x[:, 0], x[:, 1]), y)
    return lexicon


def scored(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(key, weight, words, score) of ``rows(key, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, beta = lexicon.automaton(), np.array(lexicon.logistic)
        for batch in batches:
            found = np.array([features(t.as_py(), automaton) for t in batch["text"]], dtype=float).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(design(found[:, 0], found[:, 1]) @ beta, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int64)), pa.array(score)], names=["key", "weight", "words", "score"])

    return rows.mapInArrow(run, "key long, weight double, words long, score double")


def toxicity(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, weight, words) of every row.

    Null and empty texts have no hit and the score of that. Null keys are held out and stay null; repeated rows
    get equal scores; extra columns are ignored; an empty table gives an empty result. Without labels of both
    kinds no entry has a weight and all scores are equal.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return scored(rows, lexicon).select(F.col("key").alias("doc_id"), (fold_of(F.col("key")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "weight", "words")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
