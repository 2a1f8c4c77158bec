"""Audit of how far sources diverge from each other, and from their language, in their terms.

Tasks count terms of their own texts and send one row for each term and group. A term's postings are the counts
of the sources that have it. Two sources' divergence is a sum over all kept terms: from the
sources' histograms of counts for terms that only one of them (or none) has, and from the
postings for those that both have; there, one row for each two sources leaves a task, never one for each term.

A source's most divergent terms are found by bounds: terms of like count in a source share a bucket, whose
largest count and smallest count in the language bound their values. Buckets are evaluated best first, and
no more once the bounds of all others are strictly below the value that is last in rank.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .quality import bucket_of
from .workspace import Workspace, table

#: A term is a run of letters: A-Z, a-z and everything that isn't ASCII (bytes of UTF-8 here).
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of the language that a kept term is in at least, and ranks of the part ``term``.
LEAST, TOP = 3, 200
#: Unit of shares.
UNIT = 1_000_000_000
#: Terms that a task counts before it sends what it has.
HELD = 500_000
#: Pairs of postings that are expanded at once.
PAIRS = 2_000_000
#: Each round of the search may evaluate so many times as many terms as the one before.
WIDEN = 8
#: Rows of group totals that are sent to every task at most.
GROUPS = 10_000


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, df): partial counts; also a row with a null term for each group that a task met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = [None, *(t.decode("utf-8") for t in n)]
                same = lambda v: pa.array([v] * len(terms))
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(terms, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(df[t] for t in n)], pa.int64())], names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for lang, source, t in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                mine = Counter(m.group() for m in TERM.finditer(t.as_py().lower())) if len(t.as_py()) > 1 << 24 else Counter(TERM.findall(t.as_py().lower()))
                n.update(mine)
                df.update(mine.keys())
                size += len(n) - before
                if size >= HELD:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias
    rows = docs.select(blank(lang)("lang"), blank(source)("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, df long")


def postings(docs: DataFrame, least: int, ws: Workspace, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Kept terms as (lang, term, total, postings of source and n), and all (lang, source), both written."""
    counts = ws.save(term_counts(docs, **columns), "counts")
    groups = ws.save(counts.filter("term IS NULL").select("lang", "source").distinct(), "groups")
    # partial counts meet by term; postings are no more than the language's sources
    merged = counts.filter("term IS NOT NULL").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    listed = merged.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings"))
    kept = ws.save(listed.filter(F.col("df") >= least).select("lang", "term", "total", "postings"), "postings")
    ws.drop("counts")
    return kept, groups


def share(n: str, whole: str) -> str:
    """SQL of 1 + floor(UNIT * n / whole) for 0 < n <= whole, by two steps of long division, exact up to 9e13."""
    return f"(1L + ({n} * 100000L) div {whole} * 10000L + ({n} * 100000L) % {whole} * 10000L div {whole})"


def value(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q)."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _listed(kept: DataFrame) -> DataFrame:
    return kept.select("lang", "term", "total", F.explode("postings").alias("x")).select("lang", "term", "total", "x.source", "x.n")


def totals(kept: DataFrame, groups: DataFrame, ws: Workspace) -> DataFrame:
    """A row for each group: its occurrences and different terms, the language's, the language's kept terms, and the share of an absent term (1 where nothing is kept)."""
    own = _listed(kept).groupBy("lang", "source").agg(F.sum("n").alias("n_group"), F.count("*").alias("n_terms"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    rows = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_group", "n_terms", "n_lang", "v"])
    return ws.save(rows.withColumn("absent", F.expr(f"CASE WHEN v = 0 THEN 1L ELSE {share('1L', '(n_group + v)')} END")), "totals")


def _sent(totals: DataFrame) -> DataFrame:
    """To every task while there are few groups; a shuffled join beyond."""
    return F.broadcast(totals) if totals.count() <= GROUPS else totals


def shared_terms(listed: DataFrame) -> DataFrame:
    """(lang, source, item, v): what terms that both sources have add to the sums over terms of one alone.

    ``listed(lang, sources, shares, absent)`` has a row for each term. Each task adds up its own terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        keys, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def out() -> pa.RecordBatch:
            a, b = keys >> 32, keys & 0xFFFFFFFF
            columns = [pa.array([names[i][0] for i in a], pa.string()), pa.array([names[i][1] for i in a], pa.string()), pa.array([names[i][1] for i in b], pa.string()), pa.array(sums)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "v"])

        for batch in batches:
            code = []
            for lang, sources in zip(batch["lang"].to_pylist(), batch["sources"].to_pylist(), strict=True):
                for source in sources:
                    if (lang, source) not in codes:
                        codes[lang, source] = len(names)
                        names.append((lang, source))
                    code.append(codes[lang, source])
            sizes = np.diff(batch["sources"].offsets.to_numpy())
            code, size = np.array(code, dtype=np.int64), np.repeat(sizes, sizes)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            p, absent = (batch[c].flatten().to_numpy() for c in ("shares", "absent"))
            ends = np.cumsum(size)
            low = 0
            while low < len(code):  # postings low to high, each with all postings of its term
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
                n = size[low:high]
                i = np.repeat(np.arange(low, high), n)
                j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                i, j = i[i != j], j[i != j]
                f = lambda a, b: (a - b) * (a - b) // b
                v = f(p[i], p[j]) - f(p[i], absent[j]) - f(absent[i], p[j]) + f(absent[i], absent[j])
                found, at = np.unique(np.concatenate([keys, code[i] << 32 | code[j]]), return_inverse=True)
                added = np.zeros(len(found), dtype=np.int64)
                np.add.at(added, at, np.concatenate([sums, v]))
                keys, sums, low = found, added, high
                if len(keys) > PAIRS:
                    yield out()
                    keys, sums = keys[:0], sums[:0]
        yield out()

    return listed.mapInArrow(run, "lang string, source string, item string, v long")


def source_pairs(kept: DataFrame, totals: DataFrame, ws: Workspace) -> DataFrame:
    """(lang, source, item, value, rank) of every two sources of a language."""
    few = _sent(totals)
    side = lambda tag: few.select("lang", *(F.col(c).alias(f"{tag}_{c}") for c in ("source", "n_group", "n_terms", "absent")), F.col("v").alias(f"{tag}_v"))
    p = share("(n + 1)", "(n_group + v)")
    shares = _listed(kept).join(few.select("lang", "source", "n_group", "v", "absent"), ["lang", "source"]).select("lang", "term", "source", "n", F.expr(p).alias("p"), "absent")
    lists = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("x")).filter(F.size("x") > 1)
    both = shared_terms(lists.select("lang", F.col("x.source").alias("sources"), F.col("x.p").alias("shares"), F.col("x.absent").alias("absent")))
    kinds = ws.save(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"), F.first("absent").alias("absent")), "kinds")
    one = kinds.join(side("o"), "lang").filter("source <> o_source")
    mine = one.groupBy("lang", "source", F.col("o_source").alias("item")).agg(F.expr(f"sum(k * {value('p', 'o_absent')})").alias("v"))
    theirs = one.groupBy("lang", F.col("o_source").alias("source"), F.col("source").alias("item")).agg(F.expr(f"sum(k * {value('o_absent', 'p')})").alias("v"))
    none = totals.select("lang", "source", "n_terms", "absent", "v").join(side("o"), "lang").filter("source <> o_source")
    none = none.select("lang", "source", F.col("o_source").alias("item"), F.expr(f"(v - n_terms - o_n_terms) * {value('absent', 'o_absent')}").alias("v"))
    summed = mine.unionByName(theirs).unionByName(none).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("v").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order))


def divergent_terms(kept: DataFrame, totals: DataFrame, top: int, ws: Workspace) -> DataFrame:
    """(lang, source, item, value, rank): each source's terms that are likelier there than in the language, by value.

    A bucket's bound is the value of a term with the bucket's largest count and its smallest count in the
    language: no term in it has a larger one. Terms at the last rank's value are all evaluated.
    """
    group = ["lang", "source"]
    listed = _listed(kept).withColumn("bucket", bucket_of(F.col("n")))
    buckets = listed.groupBy(*group, "bucket").agg(F.max("n").alias("most"), F.min("total").alias("least"), F.count("*").alias("terms"))
    p, q = share("({n} + 1)", "(n_group + v)"), share("({n} + 1)", "(n_lang + v)")
    buckets = buckets.join(_sent(totals).select(*group, "n_group", "n_lang", "v"), group).withColumn("p", F.expr(p.format(n="most"))).withColumn("q", F.expr(q.format(n="least"))).filter("p > q")
    buckets = buckets.withColumn("bound", F.expr(value("p", "q"))).withColumn("before", F.coalesce(F.sum("terms").over(Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buckets = ws.save(buckets.drop("p", "q", "most", "least", "terms"), "buckets")
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    best, done, turn = None, 0, 0
    while True:
        limit = top * WIDEN**turn
        unseen = buckets.filter(F.col("before") >= done)
        if best is not None:  # groups with fewer than ``top`` terms so far go on
            last = best.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
            unseen = unseen.join(last, group, "left").filter("kth IS NULL OR bound >= kth").drop("kth")
            if unseen.isEmpty():
                return best
        wanted = unseen.filter(F.col("before") < limit).select(*group, "bucket", "n_group", "n_lang", "v")
        rows = listed.join(wanted, [*group, "bucket"]).select(*group, F.col("term").alias("item"), F.expr(p.format(n="n")).alias("p"), F.expr(q.format(n="total")).alias("q")).filter("p > q")
        rows = rows.select(*group, "item", F.expr(value("p", "q")).alias("value"))
        rows = rows if best is None else rows.unionByName(best.drop("rank"))
        best = ws.save(rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), f"best{turn}")
        done, turn = limit, turn + 1


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, ws: Workspace | None = None, **columns: str) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups: parts ``pair`` and ``term``.

    Null texts, languages and sources are empty ones; a group without terms diverges from the others of its
    language like any other (by 0 if the language keeps no term); repeated rows are documents of their own; extra
    columns are ignored; an empty table gives no rows.
    """
    ws = ws or Workspace(docs.sparkSession, "divergence")
    kept, groups = postings(docs, least, ws, **columns)
    known = totals(kept, groups, ws)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return part(source_pairs(kept, known, ws), "pair").unionByName(part(divergent_terms(kept, known, top, ws), "term"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
l AS (SELECT lang, term, count(*) AS total FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
lt AS (SELECT lang, sum(total)::BIGINT AS n, count(*) AS v FROM l GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN l USING (lang, term) GROUP BY lang, source, term),
gt AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS n, coalesce(v, 0) AS v FROM g LEFT JOIN lt USING (lang)),
p AS (SELECT gt.lang, gt.source, l.term, coalesce(c.n, 0) AS n, 1 + {UNIT}::BIGINT * (coalesce(c.n, 0) + 1) // (gt.n + gt.v) AS p, 1 + {UNIT}::BIGINT * (total + 1) // (lt.n + lt.v) AS q
  FROM gt JOIN l ON l.lang = gt.lang JOIN lt ON lt.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = l.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms QUALIFY rank <= {TOP}"""
