"""Quality rules with adaptive thresholds from mergeable quantile sketches (DataFrame functions only).

Every text gets exact counts and four integer ratios. Per language and source, each ratio goes into
a sketch: a histogram over buckets whose width is at most a sixteenth of their value, so a quantile
read from it has a bounded relative error, and sketches merge by adding counts. A group's quantiles are
weighted with those of its language, and these with the whole table's, as if the larger group's sketch
had ``PRIOR`` rows in the smaller one's: however few rows a group has, its own count to that extent.
A text fails when a ratio lies far outside the span between two quantiles of its group; a rate has to
do so by more than the chance error of the text's own count, and its span is no less than what a single
occurrence makes in a text of the table's median size, which is sketched as well: groups in which a rate is nearly always
0 have no span of their own. Sketches add up whatever way rows are
dealt, so thresholds don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .workspace import Workspace, table

SPACE = " \t\n\x0b\f\r"
#: Rows that the sketch of the language (of the whole table) counts for in that of a source (of a language).
PRIOR = 100
#: Distance from the quantiles, in spans between them, at which a ratio fails.
FENCE = 6
#: Standard errors of a count that are taken off before its rate is held against the fence.
ERRORS = 3
#: Ratio: the two quantiles in percent, how many units come at once in the count (0: no count), and whether low values fail as well.
RATIOS = {"word_length": (25, 75, 0, True), "symbols": (50, 75, 1, False), "dup_lines": (50, 90, 1, False), "repeats": (50, 90, 3, False)}
#: Sizes of texts by which rates are measured.
SIZES = ("n_words", "n_lines")
#: Groups with more than this share of all rows are hot: there are at most 1 / share of them.
HOT_SHARE = 1e-4


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts of every whole text: one row per input row, null text as a text without words.

    Texts are split once; the windows of three words are compared by 64-bit hashes inside one text.
    Row identity beside the key is (h1, h2), two hashes of the text, so repeated keys don't mix.
    """
    d = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.select("doc_id", "lang", "source", "t", _trimmed(F.col("t")).alias("inner"))
    words = F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("t", "\n"), lambda x: _trimmed(x) != "")
    d = d.select("doc_id", "lang", "source", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), words.alias("w"), lines.alias("lines"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"))
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    kept = ["doc_id", "lang", "source", "h1", "h2"]
    d = d.select(
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= 4, window).alias("windows"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    ordered = F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.select(*kept, *counts, ordered.alias("o"))
    same = lambda j, k: F.coalesce(F.get("o", j)["h"] == F.get("o", k)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("o") - 1), lambda j: same(j, j - 1) | same(j, j + 1))
    d = d.select(*kept, *counts, F.when(F.col("o").isNotNull(), F.sort_array(F.transform(twice, lambda j: F.get("o", j)["i"]))).alias("p"))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), F.lit(0), lambda n, j: n + F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - F.get("p", j), F.lit(3))))
    d = d.select(*kept, *counts, F.when(F.col("p").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


#: Ratio: its count, the size that the count is divided by, and the unit.
TERMS = {"word_length": ("word_chars", "n_words", 100), "symbols": ("n_symbols", "n_words", 1000), "dup_lines": ("n_dup_lines", "n_lines", 1000), "repeats": ("n_repeat_words", "n_words", 1000)}


def _ratios(sure: bool = False) -> dict[str, Column]:
    """Integer ratios of a measured row; ``sure`` takes the chance error off the counts of rates."""

    def per(count: str, n: str, by: int, clump: int) -> Column:
        if sure and clump:
            count = f"greatest(cast(floor({count} - {ERRORS} * sqrt({clump} * {count})) as bigint), 0L)"
        return F.expr(f"{by} * {count} div greatest({n}, 1)")

    return {r: per(*TERMS[r], RATIOS[r][2]) for r in RATIOS}


def bucket_of(v: Column) -> Column:
    """Bucket of a non-negative integer: itself below 32, then sixteen buckets for each doubling."""
    e = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (16 * e + F.call_function("shiftright", v, e)).cast("long")


def bucket_top(b: Column) -> Column:
    """The largest value in a bucket."""
    e = F.when(b < 32, F.lit(0)).otherwise(F.floor(b / 16) - 1).cast("int")
    return (F.call_function("shiftleft", b - 16 * e + 1, e) - 1).cast("long")


def bucket_bottom(b: Column) -> Column:
    """The smallest value in a bucket."""
    return F.when(b > 0, bucket_top(b - 1) + 1).otherwise(F.lit(0)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n), of ratios and sizes: add ``n`` over any rows or keys to merge sketches."""
    sketched = _ratios() | {n: F.col(n) for n in SIZES}
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("ratio"), bucket_of(c).alias("bucket")) for name, c in sketched.items()))).alias("x")
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", pairs)
    return rows.groupBy("lang", "source", F.col("x.ratio").alias("ratio"), F.col("x.bucket").alias("bucket")).agg(F.count("*").alias("n"))


def _by_ratio(values: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for r, v in values.items():
        out = F.when(F.col("ratio") == r, F.lit(v)).otherwise(out)
    return out


def _quantiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(keys, ratio, rows, low and high quantile), columns named with the tag; the span takes in both quantiles' buckets."""
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    held = merged.groupBy(*keys, "ratio").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"))  # at most 1,000 buckets

    def at(percent: Column, edge: Callable[[Column], Column]) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("hit"))
        step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when((s["hit"] < 0) & (100 * (s["seen"] + x["n"]) >= percent * F.col("total")), x["bucket"]).otherwise(s["hit"]).alias("hit"))
        return edge(F.aggregate("b", state, step, lambda s: s["hit"]))

    low, high = (_by_ratio({r: v[i] for r, v in RATIOS.items()} | dict.fromkeys(SIZES, 50)) for i in (0, 1))
    return held.select(*(F.col(k).alias(f"{tag}_{k}") for k in keys), F.col("ratio").alias(f"{tag}_ratio"), F.col("total").alias(f"{tag}_n"), at(low, bucket_bottom).alias(f"{tag}_low"), at(high, bucket_top).alias(f"{tag}_high"))


def thresholds(sketch: DataFrame, prior: int = PRIOR, fence: int = FENCE) -> DataFrame:
    """One row per (lang, source): rows, and low and high bound of every ratio."""
    ratios = sketch.filter(F.col("ratio").isin(*RATIOS))
    group, language, whole = _quantiles(ratios, ["lang", "source"], "g"), _quantiles(ratios, ["lang"], "l"), _quantiles(sketch, [], "a")
    medians = whole.agg(*(F.max(F.when(F.col("a_ratio") == n, F.col("a_high"))).alias(f"s_{n}") for n in SIZES))
    whole = whole.filter(F.col("a_ratio").isin(*RATIOS)).crossJoin(medians)  # one row
    least = F.lit(0)
    for r, (_, n, by) in TERMS.items():
        least = F.when(F.col("a_ratio") == r, F.expr(f"coalesce({by * RATIOS[r][2]} div nullif(s_{n}, 0), 0)")).otherwise(least)
    whole = whole.withColumn("least", least)
    joined = group.join(language, F.col("g_lang").eqNullSafe(F.col("l_lang")) & (F.col("g_ratio") == F.col("l_ratio")))
    joined = joined.join(F.broadcast(whole), F.col("g_ratio") == F.col("a_ratio"))  # a row for each ratio
    mean = lambda n, own, other: F.expr(f"({n} * {own} + {prior} * {other}) div ({n} + {prior})")
    for q in ("low", "high"):
        joined = joined.withColumn(f"m_{q}", mean("l_n", f"l_{q}", f"a_{q}")).withColumn(q, mean("g_n", f"g_{q}", f"m_{q}"))
    span = fence * F.greatest(F.col("high") - F.col("low"), F.col("least"))
    bound = F.struct((F.col("low") - span).alias("low"), (F.col("high") + span).alias("high"))
    return joined.groupBy(F.col("g_lang").alias("t_lang"), F.col("g_source").alias("t_source")).agg(F.max("g_n").alias("t_n"), *(F.max(F.when(F.col("g_ratio") == r, bound)).alias(f"t_{r}") for r in RATIOS))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``.

    Hot groups' limits are sent to every task (there are few by the meaning of hot); rows of those, and
    rows that failed already, need no partner and are dealt by row, so no group fills a task.
    """
    least = limits.agg(F.coalesce(F.sum("t_n"), F.lit(0))).first()[0] * HOT_SHARE
    names = [f"t_{r}" for r in RATIOS]
    bounds = F.struct(*names).alias("bounds")
    hot = limits.filter(F.col("t_n") > least).select(F.col("t_lang").alias("h_lang"), F.col("t_source").alias("h_source"), bounds)  # at most 1 / HOT_SHARE rows
    cold = limits.filter(F.col("t_n") <= least).select("t_lang", "t_source", F.xxhash64("t_lang", "t_source").alias("t_key"), bounds.alias("cold"))
    same = F.col("lang").eqNullSafe(F.col("h_lang")) & F.col("source").eqNullSafe(F.col("h_source"))
    rows = measured.join(F.broadcast(hot), same, "left")
    alone = F.col("base_failed") | F.col("bounds").isNotNull()
    rows = rows.withColumn("_key", F.when(alone, F.xxhash64("doc_id", "h1")).otherwise(F.xxhash64("lang", "source")))
    joined = rows.join(cold, (F.col("_key") == F.col("t_key")) & F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    joined = joined.withColumn("_b", F.coalesce("bounds", "cold"))
    fine = F.lit(True)
    for r, c in _ratios(sure=True).items():
        fine = fine & (c <= F.col(f"_b.t_{r}.high")) & ((c >= F.col(f"_b.t_{r}.low")) if RATIOS[r][3] else F.lit(True))
    return joined.select(*measured.columns, (~F.col("base_failed") & F.coalesce(fine, F.lit(True))).alias("kept"))


def quality_verdicts(docs: DataFrame, ws: Workspace | None = None, **columns: str) -> DataFrame:
    """One verdict per row of ``docs``; see ``measures`` for the columns.

    Null and empty texts fail the base rule; null languages and sources form groups of their own;
    repeated rows get equal verdicts; extra columns are ignored; an empty table gives an empty result.
    """
    ws = ws or Workspace(docs.sparkSession, "quality")
    measured = ws.save(measures(docs, **columns), "measured")
    limits = ws.save(thresholds(ws.save(sketches(measured), "sketches")), "limits")
    ws.drop("sketches")
    return judge(measured, limits)


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", **columns: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    good = quality_verdicts(docs, key=key, text=text, **columns).filter("kept").select(F.col("doc_id").alias("_key"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.join(good, docs[key].eqNullSafe(good["_key"]) & (F.xxhash64(t) == good["_h1"]) & (F.xxhash64(F.lit(1), t) == good["_h2"]), "left_semi")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    bucket = lambda v: f"(16 * greatest(length(bin({v})) - 5, 0) + ({v} >> greatest(length(bin({v})) - 5, 0)::int))"
    top = lambda b: f"CASE WHEN {b} < 32 THEN {b} ELSE (({b} - 16 * ({b} // 16 - 1) + 1) << ({b} // 16 - 1)::int) - 1 END"
    ratio = {r: f"{by} * {c} // greatest({n}, 1)" for r, (c, n, by) in TERMS.items()}
    sure = {r: f"{by} * {f'greatest(floor({c} - {ERRORS} * sqrt({RATIOS[r][2]} * {c}))::BIGINT, 0)' if RATIOS[r][2] else c} // greatest({n}, 1)" for r, (c, n, by) in TERMS.items()}
    least = "CASE ratio " + " ".join(f"WHEN '{r}' THEN {by * RATIOS[r][2]} // (SELECT {n} FROM med)" for r, (_, n, by) in TERMS.items()) + " ELSE 0 END"
    case = lambda i: "CASE ratio " + " ".join(f"WHEN '{r}' THEN {v[i]}" for r, v in RATIOS.items()) + " END"
    parts = []
    for tag, keys in (("g", "lang, source, "), ("l", "lang, "), ("a", "")):
        part = f"PARTITION BY {keys}ratio"
        parts.append(f"""
{tag}1 AS (SELECT {keys}ratio, b, sum(n)::BIGINT AS n FROM sketch GROUP BY {keys}ratio, b),
{tag}2 AS (SELECT {keys}ratio, b, sum(n) OVER ({part} ORDER BY b)::BIGINT AS seen, sum(n) OVER ({part})::BIGINT AS total FROM {tag}1),
{tag}3 AS (SELECT {keys}ratio, max(total) AS n, min(b) FILTER (100 * seen >= {case(0)} * total) AS lo, min(b) FILTER (100 * seen >= {case(1)} * total) AS hi FROM {tag}2 GROUP BY {keys}ratio),
{tag}4 AS (SELECT {keys}ratio, n, (CASE WHEN lo = 0 THEN 0 ELSE ({top("(lo - 1)")}) + 1 END)::BIGINT AS lo, ({top("hi")})::BIGINT AS hi FROM {tag}3)""")
    mean = lambda n, own, other: f"({n} * {own} + {PRIOR} * {other}) // ({n} + {PRIOR})"
    low_too = ", ".join(f"'{r}'" for r, v in RATIOS.items() if v[3])
    return rf"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
win AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS k FROM split, unnest(range(1, len(w) - 1)) AS u(p)),
rep AS (SELECT doc_id, count(DISTINCT p + o)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win), (VALUES (0), (1), (2)) AS o(o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN rep USING (doc_id)),
mb AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
long AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{r}' AS ratio, {ratio[r]} AS v, {sure[r]} AS s FROM mb" for r in RATIOS)}),
med AS (SELECT {", ".join(f"(SELECT {top('min(b)')} FROM (SELECT b, sum(count(*)) OVER (ORDER BY b) AS seen, sum(count(*)) OVER () AS total FROM (SELECT {bucket(n)} AS b FROM mb WHERE NOT base_failed) GROUP BY b) WHERE 100 * seen >= 50 * total) AS {n}" for n in SIZES)}),
sketch AS (SELECT lang, source, ratio, {bucket("v")} AS b, count(*)::BIGINT AS n FROM long WHERE NOT base_failed GROUP BY ALL),{",".join(parts)},
lm AS (SELECT l4.lang, l4.ratio, {mean("l4.n", "l4.lo", "a4.lo")} AS lo, {mean("l4.n", "l4.hi", "a4.hi")} AS hi FROM l4 JOIN a4 USING (ratio)),
gm0 AS (SELECT g4.lang, g4.source, g4.ratio, {mean("g4.n", "g4.lo", "lm.lo")} AS lo, {mean("g4.n", "g4.hi", "lm.hi")} AS hi FROM g4 JOIN lm ON g4.lang IS NOT DISTINCT FROM lm.lang AND g4.ratio = lm.ratio),
gm AS (SELECT *, greatest(hi - lo, {least}) AS span FROM gm0),
verdict AS (SELECT doc_id, bool_and(s <= hi + {FENCE} * span AND (x.ratio NOT IN ({low_too}) OR s >= lo - {FENCE} * span)) AS fine
  FROM long x JOIN gm ON x.lang IS NOT DISTINCT FROM gm.lang AND x.source IS NOT DISTINCT FROM gm.source AND x.ratio = gm.ratio GROUP BY doc_id)
SELECT mb.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, true) AS kept
FROM mb LEFT JOIN verdict USING (doc_id)"""


ORACLE = _sql()
