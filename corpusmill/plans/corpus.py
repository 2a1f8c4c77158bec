"""Queries: text functions, duplicates, chunking, filters, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import chunking, context, dedupe, predicates as P
from corpusmill.plans.registry import query, table
from corpusmill.plans.retrieval import ASK
from corpusmill.sources import readers, writers


@query("exact_dups", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, sf):
    return dedupe.exact_groups(table(spark, sf, "documents"))


@query("new_docs_anti", "SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source IN ('src0', 'src1'))")
def new_docs_anti(spark, sf):
    d = table(spark, sf, "documents")
    registry = dedupe.register(d.filter(F.col("source").isin("src0", "src1")).select(dedupe.content_hash(F.col("text")).alias("content_hash"), "source", F.col("doc_id").alias("seen")))
    return dedupe.unseen(d, registry).select("doc_id")


@query("seen_docs_semi", "SELECT doc_id FROM documents WHERE source <> 'src0' AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0')")
def seen_docs_semi(spark, sf):
    d = table(spark, sf, "documents")
    registry = d.filter("source = 'src0'").select(dedupe.content_hash(F.col("text")).alias("content_hash"))
    return dedupe.already_seen(d.filter("source <> 'src0'"), registry.distinct()).select("doc_id")


@query("hash_registry", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_seen, max(doc_id) AS last_updated, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def hash_registry(spark, sf):
    return dedupe.register(table(spark, sf, "documents").select(dedupe.content_hash(F.col("text")).alias("content_hash"), "source", F.col("doc_id").alias("seen")))


@query("registry_stats", "SELECT count(*)::BIGINT AS n_hashes, count(DISTINCT source)::BIGINT AS n_sources FROM (SELECT sha256(text), arg_min(source, doc_id) AS source FROM documents GROUP BY 1)")
def registry_stats(spark, sf):
    return hash_registry(spark, sf).agg(F.count("*").alias("n_hashes"), F.countDistinct("source").alias("n_sources"))


@query("first_of_text", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def first_of_text(spark, sf):
    return dedupe.keep_first(table(spark, sf, "documents")).select("doc_id")


# an edit changes the counts of at most two letters by one each, so pairs further apart than 50 can't be that near
_LETTERS = "list_transform(range(97, 123), lambda c: length(h) - length(replace(h, chr(c::INT), '')))"


@query("fuzzy_dups", f"""WITH r AS (SELECT h, id, {_LETTERS} AS l FROM (SELECT substring(text, 1, 500) AS h, min(doc_id) AS id FROM documents GROUP BY 1) WHERE length(h) > 0 AND strlen(h) = length(h)),
c AS (SELECT x.id AS a, y.id AS b, x.h AS ha, y.h AS hb FROM r x JOIN r y ON x.id < y.id AND abs(length(x.h) - length(y.h)) <= 25 AND list_sum(list_transform(list_zip(x.l, y.l), lambda z: abs(z[1] - z[2]))) <= 50)
SELECT a, b, round(1 - levenshtein(ha, hb) / greatest(length(ha), length(hb)), 6) AS ratio FROM c WHERE round(1 - levenshtein(ha, hb) / greatest(length(ha), length(hb)), 6) > 0.95""")
def fuzzy_dups(spark, sf):
    """All pairs of starts that SQL can compare by characters: those in ASCII. ``fuzzy_dups_all`` has the others."""
    head = F.substring("text", 1, dedupe.PREFIX)
    return dedupe.fuzzy_pairs(table(spark, sf, "documents").filter(F.length(head) == F.octet_length(head)))


@query("fuzzy_dups_all")
def fuzzy_dups_all(spark, sf):
    """Pairs of all documents in any language and script."""
    return dedupe.fuzzy_pairs(table(spark, sf, "documents"))


@query("fuzzy_dup_classes", "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY substring(text, 1, 500)) AS first_id FROM documents WHERE length(text) > 0")
def fuzzy_dup_classes(spark, sf):
    return dedupe.head_classes(table(spark, sf, "documents"))


@query("html_strip", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("html_text", r"""SELECT page_id, array_to_string(list_filter(list_transform(flatten(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), chr(10)),
lambda x: string_split(trim(x), '  '))), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM pages""")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("wiki_documents", r"""SELECT page_id::VARCHAR AS doc_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages WHERE length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) >= 1""")
def wiki_documents(spark, sf):
    return readers.wiki_pages(table(spark, sf, "pages")).select("doc_id", "title", F.md5("text").alias("digest"))


def _codes_sql(col="text"):
    return "list_concat(" + ", ".join(f"regexp_extract_all({col}, '(?i){p}', 0)" for p in T.CODE_PATTERNS) + ")"


@query("domain_codes", f"SELECT doc_id, len(list_distinct({_codes_sql()}))::INT AS n, array_to_string(list_sort(list_distinct({_codes_sql()})), ',') AS codes FROM documents WHERE text IS NOT NULL")
def domain_codes(spark, sf):
    codes = T.domain_codes(F.col("text"))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.size(codes).alias("n"), F.array_join(F.sort_array(codes), ",").alias("codes"))


@query("top_keywords", r"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+', 0), lambda x: regexp_full_match(x, '[a-z_]{3,}') AND x NOT IN ('and', 'the', 'for', 'with', 'from', 'this', 'that', 'are', 'have')) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t), c AS (SELECT doc_id, word, count(*)::BIGINT AS n, min(pos) AS f FROM p GROUP BY ALL)
SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f)::INT AS rank FROM c QUALIFY rank <= 10""")
def top_keywords(spark, sf):
    return context.keywords(table(spark, sf, "documents"))


_SENT = r"list_filter(list_transform(string_split_regex(trim(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g')), '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')"


@query("sentence_split", f"SELECT doc_id, len({_SENT})::INT AS n, md5(array_to_string({_SENT}, '|')) AS digest FROM documents WHERE text IS NOT NULL")
def sentence_split(spark, sf):
    s = T.sentences(F.col("text"))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.size(s).alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


_KW = ", ".join(f"'{w}'" for w in sorted({w for w in ASK.lower().split() if len(w) > 2}))


@query("key_sentences", rf"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS sentence, generate_subscripts({_SENT}, 1) - 1 AS position FROM documents),
o AS (SELECT *, len(list_filter(list_distinct(string_split_regex(lower(sentence), '\s+')), lambda x: x IN ({_KW})))::INT AS overlap FROM s WHERE length(sentence) >= 20)
SELECT doc_id, position::INT AS position, sentence || '.' AS sentence, overlap FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, position) <= 5""")
def key_sentences(spark, sf):
    return context.key_sentences(table(spark, sf, "documents"), ASK)


_EX = " OR ".join(f"contains(lower(s), '{w}')" for w in ASK.lower().split() if len(w) > 3)


@query("excerpts", f"""WITH d AS (SELECT doc_id, list_filter({_SENT}, lambda s: length(s) >= 30 AND ({_EX})) AS l FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM d), g AS (SELECT doc_id, s, min(p) AS p FROM u GROUP BY doc_id, s), f AS (SELECT doc_id, s, p FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p) <= 4)
SELECT doc_id, string_agg(s, '|' ORDER BY p) AS excerpts FROM f GROUP BY doc_id""")
def excerpts(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(context.excerpts(F.col("text"), ASK), "|").alias("excerpts")).filter("excerpts <> ''")


@query("chunk_fixed", "SELECT doc_id, i::INT AS chunk_index, md5(substring(text, (i * 800 + 1)::INT, 1000)) AS digest FROM documents, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0)::BIGINT, 1))) AS u(i)")
def chunk_fixed(spark, sf):
    return chunking.chunk(table(spark, sf, "documents"), "fixed", 1000, 200).select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query("chunk_lines", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (i * 8 + 1)::INT AS start, least(len(l), 10 + i * 8)::INT AS "end", md5(array_to_string(l[i * 8 + 1 : i * 8 + 10], chr(10))) AS digest FROM l, unnest(range(0, 1 + greatest(0, (len(l) - 2) // 8))) AS u(i)""")
def chunk_lines(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.explode(chunking.by_lines(F.col("text"))).alias("c")).select("doc_id", "c.start", "c.end", F.md5("c.content").alias("digest"))


def _sections_sql(expr="text"):
    for b in chunking.BOUNDARIES:
        expr = f"replace({expr}, '{b}', chr(1) || '{b}')"
    return f"list_filter(list_transform(string_split({expr}, chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '')"


_MARKED = "replace(replace(text, 'The', 'Results'), 'Die', '## Overview')"


@query("chunk_semantic", f"SELECT doc_id, unnest(list_transform(l, lambda x: md5(x))) AS digest, generate_subscripts(l, 1)::INT - 1 AS chunk_index FROM (SELECT doc_id, {_sections_sql(_MARKED)} AS l FROM documents WHERE text IS NOT NULL)")
def chunk_semantic(spark, sf):
    marked = F.replace(F.replace("text", F.lit("The"), F.lit("Results")), F.lit("Die"), F.lit("## Overview"))
    d = table(spark, sf, "documents").filter("text IS NOT NULL").withColumn("text", marked)
    return chunking.exploded(d, chunking.sections(F.col("text"))).select("doc_id", F.md5("content").alias("digest"), "chunk_index")


@query("chunk_semantic_sized")
def chunk_semantic_sized(spark, sf):
    """Sections over the size in parts; tests hold them against the splitter."""
    return chunking.semantic_chunks(table(spark, sf, "documents"), 1000, 100, source="source")


@query("chunk_headers", r"SELECT doc_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, '. ', chr(10) || '# '), '\n(#{1,6} |---+\n|\n)', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)")
def chunk_headers(spark, sf):
    parts = chunking.by_headers(F.replace("text", F.lit(". "), F.lit("\n# ")))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query("chunk_metadata", "SELECT doc_id || '_' || i AS chunk_id, 'fixed' AS chunk_method, length(substring(text, (i * 800 + 1)::INT, 1000))::INT AS chunk_size, md5('source: ' || source || chr(10) || 'lang: ' || lang || chr(10) || substring(text, (i * 800 + 1)::INT, 1000)) AS digest FROM documents, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0)::BIGINT, 1))) AS u(i)")
def chunk_metadata(spark, sf):
    d = table(spark, sf, "documents")
    parts = d.select("doc_id", "source", "lang", F.posexplode(chunking.fixed(F.col("text"), 1000, 200)).alias("chunk_index", "content"))
    rows = chunking.with_metadata(parts, "fixed")
    return rows.select("chunk_id", "chunk_method", "chunk_size", F.md5(chunking.prepended(F.col("content"), source=F.col("source"), lang=F.col("lang"))).alias("digest"))


@query("chunk_stats", "SELECT source, count(*)::BIGINT AS n_docs, sum(greatest(ceil((length(text) - 200) / 800.0)::BIGINT, 1))::BIGINT AS n_chunks FROM documents WHERE text IS NOT NULL GROUP BY source")
def chunk_stats(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("source", F.size(chunking.fixed(F.col("text"), 1000, 200)).alias("n"))
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return chunking.chunk(table(spark, sf, "documents"), "recursive", 1000, 100)


@query("code_chunks")
def code_chunks(spark, sf):
    d = table(spark, sf, "documents")
    kind = F.element_at(F.array(F.lit("python"), F.lit("sql"), F.lit("yaml"), F.lit("code")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return chunking.code_chunks(d.select(F.concat(F.lit("file"), F.col("doc_id").cast("string")).alias("path"), kind.alias("language"), "text"), 1000, 100)


@query("document_keys", "SELECT doc_id, coalesce(nullif(source, ''), 'unknown') || '_' || substring(md5(substring(text, 1, 100)), 1, 8) AS doc_key, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS preview, len(string_split(text, chr(10)))::INT AS n_lines FROM documents WHERE text IS NOT NULL")
def document_keys(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.document_key(F.col("source"), F.col("text")).alias("doc_key"), T.preview(F.col("text"), 500).alias("preview"), T.line_count(F.col("text")).alias("n_lines"))


@query("path_filters", r"SELECT page_id, lower(regexp_extract(url, '(\.[^./]+)$', 1)) AS ext FROM pages WHERE starts_with(url, 'http') AND NOT starts_with(url, 'http://') AND NOT ends_with(url, '.pdf')")
def path_filters(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").filter(P.path_allowed(url, ["http"], ["http://"]) & P.type_allowed(url, exclude=[".pdf"])).select("page_id", P.extension(url).alias("ext"))


@query("metadata_filters", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'de') AND n_chars >= 1000 AND n_chars <= 5000")
def metadata_filters(spark, sf):
    keep = P.metadata_filter(["src1", "src2", "src3"], kinds=["en", "de"], kind="lang") & F.col("n_chars").between(1000, 5000)
    return table(spark, sf, "documents").filter(keep).select("doc_id")


@query("metadata_absent_or_equal", "SELECT doc_id FROM documents WHERE lang <> 'en' OR source = 'src1'")
def metadata_absent_or_equal(spark, sf):
    meta = F.when(F.col("lang") == "en", F.create_map(F.lit("source"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf, "documents").filter(P.metadata_matches(meta, {"source": "src1"})).select("doc_id")


@query("non_blank", r"SELECT doc_id FROM documents WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0")
def non_blank(spark, sf):
    return table(spark, sf, "documents").filter(P.not_blank(F.col("text"))).select("doc_id")


@query("set_ops", "SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT text FROM documents UNION SELECT text FROM benchmark) UNION ALL SELECT 'except', count(*) FROM (SELECT text FROM documents EXCEPT SELECT text FROM benchmark) UNION ALL SELECT 'intersect', count(*) FROM (SELECT source FROM documents INTERSECT SELECT source FROM documents WHERE lang = 'de') UNION ALL SELECT 'union_all', (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)")
def set_ops(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    texts, more = d.select("text"), b.select("text")
    named = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    parts = [named("union", texts.union(more).distinct()), named("except", texts.subtract(more)), named("intersect", d.select("source").intersect(d.filter("lang = 'de'").select("source"))), named("union_all", texts.unionAll(more))]
    return readers.union_sources(parts)


@query("ordered_distinct", "SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(ts) AS first, min(event_id) FROM events GROUP BY ALL) GROUP BY user_id HAVING count(*) = count(DISTINCT first)")
def ordered_distinct(spark, sf):
    firsts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))
    grouped = firsts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "event_type"))).alias("l"), F.count("*").alias("n"), F.countDistinct("first").alias("d"))
    return grouped.filter("n = d").select("user_id", F.array_join(F.transform("l", lambda x: x["event_type"]), ",").alias("types"))


@query("summaries", "SELECT source, CASE WHEN length(t) > 300 THEN substring(t, 1, 300) || '...' ELSE t END AS summary, n AS chunk_count FROM (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t, count(*)::INT AS n FROM documents WHERE text IS NOT NULL GROUP BY source)")
def summaries(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("source", F.col("doc_id").alias("chunk_index"), F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return writers.summaries(d).select("source", "summary", "chunk_count")


@query("variations", r"SELECT item_id, len(l)::INT AS n FROM (SELECT item_id, list_filter(list_transform(list_filter(string_split(replace('1. ' || text, '. ', chr(10) || '- '), chr(10)), lambda x: starts_with(x, '- ')), lambda x: trim(substring(x, 3))), lambda x: length(x) > 10) AS l FROM benchmark)")
def variations(spark, sf):
    text = F.replace(F.concat(F.lit("1. "), F.col("text")), F.lit(". "), F.lit("\n- "))
    return table(spark, sf, "benchmark").select("item_id", F.size(T.variations_from_text(text)).alias("n"))
