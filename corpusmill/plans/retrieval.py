"""Queries: keyword and vector retrieval, fusion, boosting, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T, vectors as V
from corpusmill.operators import boosting, compositions, context, dense, expansion, fusion, index, lexical, vector_index
from corpusmill.plans.registry import query, table
from corpusmill.workspace import Workspace, file_states

ASK = "the tion of and inthe treatment with select"
WORDS = ASK.split()
WHEN = "when was the treatment started"
KEYS = ", ".join(f"'{w}'" for w in sorted(set(WORDS)))

#: Okapi BM25 of ASK over ``docs(doc_id, text)``; __DROP__ filters terms.
BM25_SQL = f"""
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '' __DROP__) AS t FROM documents WHERE text IS NOT NULL),
len AS (SELECT doc_id, len(t) AS dl FROM w),
n AS (SELECT count(*) AS n FROM documents), av AS (SELECT avg(dl) AS avgdl FROM len),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM w) GROUP BY term),
idf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n),
mean AS (SELECT avg(idf) AS m FROM idf),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY ALL),
q AS (SELECT term, count(*) AS qn FROM (SELECT unnest(string_split('{ASK}', ' ')) AS term) GROUP BY term),
bm AS (SELECT doc_id, round(sum(qn * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN len USING (doc_id), mean, av GROUP BY doc_id)"""


_INDEXES: dict[tuple, index.KeywordIndex] = {}


def keyword_index(spark, sf):
    """The index of a folder's documents: built by the first query of an application that needs it, and used by all
    that follow as long as the folder has the same files, of the same lengths and times."""
    docs = table(spark, sf, "documents")
    files = (spark.sparkContext.applicationId, sf, file_states(spark, docs.inputFiles()))
    if files not in _INDEXES:
        _INDEXES[files] = index.build_index(docs, Workspace(spark, "keyword-index").path)
    return _INDEXES[files]


@query("bm25_index", r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(t) AS term FROM w))
SELECT (SELECT count(*) FROM documents)::BIGINT AS n_docs, round((SELECT avg(len(t)) FROM w), 6) AS avgdl, (SELECT count(DISTINCT term) FROM p)::BIGINT AS n_terms, (SELECT count(*) FROM p)::BIGINT AS n_postings""")
def bm25_index(spark, sf):
    """Builds the index; the queries below read it."""
    found = keyword_index(spark, sf)
    counts = found.terms().agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return found.figures().crossJoin(counts).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")  # one row each


@query("bm25_topk", f"WITH {BM25_SQL.replace('__DROP__', '')} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    return lexical.top_k(keyword_index(spark, sf).bm25(ASK), 20)


@query("bm25_segments", f"WITH {BM25_SQL.replace('__DROP__', '').replace('FROM documents', 'FROM documents WHERE doc_id % 9 <> 0', 1).replace('FROM documents WHERE doc_id % 9 <> 0 WHERE', 'FROM documents WHERE doc_id % 9 <> 0 AND').replace('(SELECT count(*) AS n FROM documents)', '(SELECT count(*) AS n FROM documents WHERE doc_id % 9 <> 0)')} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_segments(spark, sf):
    """The documents in three additions, one of them deleted and added again, every ninth deleted: as an index of what is left."""
    found = index.SegmentedIndex(spark, Workspace(spark, "segments").folder("index"))
    docs = table(spark, sf, "documents")
    for i in range(3):
        found.add(docs.filter(F.pmod("doc_id", F.lit(3)) == i))
    found.delete(docs.filter("doc_id % 3 = 1 OR doc_id % 9 = 0"))
    found.add(docs.filter("doc_id % 3 = 1"))
    return lexical.top_k(found.bm25(ASK), 20)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("bm25_stopwords", f"WITH {BM25_SQL.replace('__DROP__', f'AND x NOT IN ({_STOP})')} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_stopwords(spark, sf):
    """Straight from the texts, without an index."""
    return lexical.top_k(lexical.bm25(table(spark, sf, "documents"), ASK, drop=T.STOP_WORDS), 20)


@query("term_statistics", r"SELECT term, df, round(ln(n - df + 0.5) - ln(df + 0.5), 6) AS idf FROM (SELECT term, count(*)::BIGINT AS df FROM (SELECT unnest(list_distinct(string_split_regex(lower(text), '\s+'))) AS term FROM documents) WHERE term <> '' GROUP BY term HAVING count(*) >= 5), (SELECT count(*) AS n FROM documents)")
def term_statistics(spark, sf):
    return keyword_index(spark, sf).terms().filter("df >= 5").select("term", "df", F.round("idf", 6).alias("idf"))


@query("postings_top", "SELECT term, sum(tf)::BIGINT AS n, count(*)::BIGINT AS docs FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM documents) GROUP BY ALL) GROUP BY term HAVING count(*) >= 10")
def postings_top(spark, sf):
    return lexical.postings(table(spark, sf, "documents")).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("docs")).filter("docs >= 10")


def _boost_sql(query: str, text: str = "text") -> str:
    cases = " + ".join("CASE WHEN contains(lower({}), '{}') THEN {} ELSE 0 END".format(text, p.replace("'", "''"), w) for p, w in T.phrases(query))
    return f"least({cases or '0'}, 1.0)"


_TERMS = ", ".join(f"'{t}'" for t in T.query_terms(ASK))


@query("keyword_overlap_topk", f"""SELECT doc_id, round(len(list_filter(list_distinct(string_split_regex(lower(text), '\\s+')), lambda x: x IN ({_TERMS}))) / {len(T.query_terms(ASK))}.0 + {_boost_sql(ASK)}, 6) AS score
FROM documents WHERE text IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20""")
def keyword_overlap_topk(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return lexical.top_k(d.select("doc_id", F.round(lexical.overlap_score(F.col("text"), ASK), 6).alias("score")), 20)


def _count_sql(term: str, text: str = "text") -> str:
    t = term.replace("'", "''")
    return f"((length(lower({text})) - length(replace(lower({text}), '{t}', ''))) // {len(term)})"


def _rerank_sql(query: str, text: str = "text") -> str:
    head = f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')[1:50]"
    parts = []
    for t in query.lower().split():
        place = f"list_position(list_transform({head}, lambda w: contains(w, '{t}')), true)"
        parts.append(f"{_count_sql(t, text)} * 0.1 + coalesce(CASE WHEN {place} > 0 THEN (51 - {place}) / 50.0 * 0.2 END, 0)")
    return "(" + " + ".join(parts) + ")"


@query("lexical_rerank", f"SELECT doc_id, round({_rerank_sql(ASK)}, 6) AS score FROM documents WHERE text IS NOT NULL ORDER BY score DESC, doc_id LIMIT 30")
def lexical_rerank(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return lexical.top_k(d.select("doc_id", F.round(lexical.rerank_score(F.col("text"), ASK), 6).alias("score")), 30)


_COS = "round(list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[]), 6)"


def _vector(spark, sf, i=0):
    """The vector of one row, as a literal for the query."""
    return table(spark, sf, "embeddings").filter(F.col("vec_id") == i).first()["embedding"]


@query("vector_topk", f"SELECT e.vec_id, {_COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    return dense.nearest(table(spark, sf, "embeddings"), _vector(spark, sf), 20)


@query("vector_topk_filtered", f"SELECT e.vec_id, {_COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark, sf):
    return dense.nearest(table(spark, sf, "embeddings"), _vector(spark, sf), 20, where=F.col("label") == 3)


_MULTI = f"""hits AS (SELECT q.vec_id AS query_index, e.vec_id, {_COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
multi AS (SELECT query_index, vec_id, score, row_number() OVER (PARTITION BY query_index ORDER BY score DESC, vec_id) AS rank FROM hits QUALIFY rank <= 20)"""


def _multi(spark, sf):
    e = table(spark, sf, "embeddings")
    return dense.nearest_many(e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_index"), F.col("embedding").alias("q")), 20)


@query("multi_query_topk", f"WITH {_MULTI} SELECT query_index, vec_id, score, rank::INT AS rank FROM multi")
def multi_query_topk(spark, sf):
    return _multi(spark, sf)


def _vector_index(spark, sf):
    ws = Workspace(spark, "vector-index")
    e = table(spark, sf, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_index"), F.col("embedding").alias("q"))
    return vector_index.VectorIndex.build(e, ws.folder("index")), asked, ws


@query("vector_index_exact", f"""WITH {_MULTI.replace("rank <= 20", "rank <= 10")} SELECT query_index, vec_id, score, rank::INT AS rank FROM multi""")
def vector_index_exact(spark, sf):
    """Builds the index and searches it to the end: cells beyond the probes are read where their bound allows a hit."""
    found, asked, ws = _vector_index(spark, sf)
    return found.search(asked, 10, exact=True, ws=ws).select("query_index", F.col("key").alias("vec_id"), "score", "rank")


@query("vector_index_recall", "SELECT count(*)::BIGINT AS n_queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf):
    """Whether the probed cells alone have nine tenths of the true neighbours."""
    found, asked, ws = _vector_index(spark, sf)
    exact = ws.save(found.search(asked, 10, exact=True, ws=ws), "exact")
    return vector_index.recall(found.search(asked, 10), exact).select("n_queries", (F.col("recall") >= 0.9).alias("reached"))


def _joined(found):
    return found.withColumn("query_indices", F.array_join(F.col("query_indices").cast("array<string>"), ","))


@query("freq_relevance", f"""WITH {_MULTI} SELECT vec_id AS chunk_id, count(*)::BIGINT AS frequency, round(avg(score), 9) AS avg_score, round(count(*) * avg(score), 9) AS final_score, string_agg(query_index::VARCHAR, ',' ORDER BY query_index) AS query_indices
FROM multi GROUP BY vec_id HAVING count(*) >= 2 ORDER BY final_score DESC, chunk_id LIMIT 10""")
def freq_relevance(spark, sf):
    return _joined(fusion.frequency_relevance(_multi(spark, sf).withColumnRenamed("vec_id", "chunk_id")))


@query("freq_relevance_max", f"""WITH {_MULTI} SELECT vec_id AS chunk_id, count(*)::BIGINT AS frequency, round(avg(score), 9) AS avg_score, round(max(score), 9) AS final_score, string_agg(query_index::VARCHAR, ',' ORDER BY query_index) AS query_indices
FROM multi GROUP BY vec_id HAVING count(*) >= 2 AND round(avg(score), 9) >= 0.2 ORDER BY final_score DESC, chunk_id LIMIT 10""")
def freq_relevance_max(spark, sf):
    hits = _multi(spark, sf).withColumnRenamed("vec_id", "chunk_id")
    return fusion.above(fusion.frequency_relevance(hits, k=None, method="max"), average=0.2).orderBy(F.desc("final_score"), "chunk_id").limit(10).transform(_joined)


@query("freq_histogram", f"WITH {_MULTI} SELECT frequency, count(*)::BIGINT AS n FROM (SELECT count(*)::BIGINT AS frequency FROM multi GROUP BY vec_id) GROUP BY frequency")
def freq_histogram(spark, sf):
    return fusion.frequency_histogram(_multi(spark, sf).withColumnRenamed("vec_id", "chunk_id"))


@query("multi_query_stats", f"""WITH {_MULTI}, f AS (SELECT count(*) AS f FROM multi GROUP BY vec_id)
SELECT (SELECT count(*) FROM multi)::BIGINT AS n_results, (SELECT count(DISTINCT query_index) FROM multi)::BIGINT AS n_queries, (SELECT count(*) FROM f)::BIGINT AS n_chunks,
(SELECT max(f) FROM f)::BIGINT AS max_frequency, (SELECT min(f) FROM f)::BIGINT AS min_frequency, round((SELECT count(*) FROM multi) / (SELECT count(DISTINCT query_index) FROM multi), 6) AS per_query""")
def multi_query_stats(spark, sf):
    return fusion.multi_query_stats(_multi(spark, sf).withColumnRenamed("vec_id", "chunk_id"))


@query("aggregation_stats", f"""WITH {_MULTI}, a AS (SELECT count(*) AS f, round(avg(score), 9) AS s, round(count(*) * avg(score), 9) AS z, vec_id FROM multi GROUP BY vec_id HAVING count(*) >= 2 ORDER BY z DESC, vec_id LIMIT 10)
SELECT count(*)::BIGINT AS n, {", ".join(f"round(coalesce({g}({c})::DOUBLE, 0), 9) AS {p}_{n}" for c, n in (("f", "freq"), ("s", "avg"), ("z", "final")) for g, p in (("avg", "mean"), ("min", "min"), ("max", "max")))} FROM a""")
def aggregation_stats(spark, sf):
    return fusion.aggregation_stats(fusion.frequency_relevance(_multi(spark, sf).withColumnRenamed("vec_id", "chunk_id")))


def _near_sql(vectors: str) -> str:
    return f"WITH c AS (SELECT embedding, min(vec_id) AS vec_id FROM ({vectors}) GROUP BY embedding) SELECT a, b, score FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_COS.format('x.embedding', 'y.embedding')} AS score FROM c x JOIN c y ON x.vec_id < y.vec_id) WHERE score > 0.98"


@query("semantic_dups", _near_sql("SELECT vec_id, embedding FROM embeddings"))
def semantic_dups(spark, sf):
    return dense.similar_pairs(table(spark, sf, "embeddings"), 0.98)


@query("semantic_dup_classes", "SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS first_id FROM embeddings")
def semantic_dup_classes(spark, sf):
    return dense.vector_classes(table(spark, sf, "embeddings"))


@query("semantic_dups_planted", _near_sql("SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_transform(embedding, lambda x: x::DOUBLE + CASE WHEN x > 0.1 THEN 0.02 ELSE 0 END) FROM embeddings UNION ALL SELECT vec_id + 2000000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 3 = 0"))
def semantic_dups_planted(spark, sf):
    """Every vector beside one that is near it, and every third beside an equal one."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    near = e.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), F.transform("embedding", lambda x: x + F.when(x > 0.1, 0.02).otherwise(0.0)).alias("embedding"))
    equal = e.filter("vec_id % 3 = 0").select((F.col("vec_id") + 2_000_000_000).alias("vec_id"), "embedding")
    return dense.similar_pairs(e.unionByName(near).unionByName(equal), 0.98)


@query("embedding_validation", "SELECT vec_id, len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) <= 1 AS ok FROM embeddings")
def embedding_validation(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", V.valid(F.col("embedding"), 64).alias("ok"))


K = 40
_LISTS = f"""{BM25_SQL.replace('__DROP__', '')},
kw AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT {K}),
sem AS (SELECT e.vec_id AS doc_id, {_COS.format('e.embedding', 'q.embedding')} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT {K}),
kwp AS (SELECT doc_id, score, (count(*) OVER () - row_number() OVER (ORDER BY score DESC, doc_id) + 1) / count(*) OVER () AS k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM kw),
semp AS (SELECT doc_id, score, (count(*) OVER () - row_number() OVER (ORDER BY score DESC, doc_id) + 1) / count(*) OVER () AS s, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sem)"""


def _sem(spark, sf, k=K):
    return dense.nearest(table(spark, sf, "embeddings"), _vector(spark, sf), k).withColumnRenamed("vec_id", "doc_id")


def _kw(spark, sf, k=K):
    return lexical.top_k(keyword_index(spark, sf).bm25(ASK), k)


@query("hybrid_fusion_rank", f"WITH {_LISTS} SELECT doc_id, round(0.7 * coalesce(s, 0) + 0.3 * coalesce(k, 0), 6) AS fused FROM semp FULL JOIN kwp USING (doc_id) ORDER BY fused DESC, doc_id LIMIT 20")
def hybrid_fusion_rank(spark, sf):
    out = fusion.fuse(fusion.by_position(_sem(spark, sf), "s"), fusion.by_position(_kw(spark, sf), "k"), (0.7, 0.3))
    return lexical.top_k(out.select("doc_id", "fused"), 20, "fused")


_FUSION_TERMS = " OR ".join(f"contains(lower(text), '{t}')" for t in boosting.FUSION_TERMS)


@query("hybrid_fusion_score", f"""WITH {_LISTS} SELECT doc_id, round((0.7 * coalesce(sem.score, 0) + 0.3 * coalesce(kw.score, 0)) * CASE WHEN {_FUSION_TERMS} THEN 1.2 ELSE 1.0 END, 6) AS fused
FROM sem FULL JOIN kw USING (doc_id) JOIN documents USING (doc_id) ORDER BY fused DESC, doc_id LIMIT 20""")
def hybrid_fusion_score(spark, sf):
    both = fusion.fuse(_sem(spark, sf).withColumnRenamed("score", "s"), _kw(spark, sf).withColumnRenamed("score", "k"), (0.7, 0.3))
    rows = table(spark, sf, "documents").join(F.broadcast(both), "doc_id")  # two lists of K rows
    boost = F.when(T.contains_any(F.lower("text"), boosting.FUSION_TERMS), 1.2).otherwise(1.0)
    return lexical.top_k(rows.select("doc_id", F.round((0.7 * F.col("s") + 0.3 * F.col("k")) * boost, 6).alias("fused")), 20, "fused")


@query("fusion_normalised", f"WITH {_LISTS} SELECT doc_id, round(0.6 * coalesce(sem.score, 0) + 0.4 * coalesce(kw.score / (SELECT max(score) FROM kw), 0), 6) AS fused FROM sem FULL JOIN kw USING (doc_id) ORDER BY fused DESC, doc_id LIMIT 20")
def fusion_normalised(spark, sf):
    out = fusion.fuse_normalised(_sem(spark, sf).withColumnRenamed("score", "s"), _kw(spark, sf).withColumnRenamed("score", "k"))
    return lexical.top_k(out.select("doc_id", "fused"), 20, "fused")


def _ranked(rows):
    from pyspark.sql import Window

    return rows.select("doc_id", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "doc_id")).alias("rank"))  # a list of K rows


@query("fusion_rrf", f"WITH {_LISTS} SELECT doc_id, round(sum(w / (60 + rank)), 6) AS fused FROM (SELECT doc_id, rank, 0.6 AS w FROM semp UNION ALL SELECT doc_id, rank, 0.4 FROM kwp) GROUP BY doc_id ORDER BY fused DESC, doc_id LIMIT 20")
def fusion_rrf(spark, sf):
    lists = _ranked(_sem(spark, sf)).withColumn("weight", F.lit(0.6)).unionByName(_ranked(_kw(spark, sf)).withColumn("weight", F.lit(0.4)))
    return lexical.top_k(fusion.reciprocal_rank_fusion(lists), 20, "fused")


_CONTEXT = f"""{_LISTS}, first AS (SELECT doc_id, rank, 0 AS part FROM semp WHERE rank <= 7),
fresh AS (SELECT doc_id, rank, 1 AS part FROM kwp WHERE doc_id NOT IN (SELECT doc_id FROM first) ORDER BY rank, doc_id LIMIT 3),
every AS (SELECT * FROM first UNION ALL SELECT * FROM fresh UNION ALL SELECT doc_id, rank, 2 FROM semp WHERE rank > 7),
ctx AS (SELECT doc_id, ['semantic', 'keyword', 'backfill'][part + 1] AS origin, row_number() OVER (ORDER BY part, rank, doc_id)::INT AS position FROM every QUALIFY position <= 10)"""


@query("hybrid_context_split", f"WITH {_CONTEXT} SELECT * FROM ctx")
def hybrid_context_split(spark, sf):
    return fusion.hybrid_context(_ranked(_sem(spark, sf)), _ranked(_kw(spark, sf)))


@query("hybrid_context_stats", f"WITH {_CONTEXT} SELECT count(*)::BIGINT AS n, round(count(*) FILTER (origin = 'semantic') * 100.0 / count(*), 6) AS semantic_pct, round(count(*) FILTER (origin = 'keyword') * 100.0 / count(*), 6) AS keyword_pct, round(count(*) FILTER (origin = 'backfill') * 100.0 / count(*), 6) AS backfill_pct FROM ctx")
def hybrid_context_stats(spark, sf):
    return fusion.context_shares(fusion.hybrid_context(_ranked(_sem(spark, sf)), _ranked(_kw(spark, sf))))


def _any(words, text="text"):
    return "(" + " OR ".join("contains(lower({}), '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _n(words, text="text"):
    return "(" + " + ".join("contains(lower({}), '{}')::INT".format(text, w.replace("'", "''")) for w in words) + ")"


SQL_ASK = "select patient table with calculation logic for qm1 group by en12"


def _sql_boost_sql(query: str) -> str:
    import re

    q = query.lower()
    parts = ["1.0", "CASE WHEN source = 'src1' THEN 0.3 ELSE 0 END", "CASE WHEN source IN ('src1', 'src2') THEN 0.2 ELSE 0 END"]
    if boosting.has_any(q, boosting.LOGIC_WORDS):
        parts.append(f"CASE WHEN {_any(boosting.LOGIC_WORDS)} THEN 0.4 ELSE 0 END")
    mine = sum(s in q for s in boosting.SQL_STRUCTURES)
    if mine:
        n = _n(boosting.SQL_STRUCTURES)
        parts.append(f"CASE WHEN {n} > 0 THEN least({n}, {mine}) / greatest({n}, {mine}) * 0.3 ELSE 0 END")
    parts += [f"CASE WHEN contains(lower(text), '{c}') THEN 0.6 ELSE 0 END" for c in re.findall(r"\b[a-z]{2,4}\d{1,3}\b", q)]
    return " + ".join(parts)


def _domain_boost_sql(query: str) -> str:
    out = f"1.0 + least({_n(boosting.DOMAIN_TERMS)} * 0.1, 0.5) + least({_n(boosting.CODE_SYSTEMS)} * 0.2, 0.3)"
    if boosting.has_any(query, boosting.WHEN_WORDS):
        out += f" + least({_n(boosting.ANSWER_WORDS)} * 0.3 + {_n(boosting.DATE_WORDS)} * 0.4, 1.0)"
    return out + f" + CASE WHEN {_any(boosting.DIRECT_PHRASES)} THEN 0.8 ELSE 0 END"


@query("sql_boost", f"SELECT doc_id, round({_sql_boost_sql(SQL_ASK)}, 6) AS boost FROM documents WHERE text IS NOT NULL")
def sql_boost(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.round(boosting.sql_boost(F.col("text"), SQL_ASK, F.col("source") == "src1", F.col("source").isin("src1", "src2")), 6).alias("boost"))


@query("domain_boost", f"SELECT doc_id, round({_domain_boost_sql(WHEN)}, 6)::DOUBLE AS boost FROM documents WHERE text IS NOT NULL")
def domain_boost(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.round(boosting.domain_boost(F.col("text"), WHEN), 6).alias("boost"))


@query("model_boost", "SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 2.0 ELSE 0.0 END::DOUBLE AS boost FROM documents")
def model_boost(spark, sf):
    name = F.replace(F.lower("source"), F.lit("src"), F.lit("stg_qm"))
    return table(spark, sf, "documents").select("doc_id", boosting.model_boost(name, "logic of qm-1").alias("boost"))


@query("code_boost", "SELECT doc_id, round((doc_id % 10 + 1) * CASE WHEN doc_id % 7 IN (3, 5) OR contains(text, '60.1.7') THEN 1.5 ELSE 1.0 END, 6)::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def code_boost(spark, sf):
    """Texts with a code each, of which the question names two."""
    rows = table(spark, sf, "documents").filter("text IS NOT NULL")
    coded = F.concat("text", F.lit(" see ERR-"), (500 + F.col("doc_id") % 7).cast("string"))
    return rows.select("doc_id", F.round(boosting.code_boost(coded, (F.col("doc_id") % 10 + 1).cast("double"), "fix err-503 or Err-505 in 60.1.7"), 6).alias("score"))


_PIPELINE = f"""WITH {_LISTS},
s AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, doc_id) AS si FROM semp), k AS (SELECT doc_id, k, row_number() OVER (ORDER BY k DESC, doc_id) AS ki FROM kwp),
f AS (SELECT doc_id, round(0.4 * coalesce(s, 0) + 0.6 * coalesce(k, 0), 6) AS fused, coalesce(si, ki + 1000) AS ins FROM s FULL JOIN k USING (doc_id)),
b AS (SELECT doc_id, text, fused, ins, round({_sql_boost_sql(ASK).replace("source = 'src1'", "false").replace("source IN ('src1', 'src2')", "false")}, 6) AS sql_boost FROM f JOIN documents USING (doc_id)),
c AS (SELECT * FROM b ORDER BY sql_boost DESC, fused DESC, ins LIMIT 20),
d AS (SELECT *, round({_domain_boost_sql(ASK)}, 6)::DOUBLE AS domain_boost, round({_rerank_sql(ASK)}, 6) AS rerank FROM c),
u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY rerank DESC, domain_boost DESC, sql_boost DESC, fused DESC, ins) = 1)
SELECT doc_id, fused, sql_boost, domain_boost, rerank, row_number() OVER (ORDER BY rerank DESC, domain_boost DESC, sql_boost DESC, fused DESC, ins)::INT AS position FROM u"""


@query("ranking_pipeline", _PIPELINE)
def ranking_pipeline(spark, sf):
    return boosting.rank_pipeline(_sem(spark, sf), _kw(spark, sf), table(spark, sf, "documents"), ASK, 20)


@query("hierarchical_retrieve", f"""WITH doc AS (SELECT vec_id AS doc_id, embedding, label FROM embeddings), q AS (SELECT embedding FROM embeddings WHERE vec_id = 0),
summ AS (SELECT label, round(max({_COS.format('doc.embedding', 'q.embedding')}), 6) AS score FROM doc, q GROUP BY label ORDER BY score DESC, label LIMIT 5),
hits AS (SELECT doc_id, label, {_COS.format('doc.embedding', 'q.embedding')} AS s FROM doc, q WHERE label IN (SELECT label FROM summ WHERE score >= 0.3))
SELECT label, doc_id, s AS score, row_number() OVER (PARTITION BY label ORDER BY s DESC, doc_id)::INT AS rank FROM hits QUALIFY rank <= 5""")
def hierarchical_retrieve(spark, sf):
    """Groups by their best member first, then the five best rows of each group over the threshold."""
    from corpusmill.operators import tracker

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.round(V.cosine(F.col("embedding"), V.literal(_vector(spark, sf))), 6).alias("score"))
    groups = e.groupBy("label").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "label").limit(5).filter("best >= 0.3").select("label")
    rows = e.join(F.broadcast(groups), "label")  # five rows
    return tracker.top_per_group(rows, "label", [F.desc("score"), F.col("doc_id")], 5).select("label", "doc_id", "score", "rank")


HOW = "the sql of treatment and how the tion"
_BOOSTED = " + ".join(f"CASE WHEN contains(keywords, '{w}') THEN 0.1 ELSE 0.0 END" for w in HOW.lower().split())


def _hierarchical_sql(threshold: float, top_k: int) -> str:
    score = _rerank_sql(HOW)
    return f"""WITH s AS (SELECT doc_id, text AS content, lower(split_part(text, chr(10), 1)) AS keywords, CASE WHEN contains(lower(text), 'select') THEN 'sql' ELSE 'text' END AS kind, round({score}, 6) AS score FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_id FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, chunk_id, text AS content, round({score}, 6) AS score FROM l WHERE length(text) >= 200),
n AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT {min(3 * top_k, 15)}),
r AS (SELECT *, round(score + {_BOOSTED} + CASE WHEN kind = 'sql' THEN 0.15 ELSE 0.0 END, 6) AS relevance FROM n),
b AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, score DESC, doc_id) AS branch, relevance >= {threshold} AS routed FROM r QUALIFY branch <= {top_k}),
d AS (SELECT branch, row_number() OVER (PARTITION BY branch ORDER BY c.score DESC, chunk_id) AS place, 'chunk' AS kind, b.doc_id, chunk_id, c.content, relevance FROM b JOIN c USING (doc_id) WHERE routed QUALIFY place <= 5),
a AS (SELECT branch, 1 AS place, 'summary' AS kind, doc_id, NULL::BIGINT AS chunk_id, content, relevance FROM b WHERE branch NOT IN (SELECT branch FROM d) AND (routed OR NOT EXISTS (SELECT 1 FROM d))),
e AS (SELECT * FROM (SELECT * FROM d UNION ALL SELECT * FROM a) QUALIFY row_number() OVER (PARTITION BY md5(content) ORDER BY branch, place) = 1)
SELECT (row_number() OVER (ORDER BY branch, place))::INT AS position, kind, doc_id, chunk_id::BIGINT AS chunk_id, md5(content) AS digest, relevance FROM e QUALIFY position <= {top_k}"""


def _hierarchical(spark, sf, threshold, top_k):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    score = lambda: F.round(lexical.rerank_score(F.col("text"), HOW), 6).alias("score")
    kind = F.when(F.contains(F.lower("text"), F.lit("select")), "sql").otherwise("text")
    tops = d.select(F.col("doc_id").alias("summary_id"), "doc_id", F.col("text").alias("content"), F.lower(F.split_part("text", F.lit("\n"), F.lit(1))).alias("keywords"), kind.alias("document_type"), score())
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_id", "text")).filter(F.length("text") >= 200)
    chunks = lines.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("text").alias("content"), score())
    return compositions.hierarchical_scored(tops, chunks, HOW, top_k, threshold).select("position", "kind", "doc_id", "chunk_id", F.md5("content").alias("digest"), "relevance")


@query("hierarchical_scored", _hierarchical_sql(0.7, 5))
def hierarchical_scored(spark, sf):
    """Documents stand for summaries, their lines of some length for chunks: some have none."""
    return _hierarchical(spark, sf, 0.7, 5)


@query("hierarchical_fallback", _hierarchical_sql(9.0, 5))
def hierarchical_fallback(spark, sf):
    """A threshold that nothing reaches: summaries alone."""
    return _hierarchical(spark, sf, 9.0, 5)


@query("query_expansion", "SELECT * FROM (VALUES (0, 'what is the logic of table qm1'), (1, 'what is the logic of table qm-1'), (2, 'what is the logic of table quality measure 1'), (3, 'what is the calculation of table qm1'), (4, 'what is the formula of table qm1')) t(query_index, query_text)")
def query_expansion(spark, sf):
    return expansion.expanded(spark, "  What is  the LOGIC of table QM1 ")


@query("query_routes", f"""SELECT item_id, CASE WHEN regexp_matches(text, '(?i)what is|overview|explain|summary') THEN 'overview' WHEN regexp_matches(text, '(?i)how to|step by step|configure|setup') THEN 'specific' WHEN regexp_matches(text, '(?i)error|fix|troubleshoot|issue') THEN 'troubleshoot' ELSE 'general' END AS route,
{_any(T.SQL_KEYWORDS)} AS is_sql FROM (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'How to fix ' WHEN 1 THEN 'What is the issue of ' WHEN 2 THEN 'Troubleshoot ' ELSE '' END || text AS text FROM benchmark)""")
def query_routes(spark, sf):
    asked = F.when(F.col("item_id") % 5 == 0, "How to fix ").when(F.col("item_id") % 5 == 1, "What is the issue of ").when(F.col("item_id") % 5 == 2, "Troubleshoot ").otherwise("")
    rows = table(spark, sf, "benchmark").select("item_id", F.concat(asked, "text").alias("text"))
    return rows.select("item_id", expansion.route(F.col("text")).alias("route"), T.is_sql_related(F.col("text")).alias("is_sql"))


@query("normalised_queries", r"SELECT item_id, substring(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 1000) AS q, length(substring(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 1000)) >= 3 AS ok, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM benchmark")
def normalised_queries(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.normalise_query(F.col("text")).alias("q"), T.valid_query(F.col("text")).alias("ok"), T.strip_special(F.col("text")).alias("plain"))


_REL = "(" + " + ".join(f"{_count_sql(t)} * 2.0" for t in sorted(set(ASK.split()))) + " - length(text) / 10000)"


@query("context_pack", f"""WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY round(greatest({_REL}, 0), 6) DESC, doc_id) AS rank FROM documents WHERE text IS NOT NULL QUALIFY rank <= 50),
u AS (SELECT *, sum(length(text) + 19) OVER (ORDER BY rank) AS used FROM r),
o AS (SELECT *, used - length(text) - 19 AS before, sum(CASE WHEN used <= 60000 THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS over FROM u)
SELECT doc_id, rank::INT AS rank, md5(CASE WHEN used <= 60000 THEN text ELSE substring(text, 1, (60000 - before - 39)::INT) || '...[truncated]' END) AS digest FROM o
WHERE (used <= 60000 AND over = 0) OR (over = 1 AND used > 60000 AND 60000 - before > 500)""")
def context_pack(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").withColumn("score", F.round(context.relevance(F.col("text"), ASK), 6))
    best = lexical.top_k(d.select("doc_id", "text", "score"), 50)
    ranked = best.join(_ranked(best), "doc_id")
    return context.pack(ranked, 60000).select("doc_id", "rank", F.md5("content").alias("digest"))


@query("context_string", f"WITH {_LISTS} SELECT md5(string_agg('[Document ' || rank || ']' || chr(10) || 'Source: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'File: docs/' || doc_id ELSE '' END || chr(10) || 'Project: ' || lang || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest FROM kwp JOIN documents USING (doc_id) WHERE rank <= 5")
def context_string(spark, sf):
    rows = table(spark, sf, "documents").join(F.broadcast(_ranked(_kw(spark, sf)).filter("rank <= 5")), "doc_id")  # five rows
    file = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("docs/"), "doc_id"))
    return context.context_string(rows.select("rank", "source", file.alias("file_path"), F.col("lang").alias("project_tag"), F.col("text").alias("content"))).select(F.md5("context").alias("digest"))
