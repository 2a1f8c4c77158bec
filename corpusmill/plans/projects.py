"""Queries: project artifacts, whole flows, answers of models, logs and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T, vectors as V
from corpusmill.operators import artifacts as A, chunking, compositions as C, context, evaluation as E, expansion, fusion, lineage as L, ordered as O, predicates as P, tracker as K
from corpusmill.plans import history, retrieval
from corpusmill.plans.registry import query, table
from corpusmill.plans.retrieval import ASK
from corpusmill.sources import readers, writers
from corpusmill.workspace import Workspace

# -- a project: nations are models, regions are sources, some nations have tests, customers are seeds

_MODEL = "'model.shop.' || replace(lower(n_name), ' ', '_')"
_DEPS = f"SELECT n_nationkey AS k, 'source.shop.' || lower(r_name) AS dep FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT a.n_nationkey, b.id FROM nation a JOIN (SELECT n_nationkey, {_MODEL} AS id FROM nation) b ON b.n_nationkey = (a.n_nationkey + 1) % 25 WHERE a.n_nationkey % 3 = 0 UNION ALL SELECT n_nationkey, 'seed.shop.seed_r' || n_regionkey FROM nation"
_MODELS = f"SELECT n_nationkey AS k, {_MODEL} AS unique_id, replace(lower(n_name), ' ', '_') AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'table' ELSE 'view' END AS materialization FROM nation"


def _manifest(spark, sf):
    """One row: a manifest of a few dozen nodes."""
    name = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    nxt = nation.select(F.col("n_nationkey").alias("k2"), F.concat(F.lit("model.shop."), name("n_name")).alias("next"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(nxt, (F.col("n_nationkey") + 1) % 25 == F.col("k2"))
    deps = F.array_compact(F.array(F.concat(F.lit("source.shop."), F.lower("r_name")), F.when(F.col("n_nationkey") % 3 == 0, F.col("next")), F.concat(F.lit("seed.shop.seed_r"), "n_regionkey")))
    uid = F.concat(F.lit("model.shop."), name("n_name"))

    def node(kind, label, depends=None, **more):
        empty = F.array().cast("array<string>")
        parts = {"name": label, "resource_type": F.lit(kind), "description": F.lit(""), "schema": F.lit("main"), "raw_code": F.lit(None).cast("string"), "compiled_code": F.lit(None).cast("string")} | more
        held = F.when(F.lit(more.get("materialized") is None), F.lit(None)).otherwise(parts.pop("materialized", F.lit(None)).cast("string"))
        return F.struct(*(v.alias(k) for k, v in parts.items()), F.struct(held.alias("materialized")).alias("config"), F.struct((depends if depends is not None else empty).alias("nodes")).alias("depends_on"))

    models = n.select(uid.alias("id"), node("model", name("n_name"), deps, description=F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("about "), "n_name")).otherwise(""), raw_code=F.concat(F.lit("select * from "), name("n_name")), compiled_code=F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("select 1 as "), name("n_name"))), materialized=F.when(F.col("n_nationkey") % 2 == 0, "table")).alias("node"))
    tests = n.filter("n_nationkey % 6 = 0").select(F.concat(F.lit("test.shop.not_null_"), name("n_name")).alias("id"), node("test", F.concat(F.lit("not_null_"), name("n_name")), F.array(F.lit("macro.x"), uid), raw_code=F.concat(F.lit("select null from "), name("n_name"))).alias("node"))
    seeds = region.select(F.concat(F.lit("seed.shop.seed_r"), "r_regionkey").alias("id"), node("seed", F.concat(F.lit("seed_r"), "r_regionkey")).alias("node"))
    sources = region.select(F.concat(F.lit("source.shop."), F.lower("r_name")).alias("id"), node("source", F.lower("r_name")).alias("node"))
    whole = lambda rows: F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "node"))))
    nodes = models.unionByName(tests).unionByName(seeds).agg(whole(None).alias("nodes"))
    both = nodes.crossJoin(sources.agg(whole(None).alias("sources")))  # one row each
    macros = '{"macro.shop.m": {"name": "m", "macro_sql": "{% macro m(a, b) %}", "arguments": [{"name": "a"}, {"name": "b"}]}}'
    return both.select(F.lit("target/manifest.json").alias("path"), F.concat(F.lit('{"nodes": '), "nodes", F.lit(', "sources": '), "sources", F.lit(', "macros": ' + macros + "}")).alias("content"))


def _nodes(spark, sf):
    """The exploded manifest, written once for a query that reads it several times."""
    return Workspace(spark, "nodes").save(A.nodes(_manifest(spark, sf)), "nodes")


def _depending(found):
    return found.select(F.explode("depends_on").alias("src"), F.col("unique_id").alias("dst")).filter("src <> 'macro.x'")


@query("project_models", f"SELECT unique_id, name, materialization, coalesce(string_agg(dep, ',' ORDER BY dep) FILTER (starts_with(dep, 'model.')), '') AS upstream_models, coalesce(string_agg(dep, ',' ORDER BY dep) FILTER (starts_with(dep, 'source.')), '') AS upstream_sources FROM ({_MODELS}) JOIN ({_DEPS}) USING (k) GROUP BY ALL")
def project_models(spark, sf):
    """Models by what they name themselves."""
    listed = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    return A.model_metadata(_nodes(spark, sf)).select("unique_id", "name", "materialization", listed("upstream_models"), listed("upstream_sources"))


@query("project_models_graph", f"""WITH RECURSIVE m AS ({_MODELS}), d AS ({_DEPS}), e AS (SELECT dep AS src, unique_id AS dst FROM m JOIN d USING (k)), t AS (SELECT n_nationkey AS k, 'test.shop.not_null_' || replace(lower(n_name), ' ', '_') AS test FROM nation WHERE n_nationkey % 6 = 0),
up AS (SELECT dst AS id, src AS node FROM e UNION ALL SELECT id, e.src FROM up JOIN e ON up.node = e.dst)
SELECT unique_id, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM e WHERE src = unique_id), '') AS downstream_models, coalesce((SELECT string_agg(test, ',') FROM t WHERE t.k = m.k), '') AS downstream_tests, (SELECT count(*) FROM up WHERE id = unique_id)::BIGINT AS lineage_depth FROM m""")
def project_models_graph(spark, sf):
    """Models by the graph: what is below them as well, and how many edges lie above."""
    listed = lambda c: F.array_join(c, ",").alias(c)
    found = _nodes(spark, sf)
    return A.model_metadata(found, _depending(found)).select("unique_id", listed("downstream_models"), listed("downstream_tests"), "lineage_depth")


_FIRST = "(SELECT string_agg(dep, ', ') FROM (SELECT dep FROM d WHERE d.k = m.k AND starts_with(dep, '{}') ORDER BY dep))"


@query("project_sql", f"""WITH m AS ({_MODELS}), d AS ({_DEPS}) SELECT unique_id, 'model' AS kind, CASE WHEN k % 5 = 0 THEN 'compiled' ELSE 'raw' END AS code_type, CASE WHEN k % 5 = 0 THEN 'select 1 as ' ELSE 'select * from ' END || name AS content,
'DBT Model: ' || name || chr(10) || 'Type: ' || materialization || chr(10) || 'Schema: main' || CASE WHEN k % 4 = 0 THEN chr(10) || 'Description: about ' || (SELECT n_name FROM nation WHERE n_nationkey = k) ELSE '' END || coalesce(chr(10) || 'Depends on models: ' || {_FIRST.format('model.')}, '') || chr(10) || 'Depends on sources: ' || {_FIRST.format('source.')} AS summary FROM m
UNION ALL SELECT 'test.shop.not_null_' || name, 'test', 'raw', 'select null from ' || name, 'DBT Test: not_null_' || name || chr(10) || 'Validates: ' || name FROM m WHERE k % 6 = 0
UNION ALL SELECT 'macro.shop.m', 'macro', 'raw', '{{% macro m(a, b) %}}', 'DBT Macro: m' || chr(10) || 'Arguments: a, b'""")
def project_sql(spark, sf):
    return A.sql_documents(_nodes(spark, sf))


def _seed_files(spark, sf):
    """CSV files of the customers of each region, and one that is no seed."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: F.concat(x["c_custkey"].cast("string"), F.lit(","), x["c_name"])), "\n").alias("body"))
    named = F.when(F.col("n_regionkey") == 4, F.lit("other")).otherwise(F.concat(F.lit("seed_r"), "n_regionkey"))
    return rows.select(F.concat(F.lit("shop/data/"), named, F.lit(".csv")).alias("path"), F.concat(F.lit("id,name\n"), "body", F.lit("\n")).alias("content"))


@query("project_seeds", """WITH c AS (SELECT n_regionkey AS r, c_custkey AS id, c_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4),
s AS (SELECT r, count(*)::BIGINT AS n, 'id,name' || chr(10) || string_agg(id || ',' || name, chr(10) ORDER BY id) || chr(10) AS whole, 'id,name' || chr(13) || chr(10) || string_agg(id || ',' || name || chr(13) || chr(10), '' ORDER BY id) FILTER (k <= 10) AS head FROM c GROUP BY r),
u AS (SELECT n_regionkey AS r, count(*) AS n_models, list_sort(list(replace(lower(n_name), ' ', '_'))) AS models FROM nation GROUP BY 1)
SELECT 'seed_r' || r AS seed, n AS n_rows, n > 100 AS is_sample, md5(CASE WHEN n > 100 THEN head || chr(10) || chr(10) || '[Note: Showing 10 of ' || n || ' rows]' ELSE whole END) AS digest,
'DBT Seed: seed_r' || r || chr(10) || 'File: shop/data/seed_r' || r || '.csv' || chr(10) || 'Columns (2): id, name' || chr(10) || 'Rows: ' || n || chr(10) || 'Used by models: ' || array_to_string(models[1:5], ', ') || CASE WHEN n_models > 5 THEN chr(10) || '... and ' || (n_models - 5) || ' more' ELSE '' END AS summary FROM s JOIN u USING (r)""")
def project_seeds(spark, sf):
    found = A.seed_documents(_nodes(spark, sf), _seed_files(spark, sf))
    return found.select("seed", "n_rows", "is_sample", F.md5("content").alias("digest"), "summary")


@query("project_lookup", f"SELECT unique_id AS asked, unique_id, 'model' AS kind FROM ({_MODELS}) WHERE k % 2 = 0 UNION ALL SELECT name, unique_id, 'model' FROM ({_MODELS}) WHERE k % 2 = 1")
def project_lookup(spark, sf):
    """By full id, by plain name, and for names that aren't there."""
    name = F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))
    asked = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("model.shop."), name)).otherwise(name).alias("asked"))
    asked = asked.unionByName(spark.createDataFrame([("nowhere",), ("model.shop.nowhere",)], "asked string"))
    return A.lookup(_nodes(spark, sf), asked).select("asked", "unique_id", "kind")


@query("project_files", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT unnest(['manifest', 'project', 'seed', 'seed', 'seed', 'seed', 'seed']) AS kind) GROUP BY kind")
def project_files(spark, sf):
    """What of a repository's files belongs to its project."""
    other = spark.createDataFrame([("dbt_project.yml", "name: shop"), ("src/a.py", "x"), ("docs/t.csv", "a,b")], "path string, content string")
    files = _manifest(spark, sf).unionByName(_seed_files(spark, sf)).unionByName(other)
    return A.collected(files).groupBy("kind").agg(F.count("*").alias("n"))


@query("project_documents", "SELECT 'model' AS kind, 25::BIGINT AS n UNION ALL SELECT 'test', (SELECT count(*) FROM nation WHERE n_nationkey % 6 = 0) UNION ALL SELECT 'macro', 1 UNION ALL SELECT 'seed', 4")
def project_documents(spark, sf):
    other = spark.createDataFrame([("dbt_project.yml", "name: shop")], "path string, content string")
    files = _manifest(spark, sf).unionByName(_seed_files(spark, sf)).unionByName(other)
    return A.project_documents(files).groupBy("kind").agg(F.count("*").alias("n"))


@query("lineage_statistics", f"""WITH RECURSIVE e AS ({history._EDGES}), w AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region),
down AS (SELECT id, dst AS node FROM w JOIN e ON src = id UNION ALL SELECT id, e.dst FROM down JOIN e ON down.node = e.src), up AS (SELECT id, src AS node FROM w JOIN e ON dst = id UNION ALL SELECT id, e.src FROM up JOIN e ON up.node = e.dst)
SELECT id, (SELECT count(*) FROM e WHERE src = id)::BIGINT AS direct_downstream, (SELECT count(*) FROM e WHERE dst = id)::BIGINT AS direct_upstream, (SELECT count(*) FROM down d WHERE d.id = w.id)::BIGINT AS total_downstream, (SELECT count(*) FROM up u WHERE u.id = w.id)::BIGINT AS total_upstream,
(SELECT count(*) FROM down d WHERE d.id = w.id AND starts_with(node, 'c'))::BIGINT AS downstream_models, (SELECT count(*) FROM down d WHERE d.id = w.id AND starts_with(node, 's'))::BIGINT AS downstream_tests, (SELECT count(*) FROM up u WHERE u.id = w.id AND starts_with(node, 'c'))::BIGINT AS upstream_models, (SELECT count(*) FROM up u WHERE u.id = w.id AND starts_with(node, 'r'))::BIGINT AS upstream_sources FROM w""")
def lineage_statistics(spark, sf):
    wanted = history._nodes(spark, sf).filter("type IN ('nation', 'region')").select("id")
    return L.node_statistics(history._nodes(spark, sf), history._edges(spark, sf), wanted, "customer", "supplier", "region")


# -- flows

_SEM10 = "SELECT doc_id, score FROM semp WHERE rank <= 10"


@query("retrieve_strategies", f"""WITH {retrieval._LISTS}, s20 AS (SELECT doc_id, (21 - rank) / 20 AS s FROM semp WHERE rank <= 20), k20 AS (SELECT doc_id, ((SELECT count(*) FROM kwp WHERE rank <= 20) + 1 - rank) / (SELECT count(*) FROM kwp WHERE rank <= 20) AS k FROM kwp WHERE rank <= 20),
h AS (SELECT doc_id, round(0.7 * coalesce(s, 0) + 0.3 * coalesce(k, 0), 6) AS score FROM s20 FULL JOIN k20 USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10)
SELECT 'hybrid' AS strategy, doc_id, score FROM h UNION ALL SELECT 'semantic', * FROM ({_SEM10}) UNION ALL SELECT 'keyword', doc_id, score FROM kwp WHERE rank <= 10 UNION ALL SELECT 'other', * FROM ({_SEM10})""")
def retrieve_strategies(spark, sf):
    """The four answers of the dispatch."""
    legs = (lambda k: retrieval._sem(spark, sf, k), lambda k: retrieval._kw(spark, sf, k))
    out = None
    for name in ("hybrid", "semantic", "keyword", "other"):
        rows = C.retrieve(name, *legs, 10).select(F.lit(name).alias("strategy"), "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("fused_and_reranked", f"""WITH {retrieval._LISTS}, f AS (SELECT doc_id, substring(text, 1, 512) AS text, round((0.7 * coalesce(sem.score, 0) + 0.3 * coalesce(kw.score, 0)) * CASE WHEN {retrieval._FUSION_TERMS} THEN 1.2 ELSE 1.0 END, 6) AS fused FROM sem FULL JOIN kw USING (doc_id) JOIN documents USING (doc_id) ORDER BY fused DESC, doc_id LIMIT 20)
SELECT doc_id, round({retrieval._rerank_sql(ASK)}, 6) AS score FROM f ORDER BY score DESC, doc_id LIMIT 5""")
def fused_and_reranked(spark, sf):
    return C.fused_and_reranked(retrieval._sem(spark, sf), retrieval._kw(spark, sf), table(spark, sf, "documents"), ASK, 20, 5)


@query("multi_query_context", f"""WITH {retrieval._MULTI}, {retrieval._LISTS},
agg AS (SELECT * FROM (SELECT doc_id, frequency, row_number() OVER (ORDER BY final DESC, doc_id) AS rank FROM (SELECT vec_id AS doc_id, count(*)::BIGINT AS frequency, round(count(*) * avg(score), 9) AS final FROM multi GROUP BY vec_id HAVING count(*) >= 2)) WHERE rank <= 10),
first AS (SELECT doc_id, rank, 0 AS part FROM agg WHERE rank <= 7), fresh AS (SELECT doc_id, rank, 1 AS part FROM kwp WHERE rank <= 10 AND doc_id NOT IN (SELECT doc_id FROM first) ORDER BY rank, doc_id LIMIT 3),
every AS (SELECT * FROM first UNION ALL SELECT * FROM fresh UNION ALL SELECT doc_id, rank, 2 FROM agg WHERE rank > 7)
SELECT e.doc_id, ['semantic', 'keyword', 'backfill'][part + 1] AS origin, row_number() OVER (ORDER BY part, e.rank, e.doc_id)::INT AS position, frequency FROM every e LEFT JOIN agg ON e.doc_id = agg.doc_id QUALIFY position <= 10""")
def multi_query_context(spark, sf):
    return C.multi_query_context(retrieval._multi(spark, sf).withColumnRenamed("vec_id", "chunk_id"), retrieval._kw(spark, sf, 10))


@query("hierarchical_summaries", f"""WITH m AS (SELECT label, p, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p), s AS (SELECT label, list(x ORDER BY p) AS embedding FROM m GROUP BY label),
q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), b AS (SELECT label, {retrieval._COS.format('s.embedding', 'q.embedding')} AS score FROM s, q ORDER BY score DESC, label LIMIT 5)
SELECT 'summary_' || label AS summary_id, vec_id AS chunk_id, {retrieval._COS.format('e.embedding', 'q.embedding')} AS score, row_number() OVER (PARTITION BY label ORDER BY {retrieval._COS.format('e.embedding', 'q.embedding')} DESC, vec_id)::INT AS rank FROM embeddings e JOIN (SELECT label AS l FROM b WHERE score >= 0.05) ON label = l, q QUALIFY rank <= 5""")
def hierarchical_summaries(spark, sf):
    """Summaries have the mean vector of their chunks; the question is the first vector."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("summary_"), "label").alias("summary_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    mean = e.select("summary_id", F.posexplode("embedding").alias("p", "x")).groupBy("summary_id", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    summaries = mean.groupBy("summary_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("embedding")).withColumn("summary", F.col("summary_id"))
    asked = V.literal(retrieval._vector(spark, sf))
    return C.hierarchical(summaries, e, lambda v: F.round(V.cosine(v, asked), 6), least=0.05).select("summary_id", "chunk_id", "score", "rank")


@query("evaluation_step", f"SELECT event_id, {history._OVERALL} AS overall, ({' + '.join(f'({n} < {b})::INT' for n, b in history._BOUNDS.items())})::INT AS n_violations, array_to_string(list_filter([{', '.join(f'CASE WHEN {n} < {b} THEN {chr(39)}{n}{chr(39)} END' for n, b in history._BOUNDS.items())}], lambda x: x IS NOT NULL), ',') AS alerts FROM ({history._SCORES}) WHERE ('0x' || substring(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1000 < 100")
def evaluation_step(spark, sf):
    return C.evaluate(history._scores(spark, sf), history._BOUNDS, 100)


@query("truncated_contexts")
def truncated_contexts(spark, sf):
    """Conversations as contexts of several documents, cut to a small budget; tests hold it against the parts."""
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n---\n").alias("context"))
    return context.truncated(c, ASK, 400, 100)


@query("answer_without_model")
def answer_without_model(spark, sf):
    return C.answer(table(spark, sf, "documents").filter("text IS NOT NULL"), ASK)


# -- answers of models

@query("expansion_answers", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN text || '|b' WHEN 1 THEN text WHEN 2 THEN 'first variation|second variation' END AS variations, CASE item_id % 4 WHEN 0 THEN 'shop' ELSE 'general' END AS project, CASE item_id % 4 WHEN 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM benchmark WHERE item_id % 4 < 3")
def expansion_answers(spark, sf):
    """Fenced JSON, JSON without project and confidence, lines, and an answer that is of no use."""
    full = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array("text", F.lit("b")).alias("variations"), F.lit("shop").alias("project"), F.lit(0.9).alias("confidence"))), F.lit("\n```"))
    bare = F.to_json(F.struct(F.array("text").alias("variations")))
    kind = F.col("item_id") % 4
    raw = F.when(kind == 0, full).when(kind == 1, bare).when(kind == 2, "Here they are:\n1. first variation\n2) \"second variation\"").otherwise('{"project": "x"}')
    rows = table(spark, sf, "benchmark").select("item_id", T.expansion_answer(raw).alias("a")).filter("a IS NOT NULL")
    return rows.select("item_id", F.array_join("a.variations", "|").alias("variations"), "a.project", "a.confidence")


@query("fallback_variations", "SELECT item_id, array_to_string(['What is ' || text || '?', 'Explain ' || text, 'Define ' || text], '|') AS first, len(list_distinct([text, 'What is ' || text || '?', 'Explain ' || text, 'Define ' || text, replace(text, '?', ''), replace(text, 'how', 'what'), replace(text, 'is', 'are'), lower(text), lower(upper(text))]))::INT - 1 AS n FROM benchmark")
def fallback_variations(spark, sf):
    v = T.fallback_variations(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.slice(v, 1, 3), "|").alias("first"), F.size(v).alias("n"))


@query("summary_rows", "SELECT doc_id AS original_doc_id, source AS topics, lang || ', x' AS keywords, 'a, b' AS tech_tables, 'Document: f' || doc_id || chr(10) || 'Type: sql' || chr(10) || chr(10) || 'Summary:' || chr(10) || 'about ' || source || chr(10) || chr(10) || 'Keywords: ' || lang || ', x' || chr(10) || 'Topics: ' || source AS content FROM documents WHERE doc_id % 5 > 0 AND source IS NOT NULL AND lang IS NOT NULL")
def summary_rows(spark, sf):
    """Model answers to rows of the summary index; every fifth answer isn't JSON and is skipped."""
    details = F.create_map(F.lit("tables"), F.lit('["a","b"]'), F.lit("inner"), F.lit('{"x": 1}'))
    good = F.to_json(F.struct(F.concat(F.lit("about "), "source").alias("summary"), F.array("lang", F.lit("x")).alias("keywords"), F.array("source").alias("topics"), details.alias("technical_details")))
    d = table(spark, sf, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    rows = d.select("doc_id", F.concat(F.lit("f"), "doc_id").alias("filename"), F.lit("p").alias("file_path"), F.lit("sql").alias("document_type"), F.lit("repo_file").alias("source_type"), F.when(F.col("doc_id") % 5 == 0, "sorry").otherwise(good).alias("answer"))
    return writers.summary_documents(rows).select("original_doc_id", "topics", "keywords", F.col("details")["tech_tables"].alias("tech_tables"), "content")


# -- logs, keys and caches

@query("metric_logs", "WITH s AS (" + history._SCORES + "), l AS (" + " UNION ALL ".join(f"SELECT event_id, '{n}' AS metric, {n}::DOUBLE AS value, {n} >= {b} AS ok FROM s" for n, b in history._BOUNDS.items()) + ") SELECT event_id, CASE WHEN starts_with(metric, 'context_') THEN 'retrieval' ELSE 'generation' END AS log, metric, round(value, 9) AS value FROM l UNION ALL SELECT event_id, 'alerts', metric, round(value, 9) FROM l WHERE NOT ok")
def metric_logs(spark, sf):
    events = writers.evaluation_events(history._scores(spark, sf).withColumn("query", F.lit("q")), history._BOUNDS)
    return writers.metric_logs(events).withColumn("value", F.round("value", 9))


@query("source_keys", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'repo_file' WHEN 1 THEN 'wiki_page' ELSE 'local_file' END AS source_type, CASE page_id % 3 WHEN 1 THEN page_id::VARCHAR ELSE url END AS document_id, CASE page_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 's1' ELSE 'local' END AS location FROM pages WHERE page_id % 7 > 0")
def source_keys(spark, sf):
    """Keys of three kinds of chunks; every seventh is of an unknown kind and has none."""
    kind = F.when(F.col("page_id") % 7 == 0, "mail").when(F.col("page_id") % 3 == 0, "repo_file").when(F.col("page_id") % 3 == 1, "wiki_page").otherwise("local_files")
    meta = F.create_map(F.lit("source_type"), kind, F.lit("source"), F.col("url"), F.lit("page_id"), F.col("page_id").cast("string"), F.lit("space_key"), F.lit("s1"))
    rows = table(spark, sf, "pages").select("page_id", C.source_keys(meta).alias("k")).filter("k IS NOT NULL")
    return rows.select("page_id", "k.source_type", "k.document_id", "k.location")


@query("result_cache", "WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) SELECT user_id AS key FROM l, n WHERE epoch_us(now) // 1000000 - epoch_us(seen) // 1000000 < 86400 ORDER BY seen DESC, user_id LIMIT 100")
def result_cache(spark, sf):
    """Results that a cache of a day and a hundred entries would still have at the time of the last event."""
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return C.fresh_results(e.select(F.col("user_id").alias("key"), F.col("ts").alias("at")), F.lit(now), 86400).select("key")


@query("session_ratings", "SELECT user_id, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type")
def session_ratings(spark, sf):
    return E.rated_summary(table(spark, sf, "events"), "user_id", "event_type", "value")


@query("document_status", "SELECT source, chunk_count, status FROM (SELECT doc_id, * FROM (" + history._TRACKED.replace("SELECT source", "SELECT doc_id, source") + ")) WHERE doc_id = 11")
def document_status(spark, sf):
    """Point lookup in the tracker."""
    return history._tracked(spark, sf).filter("doc_id = 11").select("source", "chunk_count", "status")


@query("identities", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'c' || doc_id WHEN 1 THEN 'i' || doc_id ELSE md5(text) END AS identity, md5(trim(lower(text), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS cache_key, source || ':1-' || n_chars AS citation, printf('%.0f%%', n_chars / 4.0) AS share FROM documents WHERE text IS NOT NULL")
def identities(spark, sf):
    named = lambda k, p: F.when(F.col("doc_id") % 3 == k, F.concat(F.lit(p), "doc_id"))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.chunk_identity(named(0, "c"), named(1, "i"), F.col("text")).alias("identity"), T.cache_key(F.col("text")).alias("cache_key"), T.citation(F.col("source"), F.lit(1), F.col("n_chars")).alias("citation"), T.percentage(F.col("n_chars") / 4).alias("share"))


@query("audience_answers", "SELECT content, audience, simplified, details FROM (SELECT text AS content, 'business' AS audience, true AS simplified, NULL::VARCHAR AS details FROM conversations WHERE role = 'assistant' UNION ALL SELECT text, 'technical', NULL, 'turn ' || turn FROM conversations WHERE role = 'assistant')")
def audience_answers(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'assistant'").select(F.col("text").alias("response"), F.array().cast("array<string>").alias("sources"), F.lit(0.5).alias("confidence_score"), F.lit(1.0).alias("safety_score"), F.concat(F.lit("turn "), "turn").alias("metadata"))
    plain = C.for_audience(c).select("content", "audience", "simplified", F.lit(None).cast("string").alias("details"))
    return plain.unionByName(C.for_audience(c, "technical").select("content", "audience", F.lit(None).cast("boolean").alias("simplified"), F.col("technical_details").alias("details")))


@query("log_projection", f"WITH {retrieval._MULTI} SELECT query_index, rank::INT AS rank, 'vectors/' || vec_id AS source, vec_id::VARCHAR AS filename FROM multi WHERE rank <= 10")
def log_projection(spark, sf):
    hits = retrieval._multi(spark, sf).withColumns({"source": F.concat(F.lit("vectors/"), "vec_id"), "source_type": F.lit("vector")})
    return C.log_rows(hits, ["query_index"]).select("query_index", "rank", "source", "filename")


@query("aggregated_documents", f"WITH {retrieval._MULTI} SELECT doc_id, source, frequency AS aggregation_frequency, final_score AS aggregation_final_score FROM documents JOIN (SELECT vec_id, count(*)::BIGINT AS frequency, round(count(*) * avg(score), 9) AS final_score FROM multi GROUP BY vec_id HAVING count(*) >= 2 ORDER BY final_score DESC, vec_id LIMIT 10) ON doc_id = vec_id")
def aggregated_documents(spark, sf):
    found = fusion.frequency_relevance(retrieval._multi(spark, sf).withColumnRenamed("vec_id", "chunk_id"))
    return C.as_documents(found, table(spark, sf, "documents")).select("doc_id", "source", "aggregation_frequency", "aggregation_final_score")


_WIKI = "SELECT page_id, 's' || page_id % 3 AS space_key, CASE WHEN page_id > 0 THEN page_id // 4 END AS parent_id, url, html FROM pages"


def _wiki(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("s"), F.col("page_id") % 3).alias("space_key"), F.when(F.col("page_id") > 0, F.floor(F.col("page_id") / 4)).alias("parent_id"), "url", "html")


@query("wiki_tree", f"WITH RECURSIVE w AS ({_WIKI}), t AS (SELECT page_id, 1 AS depth FROM w WHERE parent_id = 1 UNION ALL SELECT w.page_id, depth + 1 FROM t JOIN w ON w.parent_id = t.page_id) SELECT page_id, depth::INT AS depth FROM t")
def wiki_tree(spark, sf):
    return readers.child_pages(_wiki(spark, sf), "1")


@query("wiki_by_space", f"SELECT page_id::VARCHAR AS doc_id, space_key FROM ({_WIKI}) WHERE space_key IN ('s1', 's2') QUALIFY row_number() OVER (PARTITION BY space_key ORDER BY page_id) <= 5")
def wiki_by_space(spark, sf):
    return readers.wiki_spaces(_wiki(spark, sf), ["s1", "s2"], most=5).select("doc_id", "space_key")


@query("tracker_reports", f"SELECT source, 'success rate' AS report, count(*)::BIGINT AS n, round(avg((status = 'success')::INT), 6) AS value FROM ({history._TRACKED}) WHERE status IN ('success', 'failed') GROUP BY source UNION ALL SELECT source, 'largest', processed, chunk_count FROM ({history._TRACKED}) QUALIFY row_number() OVER (PARTITION BY source ORDER BY chunk_count DESC, processed) <= 3")
def tracker_reports(spark, sf):
    t = history._tracked(spark, sf)
    rates = K.success_rates(t, "source").select("source", F.lit("success rate").alias("report"), "n", F.col("success_rate").alias("value"))
    return rates.unionByName(K.largest(t, "source", "chunk_count", 3, "doc_id").select("source", F.lit("largest").alias("report"), F.col("doc_id").alias("n"), F.col("chunk_count").cast("double").alias("value")))


@query("hybrid_context_report", f"WITH {retrieval._CONTEXT} SELECT count(*) FILTER (origin <> 'keyword') AS n_semantic, count(*) FILTER (origin = 'keyword') AS n_keyword, printf('%.0f%%', count(*) FILTER (origin <> 'keyword') * 100.0 / count(*)) || '/' || printf('%.0f%%', count(*) FILTER (origin = 'keyword') * 100.0 / count(*)) AS actual_split, (SELECT count(*) FROM kwp WHERE doc_id IN (SELECT doc_id FROM first)) AS duplicates_removed, '70%/30%' AS target_split FROM ctx")
def hybrid_context_report(spark, sf):
    s, k = retrieval._ranked(retrieval._sem(spark, sf)), retrieval._ranked(retrieval._kw(spark, sf))
    return fusion.context_report(fusion.hybrid_context(s, k), k, s)


@query("multi_query_most_found", f"WITH {retrieval._MULTI} SELECT vec_id AS chunk_id, n AS frequency, row_number() OVER (ORDER BY n DESC, vec_id)::INT AS rank FROM (SELECT vec_id, count(*)::BIGINT AS n FROM multi GROUP BY vec_id) QUALIFY rank <= 10")
def multi_query_most_found(spark, sf):
    return fusion.most_found(retrieval._multi(spark, sf).withColumnRenamed("vec_id", "chunk_id"))


@query("chunks_of_documents", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE greatest(ceil((length(text) - 200) / 800.0)::BIGINT, 1) END::BIGINT AS n_chunks, CASE WHEN doc_id % 5 > 0 THEN doc_id || '_0' END AS first_chunk, CASE WHEN doc_id % 5 > 0 THEN lang END AS first_meta FROM documents WHERE text IS NOT NULL")
def chunks_of_documents(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    parts = chunking.exploded(d.filter("doc_id % 5 > 0"), chunking.fixed(F.col("text"), 1000, 200)).join(d.select("doc_id", F.col("lang").alias("meta")), "doc_id")
    chunks = parts.withColumn("chunk_id", F.concat_ws("_", "doc_id", "chunk_index"))
    return chunking.chunks_by_document(d.select("doc_id"), chunks, "doc_id")


@query("enriched_chunks", "SELECT doc_id, source, CASE WHEN source <> 'src3' THEN 'about ' || source END AS summary FROM documents WHERE source IS NOT NULL")
def enriched_chunks(spark, sf):
    d = table(spark, sf, "documents").filter("source IS NOT NULL")
    summaries = d.filter("source <> 'src3'").groupBy("source").agg(F.concat(F.lit("about "), F.first("source")).alias("summary"), F.lit("k").alias("keywords"), F.lit("t").alias("topics"))
    return chunking.with_summaries(d.select("doc_id", "source"), summaries, "source").select("doc_id", "source", "summary")


@query("performance_trend", f"""WITH p AS (SELECT event_type AS metric, count(*)::BIGINT AS n, round(avg(value), 9) AS mean FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50) GROUP BY 1),
l AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events QUALIFY k <= 20), m AS (SELECT event_type, avg(value) FILTER (k <= 5) AS a, avg(value) FILTER (k > 5) AS b FROM l GROUP BY 1 HAVING count(*) >= 10),
t AS (SELECT event_type, round(CASE WHEN b > 0 THEN (a - b) / b * 100 ELSE 0 END, 6) AS c FROM m) SELECT metric, n, mean, CASE WHEN abs(c) < 2 THEN 'stable' WHEN c > 0 THEN 'improving' ELSE 'declining' END AS trend FROM p LEFT JOIN t ON metric = event_type""")
def performance_trend(spark, sf):
    """Means over the last fifty of each metric beside its trend."""
    e, order = table(spark, sf, "events"), [F.desc("ts"), F.desc("event_id")]
    means = K.top_per_group(e, "event_type", order, 50).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"))
    trends = O.trend(e, "event_type", order, "value").select("event_type", "trend")
    return means.join(trends, "event_type", "left").select(F.col("event_type").alias("metric"), "n", "mean", "trend")


@query("dated_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1997-06-30' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def dated_filter(spark, sf):
    keep = P.metadata_filter(["F", "O"], "1996-01-01", "1997-06-30", ["1-URGENT", "2-HIGH"], source="o_orderstatus", date="o_orderdate", kind="o_orderpriority")
    return table(spark, sf, "orders").filter(keep).select("o_orderkey")


@query("whole_document_budget", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(length(text) + 19) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents WHERE text IS NOT NULL) WHERE used <= 20000")
def whole_document_budget(spark, sf):
    """Documents of each source in order, whole, until the first that doesn't fit."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("source", "doc_id", "text", F.col("doc_id").alias("rank"))
    return context.pack(d, 20000, partial=False, by="source").select("source", "doc_id")


@query("feedback_positions", "SELECT c.conv_id, p.place, t.role FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT unnest([0, 1, 99])::BIGINT AS place) p LEFT JOIN (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations) t ON t.conv_id = c.conv_id AND t.place = p.place")
def feedback_positions(spark, sf):
    c = table(spark, sf, "conversations")
    given = c.select("conv_id").distinct().select("conv_id", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 1, 99)))).alias("place"))
    return E.attach_by_position(given, c.select("conv_id", "turn", "role"), "conv_id", "place", "turn").select("conv_id", "place", "role")


@query("title_filter", "SELECT page_id::VARCHAR AS doc_id FROM pages WHERE contains(lower(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), 'the ')")
def title_filter(spark, sf):
    return readers.wiki_pages(table(spark, sf, "pages"), titles=["The "]).select("doc_id")


@query("code_files", "SELECT doc_id, doc_id % 4 < 3 AS is_code FROM documents")
def code_files(spark, sf):
    ends = F.element_at(F.array(*map(F.lit, (".py", ".SQL", ".yml", ".md"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    path = F.concat(F.lit("a/f"), F.col("doc_id").cast("string"), ends)
    return table(spark, sf, "documents").select("doc_id", readers.is_code(path).alias("is_code"))


@query("project_listing", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'model' AS kind FROM nation UNION ALL SELECT 'source' FROM region UNION ALL SELECT 'seed' FROM region) GROUP BY kind")
def project_listing(spark, sf):
    found = _nodes(spark, sf)
    parts = [A.listing(found, k).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("model", "source", "seed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("enhanced_queries", "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'cancer ' || lower(text) || CASE WHEN contains(lower(text), 'treatment') THEN '' ELSE ' treatment therapy' END WHEN 1 THEN 'tumor ' || lower(text) || CASE WHEN contains(lower(text), 'stage') THEN '' ELSE ' staging classification' END ELSE lower(text) END AS q FROM benchmark")
def enhanced_queries(spark, sf):
    asked = F.when(F.col("item_id") % 3 == 0, "Cancer ").when(F.col("item_id") % 3 == 1, "Tumor ").otherwise("")
    return table(spark, sf, "benchmark").select("item_id", expansion.enhance(F.concat(asked, "text")).alias("q"))


_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("split_contexts", f"SELECT doc_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(text || CASE doc_id % 3 WHEN 0 THEN '---' WHEN 1 THEN '===' ELSE '###' END || source, CASE doc_id % 3 WHEN 0 THEN '---' WHEN 1 THEN '===' ELSE '###' END), lambda x: trim(x, {_STRIP})), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND NOT regexp_matches(text, '---|Document:|Source:|===|###'))")
def split_contexts(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL AND source IS NOT NULL").filter(~F.rlike("text", F.lit("---|Document:|Source:|===|###")))
    mark = F.when(F.col("doc_id") % 3 == 0, "---").when(F.col("doc_id") % 3 == 1, "===").otherwise("###")
    parts = T.split_context(F.concat("text", mark, "source"))
    return d.select("doc_id", F.size(parts).alias("n"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query("decoded_texts", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'caf' || chr(233) END AS text FROM documents WHERE text IS NOT NULL")
def decoded_texts(spark, sf):
    """Bytes that are UTF-8, and bytes that are not and count as Latin-1."""
    raw = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.unhex(F.lit("636166E9")))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", readers.decoded(raw).alias("text"))


@query("tracker_valid", "SELECT doc_id FROM documents WHERE doc_id % 4 IN (0, 1) AND source IS NOT NULL")
def tracker_valid(spark, sf):
    status = F.element_at(F.array(F.lit("success"), F.lit("failed"), F.lit("done"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    return K.valid(table(spark, sf, "documents").select("doc_id", status.alias("status"), F.col("source").alias("source_type"), F.col("doc_id").cast("string").alias("document_id"))).select("doc_id")


@query("corpus_status", f"SELECT (SELECT count(*) FROM documents)::BIGINT AS n_documents, sum(greatest(ceil((length(text) - 200) / 800.0)::BIGINT, 1))::BIGINT AS n_chunks, count(*)::BIGINT AS n_chunked, (SELECT count(*) FROM ({history._TRACKED}))::BIGINT AS n_tracked, (SELECT count(*) FROM ({history._TRACKED}) WHERE status = 'failed')::BIGINT AS n_failed FROM documents WHERE text IS NOT NULL")
def corpus_status(spark, sf):
    d = table(spark, sf, "documents")
    return K.corpus_status(d, chunking.exploded(d.filter("text IS NOT NULL"), chunking.fixed(F.col("text"), 1000, 200)), history._tracked(spark, sf))


@query("source_union", "SELECT 'wiki_page' AS source_type, count(*)::BIGINT AS n FROM pages UNION ALL SELECT 'document', count(*) FROM documents")
def source_union(spark, sf):
    """Two sources and an empty one under one schema."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("document").alias("source_type"), "source", "text")
    every = readers.union_sources([readers.tickets(spark), readers.wiki_pages(table(spark, sf, "pages"), least=0), docs])
    return every.groupBy("source_type").agg(F.count("*").alias("n"))


@query("activity_log", "SELECT 'search' AS event_type, 'u' || user_id AS session_id, event_type AS query, trunc(value * 1000)::BIGINT AS total_time_ms FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'feedback_' || event_type, 'u' || user_id, NULL, NULL FROM events WHERE event_id % 2 = 1")
def activity_log(spark, sf):
    """Search and feedback events under the schema of the log."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("session_id"), F.col("event_type").alias("query"), F.lit(3).cast("long").alias("num_results"), F.col("value").alias("seconds"), F.col("event_type").alias("kind"), F.lit("c").alias("comment"))
    searches = writers.search_events(e.filter("event_id % 2 = 0")).select("event_type", "session_id", "query", "results.total_time_ms")
    given = writers.feedback_events(e.filter("event_id % 2 = 1").withColumn("query", F.lit(None).cast("string")))
    return searches.unionByName(given.select("event_type", "session_id", "query", F.lit(None).cast("long").alias("total_time_ms")))


@query("project_defaults", "SELECT 'some' AS asked, project FROM (SELECT DISTINCT source AS project FROM documents WHERE lang = 'fr' AND source IS NOT NULL) UNION ALL SELECT 'none', * FROM (VALUES ('general'), ('shared')) t(project) WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'fr' AND text IS NULL AND source IS NOT NULL)")
def project_defaults(spark, sf):
    """Projects of the French documents, and of those without a text: the default ones, unless there are some."""
    d = table(spark, sf, "documents").filter("lang = 'fr'")
    default = ("general", "shared")
    some = C.projects(d, "source", default).select(F.lit("some").alias("asked"), "project")
    return some.unionByName(C.projects(d.filter("text IS NULL"), "source", default).select(F.lit("none").alias("asked"), "project"))


@query("cached_lookup", "WITH l AS (SELECT user_id AS key, max(ts) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1), a AS (SELECT DISTINCT user_id AS key FROM events) SELECT key, CASE WHEN seen IS NULL THEN 404 ELSE 200 END::INT AS status, epoch_us(seen)::BIGINT AS seen FROM a LEFT JOIN l USING (key)")
def cached_lookup(spark, sf):
    """The newest purchase of every user, and who has none."""
    e = table(spark, sf, "events")
    cache = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    return C.cached_results(cache, e.select(F.col("user_id").alias("key")).distinct()).select("key", "status", F.unix_micros(F.col("at").cast("timestamp")).alias("seen"))


@query("daily_files", "SELECT strftime(ts, '%Y-%m-%d') || '.jsonl' AS file, count(*)::BIGINT AS n FROM events GROUP BY 1")
def daily_files(spark, sf):
    return table(spark, sf, "events").groupBy(T.daily_file(F.col("ts")).alias("file")).agg(F.count("*").alias("n"))


@query("web_urls", "SELECT doc_id, 'https://host/_git/' || source || '?path=/' || lang || '/' || md5(text) || '.md&version=GBmain' AS url FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def web_urls(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
    path = F.concat(F.lit("/"), "lang", F.lit("/"), F.md5("text"), F.lit(".md"))
    return d.select("doc_id", T.web_url(F.lit("https://host"), F.col("source"), path, F.lit("refs/heads/main")).alias("url"))


@query("aggregation_routed", f"""WITH {retrieval._MULTI}, g AS (SELECT vec_id AS chunk_id, count(*) AS f, avg(score) AS a, max(score) AS m FROM multi GROUP BY vec_id HAVING count(*) >= 2),
r AS (SELECT method, chunk_id, round(CASE method WHEN 'max' THEN m WHEN 'average' THEN a ELSE f * a END, 9) AS final_score FROM g, (VALUES ('frequency_relevance'), ('max'), ('average'), ('other')) t(method))
SELECT method, chunk_id, final_score FROM r QUALIFY row_number() OVER (PARTITION BY method ORDER BY final_score DESC, chunk_id) <= 10""")
def aggregation_routed(spark, sf):
    """Each method by its name, and what an unknown name stands for."""
    hits = retrieval._multi(spark, sf).withColumnRenamed("vec_id", "chunk_id")
    parts = [fusion.aggregate(hits, m).select(F.lit(m).alias("method"), "chunk_id", "final_score") for m in (*fusion.AGGREGATIONS, "other")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
