"""Queries: tracker, lineage, evaluation, activity and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E, lineage as L, ordered as O, tracker as K
from corpusmill.plans.registry import query, table
from corpusmill.sources import keyed
from corpusmill.workspace import Workspace

# -- tracker: documents stand in for scans, every third one is unknown and some have other hashes

_OLD = "SELECT 'doc' AS source_type, doc_id::VARCHAR AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256(text) END AS content_hash, (doc_id % 7)::VARCHAR AS modified, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status FROM documents WHERE doc_id % 3 <> 0"
_NEW = "SELECT 'doc' AS source_type, doc_id::VARCHAR AS document_id, sha256(text) AS content_hash, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 14)::VARCHAR END AS modified FROM documents"
_CHANGES = f"""SELECT n.document_id, CASE WHEN o.document_id IS NULL THEN 'new_document' WHEN o.content_hash IS DISTINCT FROM n.content_hash THEN 'content_changed'
WHEN n.modified IS NOT NULL AND n.modified IS DISTINCT FROM o.modified THEN 'modified_date_changed' WHEN o.status = 'failed' THEN 'retry_failed' ELSE 'unchanged' END AS reason FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (source_type, document_id)"""


def _changes(spark, sf):
    d = table(spark, sf, "documents").withColumns({"source_type": F.lit("doc"), "document_id": F.col("doc_id").cast("string"), "hash": F.sha2(F.col("text").cast("binary"), 256)})
    old = d.filter("doc_id % 3 <> 0").select("source_type", "document_id", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("hash")).alias("content_hash"), (F.col("doc_id") % 7).cast("string").alias("modified"), F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("success").alias("status"))
    new = d.select("source_type", "document_id", F.col("hash").alias("content_hash"), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 14).cast("string")).alias("modified"))
    return K.detect_changes(new, old)


@query("change_detect", _CHANGES)
def change_detect(spark, sf):
    return _changes(spark, sf).select("document_id", "reason")


@query("change_counts", f"SELECT reason, count(*)::BIGINT AS n FROM ({_CHANGES}) GROUP BY reason")
def change_counts(spark, sf):
    return K.change_counts(_changes(spark, sf))


_ORD = "SELECT o_custkey AS k, o_orderkey AS v, o_orderdate AS updated_at, o_orderpriority AS created_by FROM orders"


@query("tracker_upsert", f"""WITH o AS (SELECT * FROM ({_ORD}) WHERE v % 2 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY updated_at DESC, v DESC) = 1),
n AS (SELECT * FROM ({_ORD}) WHERE v % 2 = 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY updated_at DESC, v DESC) = 1)
SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL THEN o.v ELSE n.v END AS v, CASE WHEN o.k IS NOT NULL THEN o.created_by ELSE n.created_by END AS created_by FROM o FULL JOIN n ON o.k = n.k""")
def tracker_upsert(spark, sf):
    from corpusmill.operators import dedupe

    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderpriority").alias("created_by"))
    newest = lambda r: dedupe.first_of(r, ["k"], [F.desc("updated_at"), F.desc("v")])
    return K.upsert(newest(rows.filter("v % 2 = 0")), newest(rows.filter("v % 2 = 1")), ["k"], preserved=["created_by"]).select("k", "v", "created_by")


@query("tracker_partial_upsert", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS source, lang FROM documents")
def tracker_partial_upsert(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    new = d.filter("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"), F.lit("zz").alias("lang"))
    return K.partial_upsert(d, new, ["doc_id"], ["source"])


@query("tracker_delete", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tracker_delete(spark, sf):
    return K.delete(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").filter("toxic = 1"), ["doc_id"])


_TRACKED = "SELECT source, (n_chars // 1000)::BIGINT AS chunk_count, CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'skipped' ELSE 'success' END AS status, n_chars / 1000.0 AS seconds, doc_id AS processed FROM documents"
_STATS = "count(*)::BIGINT AS n_documents, coalesce(sum(chunk_count), 0)::BIGINT AS n_chunks, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped, round(avg(seconds), 6) AS avg_seconds, max(processed) AS last_processed"


def _tracked(spark, sf):
    status = F.when(F.col("doc_id") % 11 == 0, "failed").when(F.col("doc_id") % 13 == 0, "skipped").otherwise("success")
    return table(spark, sf, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 1000).alias("chunk_count"), status.alias("status"), (F.col("n_chars") / 1000).alias("seconds"), F.col("doc_id").alias("processed"))


@query("tracker_stats", f"SELECT count(DISTINCT source)::BIGINT AS n_sources, {_STATS} FROM ({_TRACKED})")
def tracker_stats(spark, sf):
    return K.stats(_tracked(spark, sf))


@query("tracker_stats_by_source", f"SELECT source, {_STATS} FROM ({_TRACKED}) GROUP BY source")
def tracker_stats_by_source(spark, sf):
    return K.stats(_tracked(spark, sf), ["source"])


@query("failed_docs", f"SELECT processed AS doc_id, source FROM ({_TRACKED}) WHERE status = 'failed' ORDER BY processed DESC LIMIT 25")
def failed_docs(spark, sf):
    return K.recent(_tracked(spark, sf).filter("status = 'failed'"), 25, "processed", "doc_id").select("doc_id", "source")


@query("latest_per_key", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 1")
def latest_per_key(spark, sf):
    return K.top_per_group(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey", "rank")


@query("commit_topn", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rank) AS commits FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10 GROUP BY o_custkey")
def commit_topn(spark, sf):
    top = K.top_per_group(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 10)
    return top.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))).alias("l")).select("o_custkey", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("commits"))


@query("commit_stats", "SELECT count(*)::BIGINT AS n_files, sum(n)::BIGINT AS n_commits, round(avg(n), 6) AS per_file FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def commit_stats(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_files"), F.sum("n").alias("n_commits"), F.round(F.avg("n"), 6).alias("per_file"))


# -- lineage: region -> nation -> customer and supplier, as one graph

_EDGES = "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"
_NODES = "SELECT 'r' || r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier"


def _edges(spark, sf):
    pair = lambda t, a, x, b, y: table(spark, sf, t).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    return pair("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(pair("customer", "n", "c_nationkey", "c", "c_custkey")).unionByName(pair("supplier", "n", "s_nationkey", "s", "s_suppkey"))


def _nodes(spark, sf):
    parts = [table(spark, sf, t).select(F.concat(F.lit(t[0]), k).alias("id"), F.concat(F.lit(t), F.lit("-"), k).alias("name"), F.lit(t).alias("type")) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("lineage_direct", f"SELECT src AS start, dst AS node FROM ({_EDGES}) WHERE starts_with(src, 'n')")
def lineage_direct(spark, sf):
    start = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"))
    return L.neighbours(_edges(spark, sf), start)


@query("lineage_down", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src AS start, dst AS node, 1 AS depth FROM e WHERE starts_with(src, 'r') UNION ALL SELECT start, e.dst, depth + 1 FROM r JOIN e ON r.node = e.src) SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY ALL")
def lineage_down(spark, sf):
    start = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return L.reachable(_edges(spark, sf), start)


@query("lineage_up", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT dst AS start, src AS node, 1 AS depth FROM e WHERE starts_with(dst, 's') UNION ALL SELECT start, e.src, depth + 1 FROM r JOIN e ON r.node = e.dst) SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY ALL")
def lineage_up(spark, sf):
    start = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("start"))
    return L.reachable(_edges(spark, sf), start, up=True)


@query("lineage_traversed", f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT src AS start, dst AS node FROM e WHERE src = 'r1' UNION ALL SELECT start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start, count(*)::BIGINT AS n FROM r GROUP BY start")
def lineage_traversed(spark, sf):
    start = table(spark, sf, "region").filter("r_regionkey = 1").select(F.concat(F.lit("r"), "r_regionkey").alias("start"))
    return L.traversed(_edges(spark, sf), start).groupBy("start").agg(F.count("*").alias("n"))


@query("lineage_by_type", f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT src AS start, type, count(*)::BIGINT AS n FROM e JOIN n ON e.dst = n.id WHERE starts_with(src, 'n') GROUP BY ALL")
def lineage_by_type(spark, sf):
    start = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("start"))
    return L.of_type(_nodes(spark, sf), L.neighbours(_edges(spark, sf), start)).groupBy("start", "type").agg(F.count("*").alias("n"))


@query("lineage_stats", f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT id, (SELECT count(*) FROM e WHERE dst = id)::BIGINT AS direct_up, (SELECT count(*) FROM e WHERE src = id)::BIGINT AS direct_down FROM n")
def lineage_stats(spark, sf):
    return L.node_stats(_nodes(spark, sf), _edges(spark, sf))


@query("graph_summary", f"WITH e AS ({_EDGES}), n AS ({_NODES}), c AS (SELECT src, count(*) AS k FROM e GROUP BY src) SELECT type, count(*)::BIGINT AS n_nodes, coalesce(sum(k), 0)::BIGINT AS n_edges FROM n LEFT JOIN c ON id = src GROUP BY type")
def graph_summary(spark, sf):
    return L.summary(_nodes(spark, sf), _edges(spark, sf))


@query("seed_refs", "WITH m AS (SELECT DISTINCT l_suppkey AS model, l_partkey AS seed FROM lineitem), p AS (SELECT p_partkey AS seed FROM part) SELECT p.seed::VARCHAR AS seed, coalesce(string_agg(model::VARCHAR, ',' ORDER BY model::VARCHAR), '') AS models, count(model)::BIGINT AS n FROM p LEFT JOIN m USING (seed) GROUP BY p.seed")
def seed_refs(spark, sf):
    models = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("model")).agg(F.collect_set(F.concat(F.lit("seed.shop."), "l_partkey")).alias("depends_on"))
    found = L.references(models, table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("seed")))
    return found.withColumn("models", F.array_join("models", ","))


@query("column_merge", "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS node, coalesce(c.k, s.k) AS \"column\", coalesce(d, '') AS description, t AS type, i AS index FROM (SELECT c_nationkey, c_custkey % 100 AS k, max(c_name) AS d FROM customer GROUP BY ALL) c FULL JOIN (SELECT s_nationkey, s_suppkey % 100 AS k, max(s_name) AS t, max(s_suppkey) AS i FROM supplier GROUP BY ALL) s ON c_nationkey = s_nationkey AND c.k = s.k")
def column_merge(spark, sf):
    manifest = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("node"), (F.col("c_custkey") % 100).alias("column")).agg(F.max("c_name").alias("description"))
    catalog = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("node"), (F.col("s_suppkey") % 100).alias("column")).agg(F.max("s_name").alias("type"), F.max("s_suppkey").alias("index"))
    return L.merge_columns(manifest, catalog)


# -- evaluation: sources are queries, labels tell what is relevant

_RESULTS = "SELECT source AS query_index, lang AS source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, coalesce(quality, 0) = 1 AS relevant FROM documents LEFT JOIN labels USING (doc_id) QUALIFY rank <= 20"


def _results(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    top = K.top_per_group(labelled, "source", [F.desc("n_chars"), F.col("doc_id")], 20)
    return top.select(F.col("source").alias("query_index"), F.col("lang").alias("source"), "rank", (F.coalesce("quality", F.lit(0)) == 1).alias("relevant"))


@query("precision_at_k", f"SELECT query_index, round(sum(CASE WHEN rank <= 5 AND relevant THEN 1 ELSE 0 END) / least(count(*), 5), 6) AS precision_at_k FROM ({_RESULTS}) GROUP BY 1")
def precision_at_k(spark, sf):
    return E.precision_at_k(_results(spark, sf), 5)


@query("mrr", f"SELECT count(*)::BIGINT AS n_queries, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM (SELECT min(rank) FILTER (relevant) AS f FROM ({_RESULTS}) GROUP BY query_index)")
def mrr(spark, sf):
    return E.mean_reciprocal_rank(_results(spark, sf))


@query("hit_rate_at_k", f"SELECT count(*)::BIGINT AS n_queries, round(avg(h), 6) AS hit_rate FROM (SELECT max(CASE WHEN rank <= 3 AND relevant THEN 1.0 ELSE 0.0 END) AS h FROM ({_RESULTS}) GROUP BY query_index)")
def hit_rate_at_k(spark, sf):
    return E.hit_rate_at_k(_results(spark, sf), 3)


@query("chunk_overlap", f"SELECT query_index, round(CASE WHEN sum(n) < 2 THEN 0 ELSE sum(n - 1) / greatest(sum(n) - 1, 1) END, 6) AS chunk_overlap FROM (SELECT query_index, source, count(*) AS n FROM ({_RESULTS}) GROUP BY ALL) GROUP BY 1")
def chunk_overlap(spark, sf):
    return E.chunk_overlap(_results(spark, sf))


def _has(col, words):
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


_PAIRS = "SELECT a.conv_id, a.turn, q.text AS q, a.text AS r FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1"


def _pairs(spark, sf):
    c = table(spark, sf, "conversations")
    q = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    return c.join(q, ["conv_id", "turn"]).select("conv_id", "turn", "q", F.col("text").alias("r"))


@query("safety_score", f"SELECT conv_id, turn, round(greatest(0.0, least(1.0, 1.0 - CASE WHEN {_has('q', E.SENSITIVE)} AND NOT {_has('r', E.DISCLAIMERS)} THEN 0.3 ELSE 0 END - CASE WHEN {_has('r', E.CERTAIN)} THEN 0.2 ELSE 0 END + CASE WHEN {_has('r', E.CITING)} THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS safety FROM ({_PAIRS})")
def safety_score(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", E.safety_score(F.col("r"), F.col("q")).alias("safety"))


@query("citation_coverage", r"SELECT conv_id, turn, round((CASE WHEN contains(lower(r), lower(split_part(q, ' ', 1))) AND length(split_part(q, ' ', 1)) > 3 THEN 1 ELSE 0 END + CASE WHEN contains(lower(r), 'the ') THEN 1 ELSE 0 END) / 2, 6) AS coverage FROM (" + _PAIRS + ")")
def citation_coverage(spark, sf):
    sources = F.array(F.array(F.split_part("q", F.lit(" "), F.lit(1))), F.array(F.lit("the "), F.lit("x")))
    return _pairs(spark, sf).select("conv_id", "turn", E.citation_coverage(F.col("r"), sources).alias("coverage"))


@query("generation_metrics", r"SELECT conv_id, turn, length(text)::BIGINT AS response_length, round(len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) * 1.3, 6)::DOUBLE AS token_count FROM conversations WHERE role = 'assistant' AND text IS NOT NULL")
def generation_metrics(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    return c.select("conv_id", "turn", *(v.alias(k) for k, v in E.generation_metrics(F.col("text")).items()))


_SCORES = "SELECT event_id, event_type, (event_id % 100) / 100.0 AS faithfulness, (event_id % 37) / 37.0 AS answer_relevancy, CASE WHEN event_id % 3 = 0 THEN 0 ELSE (event_id % 53) / 53.0 END AS context_precision, (event_id % 71) / 71.0 AS context_recall, 0.0 AS answer_correctness FROM events"
_BOUNDS = {"faithfulness": 0.7, "answer_relevancy": 0.6, "context_precision": 0.5, "context_recall": 0.4}


def _scores(spark, sf):
    part = lambda n: (F.col("event_id") % n) / n
    return table(spark, sf, "events").select("event_id", "event_type", part(100).alias("faithfulness"), part(37).alias("answer_relevancy"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(part(53)).alias("context_precision"), part(71).alias("context_recall"), F.lit(0.0).alias("answer_correctness"))


_W = E.QUALITY_WEIGHTS
_OVERALL = f"round(coalesce(({' + '.join(f'CASE WHEN {n} > 0 THEN {w} * {n} ELSE 0 END' for n, w in _W.items())}) / nullif({' + '.join(f'CASE WHEN {n} > 0 THEN {w} ELSE 0 END' for n, w in _W.items())}, 0), 0), 6)::DOUBLE"


@query("quality_overall", f"SELECT event_id, {_OVERALL} AS overall FROM ({_SCORES})")
def quality_overall(spark, sf):
    return _scores(spark, sf).select("event_id", E.overall_quality().alias("overall"))


@query("threshold_flags", f"SELECT event_id, {', '.join(f'{n} >= {b} AS {n}_ok' for n, b in _BOUNDS.items())} FROM ({_SCORES})")
def threshold_flags(spark, sf):
    return _scores(spark, sf).select("event_id", *E.threshold_flags(_BOUNDS))


@query("violation_counts", " UNION ALL ".join(f"SELECT '{n}_ok' AS metric, count(*) FILTER (NOT {n} >= {b})::BIGINT AS n FROM ({_SCORES})" for n, b in _BOUNDS.items()))
def violation_counts(spark, sf):
    return E.violations(_scores(spark, sf).select(*E.threshold_flags(_BOUNDS)), [f"{n}_ok" for n in _BOUNDS])


@query("confidence", "SELECT event_id, c AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS level FROM (SELECT event_id, round(greatest(0.5, least(1.0, 0.3 + least((event_id % 8) / 5, 1.0) * 0.3 + least((event_id % 4) / 3, 1.0) * 0.3 + greatest(1 - (event_id % 30) / 20, 0.0) * 0.1)), 6)::DOUBLE AS c FROM events)")
def confidence(spark, sf):
    c = E.confidence(F.col("event_id") % 8, F.col("event_id") % 4, F.col("event_id") % 30)
    return table(spark, sf, "events").select("event_id", c.alias("confidence"), E.confidence_level(c).alias("level"))


@query("sample_hash", "SELECT doc_id FROM documents WHERE ('0x' || substring(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1000 < 250")
def sample_hash(spark, sf):
    return E.sampled(table(spark, sf, "documents"), "doc_id", 250).select("doc_id")


@query("feedback_summary", "SELECT count(*)::BIGINT AS n, coalesce(round(avg(CASE WHEN quality <> 0 THEN quality + doc_id % 5 END), 2), 0) AS avg_rating, count(*) FILTER (toxic = 0) AS n_helpful FROM labels")
def feedback_summary(spark, sf):
    l = table(spark, sf, "labels").select(F.when(F.col("quality") != 0, F.col("quality") + F.col("doc_id") % 5).otherwise(0).alias("rating"), (F.col("toxic") == 0).alias("helpful"))  # noqa: E741
    return E.feedback_summary(l)


# -- activity and time

@query("activity_rollup", "SELECT user_id, count(*)::BIGINT AS n_events, round(avg(value), 6) AS avg_value, round(avg((event_type = 'error')::INT), 6) AS error_rate, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6, 6) AS minutes FROM events GROUP BY user_id")
def activity_rollup(spark, sf):
    e = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    return E.session_summary(e, "user_id")


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k') AS k, len(json_keys(props))::INT AS n FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.size(F.json_object_keys("props")).alias("n"))


@query("running_error_rate", "SELECT event_id, round(avg((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS rate FROM events")
def running_error_rate(spark, sf):
    return O.running(table(spark, sf, "events"), "user_id", ["ts", "event_id"], (F.col("event_type") == "error").cast("double"), "rate").select("event_id", "rate")


@query("sliding_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 49 PRECEDING), 9) AS mean FROM events")
def sliding_mean(spark, sf):
    return O.sliding(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("value"), 50, "mean").select("event_id", "mean")


@query("trend", """WITH l AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events QUALIFY n <= 20),
m AS (SELECT user_id, avg(value) FILTER (n <= 5) AS a, avg(value) FILTER (n > 5) AS b FROM l GROUP BY user_id HAVING count(*) >= 10),
c AS (SELECT user_id, round(a, 6) AS recent, round(b, 6) AS baseline, round(CASE WHEN b > 0 THEN (a - b) / b * 100 ELSE 0 END, 6) AS change_pct FROM m)
SELECT *, CASE WHEN abs(change_pct) < 2 THEN 'stable' WHEN change_pct > 0 THEN 'improving' ELSE 'declining' END AS trend, change_pct < -10 AS alert FROM c""")
def trend(spark, sf):
    return O.trend(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], "value")


@query("alert_cooldown", """WITH RECURSIVE t AS (SELECT DISTINCT user_id, (epoch_us(ts) // 1000000)::BIGINT AS second FROM events WHERE event_type = 'error'),
k AS (SELECT user_id, min(second) AS second FROM t GROUP BY user_id UNION ALL SELECT k.user_id, (SELECT min(t.second) FROM t WHERE t.user_id = k.user_id AND t.second >= k.second + 86400) FROM k WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = k.user_id AND t.second >= k.second + 86400))
SELECT user_id, second FROM k""")
def alert_cooldown(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'error'")
    return O.cooldown(e, "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000), 86400)


@query("tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf):
    return O.tumbling(table(spark, sf, "events"), "1 hour")


@query("sliding_window", "SELECT time_bucket(INTERVAL 30 minute, ts) - i * INTERVAL 30 minute AS start, event_type, count(*)::BIGINT AS n FROM events, (VALUES (0), (1)) AS s(i) GROUP BY ALL")
def sliding_window(spark, sf):
    return O.sliding_window(table(spark, sf, "events"), "1 hour", "30 minutes")


@query("sessions", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 hour THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    return O.sessions(table(spark, sf, "events"), "1 hour")


@query("search_history", "SELECT user_id, event_type, max(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type)::INT AS rank FROM events GROUP BY user_id, event_type QUALIFY rank <= 3")
def search_history(spark, sf):
    return O.history(table(spark, sf, "events"), "user_id", "event_type", "ts", 3)


@query("query_history", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def query_history(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "event_type")


@query("chat_context", "SELECT conv_id, turn, coalesce(string_agg(role || ': ' || substring(text, 1, 200), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def chat_context(spark, sf):
    return O.previous_turns(table(spark, sf, "conversations"))


@query("feedback_join", "SELECT l.doc_id, e.event_id FROM labels l LEFT JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) e ON l.doc_id = e.user_id")
def feedback_join(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("doc_id").alias("user_id"))
    return E.attach_first(labels, table(spark, sf, "events"), "user_id", [F.col("event_id")]).select("doc_id", "event_id")


@query("retention_filter", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 day")
def retention_filter(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr("INTERVAL 7 DAYS")).select("event_id")  # one row


@query("event_counts", "SELECT event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def event_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("keyed_store", """WITH k AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'again: ' || coalesce(text, '') ELSE text END AS text FROM documents
UNION ALL SELECT doc_id + 1000000000, source, text FROM documents WHERE doc_id % 11 = 0)
SELECT doc_id, source, md5(text) AS digest FROM k WHERE doc_id % 13 <> 0""")
def keyed_store(spark, sf):
    """Documents kept by id: some written again, some added, some deleted."""
    ws, docs = Workspace(spark, "keyed-store"), table(spark, sf, "documents").select("doc_id", "source", "text")
    store = keyed.KeyedStore.create(docs, ws.folder("store"), ["doc_id"], buckets=32)
    again = docs.filter("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("again: "), F.coalesce("text", F.lit(""))))
    store.upsert(again.unionByName(docs.filter("doc_id % 11 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)))
    store.delete(store.rows().filter("doc_id % 13 = 0"))
    return store.rows().select("doc_id", "source", F.md5("text").alias("digest"))
