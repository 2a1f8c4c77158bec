"""Queries: hooks with their defaults, composed answers, summaries of evaluation histories."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from corpusmill.functions import text as T
from corpusmill.operators import context, evaluation as E, hooks, lexical, lineage as L, ordered as O, tracker as K
from corpusmill.plans import history, retrieval
from corpusmill.plans.registry import query, table
from corpusmill.plans.retrieval import ASK
from corpusmill.sources import writers


@query("project_list", "SELECT DISTINCT source AS project FROM documents WHERE source IS NOT NULL ORDER BY 1")
def project_list(spark, sf):
    return table(spark, sf, "documents").filter("source IS NOT NULL").select(F.col("source").alias("project")).distinct().orderBy("project")


@query("multi_project_topk", f"SELECT source, doc_id, score, rank FROM (SELECT source, doc_id, round({retrieval._rerank_sql(ASK)}, 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round({retrieval._rerank_sql(ASK)}, 6) DESC, doc_id)::INT AS rank FROM documents WHERE text IS NOT NULL) WHERE rank <= 3")
def multi_project_topk(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("source", "doc_id", F.round(lexical.rerank_score(F.col("text"), ASK), 6).alias("score"))
    return hooks.compare_groups(d, "source", 3).select("source", "doc_id", "score", "rank")


@query("rerank_hook", f"WITH r AS (SELECT doc_id, substring(text, 1, 512) AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, round({retrieval._rerank_sql(ASK)}, 6) AS score FROM r WHERE round({retrieval._rerank_sql(ASK)}, 6) >= 0.5 ORDER BY score DESC, doc_id LIMIT 25")
def rerank_hook(spark, sf):
    return hooks.rerank(table(spark, sf, "documents").filter("text IS NOT NULL"), ASK, 25, 0.5).select("doc_id", "score")


@query("embed_hook")
def embed_hook(spark, sf):
    return hooks.embed(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("answer_sources", f"WITH {retrieval._LISTS} SELECT string_agg(DISTINCT source, ', ' ORDER BY source) AS sources, count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS n_unique FROM kwp JOIN documents USING (doc_id) WHERE rank <= 10")
def answer_sources(spark, sf):
    best = table(spark, sf, "documents").join(F.broadcast(retrieval._kw(spark, sf, 10)), "doc_id")
    return best.agg(F.array_join(F.sort_array(F.collect_set("source")), ", ").alias("sources"), F.count("*").alias("n"), F.countDistinct("source").alias("n_unique"))


_EVENTS = "SELECT event_type AS metric, value, value >= 20 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events"


@query("performance_summary", f"SELECT metric, count(*)::BIGINT AS n, round(avg(value), 9) AS mean, count(*) FILTER (NOT ok) AS violations FROM ({_EVENTS}) WHERE n <= 50 GROUP BY metric")
def performance_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("ok", F.col("value") >= 20)
    last = K.top_per_group(e, "event_type", [F.desc("ts"), F.desc("event_id")], 50)
    return last.groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 9).alias("mean"), F.count_if(~F.col("ok")).alias("violations"))


@query("last_events", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def last_events(spark, sf):
    return K.top_per_group(table(spark, sf, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 100).select("event_type", "event_id")


@query("file_kinds", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' WHEN 2 THEN 'yaml' ELSE 'generic' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'sql' WHEN 2 THEN 'yaml' ELSE 'code' END AS language FROM documents")
def file_kinds(spark, sf):
    ends = F.element_at(F.array(*map(F.lit, (".py", ".SQL", ".yml", ".zig"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    path = F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), ends)
    return table(spark, sf, "documents").select("doc_id", T.file_kind(path).alias("kind"), T.language_of(path).alias("language"))


@query("commit_summary", "SELECT o_custkey, 'Recent commit history:' || chr(10) || string_agg('- [' || strftime(o_orderdate, '%Y-%m-%d') || '] ' || o_orderkey || ' - ' || o_orderstatus || ' (by ' || o_orderpriority || ')', chr(10) ORDER BY o_orderdate DESC, o_orderkey) AS summary FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 5) GROUP BY o_custkey")
def commit_summary(spark, sf):
    top = K.top_per_group(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 5)
    commit = F.struct("rank", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("date"), F.col("o_orderkey").cast("string").alias("short_id"), F.col("o_orderpriority").alias("author"), F.concat("o_orderstatus", F.lit("\nbody")).alias("message"))
    return top.groupBy("o_custkey").agg(F.sort_array(F.collect_list(commit)).alias("c")).select("o_custkey", T.commit_summary(F.col("c")).alias("summary"))


@query("metadata_flat", "SELECT event_id, 'x, y' AS tags, event_type AS plain FROM events")
def metadata_flat(spark, sf):
    meta = F.create_map(F.lit("tags"), F.lit('["x","y"]'), F.lit("plain"), F.col("event_type"))
    flat = writers.flat_metadata(meta)
    return table(spark, sf, "events").select("event_id", flat["tags"].alias("tags"), flat["plain"].alias("plain"))


@query("lineage_route", f"WITH e AS ({history._EDGES}) SELECT item_id, CASE WHEN contains(lower(text), 'the') THEN 'downstream' ELSE 'upstream' END AS direction, CASE WHEN contains(lower(text), 'the') THEN (SELECT count(*) FROM e WHERE src = 'n1') ELSE (SELECT count(*) FROM e WHERE dst = 'n1') END::BIGINT AS n FROM benchmark")
def lineage_route(spark, sf):
    """The question decides the direction; the graph answers it."""
    edges, start = history._edges(spark, sf), spark.createDataFrame([("n1",)], "start string")
    n = lambda up: L.neighbours(edges, start, up).agg(F.count("*").alias("up" if up else "down"))
    both = n(True).crossJoin(n(False))  # one row each
    down = T.contains_any(F.lower("text"), ["the"])
    return table(spark, sf, "benchmark").crossJoin(F.broadcast(both)).select("item_id", F.when(down, "downstream").otherwise("upstream").alias("direction"), F.when(down, F.col("down")).otherwise(F.col("up")).alias("n"))


@query("enriched_models", f"WITH e AS ({history._EDGES}) SELECT 'n' || n_nationkey AS node, n_name AS name, (SELECT count(*) FROM e WHERE src = 'n' || n_nationkey)::BIGINT AS direct_down, (SELECT string_agg(dst, ',' ORDER BY dst) FROM (SELECT dst, row_number() OVER (ORDER BY dst) AS k FROM e WHERE src = 'n' || n_nationkey) WHERE k <= 5) AS first_down FROM nation")
def enriched_models(spark, sf):
    """Metadata with the first five neighbours."""
    first = K.top_per_group(history._edges(spark, sf), "src", [F.col("dst")], 5).groupBy(F.col("src").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("first_down"))
    down = history._edges(spark, sf).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("direct_down"))
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("name"))
    return nodes.join(down, "node", "left").join(first, "node", "left").select("node", "name", F.coalesce("direct_down", F.lit(0)).alias("direct_down"), "first_down")


@query("response_cleanup", "SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE text IS NOT NULL")
def response_cleanup(spark, sf):
    c = table(spark, sf, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", hooks.clean_response(F.concat(F.lit(" Assistant: Answer:  "), F.col("text"))).alias("text"))


@query("response_structure", r"""WITH d AS (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, t, string_split(t, '. ') AS l FROM d),
j AS (SELECT doc_id, string_agg(l[i] || CASE WHEN ends_with(l[i], '.') THEN '' ELSE '.' END || CASE WHEN i % 3 = 0 AND l[i] <> l[-1] THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY i) AS s FROM p, unnest(range(1, len(l) + 1)) AS u(i) GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN length(t) > 500 THEN trim(s, ' ' || chr(10)) ELSE t END) AS digest FROM d JOIN j USING (doc_id)""")
def response_structure(spark, sf):
    flat = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    return flat.select("doc_id", F.md5(hooks.structured_response(F.col("t"))).alias("digest"))


@query("path_context", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'dbt project, staging layer, data models, dbt, models, staging' ELSE 'src, app' END AS context FROM documents")
def path_context(spark, sf):
    path = F.when(F.col("doc_id") % 2 == 0, "dbt/models/staging/stg_a.sql").otherwise("/src/app/x.py")
    return table(spark, sf, "documents").select("doc_id", T.path_context(path).alias("context"))


@query("line_budget", "SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (used <= 1000), '')) AS digest FROM (SELECT doc_id, p, l[p] AS line, sum(length(l[p]) + 1) OVER (PARTITION BY doc_id ORDER BY p) AS used FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(p)) GROUP BY doc_id")
def line_budget(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(context.truncate_lines(F.col("text"), 1000)).alias("digest"))


@query("monthly_running", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM events")
def monthly_running(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM")))
    return O.running(e, "k", ["ts", "event_id"], F.col("value"), "mean").select("event_id", "mean")


@query("quality_by_source", "SELECT source, count(*)::BIGINT AS n, round(avg(quality), 6) AS good, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def quality_by_source(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("ranked_percentile", "SELECT doc_id, round(percent_rank() OVER (PARTITION BY source ORDER BY n_chars, doc_id), 6) AS p FROM documents")
def ranked_percentile(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(F.percent_rank().over(Window.partitionBy("source").orderBy("n_chars", "doc_id")), 6).alias("p"))


@query("evaluation_sample", f"SELECT event_id, {history._OVERALL} AS overall FROM ({history._SCORES}) WHERE ('0x' || substring(md5(event_id::VARCHAR), 1, 8))::BIGINT % 1000 < 100")
def evaluation_sample(spark, sf):
    """The sampled evaluation step: a deterministic sample, then its weighted score."""
    return E.sampled(history._scores(spark, sf), "event_id", 100).select("event_id", E.overall_quality().alias("overall"))
