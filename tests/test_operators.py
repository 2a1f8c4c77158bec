"""Hand-checked cases."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T, vectors as V
from corpusmill.operators import chunking, context, dedupe, evaluation as E, expansion, fusion, lineage, ordered, predicates as P, tracker
from corpusmill.sources import readers, writers


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_frequency_relevance(spark):
    hits = spark.createDataFrame([(0, "a", 0.9), (1, "a", 0.7), (0, "b", 0.8), (0, "c", 0.5), (1, "c", 0.5), (2, "c", 0.5)], "query_index int, chunk_id string, score double")
    assert values(fusion.frequency_relevance(hits), "chunk_id", "frequency", "final_score") == [("a", 2, 1.6), ("c", 3, 1.5)]
    assert values(fusion.frequency_relevance(hits, least=1, method="max"), "chunk_id", "final_score") == [("a", 0.9), ("b", 0.8), ("c", 0.5)]


def test_rank_scores(spark):
    rows = spark.createDataFrame([(i, 10.0 - i) for i in range(4)], "doc_id int, score double")
    assert [r["s"] for r in fusion.by_position(rows, "s").orderBy("doc_id").collect()] == [1.0, 0.75, 0.5, 0.25]


def test_hybrid_split_with_backfill(spark):
    semantic = spark.createDataFrame([(i, i) for i in range(1, 13)], "doc_id int, rank int")
    keyword = spark.createDataFrame([(1, 1), (101, 2), (102, 3)], "doc_id int, rank int")
    got = fusion.hybrid_context(semantic, keyword)
    assert {r["origin"]: r["count"] for r in got.groupBy("origin").count().collect()} == {"semantic": 7, "keyword": 2, "backfill": 1}
    with pytest.raises(ValueError):
        fusion.hybrid_context(semantic, keyword, weights=(0.5, 0.1))


def test_change_reasons(spark):
    docs = spark.createDataFrame([("d", str(i), h, m) for i, h, m in [(1, "a", None), (2, "b", None), (3, "a", "y"), (4, "a", "x"), (5, "a", "x")]], "source_type string, document_id string, content_hash string, modified string")
    old = spark.createDataFrame([("d", "2", "a", "x", "success"), ("d", "3", "a", "x", "success"), ("d", "4", "a", "x", "failed"), ("d", "5", "a", "x", "success")], "source_type string, document_id string, content_hash string, modified string, status string")
    got = dict(values(tracker.detect_changes(docs, old), "document_id", "reason"))
    assert got == {"1": "new_document", "2": "content_changed", "3": "modified_date_changed", "4": "retry_failed", "5": "unchanged"}


@pytest.mark.parametrize("n, want", [(20, [(1, 10), (9, 18), (17, 20)]), (10, [(1, 10), (9, 10)])])
def test_line_chunks(spark, n, want):
    df = spark.createDataFrame([("\n".join(map(str, range(n))),)], "text string").select(F.explode(chunking.by_lines(F.col("text"))).alias("c"))
    assert [(r["c"]["start"], r["c"]["end"]) for r in df.collect()] == want


def test_recursive_split_sizes():
    text = "alpha beta. " * 40 + "\n\n" + "x" * 300
    parts = chunking.split_recursively(text, 100, 20)
    assert all(len(p) <= 100 for p in parts)
    assert "".join(parts).count("x") >= 300
    assert chunking.split_recursively("  ", 10, 2) == []


def test_code_chunks_end_where_lines_say():
    """Expected line spans written down by hand from the rules."""
    spans = lambda language, text, size, overlap=0: [(a, b, k) for _, a, b, k in chunking.scan(language, text, size, overlap)]
    long = "\n".join(f"    x{i:02} = {i:02}" for i in range(10))  # 119 characters with its line ends
    python = f"import os\nclass A:\n{long}\nclass B:\n    def f(self):\n        pass\n@deco\ndef g():\n    pass"
    assert spans("python", python, 1000) == [(2, 12, "class"), (13, 18, "function")]  # the short head before a class goes
    assert spans("python", python, 60, 100)[:2] == [(2, 7, "class"), (6, 10, "class")]  # 73 characters with the fifth line below the class, two lines shared
    sql = "SELECT 1;\n" + "SELECT " + "a, " * 100 + "b FROM t;\nDROP TABLE t"
    assert spans("sql", sql, 50) == [(1, 2, "select"), (3, 3, "drop")]
    assert spans("sql", "-- c\nupdate t\nset x = 1\ngo", 5) == [(1, 4, "update")]
    yaml = "a: 1\n{% macro m(x) %}\nbody\n{% endmacro %}\nb: 2"
    assert spans("yaml", yaml, 1000) == [(1, 4, "macro"), (5, 5, "config")]
    assert spans("yaml", "k: " + "v" * 120 + "\n" + yaml, 1000)[:2] == [(1, 2, "config"), (3, 5, "macro")]
    assert spans("yaml", "a: 1\nb: 2\nc: 3\n{% endmacro %}", 8) == [(1, 2, "config"), (3, 4, "config")]
    for language in chunking.LANGUAGES:
        assert [c for c, *_ in chunking.scan(language, "", 10)] == [""]


def test_semantic_chunks_split_large_sections(spark):
    text = "intro words\n## Overview\n" + "a sentence. " * 40 + "\nSUMMARY: short"
    rows = chunking.semantic_chunks(spark.createDataFrame([(1, text, "s"), (2, None, "t")], "doc_id long, text string, source string"), 100, 20, source="source").orderBy("chunk_index").collect()
    head, middle, last = [s.strip() for s in (text[:12], text[12 : text.index("SUMMARY")], text[text.index("SUMMARY") :])]
    parts = chunking.split_recursively(middle, 100, 20)
    assert [r["content"] for r in rows] == [head, *parts, last]
    assert [r["chunk_id"] for r in rows] == ["s_0", *(f"s_1_{j}" for j in range(len(parts))), "s_2"]
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_commit_summary_and_routes(spark):
    one = spark.createDataFrame([(1,)], "i int")
    commits = "array(named_struct('date', '2024-01-02T03:04', 'short_id', 'abc1234', 'author', 'x', 'message', 'first\nbody'), named_struct('date', null, 'short_id', null, 'author', null, 'message', null))"
    got = one.select(T.commit_summary(F.expr(commits))).first()[0]
    assert got == "Recent commit history:\n- [2024-01-02] abc1234 - first (by x)\n- [unknown] ??????? - No message (by Unknown)"
    assert one.select(T.commit_summary(F.expr(f"slice({commits}, 1, 0)"))).first()[0] == "No commit history available"
    asked = {"What is X": "overview", "How to fix it": "specific", "troubleshoot the setup": "specific", "an ERROR here": "troubleshoot", "how many": "general", "it fails": "general"}
    rows = spark.createDataFrame(list(asked.items()), "q string, want string")
    assert rows.filter(expansion.route(F.col("q")) != F.col("want")).count() == 0
    assert rows.filter(expansion.detect_project(F.col("q"), ["err", "error", "fix"]) == "error").count() == 1


def test_context_string_has_what_there_is(spark):
    rows = spark.createDataFrame([(2, "b", None, "p", "two"), (1, "a", "f.py", None, "one")], "rank int, source string, file_path string, project_tag string, content string")
    assert context.context_string(rows).first()[0] == "[Document 1]\nSource: a\nFile: f.py\n\none\n\n---\n\n[Document 2]\nSource: b\nProject: p\n\ntwo"


def test_truncated_contexts(spark):
    long = "\n---\n".join(["word " * 60, "needle needle " + "x" * 200, "needle " + "y" * 700])
    rows = spark.createDataFrame([(1, "short"), (2, long)], "id int, context string")
    got = {r["id"]: r["context"] for r in context.truncated(rows, "needle", 300, 100).collect()}
    assert got[1] == "short" and got[2].startswith("needle needle x") and len(got[2]) <= 800 + len(context.CUT)


def test_model_answers(spark):
    cases = ['```json\n{"variations": ["a", "b"], "project": "p", "confidence": 0.9}\n```', '{"variations": []}', '{"project": "p"}', "1. a longer line\n- another one here", "no"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, c string").select("i", T.expansion_answer(F.col("c")).alias("a")).orderBy("i").collect()
    assert [r["a"] and (r["a"]["variations"], r["a"]["project"], r["a"]["confidence"]) for r in rows] == [(["a", "b"], "p", 0.9), ([], "general", 0.5), None, (["a longer line", "another one here"], "general", 0.5), None]


def test_reachable_on_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "src int, dst int")
    got = lineage.reachable(edges, spark.createDataFrame([(0,), (25,)], "start int"))
    assert values(got, "start", "node", "depth") == sorted([(0, i, i) for i in range(1, 31)] + [(25, i, i - 25) for i in range(26, 31)])


def test_similar_vectors_are_all_pairs(spark):
    import numpy as np

    from corpusmill.operators import dense

    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    data = np.concatenate([base, base + rng.normal(scale=0.12, size=base.shape), base[:20]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    unit = data[:120] / np.linalg.norm(data[:120], axis=1, keepdims=True)
    for least in (0.9, 0.98):
        want = {(i, j) for i in range(120) for j in range(i + 1, 120) if round(float(unit[i] @ unit[j]), 6) > least}
        assert {(r["a"], r["b"]) for r in dense.similar_pairs(rows, least).collect()} == want and len(want) > 10
    assert dict(values(dense.vector_classes(rows), "id", "first_id"))[125] == 5
    for n in (100, 10**6, 10**10):
        bits, bands = dense.sign_bands(0.98, n)
        assert bits >= min(30, np.log2(n)) and bands <= 256


def test_unlike_candidates_meet_no_vectors(spark):
    import numpy as np

    from corpusmill.operators import dense

    assert dense.mark_limit(1.0) == 0 and dense.mark_limit(0.98) == 21 and dense.mark_limit(-1.0) == dense.MARK
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2000, 64))
    data = np.concatenate([base, base[:50] + rng.normal(scale=0.05, size=(50, 64))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    found = dense.similar_pairs(rows, 0.98)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(i, 2000 + i) for i in range(50)}
    # the join itself leaves out unlike ones that share a band
    graph = found._jdf.queryExecution().optimizedPlan()
    while graph.nodeName() != "Aggregate":
        graph = graph.children().head()
    candidates = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, graph)
    assert candidates.count() < 4000  # 26,721 share a band


def test_keywords_are_counted_where_texts_lie(spark):
    alone = [(1, "Beta alpha beta and the x1 gamma"), (2, None), (3, "no"), (4, "zed zed_a ab abc, abc é")]
    want = [(1, "alpha", 1, 2), (1, "beta", 2, 1), (1, "gamma", 1, 3), (4, "abc", 2, 1), (4, "zed", 1, 2), (4, "zed_a", 1, 3)]
    found = context.keywords(spark.createDataFrame(alone, "doc_id long, text string"))
    assert values(found, "doc_id", "word", "n", "rank") == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    again = spark.createDataFrame([*alone, (3, "one two two"), (3, "one one"), (None, "left over left"), (None, "left")], "doc_id long, text string")
    got = {(r["doc_id"], r["word"], r["n"], r["rank"]) for r in context.keywords(again, k=2).collect()}
    assert got == {w for w in want if w[3] < 3} | {(3, "one", 3, 1), (3, "two", 2, 2), (None, "left", 3, 1), (None, "over", 1, 2)}


def test_index_is_the_plain_scoring(spark, tmp_path):
    from corpusmill.operators import index, lexical

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1, 3 + i % 9)) if i % 7 else None) for i in range(80)], "doc_id long, text string")
    found = index.build_index(docs, f"file://{tmp_path}/index")
    for q in ("w1 w2 w1", "w0", "nothing here", ""):
        assert values(found.bm25(q), "doc_id", "score") == (values(lexical.bm25(docs, q), "doc_id", "score") if q else [])
    plan = found.bm25("w1")._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" in plan


def test_metrics(spark):
    rows = spark.createDataFrame([(0, r, ok) for r, ok in ((1, True), (2, False), (3, True))], "query_index int, rank int, relevant boolean")
    assert values(E.precision_at_k(rows, 5), "precision_at_k") == [(round(2 / 3, 6),)]
    rows = spark.createDataFrame([(0, 1, True), (1, 3, True), (2, 5, True)], "query_index int, rank int, relevant boolean")
    assert values(E.mean_reciprocal_rank(rows), "mrr") == [(round((1 + 1 / 3 + 1 / 5) / 3, 6),)]
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b")], "query_index int, source string")
    assert values(E.chunk_overlap(rows), "chunk_overlap") == [(0.5,)]
    one = spark.createDataFrame([("it will definitely work", "urgent decision")], "r string, q string")
    assert one.select(E.safety_score(F.col("r"), F.col("q"))).first()[0] == 0.5
    scores = spark.createDataFrame([(0.8, 0.6, 0.0, 0.0, 0.0)], ", ".join(f"{n} double" for n in ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")))
    assert scores.select(E.overall_quality()).first()[0] == 0.709091
    assert scores.select(E.confidence(F.lit(5), F.lit(3), F.lit(10))).first()[0] == 0.95


def test_trend_declines(spark):
    rows = spark.createDataFrame([("m", i, 0.8 if i < 15 else 0.6) for i in range(20)], "k string, i int, v double")
    got = ordered.trend(rows, "k", [F.desc("i")], "v").first()
    assert (got["change_pct"], got["trend"], got["alert"]) == (-25.0, "declining", True)


def test_cooldown(spark):
    rows = spark.createDataFrame([("k", t) for t in (0, 200, 310, 500, 620)], "k string, t long")
    assert values(ordered.cooldown(rows, "k", F.col("t"), 300), "second") == [(0,), (310,), (620,)]


def test_lineage_with_diamond_and_cycle(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "src string, dst string")
    start = spark.createDataFrame([("A",)], "start string")
    assert sorted(r["node"] for r in lineage.traversed(edges, start).collect()) == ["B", "C", "D", "D"]
    assert values(lineage.reachable(edges, start), "node", "depth") == [("B", 1), ("C", 1), ("D", 2)]
    cyclic = edges.unionByName(spark.createDataFrame([("D", "A")], "src string, dst string"))
    assert values(lineage.reachable(cyclic, start), "node") == [("B",), ("C",), ("D",)]


def test_pack_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, "a" * 100), (2, "b" * 2000), (3, "c" * 10)], "rank int, text string")
    got = context.pack(rows, 1000).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2] and got[1]["content"].endswith(context.CUT)
    assert [r["rank"] for r in context.pack(rows, 1000, partial=False).collect()] == [1]


def test_expansion():
    assert expansion.expand("What is the logic of QM1")[0] == "what is the logic of qm1"
    assert len(expansion.expand("what is the logic of qm1 table model query")) == 5
    with pytest.raises(ValueError):
        expansion.expand("a")


def test_predicates(spark):
    df = spark.createDataFrame([("/src/a.py", {"k": "1"}), ("/src/gen/b.py", {"k": "2"}), ("/doc/c.md", {})], "path string, meta map<string,string>")
    keep = P.path_allowed(F.col("path"), ["/src"], ["/src/gen"]) & P.type_allowed(F.col("path"), [".py"])
    assert values(df.filter(keep), "path") == [("/src/a.py",)]
    assert len(values(df.filter(P.metadata_matches(F.col("meta"), {"k": "1"})), "path")) == 2


def test_text_functions(spark):
    one = spark.createDataFrame([("ERR-500 in v1.2.3, see TICKET-123 and err-500",)], "t string")
    assert one.select(T.domain_codes(F.col("t"))).first()[0] == ["ERR-500", "err-500", "TICKET-123", "v1.2.3"]
    assert one.select(T.language_of(F.lit("a/b.SQL"))).first()[0] == "sql"
    assert one.select(T.language_of(F.lit("a/b.zig"))).first()[0] == "code"
    assert one.select(T.split_context(F.lit("a --- b"))).first()[0] == ["a", "b"]
    assert one.select(T.strip_fence(F.lit('```json\n{"a": 1}\n```'))).first()[0] == '{"a": 1}'
    assert "patient" in T.query_terms("PatientData from 'x y'") and "x y" in T.query_terms("PatientData from 'x y'")
    assert one.select(V.cosine(V.literal([1, 0]), V.literal([1, 1]))).first()[0] == pytest.approx(2**-0.5)


def test_registry_keeps_first_source(spark):
    rows = spark.createDataFrame([("h", "a", 1), ("h", "b", 2)], "content_hash string, source string, seen int")
    assert values(dedupe.register(rows), "first_seen", "last_updated", "source") == [(1, 2, "a")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("plain text")
    (tmp_path / "in/b.html").write_text("<p>hello</p><script>x</script>")
    (tmp_path / "in/c.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "in/d.txt").write_text("  ")
    got = {r["title"]: r["text"] for r in readers.local_files(spark, f"file://{tmp_path}/in").collect()}
    assert got == {"a": "plain text", "b": "hello", "c": "caf\xe9"}
    landed = {"file_path": "/m/a.sql", "repository": "r", "branch": "main", "content": "select 1\nfrom t", "commits": [{"commit_id": "1", "author_date": "2024-01-01T00:00", "author_name": "x", "message": "first\nbody"}, {"commit_id": "2", "author_date": "2024-02-01T00:00", "author_name": "y", "message": "m" * 90}]}
    (tmp_path / "repo.json").write_text(json.dumps(landed) + "\n")
    row = readers.repo_files(spark, f"file://{tmp_path}/repo.json").first()
    assert (row["last_modified_by"], row["is_code"], row["total_lines"], row["commit_count"]) == ("y", True, 2, 2)
    assert row["commit_history_summary"].split("\n")[1] == "- [2024-02-01] ??????? - " + "m" * 77 + "... (by y)"
    manifest = {"nodes": {"model.p.a": {"name": "a", "resource_type": "model", "raw_code": "select 1", "depends_on": {"nodes": ["seed.p.s"]}}}, "macros": {"macro.p.m": {"name": "m", "macro_sql": "{% macro %}"}}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    nodes = readers.manifest_nodes(spark, f"file://{tmp_path}/manifest.json")
    assert values(lineage.sql_documents(nodes), "node", "text") == [("macro.p.m", "{% macro %}"), ("model.p.a", "select 1")]
    (tmp_path / "graph.json").write_text(json.dumps({"linked": {"0": {"name": "s", "type": "source", "succ": [1]}, "1": {"name": "m", "type": "model", "succ": []}}}))
    n, e = readers.graph(spark, f"file://{tmp_path}/graph.json")
    assert values(n, "id", "type") == [(0, "source"), (1, "model")] and values(e, "src", "dst") == [(0, 1)]
    chunks = spark.createDataFrame([("wiki", "s", 0), ("repo", "t", 1)], "source_type string, source string, chunk_index int")
    writers.write_vectors(chunks, f"file://{tmp_path}/vec")
    writers.delete_documents(spark, f"file://{tmp_path}/vec", spark.createDataFrame([("s",)], "source string"), ["source"], f"file://{tmp_path}/stage")
    assert values(spark.read.parquet(f"file://{tmp_path}/vec"), "source") == [("t",)]
    assert readers.tickets(spark).count() == 0
    events = writers.search_events(spark.createDataFrame([("s", "q", 3, 0.5)], "session_id string, query string, num_results int, seconds double"))
    writers.write_activity(events, f"file://{tmp_path}/log")
    assert readers.activity_stats(spark, f"file://{tmp_path}/log").first()["n_events"] == 1


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("CM_TOKEN", "secret")
    (tmp_path / "c.yaml").write_text("a: ${CM_TOKEN}\nb: [x, '${CM_NONE}']\n")
    assert readers.settings(str(tmp_path / "c.yaml")) == {"a": "secret", "b": ["x", "${CM_NONE}"]}
    (tmp_path / "e.yaml").write_text("")
    assert readers.settings(str(tmp_path / "e.yaml")) == {}


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_pairs_are_all_pairs(spark):
    """Heads in several scripts, without full stops, with up to 27 edits anywhere, and short ones."""
    import random

    rng = random.Random(7)
    texts = []
    for letters in ("abcdefghij klmno", "äöüß абвгдежз ик"):
        for n in (15, 21, 45, 130, 470, 499, 700):
            base = "".join(rng.choice(letters) for _ in range(n))
            texts.append(base)
            for edits in (1, min(n, 500) // 20, 27):
                w = list(base)
                for _ in range(edits):
                    at = rng.randrange(min(len(w), 490))
                    w[at : at + rng.choice((0, 1, 1))] = rng.choice(("", "#", "#"))
                texts.append("".join(w))
    docs = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t[:500], i)
    want = set()
    for x, a in first.items():
        for y, b in first.items():
            longest = max(len(x), len(y))
            if a < b and abs(len(x) - len(y)) <= 25 and round(1 - _edits(x, y) / longest, 6) > 0.95:
                want.add((a, b))
    assert {(r["a"], r["b"]) for r in dedupe.fuzzy_pairs(docs).collect()} == want and len(want) > 10


def test_shared_passage_makes_no_fuzzy_candidates(spark):
    """Heads with a passage in common and unlike for the rest aren't measured against each other."""
    import random

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    passage, texts = word(150), []
    for _ in range(200):
        texts.append(passage + word(350))
    texts.append(texts[0][:400] + "#" + texts[0][401:])
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, head string")
    blocks = dedupe._blocks(docs, 0.95)
    pairs = blocks.alias("x").join(blocks.alias("y"), "block").filter("x.id < y.id").select("x.id", "y.id").distinct()
    assert pairs.count() < 50
    found = dedupe.fuzzy_pairs(docs, key="id", text="head").collect()
    assert [(r["a"], r["b"], r["ratio"]) for r in found] == [(0, 200, 0.998)]


def _near_heads(n):
    """Heads that differ by a few letters each."""
    import random

    rng = random.Random(11)
    base, texts = [rng.choice("abcdefghijklmnopqrst ") for _ in range(500)], []
    for _ in range(n):
        w = list(base)
        for _ in range(10):
            w[rng.randrange(490)] = rng.choice("uvwxyz")
        texts.append("".join(w))
    return texts


def test_fuzzy_pairs_ship_heads_once_for_a_tile(spark):
    """Of near copies each head is sent to a few places, not once for each other one, and all pairs are found there."""
    texts = _near_heads(150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("head"))
    tiles = dedupe._tiles(dedupe._candidates(rows, 0.95)).cache()
    assert tiles.count() == tiles.select("a", "b").distinct().count() == 150 * 149 // 2
    sent = tiles.select("place", F.explode(F.array("a", "b")).alias("id")).distinct()
    assert sent.count() < 10 * 150
    assert sent.groupBy("place").count().agg(F.max("count")).first()[0] < 4 * dedupe.TILE
    found = {(r["a"], r["b"]) for r in dedupe.fuzzy_pairs(docs).collect()}
    assert {p for p in found if p[0] in (0, 57)} == {(a, b) for a in (0, 57) for b in range(a + 1, 150) if _edits(texts[a], texts[b]) < 25}
    assert len(found) > 8_000


def test_fuzzy_candidates_are_sifted_and_met_once(spark):
    """Unlike heads with one rare passage make no candidates; near copies are met by few of the grams that they share."""
    import random

    rng = random.Random(5)
    unlike = ["".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(400)) for _ in range(60)]
    passage = "ÄÖÜ" * 30 + "0123456789"  # rarer than all else
    docs = spark.createDataFrame([(i, t[:200] + passage + t[200:]) for i, t in enumerate(unlike)], "id long, head string")
    assert dedupe._candidates(docs, 0.95).isEmpty()
    near = spark.createDataFrame(list(enumerate(_near_heads(60))), "id long, head string")
    blocks = dedupe._blocks(near, 0.95)
    met = blocks.alias("x").join(blocks.alias("y"), "block").filter("x.id < y.id")
    assert met.filter("x.before <> y.before OR x.before = 0").count() < 0.5 * met.count()
    assert dedupe._candidates(near, 0.95).count() == 60 * 59 // 2


def test_fuzzy_distances_are_edit_distances():
    import random

    rng = random.Random(2)
    for most in (0, 1, 3, 24, 300):
        xs, ys = [], []
        for letters in ("ab", "abcdefgh", "äб\U0001f600xyz"):
            for n in (0, 1, 2, 20, 63, 64, 90):
                x = "".join(rng.choice(letters) for _ in range(n))
                w = list(x)
                for _ in range(rng.randrange(8)):
                    at = rng.randrange(len(w) + 1)
                    w[at : at + rng.choice((0, 1, 2))] = rng.choice(("", "a", "bb"))
                xs += [x, x, x]
                ys += ["".join(w), "".join(rng.choice(letters) for _ in range(rng.randrange(90))), x]
        assert dedupe._distances(xs, ys, most).tolist() == [min(_edits(x, y), most + 1) for x, y in zip(xs, ys)]


def test_fuzzy_pairs_of_low_likeness_are_all_pairs(spark):
    texts = ["abcdef", "abxxef", "zzzzzz", "abc", "q", "ab", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (0.3, 0.6, 0.8):
        want = {(a, b) for b in range(len(texts)) for a in range(b) if round(1 - _edits(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])), 6) > least}
        assert {(r["a"], r["b"]) for r in dedupe.fuzzy_pairs(docs, least).collect()} == want


def test_fuzzy_dups_all_has_every_language(spark, tmp_path):
    from corpusmill.plans.catalogue import QUERIES

    texts = [("Ein längerer Satz über Straßen und Bäume ohne Punkt", "de"), ("Une phrase assez longue où tout est écrit sans point", None), ("plain words and one naïve letter in a longer sentence", "en")]
    rows = [(2 * i + k, t + "!" * k, lang) for i, (t, lang) in enumerate(texts) for k in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert values(QUERIES["fuzzy_dups_all"](spark, f"file://{tmp_path}"), "a", "b") == [(0, 1), (2, 3), (4, 5)]


def test_fuzzy_dups_all_against_all_pairs(spark):
    """Of the smallest tables; pairs whose letters alone differ by too much needn't be measured."""
    from collections import Counter

    from conftest import SF
    from corpusmill.plans.catalogue import QUERIES

    first = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 0").select("doc_id", "text").orderBy("doc_id").collect():
        first.setdefault(r["text"][:500], r["doc_id"])
    heads = sorted((i, t, Counter(t)) for t, i in first.items())
    want = set()
    for n, (a, x, cx) in enumerate(heads):
        for b, y, cy in heads[n + 1 :]:
            longest = max(len(x), len(y))
            if max((cx - cy).total(), (cy - cx).total()) < 0.05 * longest and round(1 - _edits(x, y) / longest, 6) > 0.95:
                want.add((a, b))
    assert {(r["a"], r["b"]) for r in QUERIES["fuzzy_dups_all"](spark, SF).collect()} == want and want


def test_equal_heads_keep_their_members(spark):
    docs = spark.createDataFrame([(1, "h" * 500 + "a"), (2, "h" * 500 + "b"), (3, "x"), (4, ""), (5, None)], "doc_id long, text string")
    assert values(dedupe.head_classes(docs), "id", "first_id") == [(1, 1), (2, 1), (3, 3)]


def test_summaries_of_whole_chunks(spark, tmp_path):
    from corpusmill.plans.catalogue import QUERIES

    rows = [(1, "a", "x" * 120), (2, "a", "y" * 250), (3, "b", "z" * 150), (4, None, "n"), *((10 + i, "c", "" if i % 2 else "k") for i in range(300))]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    want = {}
    for _, source, text in rows:
        want.setdefault(source, []).append(text)
    joined = {s: "\n\n".join(t) for s, t in want.items()}
    got = {r["source"]: (r["summary"], r["chunk_count"]) for r in QUERIES["summaries"](spark, f"file://{tmp_path}").collect()}
    assert got == {s: (t[:300] + "..." if len(t) > 300 else t, len(want[s])) for s, t in joined.items()}


def test_reachable_does_not_stop_early(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "start int")
    assert values(lineage.reachable(edges, start, most=4), "node") == [(1,), (2,), (3,), (4,)]
    with pytest.raises(ValueError):
        lineage.reachable(edges, start, most=2)


def test_syntax_chunks(spark):
    text = "import os\n\n@deco\ndef f():\n    return 1\n\nclass A:\n    x = 1\n\nprint(1)"
    rows = spark.createDataFrame([("a.py", text), ("b.py", "def ("), ("c.py", None)], "path string, text string")
    got = [tuple(r)[:5] for r in chunking.syntax_chunks(rows).orderBy("path", "chunk_index").collect()]
    assert got == [("a.py", 0, None, 1, 2), ("a.py", 1, "f", 3, 5), ("a.py", 2, "A", 7, 8), ("a.py", 3, None, 9, 10), ("b.py", 0, None, 1, 1)]


def test_repositories_and_wiki(spark):
    listed = spark.createDataFrame([("2", "b", None, "u"), ("1", "a", "refs/heads/dev", "u")], "id string, name string, default_branch string, url string")
    assert [(r["name"], r["default_branch"]) for r in readers.repositories(listed, 5).collect()] == [("a", "dev"), ("b", "main")]
    assert readers.repository_id(listed, "b") == "2"
    with pytest.raises(LookupError):
        readers.repository_id(listed, "c")
    landed = spark.createDataFrame([("/x/a.py", "r", "refs/heads/main"), ("/x/y/b.py", "r", "main"), ("/z.py", "r", "main"), ("/x/c.py", "s", "main")], "file_path string, repository string, branch string")
    assert [r[0] for r in readers.repo_items(landed, "r", below="/x").collect()] == ["/x/a.py", "/x/y/b.py"]
    assert [r[0] for r in readers.repo_items(landed, "r", below="/x", recursive=False).collect()] == ["/x/a.py"]
    page = lambda i, space, parent, title: (i, space, parent, f"u{i}", f"<title>{title}</title><p>text {i}</p>")
    pages = spark.createDataFrame([page(1, "s", None, "Top"), page(2, "s", 1, "Two"), page(3, "s", 2, "Three"), page(4, "t", None, "Two")], "page_id long, space_key string, parent_id long, url string, html string")
    assert values(readers.child_pages(pages, "1"), "page_id", "depth") == [(2, 1), (3, 2)]
    assert values(readers.child_pages(pages, "1", recursive=False), "page_id") == [(2,)]
    assert values(readers.wiki_spaces(pages, ["s"], parent="1"), "doc_id", "space_key") == [("2", "s"), ("3", "s")]
    assert values(readers.wiki_spaces(pages, ["s", "t"], most=1), "doc_id") == [("1",), ("4",)]
    assert values(readers.page_by_title(pages, "s", "Two"), "doc_id") == [("2",)] and readers.page_by_title(pages, "s", "x").count() == 0


def test_sources_are_routed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("plain text")
    (tmp_path / "repo.json").write_text(json.dumps({"file_path": "/m/a.sql", "repository": "r", "branch": "main", "content": "select 1", "commits": []}) + "\n")
    found = readers.ingest_sources(spark, [{"type": "local_files", "path": f"file://{tmp_path}/in"}, {"type": "repository", "landed": f"file://{tmp_path}/repo.json"}, {"type": "tickets"}, {"type": "wiki", "enabled": False}])
    assert values(found, "source_type", "title") == [("local_files", "a"), ("repo_file", "a.sql")]
    with pytest.raises(ValueError):
        readers.ingest_sources(spark, [{"type": "mail"}])
    readers.written_settings(str(tmp_path / "o.yaml"), {"a": 1, "b": 2}, ["b", "c"])
    assert readers.settings(str(tmp_path / "o.yaml")) == {"b": 2}
    assert readers.template(str(tmp_path / "none"), "d") == "d" and readers.template(str(tmp_path / "in/a.txt"), "d") == "plain text"


def test_deleting_keeps_a_whole_table_until_the_end(spark, tmp_path):
    rows = spark.createDataFrame([("wiki", f"s{i}") for i in range(6)], "source_type string, source string")
    path = f"file://{tmp_path}/v"
    writers.write_vectors(rows, path)
    writers.delete_documents(spark, path, rows.filter("source < 's4'"), ["source"], f"file://{tmp_path}/st")
    assert values(spark.read.parquet(path), "source") == [("s4",), ("s5",)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v"]


def test_cooldown_of_one_hot_key(spark):
    import random

    rng = random.Random(2)
    times = sorted({rng.randrange(200_000) for _ in range(3000)} | {300_000, 300_050})
    want, last = [], None
    for t in times:
        if last is None or t - last >= 100:
            want.append(t)
            last = t
    rows = spark.createDataFrame([(None, t) for t in times] + [(7, 5)], "k long, t long")
    got = ordered.cooldown(rows, "k", F.col("t"), 100)
    assert sorted(r["second"] for r in got.filter("k IS NULL").collect()) == want and got.filter("k = 7").count() == 1


def test_hierarchy_and_summary_defaults(spark, tmp_path):
    from corpusmill.operators import hooks

    chunks = spark.createDataFrame([("a", 0, "c0", "one"), ("a", 1, "c1", "two"), (None, 0, "c2", "three")], "source string, chunk_index int, chunk_id string, content string")
    writers.write_hierarchy(chunks, f"file://{tmp_path}/h")
    top, rows = spark.read.parquet(f"file://{tmp_path}/h/summaries"), spark.read.parquet(f"file://{tmp_path}/h/chunks")
    assert sorted((r["summary"], r["chunk_count"]) for r in top.collect()) == [("one\n\ntwo", 2), ("three", 1)]
    assert rows.join(top.select("summary_id"), "summary_id").count() == 3
    docs = spark.createDataFrame([(1, "beta alpha beta and gamma beta alpha"), (2, "")], "doc_id long, text string")
    assert dict(values(hooks.summarise(docs).fillna(""), "doc_id", "summary")) == {1: "beta, alpha, gamma", 2: ""}


def test_models_that_fail(monkeypatch):
    import time

    from corpusmill.operators import hooks

    waits = []
    monkeypatch.setattr(time, "sleep", waits.append)
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return texts

    assert hooks.with_retries(flaky, tries=3, wait=1.0)(["a"]) == ["a"] and waits == [1.0, 2.0]

    def broken(texts):
        raise OSError("down")

    assert hooks.with_fallback(broken, lambda texts: [t.upper() for t in texts])(["a"]) == ["A"]
    with pytest.raises(OSError):
        hooks.with_fallback(broken, broken)(["a"])
    with pytest.raises(OSError):
        hooks.with_retries(broken, tries=2)(["a"])


def test_segments_are_as_a_rebuild(spark, tmp_path, monkeypatch):
    """Additions, deletions, documents that come back, and merges on several levels."""
    from corpusmill.operators import index

    monkeypatch.setattr(index.SegmentedIndex, "FANOUT", 2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "rare"]
    text = lambda i, k=0: " ".join(words[(i * j + k) % (5 + (i % 7 == 0))] for j in range(1, 4 + i % 9))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    found = index.SegmentedIndex(spark, f"file://{tmp_path}/segments")
    live = {}
    for turn in range(5):
        rows = [(i, text(i, turn)) for i in range(10 * turn, 10 * turn + 10)] + [(1000 + turn, None)]
        found.add(frame(rows))
        live.update(rows)
        if turn in (1, 3):
            gone = [i for i in live if i % 4 == turn]
            found.delete(frame([(i, None) for i in gone]))
            for i in gone:
                del live[i]
            back = [(i, text(i, 7)) for i in gone[:3]]
            found.add(frame(back))
            live.update(back)
    rebuilt = index.build_index(frame(list(live.items())), f"file://{tmp_path}/rebuilt")
    scores = lambda x: {(r["doc_id"], r["score"]) for r in x.bm25("alpha rare omega alpha").collect()}
    assert scores(found) == scores(rebuilt) and len(scores(found)) > 10
    state = found._state()
    assert max(state["segments"].values()) >= 2 and len(state["segments"]) <= 3
    found.sweep()
    assert scores(found) == scores(rebuilt)


def test_hierarchical_branches(spark):
    """Boosts move summaries; a routed one without chunks stands for itself; a document is branched to once; equal texts stay once."""
    from corpusmill.operators import compositions

    tops = [("s1", "d1", "one", "cats dogs", "text", 0.5), ("s2", "d2", "two", "birds", "sql_model", 0.5), ("s3", "d3", "three", None, None, 0.9), ("s4", "d1", "four", "cats", "text", 0.55), ("s5", "d5", "five", "", "", 0.1)]
    summaries = spark.createDataFrame(tops, "summary_id string, doc_id string, content string, keywords string, document_type string, score double")
    chunks = spark.createDataFrame([("d1", 0, "a", 0.1), ("d1", 1, "b", 0.9), ("d2", 0, "b", 0.8), ("d2", 1, "c", 0.7), ("d5", 0, "z", 1.0)], "doc_id string, chunk_id long, content string, score double")
    got = lambda **kw: [(r["kind"], r["summary_id"], r["content"], r["relevance"]) for r in compositions.hierarchical_scored(summaries, chunks, "SQL cats dogs", **kw).orderBy("position").collect()]
    assert got(threshold=0.6) == [("summary", "s3", "three", 0.9), ("chunk", "s1", "b", 0.7), ("chunk", "s1", "a", 0.7), ("chunk", "s2", "c", 0.65)]
    assert got(threshold=0.8) == [("summary", "s3", "three", 0.9), ("summary", "s1", "one", 0.7), ("summary", "s4", "four", 0.65), ("summary", "s2", "two", 0.65), ("summary", "s5", "five", 0.1)]
    assert compositions.hierarchical_scored(summaries.limit(0), chunks, "x").count() == 0


def test_hierarchical_scores_no_chunks_of_other_documents(spark):
    from corpusmill.operators import compositions

    summaries = spark.sql("SELECT i AS summary_id, i AS doc_id, 'c' || i AS content, '' AS keywords, 'text' AS document_type, 1.0D / i AS score FROM VALUES (1L), (2L) t(i)")
    chunks = spark.range(1, 3).selectExpr("id AS doc_id", "0L AS chunk_id", "'d' || id AS content").withColumn("score", 1.0 / (F.col("doc_id") - 2))  # an error for document 2
    got = compositions.hierarchical_scored(summaries, chunks, "x", 1, 0.7).collect()
    assert [(r["kind"], r["doc_id"], r["content"]) for r in got] == [("chunk", 1, "d1")]


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = ["a" * 3000, None, "", *["b" * 500] * 20, "ü" * 5000]
    batch = pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "text": texts})
    parts = list(chunking.by_bytes(batch, "text", 2000))
    assert [i for p in parts for i in p["i"].to_pylist()] == batch["i"].to_pylist() and len(parts) > 7
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p["text"].to_pylist()) <= 2000 for p in parts)
    assert list(chunking.by_bytes(batch.slice(3, 0), "text")) == []


def test_postings_lie_in_blocks(spark, tmp_path):
    """A term's rows are shuffled and written together, however many there are."""
    from corpusmill.operators import index

    docs = spark.createDataFrame([(i, f"the word{i % 3} the") for i in range(300)] + [(300, None), (301, " ")], "doc_id long, text string").coalesce(1)
    found = index.build_index(docs, f"file://{tmp_path}/blocks")
    stored = spark.read.parquet(f"{found.folder}/postings")
    assert stored.filter("term <> ''").count() == 4
    rows = found.postings().filter("term = 'the'").agg(F.count("*"), F.sum("tf"), F.sum("dl"), F.countDistinct("doc_id")).first()
    assert tuple(rows) == (300, 600, 900, 300)
    assert values(found.postings().filter("term = '' AND doc_id >= 299"), "doc_id", "dl") == [(299, 3), (300, None), (301, 0)]
    assert values(found.terms(), "term", "df") == [("the", 300), ("word0", 100), ("word1", 100), ("word2", 100)]


def test_nearest_many_keeps_the_best_over_slices(spark, monkeypatch):
    """Ties go to the smaller key, whichever slice it is in."""
    from corpusmill.operators import dense

    monkeypatch.setattr(dense, "ROWS_AT_ONCE", 3)
    rows = [(100 - i, [1.0, float(i % 4)]) for i in range(40)] + [(200, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_index long, q array<double>")
    got = dense.nearest_many(vectors, asked, 5).collect()
    best = lambda rest: sorted(100 - i for i in range(40) if i % 4 == rest)[:5]
    for q, rest in ((0, 0), (1, 3)):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_index"] == q] == best(rest)
