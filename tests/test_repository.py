"""The repository source against a local service."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import readers, repository

FILES = {f"/src/mod{i:03d}.{('py', 'sql', 'md')[i % 3]}": f"line {i}\nsecond" for i in range(120)} | {"/docs/read me.md": "héllo", "/docs/empty.md": "", "/.git/config": "x"}


@pytest.fixture(scope="module")
def service():
    asked, fails = [], {"/src/mod007.sql": 2, "/src/mod009.py": 99}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
            if url.path.endswith("/commits"):
                body = {"value": [{"commitId": f"{i:08d}abcd", "author": {"name": f"a{i}", "date": f"2024-01-{i + 1:02d}"}, "comment": f"c{i}"} for i in range(int(q["searchCriteria.$top"]))]}
            elif "scopePath" in q:
                under = [p for p in FILES if p.startswith(q["scopePath"])]
                under = under if q["recursionLevel"] == "Full" else [p for p in under if "/" not in p[len(q["scopePath"]) :]]
                body = {"value": [{"gitObjectType": "tree", "path": "/src"}, *({"gitObjectType": "blob", "path": p} for p in under)]}
            else:
                asked.append(q["path"])
                if fails.get(q["path"], 0) > 0:
                    fails[q["path"]] -= 1
                    self.send_error(503)
                    return
                body = FILES[q["path"]]
            data = (body if isinstance(body, str) else json.dumps(body)).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_batch_reads_all_files_once(spark, service):
    url, asked = service
    rows = repository.repository(spark, url=url, repository="r", exclude="/.git", pause="0.01", history=3).collect()
    got = {r["file_path"]: r["content"] for r in rows}
    assert got == {p: c for p, c in FILES.items() if c and p != "/src/mod009.py" and not p.startswith("/.git")}  # one can't be had
    assert len(rows) == len(got) and all(len(r["commits"]) == 3 for r in rows)
    docs = {r["doc_id"]: r for r in readers.repo_documents(repository.repository(spark, url=url, repository="r", path="/docs/", pause="0.01")).collect()}
    assert docs["/docs/read me.md"]["title"] == "read me.md" and docs["/docs/read me.md"]["last_modified_by"] == "a9"


def test_filters_reach_the_listing(spark, service):
    url, asked = service
    read = lambda: repository.repository(spark, url=url, repository="r", pause="0.01", batch=7, pushdown="true")
    asked.clear()
    found = read().filter(F.startswith("file_path", F.lit("/src/mod01")) & F.endswith("file_path", F.lit(".sql"))).select("file_path").collect()
    want = {p for p in FILES if p.startswith("/src/mod01") and p.endswith(".sql")}
    assert {r[0] for r in found} == want and set(asked) == want
    asked.clear()
    assert read().filter("file_path IN ('/src/mod001.sql', '/nowhere') AND length(content) > 1").count() == 1 and asked == ["/src/mod001.sql"]
    df = repository.repository(spark, url=url, repository="r", pause="0.01", batch=7)
    assert df.filter("file_path = '/src/mod001.sql'").count() == 1
    assert read().filter("file_path = '/src/mod001.sql'").rdd.getNumPartitions() == 1 and df.rdd.getNumPartitions() == -(-len(FILES) // 7)


def test_stream_gives_the_rows_of_the_batch_after_restarts(spark, service, tmp_path):
    url, _ = service
    options = dict(url=url, repository="r", types=".sql,.md", pause="0.01", history=1)
    sizes = []
    for _ in range(4):  # each run is a restart: the next fifty, until there are none
        q = repository.repository(spark, stream=True, **options).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        sizes.append(sum(p["numInputRows"] for p in q.recentProgress))
    out = spark.read.parquet(f"file://{tmp_path}/out")
    batch = repository.repository(spark, **options)
    assert max(sizes) <= 50 and sizes[-1] == 0
    assert out.count() == batch.count() and out.exceptAll(batch.select(out.columns)).count() == 0
