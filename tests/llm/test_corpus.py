"""Quality rules, sharding, archives and the pipeline."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import archives, quality, sharding
from corpusmill.llm.catalogue import ORACLES, QUERIES
from helpers import SCHEMA, awkward, base_counts, components, line_dedup, prose, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_measures(docs):
    rows = {r[0]: r[1] for r in awkward()}
    got = quality.measures(docs).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_counts(rows[r["doc_id"]])


def test_buckets_keep_a_sixteenth(spark):
    df = spark.range(0, 5000).select(F.col("id"), quality.bucket_top(quality.bucket_of(F.col("id"))).alias("top"))
    assert df.filter("top < id OR top > id + id / 16").count() == 0
    low = spark.range(0, 5000).select(F.col("id"), quality.bucket_bottom(quality.bucket_of(F.col("id"))).alias("low"))
    assert low.filter("low > id OR low < id - id / 16").count() == 0


def test_sketches_merge(spark):
    from pyspark.sql import Row

    rows = [Row(lang="en", source=f"s{i % 3}", base_failed=False, n_words=100, word_chars=400 + i, n_symbols=0, n_lines=10, n_dup_lines=0, n_repeat_words=0) for i in range(300)]
    df = spark.createDataFrame(rows)
    whole = quality.sketches(df).groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    parts = quality.sketches(df.filter("word_chars % 2 = 0")).unionByName(quality.sketches(df.filter("word_chars % 2 = 1"))).groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(parts).count() == 0


def test_rules_drop_junk_and_keep_clean(spark):
    """In groups of every size: a few rows, a group of its own scale, and many."""
    clean = [(i, prose(i, 120), "en", f"s{i % 3 if i < 240 else i}") for i in range(250)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 100).split()), "en", f"s{i}") for i in range(5)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert kept == {c[0] for c in clean}


def test_thresholds_move_with_the_rows_of_a_group(spark):
    """The quantile of a group is its own in proportion to its rows: no switch at any size."""
    from pyspark.sql import Row

    found = []
    for n in (1, 10, 99, 100, 101, 1000, 10000):
        rows = [Row(lang="en", source=s, ratio=r, bucket=b, n=k) for r in quality.RATIOS for s, b, k in (("big", 10, 1_000_000), ("own", 30, n))]
        limits = quality.thresholds(spark.createDataFrame(rows, "lang string, source string, ratio string, bucket long, n long"))
        found.append(limits.filter("t_source = 'own'").first()["t_symbols"]["high"])
    assert found == [10 + 20 * n // (n + 100) for n in (1, 10, 99, 100, 101, 1000, 10000)]


def test_hot_and_cold_groups_get_their_limits(spark, monkeypatch):
    monkeypatch.setattr(quality, "HOT_SHARE", 0.2)
    docs = [(i, prose(i, 80), "en", "hot") for i in range(40)] + [(100 + i, prose(i, 80), None, f"c{i}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    a = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(df).collect()}
    monkeypatch.setattr(quality, "HOT_SHARE", 2.0)
    assert a == {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(df).collect()} and len(a) == 70


def test_shards(docs):
    rows = sharding.assign_shards(docs, weights=(1.0,) * 8).collect()
    texts = {r[0]: r[1] or "" for r in awkward()}
    slots = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


M = 1 << 64


def _xx64(data: bytes, seed: int) -> int:
    """xxHash64 of less than 32 bytes, by its public description."""
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    turn = lambda x, r: (x << r | x >> (64 - r)) % M
    h = (seed + p5 + len(data)) % M
    while len(data) >= 8:
        h = (turn(h ^ turn(int.from_bytes(data[:8], "little") * p2 % M, 31) * p1 % M, 27) * p1 + p4) % M
        data = data[8:]
    if len(data) >= 4:
        h = (turn(h ^ int.from_bytes(data[:4], "little") * p1 % M, 23) * p2 + p3) % M
    h = (h ^ h >> 33) * p2 % M
    h = (h ^ h >> 29) * p3 % M
    return h ^ h >> 32


def test_shards_are_those_of_the_highest_scores(spark):
    """Scores recomputed in Python from key and shard: winner, share by weight, and what a new shard takes."""
    import math

    weights = (1.0, 2.5, 0.5, 1.0, 3.0)

    def scores(key: int, n: int) -> list[float]:
        out = []
        for shard in range(n):
            h = _xx64(shard.to_bytes(4, "little"), _xx64((key % M).to_bytes(8, "little"), 42))
            out.append(-(*weights, 2.0)[shard] / math.log(((h >> 11) + 0.5) * 2.0**-53))
        return out

    keys = [*range(-200, 200), 2**62, -(2**63)]
    df = spark.createDataFrame([(k, "x") for k in keys], "doc_id long, text string")
    for r in sharding.assign_shards(df, weights=weights, grown_weight=2.0).collect():
        now, grown = scores(r["doc_id"], 5), scores(r["doc_id"], 6)
        assert r["shard"] == max(range(5), key=now.__getitem__) and r["grown_shard"] == max(range(6), key=grown.__getitem__)


def test_growth_is_the_larger_assignment(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    small = {r["doc_id"]: r for r in sharding.assign_shards(df, weights=(1.0,) * 8).collect()}
    large = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df, weights=(1.0,) * 9).collect()}
    assert all(large[d] == r["grown_shard"] for d, r in small.items())
    moved = sum(r["grown_shard"] == 8 for r in small.values())
    assert abs(moved / 20_000 - 1 / 9) < 0.01
    heavy = sharding.assign_shards(df, weights=(3.0, 1.0)).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in heavy}[0] / 20_000 - 0.75) < 0.02


SF = "/root/testdata/sf0.001"
PAGES = [
    (1, "http://a/x y", "p" * 2000),
    (2, None, "p" * 2000),
    (2, None, "p" * 2000),
    (3, "https://é", None),
    (4, "http://a", ""),
    (5, "u", "s" * 999),
    (6, "u", "s" * 999),
    (7, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\nx"),
    (None, "u", "z" * 5000),
    (8, "u", "é" * 300_000),
]


def test_archives(spark, monkeypatch):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("uri", F.lit("x")).repartition(3)
    got = archives.archive_pages(df).collect()
    assert len(got) == len(PAGES)
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    for r in got:
        data = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (1, 2, 5, 6)), key=str)
    assert kinds == [(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (5, "response", None), (6, "response", None)]
    assert archives.archive_pages(df.filter("page_id < 0")).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions_and_bad_files(tmp_path, version):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\npayload\nwith lines\n"
    uri = f"file://{tmp_path}/t.arc"
    (tmp_path / "t.arc").write_bytes(archives.arc_header(version, "t.arc") + archives.arc_record(version, "t.arc", 5, "http://a/b c", body) + body + b"\n")
    first, record = archives.read_arc(uri)
    assert first.fields["URL"] == "filedesc://t.arc" and record.content == body and record.fields["URL"] == "http://a/b c"
    head, block = archives.warc_record(1, 1, record)
    assert b"WARC-Type: response" in head and b"WARC-Date: 2024-01-01T00:00:00Z" in head and block == body
    assert archives.warc_record(1, 1, record) == archives.warc_record(1, 1, record)
    assert b"WARC-Type: warcinfo" in archives.warc_record(1, 0, first)[0]
    (tmp_path / "t.arc").write_bytes(archives.arc_header(version, "t.arc") + b"http://a 1.1.1.1 20240101000000 text/html 99\nshort")
    with pytest.raises(ValueError):
        list(archives.read_arc(uri))


def test_offsets_are_those_of_members(spark, tmp_path):
    """The offset in a version 2 header line is where the record's gzip member begins."""
    import gzip
    import io

    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string").repartition(2)
    seen = 0
    for row in archives.write_arcs(df, f"file://{tmp_path}/arcs").collect():
        data = open(row["uri"].removeprefix("file://"), "rb").read()
        for arc in archives.read_arc(row["uri"]):
            if "Offset" in arc.fields:
                member = gzip.GzipFile(fileobj=io.BytesIO(data[int(arc.fields["Offset"]) :]))
                assert member.readline().split()[0] == arc.fields["URL"].split()[0].encode()
                seen += 1
    assert seen > 10


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality.quality_verdicts(none).count() == 0
    assert quality.keep_good(none).count() == 0
    assert sharding.assign_shards(none).count() == 0


def test_pipeline_is_its_stages_one_after_the_other(spark, tmp_path):
    """run() against brute force of each stage on what the one before kept, down to the pieces' ids."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = awkward(repeat=False)
    junk = [(200 + i, " ".join(w + "###" for w in prose(300 + i, 70).split()), "en", "s0", 1) for i in range(3)]
    near = [(300 + i, " ".join([*prose(400 + i // 2, 150).split()[: 150 - 20 * (i % 2)], f"end{i}"]), "en", "s1", 1) for i in range(20)]
    boiler = [(400 + i, prose(500 + i, 60) + "\n  One Licence LINE \n" + prose(600 + i, 40), "de", "s2", 1) for i in range(14)]
    docs = [r[:5] for r in rows] + junk + near + boiler
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    frame.write.parquet(f"file://{tmp_path}/documents.parquet")

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    good = {d for d, *_, kept in con.sql(f"SELECT doc_id, kept FROM ({ORACLES['op10_quality']})").fetchall() if kept}
    now = [(d, t) for d, t, *_ in docs if d in good]
    assert not {200, 201, 202} & good and {400, 300} <= good and len(now) < len(docs) - 5
    now = [(d, t) for d, _, _, t in line_dedup(now)]
    assert sum("Licence" in t for _, t in now) == 0
    linked = components(dict(now), 80)
    now = [(d, t) for d, t in now if linked[d] == d]
    assert 0 < sum(d in range(300, 320) for d, _ in now) < 20
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in now:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(d, i, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]

    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 1024


def test_pipeline_stages_keep_the_columns_of_awkward_rows(spark, docs):
    """Repeated rows, nulls and clashing columns: every stage runs on all of them by itself."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == corpus_pipeline.COLUMNS
    twice = spark.createDataFrame([(1, prose(1, 60)), (1, prose(2, 60)), (None, prose(3, 60)), (None, prose(4, 60)), (2, None)], "doc_id long, text string").withColumns({c: F.lit(None).cast(k) for c, k in (("lang", "string"), ("source", "string"), ("n_chars", "long"))})
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, twice, SF).collect()))) == ["1", "2", "None", "None"]
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, twice, SF).collect()}[2] is None


def test_pipeline_on_an_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0


def test_near_stage_links_from_080(spark):
    """Pairs edited to lie between 0.7 and 0.95; those from 0.80 up to 0.85 are linked as well."""
    texts = {}
    for i in range(40):
        w = prose(100 + i, 150).split()
        texts[2 * i] = " ".join(w)
        for j in range(1 + i % 5):
            w[7 + 30 * j] = f"e{i}_{j}"
        texts[2 * i + 1] = " ".join(w)
    want = components(texts, 80)
    assert want != components(texts, 85)
    docs = spark.createDataFrame([(d, t, "en", "s0", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert got == {d for d in texts if want[d] == d}


def test_near_uniform_groups_keep_long_texts(spark):
    """Where a rate is nearly always 0, a few occurrences in a long text are no sign; many still are."""
    clean = [(i, " ".join(f"w{i * 200 + j:05d}" for j in range(200)), "en", "s") for i in range(300)]
    lines = [" ".join(f"v{8 * i + j:05d}" for j in range(8)) for i in range(997)]
    long = [(1000, "\n".join(lines + lines[:3]), "en", "s"), (1001, "\n".join(lines), "en", "s"), (1002, "\n".join(lines[:600] + lines[:400]), "en", "s"), (1003, " ".join(f"u{j:05d}#" for j in range(200)), "en", "s")]
    df = spark.createDataFrame(clean + long, "doc_id long, text string, lang string, source string")
    dropped = {r["doc_id"] for r in quality.quality_verdicts(df).filter("NOT kept").collect()}
    assert dropped == {1002, 1003}
