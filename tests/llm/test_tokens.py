"""Encoders, packing, token files and counts against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusmill.llm import byte_bpe, packing, pretokens, token_counts, token_files, token_ids
from corpusmill.llm.workspace import Workspace
from helpers import SCHEMA, awkward

JSON, RANKS, MODEL = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
ODD = st.text(st.one_of(st.sampled_from(list(" \n\t'sdmtrevlAb1!é　\x85\x1c漢😀")), st.characters(exclude_categories=["Cs"])), max_size=40)
PATTERN = regex.compile(P.PATTERN)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_split_is_the_pattern(texts):
    assert pretokens.split_texts(texts) == [PATTERN.findall(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(ODD)
def test_bpe_is_the_library(tik, text):
    bpe = byte_bpe.encoder(RANKS)
    ((ids, _),) = bpe.encode([text])
    assert ids.tolist() == tik.encode_ordinary(text) and bpe.decode(ids) == text.encode()


def test_bpe_on_long_pieces(tik):
    bpe = byte_bpe.encoder(RANKS)
    for text in ("ab" * 20_000, "\n" * 3000, "".join(random.Random(1).choices("abcdefgh", k=30_000))):
        ((ids, _),) = bpe.encode([text])
        assert ids.tolist() == tik.encode_ordinary(text)


def test_cache_is_bounded():
    cache = pretokens.PieceCache(lambda ps: [p.upper() for p in ps], size=10)
    for i in range(100):
        assert cache.values([f"a{j}" for j in range(i, i + 5)]) == [f"A{j}" for j in range(i, i + 5)]
        assert len(cache.young) + len(cache.old) <= 40


def test_round_trip(docs, tik):
    texts = {r[0]: r[1] or "" for r in awkward()}
    rows = byte_bpe.round_trip(docs, RANKS).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        ids = tik.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_ids_are_the_library(library):
    texts = [r[1] or "" for r in awkward()] + ["<|endoftext|>", " <|endoftext|> a<|endoftext|>\n", "a  <|endoftext|>"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_ids.TokenIds(JSON).encode(texts)]
    assert got == want
    other = token_ids.TokenIds(P.path("word_bpe_49k.json"))
    assert not other.by_pieces
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert np.frombuffer(next(other.encode(["Some words"])), "<u4").tolist() == t.encode("Some words", add_special_tokens=False).ids


def _plan_checked(counts, size):
    plan, taken = packing.plan(counts, size)
    used = np.zeros(size + 1, dtype=int)
    for parts, n in plan:
        assert n > 0 and sum(parts) <= size
        for p in parts:
            used[p] += n
    assert (used == counts).all()
    return sum(n for _, n in plan), taken


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_uses_every_piece_once(lengths):
    _plan_checked(np.bincount(lengths, minlength=65) if lengths else np.zeros(65, dtype=int), 64)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_new_patterns_are_the_best_ones(lengths):
    """Against all patterns of up to three lengths around each length."""
    rng = np.random.default_rng(len(lengths))
    value = np.full(31, -np.inf)
    value[lengths] = rng.normal(size=len(lengths))
    parts, totals = packing.best_patterns(value, 30, 1)
    here = sorted(set(lengths))
    for p, t in zip(parts, totals):
        first = int(p[0])
        options = [(first,), *((first, b) for b in here if first + b <= 30), *((first, b, c) for b in here for c in here if first + b + c <= 30)]
        assert sum(p) <= 30 and abs(t - max(sum(value[list(o)]) for o in options)) < 1e-9 and abs(t - sum(value[[q for q in p if q]])) < 1e-9


def test_least_squares_are_those_of_all_supports():
    """The active set's minimum against the least over all subsets of the same columns."""
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = np.zeros(21, dtype=np.int64)
        counts[rng.choice(np.arange(1, 20), 5, replace=False)] = rng.integers(1, 30, 5)
        there = np.flatnonzero(counts).tolist()
        every = [p for k in (1, 2, 3) for p in itertools.combinations_with_replacement(there, k) if sum(p) <= 20]
        patterns = [every[i] for i in rng.choice(len(every), min(7, len(every)), replace=False)]
        squares = packing.NonNegative(counts, 20)
        squares.add(patterns)
        rest = squares.solve(1e-9)
        values = [squares.wanted @ squares.wanted]
        for k in range(1, len(patterns) + 1):
            for on in itertools.combinations(range(len(patterns)), k):
                a = squares.columns[list(on)].T
                y, *_ = np.linalg.lstsq(a, squares.wanted, rcond=None)
                if (y >= -1e-12).all():
                    values.append(((squares.wanted - a @ y) ** 2).sum())
        assert abs(rest @ rest - min(values)) < 1e-6 and (squares.x >= 0).all()


@pytest.mark.parametrize("n, mean, share", [(1000, 5.6, 0.5), (20_000, 5.6, 0.9), (20_000, 4.0, 0.7)])
def test_plan_is_tight_and_by_patterns(n, mean, share):
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(mean, 0.9, n).astype(int), 1, 1023)
    sequences, taken = _plan_checked(np.bincount(lengths, minlength=1025), 1024)
    assert sequences <= -(-int(lengths.sum()) // 1024) * 1.005 + 1
    assert taken >= share * n


def test_packing(docs, library):
    rows = packing.pack_documents(docs, JSON).collect()
    ids = {r[0]: [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in awkward()}
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert sum(r["length"] for r in rows) == sum(len(ids[r[0]]) for r in awkward())
    for d, pieces in by.items():
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[d][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            assert p["length"] == 1024 or p["piece"] == 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_blocks_round_trip(values):
    ids = np.array(values, dtype=np.uint32)
    data, at, out = b"".join(token_files.encode_blocks(ids)), 0, []
    starts = []
    while at < len(data):
        starts.append(at)
        block, at = token_files.decode_block(data, at)
        out += block.tolist()
    assert out == values
    if starts:
        assert token_files.decode_blocks(data, np.array(starts)).tolist() == values


def test_token_file_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SPLIT_IDS", 800)
    uri = f"file://{tmp_path}/a.pfor"
    w = token_files.TokenFileWriter(uri)
    ids = np.random.default_rng(1).integers(0, 50_257, 5000).astype("<u4")
    w.add([1, -(1 << 63)], [ids[:700], ids[:0]])
    w.add([None], [ids[700:]])
    splits = w.close()
    assert splits == [(0, 2, 0, 700), (2, 1, 700, 4300)]
    f = token_files.TokenFile(uri)
    for low, high in ((650, 1300), (0, 5000), (4999, 5000), (256, 512), (5, 5)):
        assert f.read(low, high).tolist() == ids[low:high].tolist()
    assert [(k, len(t)) for keys, texts in f.documents(ids_at_once=500) for k, t in zip(keys, texts)] == [(1, 700), (-(1 << 63), 0), (None, 4300)]
    assert [(k, t.tolist()) for keys, texts in f.documents(2, 1, 700) for k, t in zip(keys, texts)] == [(None, ids[700:].tolist())]
    with pytest.raises(ValueError):
        (tmp_path / "b.pfor").write_bytes(b"x" * 100)
        token_files.TokenFile(f"file://{tmp_path}/b.pfor")


def test_files_roll_and_equal_keys_are_dealt_out(spark, library):
    """Many small files in key order; rows of one key and rows without a key go to several parts."""
    texts = [f"text number {i} " * (i % 7) for i in range(400)]
    rows = [(None if i < 100 else 5 if i < 200 else i, t) for i, t in enumerate(texts)]
    ws = Workspace(spark, "rolled")
    files = ws.save(token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ws.folder("f"), JSON, partitions=8), "list")
    assert files.select("part").distinct().count() > 5
    got = token_files.read_token_files(files).orderBy("start").collect()
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    keys = [r["doc_id"] for r in got]
    assert keys == [None] * 100 + [5] * 100 + list(range(200, 400))
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted(r["ids_crc32"] for r in got) == sorted(map(crc, texts))


def test_token_files(spark, docs, library):
    ws = Workspace(spark, "files")
    written = ws.save(token_files.write_token_files(docs, ws.folder("f"), JSON, partitions=3), "list")
    got = sorted(token_files.read_token_files(written).collect(), key=lambda r: r["start"])
    at = 0
    for r, (d, t) in zip(got, sorted((r[0], r[1] or "") for r in awkward()), strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a ", "the ", "  ", "漢", " word", "longerword", "▁", " ▁", "\n", "\t", "\r\n", "\u00a0", "\u3000", "e\u0301", "tion ", "x" * 20, "é", "."]), max_size=80))
def test_splicing(parts):
    text = "".join(parts)
    c = token_counts.PieceCounter(MODEL, chunk=60, overlap=8)
    assert c.counts([text]) == [len(c.model.encode(text))]


def test_token_counts(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r[0]: r[1] or "" for r in awkward()}
    for r in token_counts.token_counts(docs, MODEL).collect():
        t = texts[r["doc_id"]]
        n = len(model.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    ws = Workspace(spark, "none")
    assert byte_bpe.round_trip(none, RANKS).count() == 0
    assert packing.pack_documents(none, JSON).count() == 0
    assert token_files.read_token_files(ws.save(token_files.write_token_files(none, ws.folder("f"), JSON), "l")).count() == 0
    assert token_counts.token_counts(none, MODEL).count() == 0
