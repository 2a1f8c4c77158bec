"""Legacy ARC archives to WARC: header lines and declared lengths in, synthesised WARC records out.

Pages are written to ARC files (version 1 and 2 by turns), the converter turns these into WARC/1.1
files, and the reader reads those back. Files lie in the shared folder; each task streams whole files
record by record, so memory holds one record. A file is rolled over at ``FILE_BYTES``.

Which records become revisits is decided on an index of digests without payloads: the payloads are
never shuffled.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .workspace import Workspace, table

FILE_BYTES = 64 << 20
#: Payloads from this length up are deduplicated.
LEAST = 1000
#: Pages carry no capture time; records get this one.
CAPTURED = "20240101000000"
FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE, TARGET = "X-Page-Id", "X-Refers-To-Page-Id"
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArcRecord(NamedTuple):
    fields: dict[str, str]
    content: bytes


class Revisit(NamedTuple):
    page: int | None
    record_id: str


def _url_of(url: str | None, page: int | None) -> str:
    """A URL that fits in a header line: blanks, controls and non-ASCII characters percent-encoded."""
    if not url:
        return f"urn:page:{'' if page is None else page}"
    return "".join(c if 0x21 <= ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


class _Member:
    """Writes gzip members, one for each record, beside the path; moves the file into place at the end."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self._draft = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self._out = self.fs.open_output_stream(self._draft)
        self.size = 0

    def put(self, *data: bytes) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        for d in data:
            self._out.write(z.compress(d))
            self.size += len(d)
        self._out.write(z.flush())

    @property
    def packed(self) -> int:
        """Where the next member begins in the file."""
        return self._out.tell()

    def close(self) -> None:
        self._out.close()
        self.fs.move(self._draft, self.path)


def _open(uri: str) -> io.BufferedReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    raw = fs.open_input_file(path)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)


def _exactly(stream: io.BufferedReader, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"record ends after {len(data)} of {n} bytes")
    return data


def arc_header(version: str, name: str) -> bytes:
    body = f"{version} 0 corpusmill\n{' '.join(FIELDS[version])}\n".encode()
    first = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(first[f] for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: str, name: str, offset: int, url: str, content: bytes) -> bytes:
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(content))}
    return " ".join(values[f] for f in FIELDS[version]).encode() + b"\n"


def read_arc(uri: str) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version block first.

    The version block names the version and the fields of the header lines that follow; lines are
    split from the right, because a URL may hold blanks in old files. Contents are taken by their
    declared length.
    """
    with _open(uri) as stream:
        line = stream.readline()
        if not line.startswith(b"filedesc://"):
            raise ValueError(f"{uri} has no ARC version block")
        block = _exactly(stream, int(line.split()[-1]))
        version, names = block.split(b"\n")[0].split()[0].decode(), block.split(b"\n")[1].decode().split()
        if names != FIELDS.get(version):
            raise ValueError(f"{uri}: unknown ARC version {version}")

        def parsed(raw: bytes) -> dict[str, str]:
            values = raw.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(names) - 1)
            if len(values) != len(names):
                raise ValueError(f"{uri}: header line with {len(values)} of {len(names)} fields")
            return dict(zip(names, values, strict=True))

        yield ArcRecord(parsed(line), block)
        while line := stream.readline():
            if line.strip():
                fields = parsed(line)
                yield ArcRecord(fields, _exactly(stream, int(fields["Archive-length"])))


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload; no head where the content has none."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    m = re.search(rb"\r?\n\r?\n", content)
    return (content[: m.end()], content[m.end() :]) if m else (content, b"")


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace") if m else None


def record_id(file_no: int, seq: int) -> str:
    """Identifier of a converted record: the same whenever and wherever the file is converted."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'arc:{file_no}:{seq}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(file_no: int, seq: int, arc: ArcRecord, revisit: Revisit | None = None) -> tuple[bytes, bytes]:
    """Header and block of the WARC record that stands for an ARC record."""
    d = arc.fields["Archive-date"].ljust(14, "0")[:14]
    head, payload = split_http(arc.content)
    lines = {"WARC-Record-ID": record_id(file_no, seq), "WARC-Date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"}
    block = arc.content
    if arc.fields["URL"].startswith("filedesc://"):
        lines |= {"WARC-Type": "warcinfo", "WARC-Filename": arc.fields["URL"][11:], "Content-Type": "application/warc-fields"}
        block = b"software: corpusmill\r\nformat: WARC File Format 1.1\r\nconvertedFrom: ARC " + arc.content.split(b" ")[0] + b"\r\n"
    else:
        lines |= {"WARC-Target-URI": arc.fields["URL"], "WARC-IP-Address": arc.fields["IP-address"], "WARC-Payload-Digest": _digest(payload)}
        if revisit:
            lines |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": revisit.record_id, TARGET: "" if revisit.page is None else str(revisit.page), "Content-Type": "application/http;msgtype=response"}
            block = head
        elif head:
            lines |= {"WARC-Type": "response", "Content-Type": "application/http;msgtype=response"}
        else:
            lines |= {"WARC-Type": "resource", "Content-Type": arc.fields["Content-type"]}
    lines |= {"WARC-Block-Digest": _digest(block), "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode(), block


def read_warc(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a WARC file."""
    with _open(uri) as stream:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{uri}: not a WARC record: {line[:40]!r}")
            fields = {}
            while (line := stream.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.partition(b":")
                fields[name.decode().lower()] = value.strip().decode("utf-8", "replace")
            yield fields, _exactly(stream, int(fields["content-length"]))


def write_arcs(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as HTTP responses to ARC files; (file_no, uri, records), one row for each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, out, n = TaskContext.get().partitionId(), 0, None, 0
        listed: list[tuple[int, str, int]] = []
        for batch in batches:
            for page, link, text in zip(*(batch[c].to_pylist() for c in ("page", "url", "html")), strict=True):
                if out is not None and out.size >= FILE_BYTES:
                    out.close()
                    listed.append((no, uri, n))
                    out, turn = None, turn + 1
                if out is None:
                    no, n = (part << 32) + turn, 0
                    version, name = "12"[(part + turn) % 2], f"pages-{part:06d}-{turn:06d}.arc.gz"
                    uri = f"{folder}/{name}"
                    out = _Member(uri)
                    out.put(arc_header(version, name))
                payload = (text or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n" + (f"{PAGE}: {page}\r\n" if page is not None else "") + "\r\n"
                content = head.encode() + payload
                out.put(arc_record(version, name, out.packed, _url_of(link, page), content), content, b"\n")
                n += 1
        if out is not None:
            out.close()
            listed.append((no, uri, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in listed], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["file_no", "uri", "records"])

    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(write, "file_no long, uri string, records long")


def index_arcs(arcs: DataFrame) -> DataFrame:
    """(file_no, seq, page_id, payload_bytes, digest) of every record in the listed ARC files."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, uri in zip(batch["file_no"].to_pylist(), batch["uri"].to_pylist(), strict=True):
                rows = []
                for seq, arc in enumerate(read_arc(uri)):
                    if seq:
                        head, payload = split_http(arc.content)
                        page = http_field(head, PAGE)
                        rows.append((no, seq, int(page) if page else None, len(payload), hashlib.sha1(payload).hexdigest()))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["file_no", "seq", "page_id", "payload_bytes", "digest"])

    return arcs.select("file_no", "uri").mapInArrow(index, "file_no long, seq long, page_id long, payload_bytes long, digest string")


def convert_arcs(arcs: DataFrame, indexed: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a WARC file for every ARC file; (file_no, uri, records).

    Of records with equal payloads of at least ``least`` bytes, the one with the largest page id is
    a response and the others revisit it; among rows of that same id the last one written is.
    """
    kept = F.max(F.struct("page_id", "file_no", "seq")).alias("kept")
    groups = indexed.filter(F.col("payload_bytes") >= least).groupBy("digest").agg(kept, F.count("*").alias("n")).filter("n > 1").select("digest", "kept")
    again = indexed.filter(F.col("payload_bytes") >= least).join(groups, "digest").filter((F.col("file_no") != F.col("kept.file_no")) | (F.col("seq") != F.col("kept.seq")))
    # as many as the file has records at most, which FILE_BYTES bounds
    decisions = again.groupBy("file_no").agg(F.collect_list(F.struct("seq", F.col("kept.page_id").alias("page"), F.col("kept.file_no").alias("kept_file"), F.col("kept.seq").alias("kept_seq"))).alias("revisits"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, uri, revisits in zip(*(batch[c].to_pylist() for c in ("file_no", "uri", "revisits")), strict=True):
                found = {r["seq"]: Revisit(r["page"], record_id(r["kept_file"], r["kept_seq"])) for r in revisits or ()}
                target = f"{folder}/{uri.rpartition('/')[2].removesuffix('.gz').removesuffix('.arc')}.warc.gz"
                out, n = _Member(target), 0
                for n, arc in enumerate(read_arc(uri)):
                    out.put(*warc_record(no, n, arc, found.get(n)), b"\r\n\r\n")
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([target]), pa.array([n], pa.int64())], names=["file_no", "uri", "records"])

    return arcs.select("file_no", "uri").join(decisions, "file_no", "left").mapInArrow(convert, "file_no long, uri string, records long")


def read_pages(warcs: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in WARC files.

    Digests of payloads that are there are computed and must equal the recorded ones; a revisit's
    length is what its HTTP head declares.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                rows = []
                for fields, block in read_warc(uri):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest = fields["warc-payload-digest"]
                    page, target, size = http_field(head, PAGE), None, len(payload)
                    if kind == "revisit":
                        target, size = fields[TARGET.lower()], int(http_field(head, "Content-Length"))
                    elif _digest(payload) != digest:
                        raise ValueError(f"{uri}: payload of {fields['warc-record-id']} doesn't have its digest")
                    rows.append((int(page) if page else None, size, base64.b32decode(digest[5:]).hex(), kind, int(target) if target else None))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return warcs.select("uri").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, ws: Workspace | None = None) -> DataFrame:
    """Pages through ARC files and converted WARC files, as read back from these.

    Null htmls are empty payloads, null or odd URLs get one that fits in a header line. Repeated rows
    give a record each; extra columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    ws = ws or Workspace(spark, "archives")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arcs = ws.save(write_arcs(pages, ws.folder("arc"), key, url, html), "arc-list").repartition(spread, "file_no")
    indexed = ws.save(index_arcs(arcs), "index")
    warcs = ws.save(convert_arcs(arcs, indexed, ws.folder("warc"), least), "warc-list")
    ws.drop("arc", "index")
    return read_pages(warcs.repartition(spread, "file_no"))


def op9_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m"""
