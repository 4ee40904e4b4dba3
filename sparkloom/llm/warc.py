"""WARC archives: write one record per page, index first, then read selected records by coalesced byte ranges.

An archive holds one gzip member per record, so that an (offset, length) range decodes on its own. The
index is a table of file, offset, length, url and payload digest. A task writes its archive under a name
of its own and only the index rows of the attempt that succeeds are kept, so a lost executor leaves at
most a file that no index row names.

Cases: a null payload is empty; a null url is an empty target; rows with a null page_id have no record
id and are always responses; repeated rows are each written, and a repeat of the response's page_id is a
response too; other columns are ignored; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .kernel import column

MIN_SHARED = 100  # bytes: equal payloads of at least this size are written once
ROLL = 256 << 20  # bytes: an archive beyond this size is closed and another begun
GAP, SPAN = 64 << 10, 8 << 20  # ranges with smaller gaps are read at once, up to this many bytes
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string"
RECORD = "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, payload binary"


def _fs(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _urn(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _record(page, url, payload: bytes, digest: str, refers) -> bytes:
    target = "".join(c for c in url or "" if c not in "\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> dict:
    """One record: its headers, and of its block the HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x[len("<urn:page:") : -1]) if len(x) > len("<urn:page:>") else None
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI", ""),
        "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "declared_bytes": declared,
        "declared_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "payload": payload if kind == "response" else None,
    }


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers in zip(*(column(batch, c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    fs, inner = _fs(folder)
                    fs.create_dir(inner, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, at, out = f"{folder}/{name}", 0, fs.open_output_stream(f"{inner}/{name}", compression=None)
                raw = _record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())
                out.write(raw)
                rows.append((path, at, len(raw), page.as_py(), url.as_py(), digest.as_py()))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "offset", "length", "page_id", "url", "payload_digest"])
        if out is not None:
            out.close()

    return write


def write_archives(pages: DataFrame) -> DataFrame:
    """Archives of pages (page_id, url, html) in the shared folder; returns the index as a written table."""
    spark = pages.sparkSession
    common.tune(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = rows.filter(F.octet_length("payload") >= MIN_SHARED).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "first")
    shared = common.materialize(shared, "warc-shared")  # so that the join below is between two plain exchanges, whose hot digests are split
    joined = rows.join(shared, "payload_digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first")))
    folder = common.fresh_path(spark, "warc")
    return common.materialize(joined.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(common.freeing(_writer(folder)), INDEX), "warc-index")


def _ranges(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of (file, offset, length) that one read serves."""
    run: list[tuple] = []
    for r in rows:
        if run and (r[0] != run[-1][0] or r[1] - (run[-1][1] + run[-1][2]) > GAP or r[1] + r[2] - run[0][1] > SPAN):
            yield run
            run = []
        run.append(r)
    if run:
        yield run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("payload", pa.binary()))
    opened: dict[str, pa.NativeFile] = {}
    for batch in batches:
        rows = list(zip(*(column(batch, c).to_pylist() for c in ("file", "offset", "length", "payload_digest")), strict=True))
        for run in _ranges(rows):
            file, begin, end = run[0][0], run[0][1], run[-1][1] + run[-1][2]
            if file not in opened:
                for x in opened.values():
                    x.close()
                fs, inner = _fs(file)
                opened = {file: fs.open_input_file(inner)}
            data = opened[file].read_at(end - begin, begin)
            got = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for _, o, n, _ in run]
            for x, (_, o, _, wanted) in zip(got, run, strict=True):
                if wanted != x["declared_digest"] or x["payload"] is not None and digest(x["payload"]) != wanted:
                    raise ValueError(f"the record at {o} of {file} is not the one that the index names")
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in got], t) for c, t in types], names=[c for c, _ in types])
    for x in opened.values():
        x.close()


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index rows name; one whose payload has another digest is an error. Rows of one 16 MB stretch of an archive meet in one task, sorted by offset."""
    n = common.partitions(index.sparkSession)
    at = index.select("file", "offset", "length", "payload_digest").withColumn("stretch", F.expr("offset div 16777216"))
    return at.repartition(n, "file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(common.freeing(_reader), RECORD)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    got = read_records(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    full = F.col("payload").isNotNull()
    return got.select(
        "page_id",
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""


def digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
