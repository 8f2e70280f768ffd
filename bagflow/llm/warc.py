"""WARC archives, index first.

`write` makes one record per page in gzip members of .warc.gz files and returns the index: file, offset, length, URL
and digest per record. `read` takes any selection of index rows, sorts them by place, joins neighbouring byte ranges
into few larger reads, and returns the parsed records. Records with equal payloads of at least `least_bytes` are
stored once: the one of the largest page_id is the response, the others are revisits that refer to it.

Archives are written and read through pyarrow's filesystems, so the folder may be any URI that those open; by
default it lies in the shared folder. A task names its file by its attempt, and only index rows of tasks that
succeeded refer to files, so retries and lost executors leave no wrong record.

Defined results: null html is an empty payload; null URL is written empty and read as null; rows that repeat the
largest page_id of their payload are all responses; rows without a page_id count as the smallest; an empty table
gives no files and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ._common import written

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: A read of several records skips at most so many bytes between two of them, and holds at most so many.
MOST_GAP, MOST_READ = 64 << 10, 8 << 20
BLOCK = 8 << 20


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(page_id, url, html: bytes, first, date: str) -> tuple[str, str, bytes]:
    """Record type, digest and the record's bytes (before compression)."""
    digest = base32_sha1(html)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(html)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    body = http + (html if first is None else b"")
    head.append(f"Content-Length: {len(body)}")
    return "response" if first is None else "revisit", digest, "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(data: bytes) -> tuple:
    """The columns of RECORD from one record's bytes; raises if the digest of a stored payload differs."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    got = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = body[: int(got["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = got["WARC-Type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"digest of {got['WARC-Record-ID']} doesn't match its payload")
    page, first = (x[10:-1] if x else "" for x in (got["WARC-Record-ID"], got.get("WARC-Refers-To", "")))
    return int(page) if page else None, got["WARC-Target-URI"] or None, kind, int(first) if first else None, int(got["X-Payload-Length"]), digest, payload if kind == "response" else None


def write(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", broadcast_rows: int = 200_000) -> DataFrame:
    """Write the archives; returns the index, read from a written table."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    # payloads that more than one record has: counted before the shuffle, so a hot payload is one row a task
    copies = rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha", "first")
    copies = written(copies, "warc-copies")
    if copies.limit(broadcast_rows + 1).count() <= broadcast_rows:
        copies = F.broadcast(copies)
    rows = rows.join(copies, "sha", "left").select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def task(batches):
        fs, path = _filesystem(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        for b in batches:
            index = []
            for page_id, url, html, first in zip(*(b.column(k).to_pylist() for k in range(4))):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                kind, digest, data = _record(page_id, url, html, first, date)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                index.append((name, at, len(member), url, digest, page_id, kind))
                at += len(member)
            cols = list(zip(*index)) if index else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    index = written(rows.mapInArrow(task, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def read(index: DataFrame, *, block: int = BLOCK, payloads: bool = True) -> DataFrame:
    """The records that the index rows name. Rows of one stretch of `block` bytes of a file meet in one task."""
    want = index.select("file", "offset", "length")
    # rows of the index are few bytes, the records that they name many: the number of tasks follows the records' bytes
    stretch = F.floor(F.col("offset") / block)
    size, stretches = want.agg(F.sum("length"), F.count_distinct("file", stretch)).first()
    tasks = max(1, -(-(size or 0) // block), min(stretches, want.sparkSession.sparkContext.defaultParallelism))
    dealt = want.repartition(tasks, F.col("file"), stretch).sortWithinPartitions("file", "offset")

    def task(batches):
        opened: dict[str, object] = {}

        def records(run):
            file, start = run[0][0], run[0][1]
            fs, path = _filesystem(file)
            if file not in opened:
                opened.clear()
                opened[file] = fs.open_input_file(path)
            opened[file].seek(start)
            data = opened[file].read(run[-1][1] + run[-1][2] - start)
            for _, at, n in run:
                yield _parse(zlib.decompress(data[at - start : at - start + n], 31))

        def batch(rows):
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            out = [pa.array(c, k) for c, k in zip(cols, kinds)]
            if not payloads:
                out[6] = pa.nulls(len(rows), pa.binary())
            return pa.RecordBatch.from_arrays(out, names=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

        for b in batches:
            run: list[tuple] = []
            for r in zip(*(b.column(k).to_pylist() for k in range(3))):
                if run and (r[0] != run[-1][0] or r[1] - run[-1][1] - run[-1][2] > MOST_GAP or r[1] + r[2] - run[0][1] > MOST_READ):
                    yield batch(list(records(run)))
                    run = []
                run.append(r)
            if run:
                yield batch(list(records(run)))

    return dealt.mapInArrow(task, RECORD)
