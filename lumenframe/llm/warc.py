"""WARC archives with revisit resolution.

Headers alone (payload digest, length, id) shuffle by digest; a digest met more than once names its largest
page_id the original. The few original rows join back to the pages, so one record of each payload is written
as `response` and the others as `revisit` records that refer to it, all with fresh headers. Files are gzipped
record by record, written under a temporary name and then renamed, so a task that runs again replaces its own
files; the list of files that committed tasks wrote is a table beside them, and only listed files are read. They go
through pyarrow's file systems, to whatever store the folder's URI names; a path without scheme is one of Spark's default
file system. Each file begins with a warcinfo record. Record ids are UUIDs made from page_id and digest, so a revisit
knows its original's without a join; page_ids travel in headers of their own.

Nulls: a null html is an empty payload; a null url gets an empty target; a null page_id ranks below all others,
and if a payload has only such rows each is a response. A row that repeats its original's page_id and payload is
the same capture again and stays a response. Payloads under `min_bytes` are never revisits. An empty table
writes no archive and reads back as no rows. Very long payloads are one record each. Other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import Table, shared_dir

PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, n_records long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, warc_path string, warc_offset long"
LEVEL = 1


def record_id(page_id, digest: bytes) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}/{digest.decode()}")).encode()


def info(date: bytes) -> bytes:
    """The warcinfo record of a file."""
    block = b"software: lumenframe\r\nformat: WARC File Format 1.1\r\n"
    head = [b"WARC/1.1", b"WARC-Type: warcinfo", b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.uuid4()).encode(), b"WARC-Date: " + date, b"Content-Type: application/warc-fields", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id, url: bytes, payload: bytes, digest: bytes, original, original_url: bytes, date: bytes) -> bytes:
    """One WARC 1.1 record; a revisit of `original` unless that is None."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if original is None else b"")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if original is None else b"revisit"),
        b"WARC-Record-ID: " + record_id(page_id, digest),
        b"X-Page-ID: %s" % str(page_id).encode(),
        b"WARC-Date: " + date,
        b"WARC-Target-URI: " + b"".join(url.split()),
        b"WARC-Payload-Digest: sha1:" + digest,
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if original is not None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: " + record_id(original, digest), b"WARC-Refers-To-Date: " + date]
        head += [b"WARC-Refers-To-Target-URI: " + b"".join(original_url.split()), b"X-Refers-To-Page-ID: %s" % str(original).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return member.compress(data) + member.flush()


def _uri(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, Spark's default file system if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


LISTED = "_archives"


def _writer(folder: str, date: str, file_bytes: int):
    def write(batches):
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, k, size, n, done = None, 0, 0, 0, []

        def close():
            out.close()
            name = f"part-{part:05d}-{k:04d}-{attempt}.warc.gz"
            store.move(f"{root}/_tmp-{attempt}-{k}", f"{root}/{name}")
            done.append((f"{folder}/{name}", n))

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, html, original, original_url = (c[i].as_py() for c in cols)
                payload = html or b""
                digest = base64.b32encode(hashlib.sha1(payload).digest())
                if out is None:
                    out, n = store.open_output_stream(f"{root}/_tmp-{attempt}-{k}"), 0
                    size = out.write(_member(info(date.encode())))
                data = _member(record(page_id, url or b"", payload, digest, original, original_url or b"", date.encode()))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "n_records"])

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str | None = None, file_bytes: int = 64 << 20) -> int:
    """Write pages(page_id, url, html) to *.warc.gz files in `folder` (a path or URI); how many records were written.
    The records' date is that of the run unless one is given."""
    spark = pages.sparkSession
    folder, date = _uri(spark, folder), date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.encode("url", "UTF-8").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    heads = rows.select("digest", "page_id", "url", F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes)
    originals = heads.groupBy("digest").agg(F.max("page_id").alias("original"), F.max_by("url", "page_id").alias("original_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND original IS NOT NULL").drop("n")
    originals = Table(originals, "warc-originals")  # its true size decides whether the next join broadcasts it
    rows = rows.join(originals.read(), "digest", "left")
    original = F.when(F.col("page_id").eqNullSafe(F.col("original")), None).otherwise(F.col("original"))
    written = rows.select("page_id", "url", "html", original.alias("original"), "original_url").mapInArrow(_writer(folder, date, file_bytes), WRITTEN)
    written.write.mode("overwrite").parquet(f"{folder}/{LISTED}")
    originals.drop()
    return spark.read.schema(WRITTEN).parquet(f"{folder}/{LISTED}").agg(F.sum("n_records")).first()[0] or 0


def parse(stream: io.BufferedIOBase):
    """(offset among the unpacked bytes, headers, block) of each record."""
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"no record begins at {start}: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            at += len(line)
            key, _, value = line.partition(b":")
            head[key.lower()] = value.strip()
        n = int(head[b"content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {start} breaks off")
        at += len(line) + n + 4
        yield start, head, block


def _page(i: bytes | None):
    return None if i in (None, b"None") else int(i)


def _reader(batches):
    from pyarrow.fs import FileSystem

    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = FileSystem.from_uri(uri)
            with store.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                for start, head, block in parse(io.BufferedReader(f, 1 << 20)):
                    if head[b"warc-type"] == b"warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = head[b"warc-type"].decode()
                    digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                    size = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{path}: the record at {start} does not match its digest")
                    rows.append((_page(head[b"x-page-id"]), head[b"warc-target-uri"].decode("utf-8", "replace"), size, digest, kind, _page(head.get(b"x-refers-to-page-id")), path, start))
                    if len(rows) >= 5000:
                        yield flush()
                        rows.clear()
    yield flush()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives listed in `folder`, digests of responses checked; warcinfo records are skipped."""
    paths = spark.read.schema(WRITTEN).parquet(f"{_uri(spark, folder)}/{LISTED}").select("path")
    return paths.repartition(max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(_reader, READ)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
