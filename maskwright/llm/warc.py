"""WARC archives with repeated payloads resolved to revisit records.

Archives are written by tasks, a gzip member for each record, and rolled at a set size;
only headers travel: they are shuffled by payload digest, the greatest id of each
repeated payload becomes its response, and the others are joined to it. Then each archive
is read again as a stream and written anew with fresh headers, a revisit without its
payload. A row of a manifest names each written file; files that a lost task began are
named by none. Records can be as large as a row; a task holds one at a time.

A null payload counts as empty. Payloads below the least size are always responses, as
are rows with a null id. Of rows that repeat the greatest id all are responses. An empty
table gives an empty manifest.
"""

import base64
import datetime
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
import pyspark.sql.types as T
from pyspark.sql import functions as F

from maskwright.llm.common import steps, table, written
from maskwright.session import work_path

LEAST_BYTES = 1000
ARCHIVE_BYTES = 128 << 20
_CHUNK = 1 << 20
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("place", T.LongType()), T.StructField("page_id", T.LongType()),
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("refers_to_record", T.StringType()), T.StructField("target", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType())])


class ArchiveWriter:
    """Writes records to archives below a folder; one task's files share a name of their own."""

    def __init__(self, folder):
        self.files, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.name, self.count, self.stream, self.size, self.place = uuid.uuid4().hex, 0, None, 0, 0

    def add(self, headers, payload):
        """Path and place (number of the record in its file) of the written record."""
        head = "WARC/1.1\r\n" + "".join([f"{k}: {v}\r\n" for k, v in headers if v is not None])
        record = gzip.compress(b"".join([head.encode("utf-8"), b"\r\n", payload, b"\r\n\r\n"]), 6, mtime=0)
        if self.stream is None or self.size + len(record) > ARCHIVE_BYTES and self.size:
            self.close()
            self.path = f"{self.folder}/{self.name}-{self.count:05d}.warc.gz"
            self.count, self.size, self.place = self.count + 1, 0, 0
            self.stream = self.files.open_output_stream(self.path, compression=None)
        self.stream.write(record)
        self.size, self.place = self.size + len(record), self.place + 1
        return self.path, self.place - 1

    def close(self):
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def members(stream):
    """The uncompressed bytes of each gzip member of a stream, one after the other."""
    rest, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        chunk = rest or stream.read(_CHUNK)
        if not chunk:
            return
        out.append(unpack.decompress(chunk))
        rest = b""
        if unpack.eof:
            yield b"".join(out)
            rest, unpack, out = unpack.unused_data, zlib.decompressobj(31), []


def parsed(record):
    """(headers, payload) of a record's bytes."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")[1:]
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, block[:int(headers["Content-Length"])]


def read_archive(path, folder):
    """(headers, payload) of each record of an archive, in order."""
    files, _ = pyarrow.fs.FileSystem.from_uri(folder)
    with files.open_input_stream(path, compression=None) as stream:
        for record in members(stream):
            yield parsed(record)


def sha1_header(payload):
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _date(now=None):
    return (now or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _safe(url):
    """A target that keeps to one header line."""
    return None if url is None else "".join([c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in url])


def _record_headers(kind, headers, payload, date):
    return [("WARC-Type", kind), ("WARC-Record-ID", headers["WARC-Record-ID"]), ("WARC-Date", date),
            ("WARC-Target-URI", headers.get("WARC-Target-URI")), ("WARC-Payload-Digest", headers["WARC-Payload-Digest"]),
            ("X-Page-ID", headers.get("X-Page-ID")), ("X-Payload-Length", headers["X-Payload-Length"])]


def _rows(found):
    columns = list(zip(*found)) if found else [[] for _ in _HEADERS.names]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(columns, _HEADERS.fields)],
        _HEADERS.names)


def _row(path, place, headers):
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = headers.get("X-Page-ID")
    return (path, place, int(page) if page is not None else None, headers["WARC-Record-ID"], headers["WARC-Type"],
            headers.get("WARC-Refers-To"), headers.get("WARC-Target-URI"), headers["WARC-Date"],
            int(headers["X-Payload-Length"]), digest)


def write_archives(pages, folder, key="page_id", url="url", payload="html"):
    """Writes a response record for each row; returns their headers, with file and place."""

    def run(batches):
        writer = ArchiveWriter(folder)
        date = _date()
        for batch in batches:
            for part in steps(batch, payload):
                found = []
                for page, target, text in zip(*[part.column(c).to_pylist() for c in (key, url, payload)]):
                    body = (text or "").encode("utf-8")
                    own = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Target-URI": _safe(target),
                           "WARC-Payload-Digest": sha1_header(body), "X-Page-ID": None if page is None else str(page),
                           "X-Payload-Length": str(len(body))}
                    lines = _record_headers("response", own, body, date) + [
                        ("WARC-Block-Digest", own["WARC-Payload-Digest"]), ("Content-Type", "text/html; charset=utf-8"),
                        ("Content-Length", len(body))]
                    path, place = writer.add(lines, body)
                    found.append(_row(path, place, {k: v for k, v in lines if v is not None}))
                yield _rows(found)
        writer.close()

    return pages.select(key, url, payload).mapInArrow(run, _HEADERS)


def revisits(headers, least=LEAST_BYTES):
    """Headers of the records that repeat a payload, with those of the response they revisit."""
    large = headers.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    kept = large.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("kept_page"), F.count("*").alias("n"),
        F.max_by(F.struct("record_id", "target", "date"), F.struct("page_id", "record_id")).alias("kept")).where("n > 1")
    return (
        large.join(kept, ["payload_digest", "payload_bytes"])
        .where(F.col("page_id") < F.col("kept_page"))
        .select("path", "place", "kept_page", F.col("kept.record_id").alias("kept_record"),
                F.col("kept.target").alias("kept_target"), F.col("kept.date").alias("kept_date"))
    )


def deduplicate(headers, source, folder, least=LEAST_BYTES):
    """Writes the archives of `headers` anew, repeated payloads as revisit records.

    `source` is the folder they lie in. A file's revisits, at most as many as it has
    records, come to the task that reads it as one sorted list."""
    again = revisits(headers, least).groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("place", "kept_record", "kept_target", "kept_date"))).alias("again"))
    paths = headers.select("path").distinct()
    # as many tasks as files, which adaptive execution would put together, being few bytes of names
    work = paths.join(again, "path", "left").repartition(max(1, paths.count()), "path")

    def run(batches):
        writer = ArchiveWriter(folder)
        date = _date()
        for batch in batches:
            for path, again in zip(batch.column("path").to_pylist(), batch.column("again").to_pylist()):
                original = {r["place"]: r for r in again or ()}
                found = []
                for place, (old, body) in enumerate(read_archive(path, source)):
                    kept = original.get(place)
                    lines = _record_headers("response" if kept is None else "revisit", old, body, date)
                    if kept is not None:
                        body = b""
                        lines += [("WARC-Profile", _REVISIT_PROFILE), ("WARC-Refers-To", kept["kept_record"]),
                                  ("WARC-Refers-To-Target-URI", kept["kept_target"]), ("WARC-Refers-To-Date", kept["kept_date"]),
                                  ("Content-Length", 0)]
                    else:
                        lines += [("WARC-Block-Digest", sha1_header(body)), ("Content-Type", "text/html; charset=utf-8"),
                                  ("Content-Length", len(body))]
                    at = writer.add(lines, body)
                    found.append(_row(*at, {k: str(v) for k, v in lines if v is not None}))
                    if len(found) >= 10_000:
                        yield _rows(found)
                        found = []
                yield _rows(found)
        writer.close()

    return work.mapInArrow(run, _HEADERS)


def read_archives(manifest, folder):
    """The header rows of all records in the files of `manifest`, read from the archives, each
    response's digest computed anew from its payload."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found = []
                for place, (headers, body) in enumerate(read_archive(path, folder)):
                    if headers["WARC-Type"] == "response":
                        headers = {**headers, "WARC-Payload-Digest": sha1_header(body), "X-Payload-Length": str(len(body))}
                    found.append(_row(path, place, headers))
                    if len(found) >= 10_000:
                        yield _rows(found)
                        found = []
                yield _rows(found)

    paths = manifest.select("path").distinct()
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(run, _HEADERS)


def resolve(records):
    """Records with `refers_to`: revisits are joined to the responses that they name, and take
    payload size and digest from there."""
    named = records.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("_record"), F.col("page_id").alias("_page"),
        F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    plain = records.where(F.col("record_type") == "response").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = records.where(F.col("record_type") == "revisit").join(
        named, F.col("refers_to_record") == F.col("_record"), "left").select(
        "page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"),
        F.coalesce("_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    return plain.union(again)


def archive(pages, folder, key="page_id", url="url", payload="html", least=LEAST_BYTES):
    """Writes deduplicated archives of `pages` below `folder` and returns their manifest."""
    raw = f"{folder}/raw"
    headers = written(write_archives(pages, raw, key, url, payload))
    manifest = written(deduplicate(headers, raw, f"{folder}/archives", least))
    files, path = pyarrow.fs.FileSystem.from_uri(raw)
    if files.get_file_info(path).type == pyarrow.fs.FileType.Directory:
        files.delete_dir(path)  # the first archives have been written anew
    return manifest


def op4_warc(spark, sf_dir):
    """Every page written to archives, deduplicated, and read back."""
    folder = work_path(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    manifest = archive(table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return resolve(written(read_archives(manifest, f"{folder}/archives")))
