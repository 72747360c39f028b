"""WARC archives: monolithic gzip files normalised to one member a record, with a sidecar offset index."""

from __future__ import annotations

import base64
import os
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut, shared_dir
from meshwalk.llm.common import maybe_broadcast, table
from meshwalk.llm.hashing import slices

LEAST_BYTES = 0
DATE = "1970-01-01T00:00:00Z"  # archives are the same in every run
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 20
LEVEL = 1


def _fs(path: str):
    """The file system of a shared folder's path, as any task can open it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


class _Output:
    """A file that appears under its name only when complete; a repeated task replaces it by equal content."""

    def __init__(self, path: str):
        self.fs, self.path = _fs(path)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.stream, self.size = self.fs.open_output_stream(self.draft, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.draft, self.path)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else "%20" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def inflated(stream):
    """Blocks of a gzip file of any number of members, inflated once from start to end."""
    z = zlib.decompressobj(31)
    while data := stream.read(BLOCK):
        while data:
            if z.eof:
                z = zlib.decompressobj(31)
            yield z.decompress(data)
            data = z.unused_data
    if not z.eof:
        raise EOFError("the gzip stream ends early")


def records(blocks):
    """(headers, whole record) of every WARC record in the blocks; what is held is one record and a block."""
    buffer = bytearray()
    blocks = iter(blocks)

    def more() -> bool:
        for b in blocks:
            buffer.extend(b)
            return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buffer).strip():
                    raise EOFError("a WARC record ends early")
                return
        headers = head(bytes(buffer[:end]))
        size = end + 4 + int(headers["content-length"]) + 4
        while len(buffer) < size:
            if not more():
                raise EOFError("a WARC record ends early")
        yield headers, bytes(buffer[:size])
        del buffer[:size]


def head(raw: bytes) -> dict[str, str]:
    first, *lines = raw.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def write_monoliths(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One gzip stream of WARC records for each partition of ``pages`` (page_id, url, html); returns the files' paths.

    Of records with equal payloads (SHA-1 and length) of at least ``least_bytes``, that with the largest page_id is a
    response and the others revisit it. Only digests are grouped; the list of revisits is broadcast if small, and
    payloads are shuffled only if it is not.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    p = p.withColumn("sha", F.sha1("html"))
    light = p.select("page_id", "sha", F.octet_length("html").alias("size")).where(F.col("size") >= least_bytes)
    groups = light.groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1 and last is not null")
    again = light.join(maybe_broadcast(cut(groups.select("sha", "last"), "groups")), "sha").where("page_id is null or page_id < last").select(F.col("page_id").alias("id"), F.col("sha").alias("s"), "last").distinct()
    p = p.join(maybe_broadcast(again), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "sha", "last")

    def run(batches):
        out, z, n = None, zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        path = f"{folder}/raw/part-{TaskContext.get().partitionId():06d}.warc.gz"
        for part in slices(batches, "html"):
            out = out or _Output(path)
            for page_id, url, html, sha, last in zip(*(c.to_pylist() for c in part.columns), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                out.write(z.compress(record(page_id, url, html, digest, last)))
                n += 1
        if out:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    return p.mapInArrow(run, "path string, n long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``files`` (path) so that every record is a gzip member of its own.

    A file is inflated once, as a stream; next to the new archive comes ``.idx``, a line for each member: offset, length,
    record id, type, digest. Returns path, index, n. A gzip stream can only be read from its start, so one file is one
    task's work; what a task holds is one record.
    """

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1].removesuffix(".warc.gz")
                target = f"{folder}/members/{name}.warc.gz"
                source, inner = _fs(path)
                out, index, n = _Output(target), _Output(f"{target}.idx"), 0
                with source.open_input_stream(inner, compression=None) as stream:
                    for h, raw in records(inflated(stream)):
                        z, at = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), out.size
                        out.write(z.compress(raw) + z.flush())
                        index.write(f"{at}\t{out.size - at}\t{h['warc-record-id']}\t{h['warc-type']}\t{h.get('warc-payload-digest', '-')}\n".encode())
                        n += 1
                out.close()
                index.close()
                yield pa.RecordBatch.from_pydict({"path": [target], "index": [f"{target}.idx"], "n": pa.array([n], pa.int64())})

    return files.select("path").mapInArrow(run, "path string, index string, n long")


def read_members(spark, folder: str) -> DataFrame:
    """Every record of the normalised archives, each by its own seek: page_id, url, payload, payload_bytes,
    payload_digest, record_type, refers_to. The payload of a response is checked against its digest."""
    lines = spark.read.text(f"{folder}/members/*.idx").select(F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", "").alias("path"), F.split("value", "\t").alias("f"))
    lines = lines.select("path", F.col("f")[0].cast("long").alias("at"), F.col("f")[1].cast("long").alias("size"))
    page = lambda h, k: (lambda v: int(v) if v else None)(h.get(k, "").removeprefix("<urn:page:").removesuffix(">"))

    def run(batches):
        import hashlib

        opened, stream = None, None
        for b in batches:
            out = []
            for path, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != opened:
                    source, inner = _fs(path)
                    opened, stream = path, source.open_input_file(inner)
                stream.seek(at)
                raw = zlib.decompress(stream.read(size), 31)
                cut = raw.index(b"\r\n\r\n")
                h = head(raw[:cut])
                payload = raw[cut + 4 : cut + 4 + int(h["content-length"])]
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"record {h['warc-record-id']} in {path} does not fit its digest")
                out.append((page(h, "warc-record-id"), h.get("warc-target-uri"), payload, int(h["x-payload-length"]), digest, h["warc-type"], page(h, "warc-refers-to")))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return lines.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these and read the records back.

    A null html is an empty payload; a null url has no target line. A null page_id is an empty record id: such a row
    revisits an equal payload that has an id, else is a response. Rows repeated with the largest id of their payload are
    all responses (ties are broken by nothing else). A page of any length is one record, held by one task. No rows give no
    files and an empty result. Further columns are ignored, whatever their names.
    """
    spark, folder = pages.sparkSession, folder or f"{shared_dir(pages.sparkSession)}/warc"
    # all archives at once, one a task; their paths stand in a table, not on the driver
    files = cut(write_monoliths(pages, folder, least_bytes).select("path"), "archives")
    n = files.count()
    if not n:
        return spark.createDataFrame([], "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
    cut(normalise(files.repartition(n), folder), "normalised")
    return read_members(spark, folder)


def op5_warc_archives(spark, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS last FROM p),
bits AS (SELECT page_id, html, last, sha1(html) AS hex FROM g),
b32 AS (SELECT page_id, html, last, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
  (CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS digest FROM bits)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM b32
"""
