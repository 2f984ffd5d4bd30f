"""WARC archives: monolithic gzip in, one gzip member per record out, with an offset index (operator 8).

`write_monolithic` makes archives that are one gzip stream each; `normalise` inflates such a stream once,
rewrites every record as a member of its own and writes `<archive>.idx.json` beside it (one line per record:
offset, length, identifier, type); `read_records` cuts the members out by that index.  Files are written by
the tasks through pyarrow's file systems to a shared folder, under a name of their own first and then renamed,
so a repeated task leaves the same files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atril.llm.common import materialise
from atril.session import scratch_path

#: Uncompressed bytes after which a new archive is begun.
ARCHIVE_BYTES = 32 << 20
DATE = "2020-01-01T00:00:00Z"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")


def _write(folder: str, name: str, data: bytes) -> str:
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, f"{path}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has no block; length and digest of the full payload are in the header."""
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe=":/?#[]@!$&'()*+,;=%-._~"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        payload = b""
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


class RecordCutter:
    """Cuts an uncompressed record stream, given in any pieces, into (header, whole record)."""

    def __init__(self):
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += data
        while (end := self.held.find(b"\r\n\r\n")) >= 0:
            head = parse_header(bytes(self.held[:end]))
            size = end + 4 + int(head["Content-Length"]) + 4
            if len(self.held) < size:
                return
            yield head, bytes(self.held[:size])
            del self.held[:size]


def gunzip_stream(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Inflate gzip data once, front to back; several members in a row are one stream."""
    tool = zlib.decompressobj(31)
    for start in range(0, len(data), step):
        piece = data[start : start + step]
        while piece:
            yield tool.decompress(piece)
            piece = tool.unused_data
            if tool.eof and piece:
                tool = zlib.decompressobj(31)
    yield tool.flush()


def gzip(data: bytes, level: int = 6) -> bytes:
    tool = zlib.compressobj(level, wbits=31)
    return tool.compress(data) + tool.flush()


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write `page_id`, `url`, `payload`, `refers_to` as archives of one gzip stream each; returns their paths.

    The paths come from a written table, so the archives are made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, size = TaskContext.get().partitionId(), 0, 0
        tool, parts = zlib.compressobj(1, wbits=31), []

        def close() -> pa.RecordBatch:
            name = f"part-{task:06d}-{made:04d}.warc.gz"
            return pa.RecordBatch.from_pydict({"path": [_write(folder, name, b"".join([*parts, tool.flush()]))]})

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                data = record(page_id, url, payload, refers_to)
                parts.append(tool.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    yield close()
                    tool, parts, made, size = zlib.compressobj(1, wbits=31), [], made + 1, 0
        if size:
            yield close()

    return materialise(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string"), "archives")


def _files(spark, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")


def normalise(spark, folder: str, target: str) -> DataFrame:
    """Rewrite each monolithic archive of `folder` in `target`; returns the index: path, offset, length, record_id, record_type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                cutter, out, offset = RecordCutter(), [], 0
                index: dict[str, list] = {k: [] for k in ("path", "offset", "length", "record_id", "record_type")}
                name = path.rsplit("/", 1)[-1]
                for piece in gunzip_stream(content.as_py()):
                    for head, whole in cutter.feed(piece):
                        member = gzip(whole)
                        for k, v in zip(index, (name, offset, len(member), head["WARC-Record-ID"], head["WARC-Type"]), strict=True):
                            index[k].append(v)
                        out.append(member)
                        offset += len(member)
                if cutter.held:
                    raise ValueError(f"{path} ends inside a record")
                _write(target, name, b"".join(out))
                lines = (json.dumps(dict(zip(index, row, strict=True))) for row in zip(*index.values(), strict=True))
                _write(target, f"{name}.idx.json", "".join(f"{x}\n" for x in lines).encode())
                yield pa.RecordBatch.from_pydict(index, schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))

    index = _files(spark, folder).mapInArrow(run, "path string, offset long, length long, record_id string, record_type string")
    return materialise(index, "warc-index")


def read_records(spark, folder: str) -> DataFrame:
    """Records of normalised archives, each member cut out by the sidecar index and inflated by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data = memoryview(content.as_buffer())
                with store.open_input_stream(f"{root}/{path.rsplit('/', 1)[-1]}.idx.json") as index:
                    lines = index.read().splitlines()
                out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for line in lines:
                    at = json.loads(line)
                    whole = zlib.decompress(data[at["offset"] : at["offset"] + at["length"]], wbits=31)
                    ((head, same),) = RecordCutter().feed(whole)
                    payload = same[same.find(b"\r\n\r\n") + 4 : -4]
                    if head["WARC-Type"] == "response" and f"sha1:{digest(payload)}" != head["WARC-Payload-Digest"]:
                        raise ValueError(f"damaged record in {path}")
                    number = [head.get(k, "").removeprefix("<urn:page:").rstrip(">") for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    for k, v in zip(out, (
                        int(number[0]) if number[0] else None, int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"),
                        head["WARC-Type"], int(number[1]) if number[1] else None,
                    ), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return _files(spark, folder).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as WARC, normalise the archives and read them back; one row per page.

    Payloads of at least `least` bytes that are equal make one response, that with the smallest page_id, and
    revisits of it.  Null html is the empty payload.  Rows that repeat a page_id with the same payload share its type; a
    null page_id is a revisit if any page_id has the payload, and else a response.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha1", F.unhex(F.sha1("payload")))
    firsts = rows.where(F.length("payload") >= least).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1 AND first IS NOT NULL").drop("n")
    marked = rows.join(firsts, "sha1", "left").withColumn(
        "refers_to", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    )
    folder = scratch_path(spark, "warc")
    paths = write_monolithic(marked, f"{folder}/monolithic", archive_bytes)
    if paths.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    normalise(spark, f"{folder}/monolithic", f"{folder}/members")
    return read_records(spark, f"{folder}/members")
