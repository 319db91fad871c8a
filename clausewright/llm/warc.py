"""WARC archives as a Spark data source: a writer of gzip members, one a record, and a splittable reader.

A read task owns the records that start in its byte range. It looks there for the gzip magic, takes a place
for a member only when it decodes to a WARC header, then follows member upon member.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import new_path, written

MAGIC, BLOCK = b"\x1f\x8b\x08", 1 << 18
#: Lists the files of finished tasks; what failed attempts left behind is in no list.
MANIFEST = "_files.json"
#: Fixed values of the WARC format.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload binary"
ARCHIVED = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
NO_ID = "none"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def one_line(value: str) -> str:
    """A header's value: line breaks, which would end it, are escaped."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def member(page_id: int | None, url: str | None, kind: str, refers_to: int | None, payload: bytes) -> bytes:
    """One record as a gzip member; a revisit holds the response's headers without its payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if kind == "revisit" else payload)
    named = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "X-Page-ID": NO_ID if page_id is None else str(page_id),
    }
    if url is not None:
        named["WARC-Target-URI"] = one_line(url)
    if kind == "revisit":
        named |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": NO_ID if refers_to is None else str(refers_to)}
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


def parse(raw: bytes) -> tuple:
    """The columns of ARCHIVED from a record's bytes; a payload that belies its digest raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(named["Content-Length"])].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"record {named['WARC-Record-ID']}: payload doesn't match its length and digest")
    number = lambda x: None if x in (None, NO_ID) else int(x)
    url = named.get("WARC-Target-URI")
    url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None
    return number(named.get("X-Page-ID")), url, kind, number(named.get("X-Refers-To-Page-ID")), size, digest, payload if kind == "response" else None


def decode_member(file: pa.NativeFile, at: int, size: int) -> tuple[bytes, int] | None:
    """Content and end of the member at ``at``, or None where no WARC record starts."""
    open_, out, checked = zlib.decompressobj(31), [], False
    file.seek(at)
    while not open_.eof:
        block = file.read(min(BLOCK, size - at))
        if not block:
            return None
        at += len(block)
        try:
            out.append(open_.decompress(block))
        except zlib.error:
            return None
        if not checked and sum(map(len, out)) >= len(VERSION):
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            checked = True
    return (b"".join(out), at - len(open_.unused_data)) if checked else None


def records(file: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """Content of the records whose members start at ``start`` or later, before ``end``."""
    size, at = file.size(), start
    while at < end:
        file.seek(at)
        block = file.read(min(BLOCK, end - at + len(MAGIC) - 1))
        found = block.find(MAGIC)
        if found < 0:
            at += max(1, len(block) - len(MAGIC) + 1)
            continue
        at += found
        if got := decode_member(file, at, size):
            yield got[0]
            at = got[1]
        else:
            at += 1


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it for a Hadoop URI: local, HDFS, S3 (s3a and s3n too), GCS and those that pyarrow knows else; others raise."""
    try:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1) if path.startswith(("s3a://", "s3n://")) else path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"WARC archives can't be kept under {path}: set spark.checkpoint.dir to a folder that pyarrow can reach ({e})") from e


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        storage(path)  # on the driver, before any work

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = storage(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out = None
        for batch in iterator:
            for row in zip(*(batch[k].to_pylist() for k in ("page_id", "url", "record_type", "refers_to", "payload"))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member(*row[:4], row[4] or b""))
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = storage(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(m.file for m in messages if m and m.file)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = storage(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{root}/{m.file}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        store, root = storage(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = [f"{root}/{x}" for x in json.loads(f.read())]
        sizes = [(x.path, x.size) for x in store.get_file_info(files)]
        return [Range(p, a, min(a + self.split, n)) for p, n in sizes for a in range(0, n, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.end:
            return
        store, _ = storage(self.path)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds.types)], schema=kinds)

        rows, held = [], 0
        with store.open_input_file(partition.file) as file:
            for raw in records(file, partition.start, partition.end):
                rows.append(parse(raw))
                held += len(raw)
                if held > 4 << 20 or len(rows) >= 4096:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


class WarcSource(DataSource):
    """``df.write.format("warc").mode("append").save(path)`` and ``spark.read.format("warc").option("split_bytes", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ARCHIVED

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)))


def revisits(pages: DataFrame, least_bytes: int = 0, payload: str = "html") -> DataFrame:
    """Records (RECORD) of ``pages`` (page_id, url, payload text).

    Of equal payloads of ``least_bytes`` or more, that with the smallest page_id is a response and the others
    revisit it; all else is a response. A null payload is empty; a null page_id is smaller than no other; rows
    that share page_id and payload are alike.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("key", F.sha2("payload", 256))
    # copies are combined before the shuffle; written, so that adaptive execution can split a hot payload in the join
    groups = keyed.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least", F.lit(True).alias("shared"))
    joined = keyed.join(written(groups, "payload-groups"), "key", "left")
    again = F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("least"))
    return joined.select("page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("least")).alias("refers_to"), "payload")


def archive(pages: DataFrame, least_bytes: int = 0, payload: str = "html", split_bytes: int = 32 << 20) -> DataFrame:
    """Writes ``pages`` as WARC files in the shared folder and reads them back: one row (ARCHIVED) for each row of ``pages``.

    No rows give an archive without files and no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    path = new_path(spark, "warc")
    path = path if "://" in path or not path.startswith("file:") else path.replace("file:", "file://", 1)
    revisits(pages, least_bytes, payload).write.format("warc").mode("append").save(path)
    return spark.read.format("warc").option("split_bytes", split_bytes).load(path)
