"""Deterministic sharded WARC writer and reader.

Method: records are range-sorted by page id into shards of equal payload bytes (exact
splitters, see :mod:`tidemark.llm.sharding`), one task per shard writes gzip members and
rolls files by compressed size, with headers and digests made anew. A file is written
under a temporary name and renamed when complete; the manifest of all files is a table
that Spark commits last, and readers open only what it lists. Everything in a file
follows from the rows, so a task that runs again writes the same bytes to the same names.

Records with equal payloads: the smallest page id is the response, the others revisit
it. Which page a payload belongs to is counted on digests alone; the references travel
to the writers as small rows beside the pages, so payloads are exchanged once.

Defined results: a null payload is empty; a null page id is larger than every id; of rows
that repeat page id and payload the first is the response if any is, the others revisit
it; a null url becomes a urn of the page; an empty table gives an empty manifest;
further columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import whole_text, written
from tidemark.llm.sharding import find_splitters, id_order, range_of

MANIFEST = "file string, shard int, records long, bytes long, sha256 string"
RECORDS = (
    "page_id string, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to string, payload binary"
)


@dataclass(frozen=True)
class WarcParams:
    shard_bytes: int = 64 << 20
    file_bytes: int = 16 << 20
    min_revisit_bytes: int = 0
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: dict[str, str], block: bytes) -> bytes:
    fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _uri(url: str | None, page_id: str | None) -> str:
    if not url:
        return f"urn:page:{page_id or 'unknown'}"
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url)


def page_record(
    page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, nth: int, date: str
) -> bytes:
    """One response or, with ``refers_to``, revisit record; ``nth`` tells repeated rows apart."""
    payload_digest = digest(payload)
    head = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, payload_digest, nth),
        "WARC-Date": date,
        "WARC-Target-URI": _uri(url, page_id),
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
    }
    if page_id is not None:
        fields["X-Page-Id"] = page_id
    if refers_to is None:
        return _record(fields, head + payload)
    fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields["WARC-Refers-To"] = _record_id(refers_to or None, payload_digest, 0)
    fields["X-Refers-To-Page-Id"] = refers_to
    return _record(fields, head)


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or a plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class ShardFiles:
    """The files of one shard, each renamed to its final name when complete."""

    def __init__(self, folder: str, shard: int, params: WarcParams):
        self.files, self.path = open_folder(folder)
        self.shard, self.params, self.number = shard, params, 0
        self.rows: list[tuple] = []
        self.out = None

    def _open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}"
        self.out = self.files.open_output_stream(self.temporary, compression=None)
        self.sha, self.size, self.records = hashlib.sha256(), 0, 0
        info = {
            "WARC-Type": "warcinfo",
            "WARC-Record-ID": _record_id("warcinfo", self.name),
            "WARC-Date": self.params.date,
            "WARC-Filename": self.name,
            "Content-Type": "application/warc-fields",
        }
        self._put(_record(info, b"format: WARC File Format 1.1\r\n"))

    def _put(self, record: bytes) -> None:
        data = gzip.compress(record, self.params.level, mtime=0)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        if self.out is None:
            self._open()
        self._put(record)
        self.records += 1
        if self.size >= self.params.file_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.files.move(self.temporary, f"{self.path}/{self.name}")
        self.rows.append((self.name, self.shard, self.records, self.size, self.sha.hexdigest()))
        self.number += 1


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    params: WarcParams = WarcParams(),
) -> DataFrame:
    """Write one record per row into ``folder``; returns the committed manifest."""
    kind = pages.schema[id_col].dataType.simpleString()
    payload = whole_text(F.col(html_col))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).select(
        "id",
        "url",
        "payload",
        F.sha1(F.col("payload").cast("binary")).alias("sha1"),
        id_order(F.col("id"), kind).alias("high"),
    ).withColumn("low", F.xxhash64("sha1"))
    narrow = written(
        rows.select("id", "sha1", "high", "low", F.octet_length("payload").cast("long").alias("size")),
        "page-digests",
    )
    shared = narrow.where(F.col("size") >= params.min_revisit_bytes)
    first = shared.groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    references = (
        shared.select("id", "sha1", "high", "low")
        .join(first, "sha1")
        .where(~F.col("id").eqNullSafe(F.col("first")))
        .select("id", "sha1", "high", "low", F.col("first").cast("string").alias("first"))
        .distinct()
    )
    total = narrow.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // params.shard_bytes))
    splitters = find_splitters(narrow.select("high", "low", "size"), shards, shards, tolerance=0.01)
    files, path = open_folder(folder)
    files.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, []
        target = last = None
        nth = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.shard != row["shard"]:
                    if out is not None:
                        out.close()
                        done += out.rows
                    out, last, target = ShardFiles(folder, row["shard"], params), None, None
                same = (row["id"], row["sha1"])
                if row["is_page"] == 0:
                    target = (same, row["first"])
                    continue
                nth = nth + 1 if last == same else 0
                last = same
                refers_to = target[1] if target and target[0] == same else None
                data = row["payload"].encode()
                if nth and refers_to is None and len(data) >= params.min_revisit_bytes:
                    refers_to = row["id"] or ""
                out.add(page_record(row["id"], row["url"], data, refers_to, nth, params.date))
        if out is not None:
            out.close()
            done += out.rows
        columns = list(zip(*done)) or [()] * 5
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        names = ("file", "shard", "records", "bytes", "sha256")
        yield pa.record_batch({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    columns = [F.col("id").cast("string").alias("id"), "url", "payload", "sha1", "high", "low"]
    both = rows.select(*columns, F.lit(1).alias("is_page"), F.lit(None).cast("string").alias("first")).unionByName(
        references.select(
            F.col("id").cast("string").alias("id"), "sha1", "high", "low", F.lit(0).alias("is_page"), "first"
        ),
        allowMissingColumns=True,
    )
    manifest = (
        both.withColumn("shard", range_of(splitters, "high", "low", 1)["shard"])
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "high", "sha1", "is_page", "url")
        .select("shard", "id", "url", "payload", "sha1", "is_page", "first")
        .mapInArrow(write, MANIFEST)
    )
    manifest.write.parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n")[1:] if line)
    return {k.decode().lower(): v.strip().decode() for k, _, v in pairs}


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an uncompressed stream."""
    while True:
        head = b""
        while not head.endswith(b"\r\n\r\n"):
            line = stream.readline()
            if not line:
                if head.strip():
                    raise ValueError("record cut short")
                return
            head = head + line if head or line.strip() else b""
        fields = _fields(head)
        block = stream.read(int(fields["content-length"]))
        if fields.get("warc-block-digest") != f"sha1:{digest(block)}":
            raise ValueError(f"damaged block in {fields.get('warc-record-id')}")
        stream.read(4)
        yield fields, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per response or revisit record of the files that the manifest lists."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(folder)
        names = [f.split()[0] for f in RECORDS.split(", ")]
        schema = pa.schema(
            [(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names]
        )
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    for fields, block in records(stream):
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(_fields(head)["content-length"])
                        response = fields["warc-type"] == "response"
                        stated = fields["warc-payload-digest"].removeprefix("sha1:")
                        if response and (len(payload) != length or digest(payload) != stated):
                            raise ValueError(f"damaged payload in {name}")
                        rows.append(
                            (
                                fields.get("x-page-id"),
                                fields["warc-target-uri"],
                                length,
                                stated,
                                fields["warc-type"],
                                fields.get("x-refers-to-page-id") or None,
                                payload if response else None,
                            )
                        )
                        size += len(payload)
                        if size > 4 << 20:
                            yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.record_batch(list(map(list, zip(*rows))), schema=schema)

    # Names are tiny, so they are dealt by number: one file to a task.
    numbered = manifest.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("number"))
    dealt = numbered.repartitionById(max(1, manifest.count()), "number")
    return dealt.select("file").mapInArrow(read, RECORDS)
