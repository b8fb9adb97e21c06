"""Deterministic, sharded WARC archives.

Writing. Records are put in the order of page id (null first), then of a hash of
their content. The running sum of their sizes in that order cuts it into shards,
so a shard's records follow from the rows and ``shard_bytes`` alone, whatever the
number of tasks; the first key of each shard is the one thing the driver holds
(at most ``MOST_SHARDS`` keys: beyond that the shards grow). Pages are shuffled
once, each shard to a task of its own, and sorted there. A shard is written as gzip members, one a
record; its file is closed once its compressed size reaches ``file_bytes``, and
the next one begins. Headers, ids and digests are made anew from the row.

Commit. A task writes under names of its own attempt in ``_temporary``; Spark
keeps the list of files of successful attempts only. A second job moves these to
their final names (a move that a lost task has made already counts as made), and
the manifest, one row a file with its size, records and SHA-1, is written last
through Spark's own committer. Readers open what the manifest names and nothing
else, and check size, block and payload digests.

Revisits. Of records with equal payloads of at least ``revisit_bytes`` bytes the
one with the least page id (null last) is the ``response``, the others are
``revisit`` records that name it.

Cases: a null text is an empty payload. Null and repeated page ids are kept; of
rows equal in id and payload one is the response and the others revisit it. Null
addresses get a fixed one, control characters, spaces and other characters that
a header cannot hold are percent-encoded. An empty table gives archives without
files. Other columns are not read.

The folder must be reachable by pyarrow.fs from driver and executors: a shared
folder, or a store that pyarrow opens by its URI.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import running_sums
from ..session import scratch_path
from .common import prepare, saved

SHARD_BYTES = 16 << 20  # of payloads and headers, before compression
FILE_BYTES = 256 << 20  # compressed
MOST_SHARDS = 65_536
HEADER_BYTES = 700  # about; only for cutting shards
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
NO_ADDRESS = "urn:weblog-engine:no-address"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, " \
          "refers_to long, archive string, record_offset long"
_FILES = "name string, temporary string, bytes long, records long, sha1 string"
KEY = ["page_id", "spread", "file", "row"]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    local = re.match(r"file:/+", path)
    return fs.FileSystem.from_uri("/" + path[local.end():] if local else path)


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


# --- records -----------------------------------------------------------------

def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("ascii") + b"\r\n" + block + b"\r\n\r\n"


def _urn(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(key[:32])}>"


def _address(url: str | None) -> str:
    return quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else NO_ADDRESS


def page_record(page_id: int | None, url: str | None, payload: bytes, key: str, first: dict | None) -> bytes:
    """The record of a page: a revisit of the page that ``first`` describes, or
    a response."""
    sha1 = "sha1:" + digest_text(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", _urn(key)), ("WARC-Date", DATE),
              ("WARC-Target-URI", _address(url)), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", sha1), ("WARC-Block-Digest", "sha1:" + digest_text(hashlib.sha1(block).digest()))]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(first["key"])),
                   ("WARC-Refers-To-Target-URI", _address(first["url"])), ("WARC-Refers-To-Date", DATE)]
        if first["page_id"] is not None:
            fields.append(("X-Refers-To-Page-ID", str(first["page_id"])))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    return _record(fields, block)


def info_record(name: str) -> bytes:
    block = b"software: weblog_engine\r\nformat: WARC File Format 1.1\r\n"
    key = hashlib.sha1(name.encode()).hexdigest()
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(key)), ("WARC-Date", DATE),
                    ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
                    ("WARC-Block-Digest", "sha1:" + digest_text(hashlib.sha1(block).digest()))], block)


def gzip_member(data: bytes) -> bytes:
    """One gzip member without a time, so equal data give equal bytes."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class ShardWriter:
    """The files of one shard, under the names of one attempt."""

    def __init__(self, store: fs.FileSystem, root: str, job: str, prefix: str, shard: int, file_bytes: int):
        self.store, self.root, self.job, self.file_bytes = store, root, job, file_bytes
        self.prefix, self.shard, self.roll = prefix, shard, 0
        self.attempt, self.out, self.done = uuid.uuid4().hex, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.prefix}-{self.shard:06d}-{self.roll:04d}.warc.gz"
            self.temporary = f"_temporary/{self.job}/{self.name}.{self.attempt}"
            self.out = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.records, self.sha1 = 0, 0, hashlib.sha1()
            self._put(gzip_member(info_record(self.name)))
        self._put(gzip_member(record))
        self.records += 1
        if self.size >= self.file_bytes:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha1.update(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.temporary, self.size, self.records, self.sha1.hexdigest()))
            self.out, self.roll = None, self.roll + 1


# --- writing -----------------------------------------------------------------

def _identified(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """Pages with their place in the order and their digest. A row is known by
    its file and its number there, which both passes over the table see alike; a
    frame that is not a plain file scan is written down first."""
    try:
        pages.select("_metadata.row_index")
    except AnalysisException:
        pages = saved(pages.select(id_col, url_col, text_col), "warc_pages")
    path = F.col("_metadata.file_path")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("html"), path.alias("file"),
                        F.element_at(F.split(path, "/"), -1).alias("name"), F.col("_metadata.row_index").alias("row"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    # equal content lies together; rows equal in all are spread by their number
    content = F.pmod(F.xxhash64("digest", "url"), F.lit(1 << 30))
    number = F.pmod(F.xxhash64("name", "row"), F.lit(1 << 20))
    key = F.sha1(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "name", "row", "digest"))
    return rows.withColumn("spread", content * (1 << 20) + number).withColumn("key", key).drop("name")


def shard_starts(rows: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first (page_id, spread) of each shard but the first, null as the
    least; ``rows`` has the key columns and ``bytes``."""
    total = rows.agg(F.sum(F.col("bytes") + HEADER_BYTES).alias("t")).first().t or 0
    size = max(shard_bytes, -(-total // MOST_SHARDS))
    if total <= size:
        return []
    placed = running_sums(rows, KEY, {"before": F.col("bytes") + HEADER_BYTES}, inclusive=False)
    starts = placed.groupBy(F.floor(F.col("before") / size).alias("shard")) \
        .agg(F.min(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "spread")).alias("s")) \
        .orderBy("shard").collect()
    return sorted({_place(r.s.page_id, r.s.spread) for r in starts[1:]})


def _place(page_id: int | None, spread: int) -> tuple:
    return (page_id is not None, page_id or 0, spread)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
          revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
          prefix: str = "pages") -> DataFrame:
    """Writes the archives of ``pages`` into the new folder ``path``; returns
    the manifest."""
    spark = pages.sparkSession
    prepare(spark)
    rows = _identified(pages, id_col, url_col, text_col)
    known = saved(rows.select(*KEY, "key", "url", "digest", F.octet_length("html").cast("long").alias("bytes")), "warc_rows")
    starts = shard_starts(known, shard_bytes)

    @F.pandas_udf("long")
    def shard(page_id: pd.Series, has_id: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(starts, (ok, i if ok else 0, s))
                          for i, ok, s in zip(page_id.tolist(), has_id.tolist(), spread.tolist())], dtype="int64")

    many = known.where(F.col("bytes") >= revisit_bytes).groupBy("digest", "bytes").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), *KEY, "key", "url")).alias("first")).where("n > 1") \
        .select("digest", "bytes", "first")
    again = known.join(many, ["digest", "bytes"]).where("key <> first.key") \
        .select(*KEY, F.struct("first.page_id", "first.key", "first.url").alias("first"))
    empty = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first_type = "struct<page_id:bigint,key:string,url:string>"
    # the row that says whom a page revisits sorts just before the page
    both = rows.select(*KEY, F.lit(True).alias("is_page"), "url", "html", "key", empty(first_type, "first")) \
        .unionByName(again.select(*KEY, F.lit(False).alias("is_page"), empty("string", "url"), empty("string", "html"),
                                  empty("string", "key"), "first"))
    both = both.withColumn("shard", shard(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNotNull(), F.col("spread")))
    job = uuid.uuid4().hex
    store, root = open_store(path)
    store.create_dir(f"{root}/_temporary/{job}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        writer, first = None, None
        for b in batches:
            columns = [b.column(c) for c in ("shard", "page_id", "is_page", "url", "html", "key", "first")]
            for at in range(b.num_rows):
                s, page_id, is_page, url, html, key, told = (c[at].as_py() for c in columns)
                if not is_page:
                    first = told
                    continue
                if writer is None or writer.shard != s:
                    if writer:
                        yield from finish(writer)
                    writer = ShardWriter(store, root, job, prefix, s, file_bytes)
                writer.add(page_record(page_id, url, html.encode(), key, first))
                first = None
        if writer:
            yield from finish(writer)

    def finish(writer: ShardWriter) -> Iterator[pa.RecordBatch]:
        writer.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*writer.done), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["name", "temporary", "bytes", "records", "sha1"])

    # a shard is a partition: no task holds more than one
    written = saved(both.repartitionById(len(starts) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", *KEY, "is_page").mapInArrow(run, _FILES),
                    "warc_attempts")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for b in batches:
            for name, temporary in zip(b.column("name").to_pylist(), b.column("temporary").to_pylist()):
                if store.get_file_info(f"{root}/{temporary}").type == fs.FileType.File:
                    store.move(f"{root}/{temporary}", f"{root}/{name}")
                elif store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{root}/{temporary}")
            yield b.select(["name", "bytes", "records", "sha1"])

    written.mapInArrow(move, "name string, bytes long, records long, sha1 string").write.parquet(f"{path}/manifest")
    store.delete_dir(f"{root}/_temporary")  # what lost attempts left
    return manifest(spark, path)


# --- reading -----------------------------------------------------------------

def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, records, sha1) of the files of committed archives."""
    return spark.read.schema("name string, bytes long, records long, sha1 string").parquet(f"{path}/manifest")


def members(source, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream."""
    at, left = 0, b""
    while left or (left := source.read(chunk)):
        d, parts, begun = zlib.decompressobj(31), [], at
        while not d.eof:
            if not left and not (left := source.read(chunk)):
                raise EOFError("the last gzip member is cut off")
            parts.append(d.decompress(left))
            at += len(left) - len(d.unused_data)
            left = d.unused_data
        yield begun, b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"length of {fields.get('warc-record-id')}")
    return fields, rest[:size]


def _page(record: bytes) -> tuple | None:
    """What RECORDS has of a page's record, but archive and offset, and the
    payload; None for other records."""
    f, block = parse(record)
    if "sha1:" + digest_text(hashlib.sha1(block).digest()) != f["warc-block-digest"]:
        raise ValueError(f"block digest of {f['warc-record-id']}")
    kind = f["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?mi)^content-length: *(\d+)", http)[1])
    sha1 = f["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (length != len(payload) or sha1 != digest_text(hashlib.sha1(payload).digest())):
        raise ValueError(f"payload of {f['warc-record-id']}")
    number = lambda k: int(f[k]) if k in f else None
    url = f["warc-target-uri"]
    return (number("x-page-id"), None if url == NO_ADDRESS else url, kind, length, sha1,
            number("x-refers-to-page-id"), payload if kind == "response" else None)


def read(spark: SparkSession, path: str, payloads: bool = False, batch_bytes: int = 16 << 20) -> DataFrame:
    """The page records of committed archives, their digests checked; with
    ``payloads`` also the responses' bytes. One task reads a file, record by
    record."""
    prepare(spark)
    files = manifest(spark, path)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                        ("archive", pa.string()), ("record_offset", pa.int64()),
                        *([("payload", pa.binary())] if payloads else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        for b in batches:
            for f in b.to_pylist():
                held, size, n = [], 0, 0
                if store.get_file_info(f"{root}/{f['name']}").size != f["bytes"]:
                    raise ValueError(f"size of {f['name']}")
                with store.open_input_stream(f"{root}/{f['name']}", compression=None) as source:
                    for offset, record in members(source):
                        page = _page(record)
                        if page is None:
                            continue
                        n += 1
                        held.append((*page[:6], f["name"], offset, *page[6:7 if payloads else 6]))
                        size += len(record) if payloads else 256
                        if size >= batch_bytes:
                            yield batch(held)
                            held, size = [], 0
                if n != f["records"]:
                    raise ValueError(f"records of {f['name']}")
                if held:
                    yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    n = max(1, min(files.count(), 10_000))
    return files.repartition(n).mapInArrow(run, RECORDS + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes the archives of ``pages`` to the shared scratch folder and reads
    them back: RECORDS."""
    path = scratch_path(pages.sparkSession, f"warc-{uuid.uuid4().hex}")
    write(pages, path, **how)
    return read(pages.sparkSession, path)
