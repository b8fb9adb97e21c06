"""Document fingerprints by content-defined chunking.

A 32-byte gear hash runs over a text's UTF-8 bytes. A chunk ends at the first
position after ``MIN`` bytes whose hash meets the strict mask, after ``NORMAL``
bytes already at the loose mask, at ``MAX`` bytes at the latest (normalised
chunking). The fingerprint is the set of chunk digests; a digest carries its
chunk's length, which is its weight. An insertion shifts bytes but moves only
the boundaries near it, so the other digests stay.

Cases: null and empty texts have the empty fingerprint; two empty fingerprints
are alike with 1, an empty and a filled one with 0. Rows with the same id are
ordered by text; null ids come last. Texts of any length are cut whole; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import byte_codes, prepare

MIN, NORMAL, MAX = 16, 64, 256
STRICT_BITS, LOOSE_BITS = 7, 5

_GEAR = (byte_codes(7) >> np.uint64(32)).astype(np.uint32)
_FIRST_ID = -(1 << 63)


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 byte codes, each shifted left by its
    distance, modulo 2^32; summed by doubling the window five times."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut(data: np.ndarray) -> list[int]:
    """End positions of the chunks of one text."""
    n = len(data)
    h = gear(data)
    at = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = (h[at] >> np.uint32(32 - STRICT_BITS) == 0).tolist()
    ends, start = [], 0
    for p, s in zip((at + 1).tolist(), strict):
        while p - start > MAX:
            start += MAX
            ends.append(start)
        size = p - start
        if size >= NORMAL or (s and size >= MIN):
            ends.append(p)
            start = p
    while n - start > MAX:
        start += MAX
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str | None) -> np.ndarray:
    """Sorted distinct codes: 56 bits of the chunk's digest, 8 of its length."""
    raw = (text or "").encode()
    codes, start = [], 0
    for end in cut(np.frombuffer(raw, np.uint8)):
        codes.append(xxhash.xxh3_64_intdigest(raw[start:end]) >> 8 << 8 | (end - start - 1))
        start = end
    return np.unique(np.array(codes, np.uint64))


def as_text(codes: np.ndarray) -> str:
    return codes.astype(">u8").tobytes().hex()


def weight(codes: np.ndarray) -> int:
    return int((codes & np.uint64(255)).sum()) + len(codes)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment: the share of a's chunk bytes whose chunks are in b."""
    if not len(a):
        return 0.0 if len(b) else 1.0
    return weight(np.intersect1d(a, b, assume_unique=True)) / weight(a)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [as_text(fingerprint(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [id_col, "fingerprint"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fingerprint string")


def _ranges(df: DataFrame, id_col: str) -> list[int]:
    """The largest id of each of at most ``spark.sql.shuffle.partitions``
    ranges of ids, descending; made from the ids alone, one value per range."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("k")
    parts = shuffle_partitions(df.sparkSession)
    heads = df.select(key).repartitionByRange(parts, F.col("k").desc()) \
        .groupBy(F.spark_partition_id()).agg(F.max("k").alias("k")).collect()
    return sorted({r.k for r in heads}, reverse=True)


def with_next(df: DataFrame, each, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``each(id, text, next text)`` makes for every document and its
    successor in descending id order, cyclically.

    Documents are dealt into ranges of ids; a range also gets the first
    document of the range after it. A task walks its ranges in order holding
    one batch, so ranges may be larger than memory."""
    prepare(df.sparkSession)
    heads = _ranges(df, id_col)
    if not heads:
        return df.sparkSession.createDataFrame([], schema)
    edges = -np.array(heads, dtype=object).astype(object)
    ascending = np.array([-int(e) for e in edges][::-1], dtype=np.int64)  # of the heads
    n = len(heads)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = n - 1 - np.searchsorted(ascending, ids, "left")
            first = np.flatnonzero(ids == ascending[n - 1 - at])
            for rows, range_no, copy in ((np.arange(len(ids)), at, False), (first, (at[first] - 1) % n, True)):
                if len(rows):
                    part = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range_no.astype(np.int32)), pa.array([copy] * len(rows)), *part.columns],
                        ["range_no", "is_copy", "k", "id", "text"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_range, done = None, None, False
        for b in batches:
            out = []
            for range_no, copy, i, text in zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4))):
                if range_no != held_range:
                    held, held_range, done = None, range_no, False
                if done:
                    continue
                if held is not None:
                    out.append(each(held[0], held[1], text))
                held, done = (i, text), copy
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("k"),
                     F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    dealt = rows.mapInArrow(deal, f"range_no int, is_copy boolean, k long, id {id_type}, text string")
    return dealt.repartition(shuffle_partitions(df.sparkSession), "range_no") \
        .sortWithinPartitions("range_no", "is_copy", F.col("k").desc(), F.col("text").asc_nulls_first()) \
        .mapInArrow(walk, schema)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike it
    is to its edited text and to the next document."""
    import hashlib
    last: dict = {}

    def of(text: str) -> np.ndarray:
        """The next document's fingerprint serves again when its turn comes."""
        if last.get("text") != text:
            last.update(text=text, codes=fingerprint(text))
        return last["codes"]

    def each(i, text, following):
        text, following = text or "", following or ""
        own, new = of(text), edited(text, following)
        other = fingerprint(new)
        return {"doc_id": i, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(),
                "fingerprint": as_text(own), "edited_fingerprint": as_text(other),
                "near_edited": likeness(own, other), "near_next": likeness(own, of(following))}

    return with_next(df, each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                               "edited_fingerprint string, near_edited double, near_next double", id_col, text_col)
