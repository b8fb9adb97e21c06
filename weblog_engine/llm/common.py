"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

# Bounds of one Arrow batch handed to a Python worker: rows and bytes. They
# bound a worker's memory; results do not depend on them.
BATCH_ROWS = 1000
BATCH_BYTES = 16 * 1024 * 1024


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors and bound the Arrow batches."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and reread it:
    cuts lineage, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(column: str | Column) -> Column:
    """128 bits that stand for a text; null stands as empty."""
    text = F.col(column) if isinstance(column, str) else column
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n+1 offsets into
    them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    kind = np.int64 if wide else np.int32
    o = np.frombuffer(offs, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if offs is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0]:o[-1]], o - o[0]


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """256 fixed pseudo-random 64-bit codes, one per byte value."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 256)) * step)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
