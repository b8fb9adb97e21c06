"""The registered queries of this folder and their oracle SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        _QUERIES[name] = fn
        if sql:
            _ORACLE[name] = sql
        return fn
    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def vocabulary_path() -> str:
    """The public word BPE vocabulary installed with the tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@register("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe
    return bpe.digests(documents(spark, sf_dir), vocabulary_path())


@register("op2_block_join")
def op2_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import blockjoin
    vectors = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    return blockjoin.nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors)


@register("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing
    return packing.pack(documents(spark, sf_dir)).drop("text")


@register("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix
    return suffix.report(documents(spark, sf_dir))


@register("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets
    return secrets.report(documents(spark, sf_dir))


@register("op6_set_join")
def op6_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import setjoin
    return setjoin.join(documents(spark, sf_dir)).drop("tag", "group")


@register("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chunks
    return chunks.edit_report(documents(spark, sf_dir))


@register("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ppm
    return ppm.predictions(documents(spark, sf_dir))


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii
    return pii.report(documents(spark, sf_dir))


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    return toxicity.predictions(documents(spark, sf_dir), labels)


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whiten
    return whiten.whiten(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")))


# 40 hexadecimal digits to 32 of base 32: five digits are 20 bits, four letters
_BASE32 = """list_aggregate([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr({hex}, CAST(5 * (i // 4) + 1 AS INTEGER), 5))::INTEGER >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1,
           1) for i in range(0, 32)], 'string_agg', '')"""


@register("op12_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first_id, sha1(h) AS hex FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32.format(hex='hex')} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q""")
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc
    return warc.round_trip(spark.read.parquet(os.path.join(sf_dir, "pages.parquet"))) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op11_hard_negatives", """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id AS other_id, b.label AS other_label,
           CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, anchor_label, other_id AS positive_id, score AS positive_score FROM pairs
    WHERE anchor_label = other_label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
       n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.other_label <> p.anchor_label
     AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import hardneg
    rows = spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0, label=moved)
