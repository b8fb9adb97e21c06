"""The document pipeline: language identification, near-duplicate removal,
removal of repeated passages, redaction of personal data and packing.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's
documents; all but the last return the columns of ``documents``. ``n_chars``
follows the text. Null ids, null, empty or very long texts, repeated rows and an
empty table pass through every stage as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog_engine.llm import packing, pii, ppm, setjoin, suffix
from weblog_engine.llm.common import documents, saved, text_key

# A text that costs more bits than unpredicted bytes is like none of the languages.
MOST_BITS_PER_BYTE = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those unlike every language;
    fills in missing languages."""
    model = ppm.train(docs.where(~ppm.held_out()))
    found = ppm.identify(docs, model, keep=tuple(docs.columns)) \
        .where((F.col("lang_pred") != ppm.UNDETERMINED) & (F.col("bits_per_byte") <= MOST_BITS_PER_BYTE))
    return _row_with(found, docs.columns, lang=F.coalesce(F.col("row.lang"), F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the least
    id. Documents without words are all kept."""
    found = setjoin.join(docs).where("group IS NOT NULL").select("doc_id", "tag", "group")
    found = saved(found, "groups")
    many = found.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")).alias("r")).where("n > 1")
    member = found.join(many, "group").select(
        F.col("doc_id").alias("k"), F.col("tag").alias("t"),
        (F.col("doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("tag") == F.col("r.tag"))).alias("first")).distinct()
    member = saved(member, "members")
    # only documents that may be members are shuffled to be looked up
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("key"), text_key("text").alias("tag"))
    rows = setjoin.mark(whole, member.select(F.col("k").alias("key"), F.col("t").alias("tag")))
    judged = rows.where("marked").join(
        member, F.col("key").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t")), "left")
    alone = judged.where("first IS NULL").select("row.*")
    first = judged.where("first").dropDuplicates(["key", "tag"]).select("row.*")
    return rows.where("NOT marked").select("row.*").unionByName(alone).unionByName(first)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes and more that occur elsewhere; a character
    that a cut splits goes with it."""
    found = suffix.dedup(docs, keep=tuple(docs.columns))
    left = F.make_valid_utf8(F.col("kept").cast("string"))
    # characters that were cut in two, unless the text holds the sign itself
    left = F.when(F.col("row.text").contains("�"), left).otherwise(F.replace(left, F.lit("�"), F.lit("")))
    text = F.when(F.col("row.text").isNotNull(), F.when(F.col("n_spans") > 0, left).otherwise(F.col("row.text")))
    return _with_text(found.select("row", text.alias("text")), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    redacted = pii.redact(docs)
    return _with_text(redacted.select(F.struct(*docs.columns).alias("row"), "text"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's length bucket and token-budget batch."""
    return packing.pack(docs)


def _row_with(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns of the struct ``row``, some of them changed."""
    return df.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def _with_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``row`` with the column ``text`` as its text."""
    return _row_with(df, columns, text=F.col("text"), n_chars=F.coalesce(F.length("text"), F.lit(0)).cast("long"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", pack),
]

# SQL cannot express the first stage; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
