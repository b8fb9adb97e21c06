"""A table that holds every message of a topic exactly once, whatever is replayed.

Rows carry (topic, partition, offset). A batch is written to a folder of its own
and then committed by a small file that names the folder and the greatest offset
of each partition in it. Rows at or below a partition's greatest committed offset
are left out, so a replay adds nothing, be it of one batch, of a restart, or of a
whole topic under a new checkpoint. A folder without a commit (a run that died in
between) is never read. Compaction writes all live folders into one, whose commit
names those it replaces, and then deletes them. One writer at a time; messages of a
partition come in the order of their offsets."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COMMIT = "folder string, topic string, partition int, last long, rows long, replaces array<string>"
COMPACT_AT = 32  # live folders


def commits(spark: SparkSession, target: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).parquet(os.path.join(target, "commits"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def live_folders(spark: SparkSession, target: str) -> list[str]:
    """Committed folders that no other one replaces; compaction bounds them."""
    rows = commits(spark, target).select("folder", "replaces").distinct().collect()
    gone = {f for r in rows for f in r.replaces or []}
    return sorted({r.folder for r in rows} - gone)


def high_water_marks(spark: SparkSession, target: str) -> DataFrame:
    """(topic, partition, last): the greatest offset stored of each partition."""
    return commits(spark, target).groupBy("topic", "partition").agg(F.max("last").alias("last"))


def read_table(spark: SparkSession, target: str, schema) -> DataFrame:
    paths = [os.path.join(target, "data", f) for f in live_folders(spark, target)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, target: str, folder: str, schema, replaces: list[str]) -> None:
    stored = spark.read.schema(schema).parquet(os.path.join(target, "data", folder))
    marks = stored.groupBy("topic", "partition").agg(F.max("offset").alias("last"), F.count(F.lit(1)).alias("rows"))
    # one file, moved into place at once: a commit is there as a whole or not at all
    marks.select(F.lit(folder).alias("folder"), F.col("topic").cast("string"), F.col("partition").cast("int"),
                 F.col("last").cast("long"), "rows", F.array(*[F.lit(r) for r in replaces]).cast("array<string>").alias("replaces")) \
        .coalesce(1).write.mode("append").parquet(os.path.join(target, "commits"))


def append(batch: DataFrame, target: str) -> None:
    """Adds the rows that the table does not hold yet."""
    spark, folder = batch.sparkSession, uuid.uuid4().hex
    marks = high_water_marks(spark, target).select(F.col("topic").alias("_t"), F.col("partition").alias("_p"), "last")
    # a row for each partition of the topics
    fresh = batch.join(F.broadcast(marks), (F.col("topic") == F.col("_t")) & (F.col("partition") == F.col("_p")), "left") \
        .where(F.col("last").isNull() | (F.col("offset") > F.col("last"))).drop("_t", "_p", "last") \
        .dropDuplicates(["topic", "partition", "offset"])
    path = os.path.join(target, "data", folder)
    fresh.write.parquet(path)
    if spark.read.schema(batch.schema).parquet(path).isEmpty():
        _delete(spark, path)  # nothing but replays
    else:
        _commit(spark, target, folder, batch.schema, [])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def compact(spark: SparkSession, target: str, schema, files: int = 1) -> None:
    """All live folders as one with so many files."""
    old = live_folders(spark, target)
    if len(old) < 2:
        return
    folder = uuid.uuid4().hex
    read_table(spark, target, schema).repartition(files).write.parquet(os.path.join(target, "data", folder))
    _commit(spark, target, folder, schema, old)
    for name in old:
        _delete(spark, os.path.join(target, "data", name))


def persist_messages(messages: DataFrame, target: str, checkpoint: str, compact_at: int = COMPACT_AT,
                     files: int = 1) -> StreamingQuery:
    """Streams messages with (topic, partition, offset) into the table."""
    def write(batch: DataFrame, _: int) -> None:
        append(batch, target)
        if len(live_folders(batch.sparkSession, target)) >= compact_at:
            compact(batch.sparkSession, target, batch.schema, files)

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
