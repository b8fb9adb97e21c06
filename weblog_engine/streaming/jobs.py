"""Streaming jobs: message sources, decode, windowed statistics, alerts,
persistence. Sources and sinks are parameters: a Kafka topic on a cluster,
a folder of message files in tests (no Kafka connector is bundled here)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import round_half_up
from ..schema import MODEL_METADATA_SCHEMA
from ..sources.ingest import decode_events
from .windows import GRACE, WINDOW, encode_windows, windowed_stats

RAW_TOPIC = "weblogs.raw"
AGGREGATED_TOPIC = "weblogs.aggregated"
CONSUMER_GROUP = "weblog-consumer"


def kafka_source(spark: SparkSession, bootstrap: str, topic: str = RAW_TOPIC,
                 starting_offsets: str = "earliest") -> DataFrame:
    """(key, value, topic, partition, offset, timestamp) from a Kafka topic.
    Needs the spark-sql-kafka package on the classpath."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
            .option("kafka.group.id", CONSUMER_GROUP)
            .load()
            .select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                    "topic", "partition", "offset", "timestamp"))


def kafka_sink_options(bootstrap: str, topic: str = AGGREGATED_TOPIC) -> dict:
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic}


def file_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Message files (one JSON message per line) as a stream of (key, value);
    the test twin of the Kafka source. Files are taken oldest first."""
    r = spark.readStream.format("text").option("latestFirst", False)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path).select(F.get_json_object("value", "$.method").alias("key"), "value")


def event_stream(messages: DataFrame, value_col: str = "value", observe: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Decode messages; the event time is cast to TIMESTAMP (UTC), which a
    watermark requires. Undecodable messages go to the second frame. ``observe``
    names the counts that ``accounted`` reads."""
    rows, bad = decode_events(messages, value_col, observe)
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp")), bad


def window_stream(events: DataFrame, size: str = WINDOW, grace: str = GRACE,
                  time_col: str = "timestamp", key_col: str = "method") -> DataFrame:
    """Per-key tumbling-window statistics with zero grace: rows later than
    the watermark are dropped; in append mode each window is emitted once,
    when it closes. Rows without a usable timestamp cannot be placed in a
    window and are left out."""
    src = events.where(F.col(time_col).isNotNull())
    return windowed_stats(src, time_col, key_col, size, grace)


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep window state in RocksDB (off-heap, spills to local disk and is
    checkpointed) instead of the JVM heap; set before a query first starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def start_window_job(events: DataFrame, sink_path: str, checkpoint: str, size: str = WINDOW,
                     grace: str = GRACE, fmt: str = "parquet", options: dict | None = None) -> StreamingQuery:
    """Start the windowed-statistics stream. State is keyed by (window,
    method) and dropped once the watermark passes the window end. A Kafka
    sink gets (key = method, value = JSON result) messages."""
    out = window_stream(events, size, grace)
    if fmt == "kafka":
        out = encode_windows(out)
    w = (out.writeStream.outputMode("append").format(fmt)
         .option("checkpointLocation", checkpoint))
    for k, v in (options or {}).items():
        w = w.option(k, v)
    return w.start(sink_path) if fmt != "kafka" else w.start()


def persist_stream(events: DataFrame, target: str, checkpoint: str,
                   partition_col: str = "_batch") -> StreamingQuery:
    """Append every micro-batch to ``target`` exactly once: each batch is
    written to its own ``_batch=<id>`` partition with dynamic overwrite, so
    a batch replayed after a failure replaces its own earlier attempt."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn(partition_col, F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition_col).parquet(target))
    return (events.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).start())


ACCOUNTED = "batch_id long, messages long, undecodable long, late_groups long"


def accounted(query: StreamingQuery, observe: str) -> DataFrame:
    """What became of each micro-batch's messages: how many came, how many could
    not be decoded, and how many (window, method) groups came after their window
    had closed and were dropped. Taken from the query's own progress, which Spark
    keeps for ``spark.sql.streaming.numRecentProgressUpdates`` batches."""
    rows = {}
    for p in query.recentProgress:
        seen = p.observedMetrics.get(observe)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        old = rows.get(p.batchId, (0, 0, 0))
        rows[p.batchId] = (old[0] + (seen.messages if seen else 0), old[1] + (seen.undecodable if seen else 0), old[2] + late)
    return SparkSession.getActiveSession().createDataFrame([(k, *v) for k, v in sorted(rows.items())], ACCOUNTED)


def error_events(events: DataFrame) -> DataFrame:
    """Side output of failed requests (status >= 400)."""
    return events.where(F.col("status_code") >= 400)


def start_alert_job(events: DataFrame, detector, sink_path: str, checkpoint: str,
                    rule: str = "zscore", forest_scorer=None) -> StreamingQuery:
    from ..operators.anomaly import alerts
    a = alerts(events, detector, rule, forest_scorer)
    return (a.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", checkpoint).start(sink_path))


# The buffers of the window aggregate as the state store keeps them, by position.
_STATE = "struct<count: bigint, total: decimal(38,6), empty: boolean, known: bigint, errors: bigint>"


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The window job's state, read from its checkpoint while it runs or after
    it: the windows that have not closed yet, with what they have counted so far."""
    v = F.col("value").cast(_STATE)
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col("key.method").alias("method"), F.col("key.window.start").alias("window_start"),
        F.col("key.window.end").alias("window_end"), v["count"].alias("count"),
        round_half_up(v["total"].cast("double") / v["known"], 2).alias("avg_response_time_ms"), v["errors"].alias("error_count"))


def start_live_alert_job(events: DataFrame, metadata: str, sink_path: str, checkpoint: str,
                         rule: str = "zscore") -> StreamingQuery:
    """Alerts by the detector that is active in the model table at ``metadata``
    when a micro-batch begins: one version a batch, named in its alerts as
    ``model_version``. Without one the fixed moments serve, under no version. A
    batch that is replayed replaces its own alerts."""
    from ..operators import anomaly, iforest, train
    known: dict = {}

    def active(spark: SparkSession):
        try:
            meta = spark.read.schema(MODEL_METADATA_SCHEMA).parquet(metadata)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None, None
        row = train.active_models(meta).where(F.col("model_type") == "anomaly_detector").first()
        if row is None:
            return None, None
        if known.get("at") != (row.version, row.file_path):
            known.update(at=(row.version, row.file_path), detector=anomaly.load_detector(spark, row.file_path))
        return row.version, known["detector"]

    def write(batch: DataFrame, batch_id: int) -> None:
        version, det = active(batch.sparkSession)
        forest = (lambda d: iforest.score(d, det.forest)) if det and det.forest else None
        found = anomaly.alerts(batch, det, rule, forest).withColumn("model_version", F.lit(version).cast("string"))
        found.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(sink_path)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
