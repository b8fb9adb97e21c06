"""Log ingestion: CSV upload with header resolution and bad-row
quarantine, JSON events, table loaders and sinks.

Parsing is one projection of built-in expressions over the raw text
columns, so it runs inside codegen on every executor; the driver only reads
the header line."""

from __future__ import annotations

import csv
import io
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import parse_timestamp, truncated_int, with_scalar
from ..schema import EVENT_JSON_SCHEMA, KNOWN_HEADER_NAMES, REQUIRED_HEADER_NAMES, WEBLOG_COLUMNS

CORRUPT = "_corrupt_record"
# Comma outside double quotes (for counting the fields of a raw CSV line).
_FIELD_SPLIT = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
TS_WRITE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def normalise_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def resolve_header(names: list[str]) -> dict[str, int]:
    """Known column -> position. Trim, lower-case, spaces to underscores;
    unknown names are ignored; a repeated name keeps its last position.
    Raises if a required column is missing."""
    mapping: dict[str, int] = {}
    for i, n in enumerate(names):
        key = normalise_name(n)
        if key in KNOWN_HEADER_NAMES:
            mapping[key] = i
    missing = [c for c in REQUIRED_HEADER_NAMES if c not in mapping]
    if missing:
        raise ValueError(f"CSV header lacks required columns: {missing}")
    return mapping


def _fields(line: str) -> list[str]:
    return next(csv.reader(io.StringIO(line)))


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> the files of the upload that start with it, from one
    aggregation over the text: a file's first line is the first row of its
    first block. One entry unless the parts of a folder differ; the files are
    listed only then."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")).where("block = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "row").alias("line"))
    kinds = [r.line for r in first.select("line").distinct().collect()]
    if not kinds or any(not k.strip() for k in kinds):
        raise ValueError("empty CSV upload")
    if len(kinds) == 1:
        return {kinds[0]: [path]}
    out: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        out.setdefault(r.line, []).append(r.file)
    return out


def check_upload_name(path: str) -> None:
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError("only .csv uploads are accepted")


def raw_csv(spark: SparkSession, path: str | list[str], n_fields: int, whole_records: bool = True) -> DataFrame:
    """With ``whole_records`` a quoted field may hold line breaks; a file is
    then read by one task. Without it files are split between tasks, and each
    line is a record. All fields as text, one column per header field, plus the raw line of
    rows whose field count differs from the header. Column pruning is off
    for this read: with it, which rows count as malformed would depend on
    the columns a later projection happens to need."""
    schema = T.StructType([T.StructField(f"_f{i}", T.StringType()) for i in range(n_fields)] +
                          [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("escape", '"')
            .option("enforceSchema", True).option("columnPruning", False)
            .option("multiLine", whole_records).csv(path))


def _strict_int(s: Column) -> Column:
    """Integer text only ("12.5" and "" fail, as with a strict int parser)."""
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))


def parse_rows(raw: DataFrame, mapping: dict[str, int]) -> DataFrame:
    """Typed rows plus ``reject_reason`` (NULL for good rows).

    A field counts as missing when the row is shorter than the header;
    an empty field is present with empty text. Rules: required columns
    must parse; method upper-cased; path '/unknown' when the column is
    absent, rejected when missing from a short row, '' when empty;
    user_agent / ip_address NULL when absent or missing; bytes_sent 0 when
    absent or missing, rejected when empty or not an integer."""
    n_tok = F.when(F.col(CORRUPT).isNotNull(),
                   F.size(F.split(F.col(CORRUPT), _FIELD_SPLIT, -1)))

    def field(name):
        i = mapping.get(name)
        if i is None:
            return None, F.lit(False)
        present = F.col(CORRUPT).isNull() | (n_tok > F.lit(i))
        return F.when(present, F.coalesce(F.trim(F.col(f"_f{i}")), F.lit(""))), present

    ts_s, ts_p = field("timestamp")
    m_s, m_p = field("method")
    p_s, p_p = field("path")
    st_s, st_p = field("status_code")
    rt_s, rt_p = field("response_time_ms")
    ua_s, _ = field("user_agent")
    ip_s, _ = field("ip_address")
    by_s, by_p = field("bytes_sent")

    ts = parse_timestamp(ts_s)
    status = _strict_int(st_s)
    rt = rt_s.try_cast("double")
    # NaN and infinite times would spoil every sum and mean
    rt = F.when(F.abs(rt) < float("inf"), rt)
    path = p_s if p_s is not None else F.lit("/unknown")
    if by_s is None:
        bytes_ = F.lit(0)
        bytes_bad = F.lit(False)
    else:
        bytes_ = F.when(by_p, _strict_int(by_s)).otherwise(F.lit(0))
        bytes_bad = by_p & bytes_.isNull()
    reason = (F.when(ts_s.isNull(), "missing timestamp")
              .when(ts.isNull(), "bad timestamp")
              .when(m_s.isNull(), "missing method")
              .when(path.isNull(), "missing path")
              .when(st_s.isNull(), "missing status_code")
              .when(status.isNull(), "bad status_code")
              .when(rt_s.isNull(), "missing response_time_ms")
              .when(rt.isNull(), "bad response_time_ms")
              .when(bytes_bad, "bad bytes_sent"))
    return raw.select(
        ts.alias("timestamp"),
        F.upper(m_s).alias("method"),
        path.alias("path"),
        status.alias("status_code"),
        rt.alias("response_time_ms"),
        (ua_s if ua_s is not None else F.lit(None).cast("string")).alias("user_agent"),
        (ip_s if ip_s is not None else F.lit(None).cast("string")).alias("ip_address"),
        bytes_.cast("int").alias("bytes_sent"),
        reason.alias("reject_reason"),
        F.col(CORRUPT).alias("raw_line"),
    )


@dataclass
class Ingested:
    good: DataFrame
    rejects: DataFrame
    counts: DataFrame      # one row: processed, failed


def parse_upload(spark: SparkSession, path: str, whole_records: bool = True) -> DataFrame:
    """Typed rows of an upload (file or folder of parts), each part by its
    own header."""
    parsed = None
    for line, files in sorted(headers(spark, path).items()):
        names = _fields(line)
        part = parse_rows(raw_csv(spark, files, len(names), whole_records), resolve_header(names))
        parsed = part if parsed is None else parsed.unionByName(part)
    return parsed


def ingest_csv(spark: SparkSession, path: str, check_name: bool = True, whole_records: bool = True) -> Ingested:
    """Parse an uploaded CSV (file or folder of CSV parts) into good rows
    (canonical schema without id/created_at) and rejected rows with a
    reason. Nothing is collected; ``counts`` is one aggregate."""
    if check_name:
        check_upload_name(path)
    parsed = parse_upload(spark, path, whole_records)
    good = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason", "raw_line")
    rejects = parsed.where(F.col("reject_reason").isNotNull())
    counts = parsed.agg(F.count(F.when(F.col("reject_reason").isNull(), 1)).alias("processed"),
                        F.count(F.col("reject_reason")).alias("failed"))
    return Ingested(good, rejects, counts)


def land_csv(spark: SparkSession, path: str, dest: str, check_name: bool = True, whole_records: bool = True) -> dict:
    """Parse once and write good and rejected rows in a single pass,
    partitioned by ``is_valid``; counts come from the written table."""
    if check_name:
        check_upload_name(path)
    tagged = parse_upload(spark, path, whole_records) \
        .withColumn("is_valid", F.col("reject_reason").isNull())
    tagged.write.mode("overwrite").partitionBy("is_valid").parquet(dest)
    c = spark.read.parquet(dest).groupBy("is_valid").count().collect()
    got = {str(r["is_valid"]).lower(): r["count"] for r in c}
    processed, failed = got.get("true", 0), got.get("false", 0)
    if processed + failed == 0:
        raise ValueError("CSV upload has no rows")
    return {"processed": processed, "failed": failed}


def with_ingest_columns(good: DataFrame, id_col: Column | None = None, upload: str | None = None) -> DataFrame:
    """Attach ``id`` (from the source, else a hash of the upload's name and the
    row's place in it, so that uploads do not share ids) and ``created_at`` =
    ingest time."""
    place = F.xxhash64(F.lit(upload or uuid.uuid4().hex), F.monotonically_increasing_id())
    ident = id_col if id_col is not None else place
    return good.select(ident.cast("long").alias("id"), *[c for c in good.columns if c != "id"],
                       F.localtimestamp().alias("created_at"))


# --------------------------------------------------------------- events

def encode_events(logs: DataFrame) -> DataFrame:
    """(key, value) message rows: key = method, value = JSON of the log row
    with camelCase names."""
    value = F.to_json(F.struct(
        F.col("id").alias("id"),
        F.date_format("timestamp", TS_WRITE_FORMAT).alias("timestamp"),
        F.col("method"), F.col("path"),
        F.col("status_code").alias("statusCode"),
        F.col("response_time_ms").alias("responseTimeMs"),
        F.col("user_agent").alias("userAgent"),
        F.col("ip_address").alias("ipAddress"),
        F.col("bytes_sent").alias("bytesSent")))
    return logs.select(F.col("method").alias("key"), value.alias("value"))


def publish_events(logs: DataFrame, bootstrap: str, topic: str = "weblogs.raw") -> None:
    """Batch publish: every row as one message (key = method) to a Kafka
    topic. Needs the spark-sql-kafka package on the classpath."""
    (encode_events(logs).write.format("kafka")
     .option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save())


def decode_events(messages: DataFrame, value_col: str = "value", observe: str | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON messages -> (log rows, undecodable messages). Numbers may come as
    JSON numbers or numeric text, decimals are cut to integers where one is
    due; a missing or non-numeric status is 200, such a response time 0.0; text that is not a JSON object is quarantined.
    With ``observe``, both frames count all messages and the undecodable ones under that name as they pass."""
    schema = T.StructType(EVENT_JSON_SCHEMA.fields + [T.StructField("_bad", T.StringType())])
    j = messages.withColumn("_j", F.from_json(F.col(value_col).cast("string"), schema,
                                              {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_j").isNull() | F.col("_j._bad").isNotNull()
    if observe:
        j = j.observe(observe, F.count(F.lit(1)).alias("messages"), F.count_if(bad).alias("undecodable"))
    rows = j.where(~bad).select(
        F.col("_j.id").try_cast("long").alias("id"),
        parse_timestamp(F.col("_j.timestamp")).alias("timestamp"),
        F.upper(F.trim(F.col("_j.method"))).alias("method"),
        F.col("_j.path").alias("path"),
        F.coalesce(truncated_int("_j.statusCode"), F.lit(200)).alias("status_code"),
        F.coalesce(F.col("_j.responseTimeMs").try_cast("double"), F.lit(0.0)).alias("response_time_ms"),
        F.col("_j.userAgent").alias("user_agent"),
        F.col("_j.ipAddress").alias("ip_address"),
        F.coalesce(truncated_int("_j.bytesSent"), F.lit(0)).alias("bytes_sent"),
    )
    corrupt = j.where(bad).drop("_j")
    return rows, corrupt


# -------------------------------------------------------- loaders, sinks

def load_first_nonempty(loaders) -> DataFrame | None:
    """Try loaders in order (e.g. database table, then CSV file); the first
    that succeeds with at least one row wins."""
    for load in loaders:
        try:
            df = load()
        except Exception:  # noqa: BLE001 - an unavailable source falls through
            continue
        if df is not None and not df.isEmpty():
            return df
    return None


def read_jdbc(spark: SparkSession, url: str, table: str = "web_logs", partition_column: str = "id",
              num_partitions: int = 64, properties: dict | None = None) -> DataFrame:
    """Parallel JDBC scan split on the id range (bounds from one MIN/MAX
    query). Ordering is left to the consumer that needs it."""
    props = dict(properties or {})
    b = spark.read.jdbc(url, f"(SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi "
                             f"FROM {table}) b", properties=props).first()
    if b is None or b[0] is None:
        return spark.read.jdbc(url, table, properties=props)
    lo, hi = int(b[0]), int(b[1])
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lo, upperBound=hi + 1,
                           numPartitions=num_partitions, properties=props)


def latest(df: DataFrame, n: int = 5000, ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Newest ``n`` rows. Counts per hour name the hour that the n-th newest
    row falls into, so the final sort gets little more than ``n`` rows,
    however many partitions there are."""
    hours = df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    newer = F.sum("c").over(Window.orderBy(F.desc("hour"))) - F.col("c")  # one row per hour of data
    cut = hours.withColumn("newer", newer).agg(
        F.min(F.when(F.col("newer") < n, F.col("hour"))).alias("hour"), F.sum("c").alias("rows"))
    known = F.col("_cut.rows") >= n
    return with_scalar(df, "_cut", cut).where(
        (F.col(ts) >= F.col("_cut.hour")) | ~F.coalesce(known, F.lit(False))).drop("_cut") \
        .orderBy(F.desc(ts), F.desc(id_col)).limit(n)


def write_jdbc(df: DataFrame, url: str, table: str = "web_logs", batch_size: int = 500,
               properties: dict | None = None) -> None:
    df.write.mode("append").option("batchsize", batch_size).jdbc(url, table, properties=properties or {})


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, no index column; timestamps with microseconds."""
    (df.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", TS_WRITE_FORMAT).option("timestampFormat", TS_WRITE_FORMAT)
     .csv(path))


def canonical(df: DataFrame) -> DataFrame:
    return df.select(*WEBLOG_COLUMNS)
