"""CSV upload and JSON event parsing edge cases (FIXTURES F-1, F-8)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from weblog_engine.sources import ingest

T0 = dt.datetime(2025, 1, 15, 10, 30)


def write(text, name="up.csv"):
    d = tempfile.mkdtemp(prefix="ingest-")
    p = os.path.join(d, name)
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_resolve_header():
    m = ingest.resolve_header([" TimeStamp", "method", "Status Code", "response_time_ms", "x", "METHOD "])
    assert m == {"timestamp": 0, "method": 5, "status_code": 2, "response_time_ms": 3}
    with pytest.raises(ValueError):
        ingest.resolve_header(["timestamp", "method", "response_time_ms"])


def test_upload_name_and_empty(spark):
    with pytest.raises(ValueError):
        ingest.check_upload_name("/x/data.txt")
    ingest.check_upload_name("/x/DATA.CSV")
    with pytest.raises(ValueError):
        ingest.ingest_csv(spark, write(""))


def test_formats_and_rules(spark):
    p = write(
        "timestamp,method,path,status_code,response_time_ms,user_agent,ip_address,bytes_sent\n"
        "2025-01-15T10:30:00, get ,/a,200,12.5,ua,1.2.3.4,10\n"
        "2025-01-15T10:30,POST,/b,201,1,ua,ip,0\n"
        "2025-01-15 10:30:00,PUT,,404,2,ua,ip,5\n"
        "15/01/2025 10:30:00,DELETE,/c,500,3,ua\n"
        "junk,GET,/d,200,1,ua,ip,1\n"
        "2025-01-15,GET,/e,200,1,ua,ip,1\n"
        "2025-01-15T10:30:00,GET,/f,12.5,1,ua,ip,1\n"
        "2025-01-15T10:30:00,GET,/g,,1,ua,ip,1\n"
        "2025-01-15T10:30:00,GET,/h,200,1,ua,ip,\n"
        "2025-01-15T10:30:00,GET,/i,200,1,ua,ip,7,extra\n"
        "2025-01-15T10:30:00,GET\n"
        "30/02/2025 10:30:00,GET,/j,200,1,ua,ip,1\n")
    ing = ingest.ingest_csv(spark, p)
    good = {r["path"]: r for r in ing.good.collect()}
    assert set(good) == {"/a", "/b", "", "/c", "/i"}
    assert all(r["timestamp"] == T0 for r in good.values())
    assert good["/a"]["method"] == "GET" and good["/a"]["bytes_sent"] == 10
    assert good["/c"]["user_agent"] == "ua" and good["/c"]["ip_address"] is None
    assert good["/c"]["bytes_sent"] == 0
    assert good["/i"]["bytes_sent"] == 7
    bad = {r["reject_reason"] for r in ing.rejects.collect()}
    assert {"bad timestamp", "bad status_code", "bad bytes_sent", "missing path"} <= bad
    c = ing.counts.first()
    assert (c["processed"], c["failed"]) == (5, 7)


def test_absent_optional_columns(spark):
    p = write("Timestamp,Method,Status_Code,Response_Time_MS,bytes\n"
              "2025-01-15T10:30:00,GET,200,1.5,9\n"
              "2025-01-15T10:30:00,GET,200\n")
    ing = ingest.ingest_csv(spark, p)
    rows = ing.good.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["path"] == "/unknown" and r["bytes_sent"] == 0 and r["user_agent"] is None
    assert ing.counts.first()["failed"] == 1


def test_missing_required_header(spark):
    with pytest.raises(ValueError):
        ingest.ingest_csv(spark, write("timestamp,method,path\n2025-01-15T10:30:00,GET,/a\n"))


def test_land_csv(spark, tmp_path):
    p = write("timestamp,method,status_code,response_time_ms\n2025-01-15T10:30:00,GET,200,1\nx,GET,200,1\n")
    out = ingest.land_csv(spark, p, str(tmp_path / "landed"))
    assert out == {"processed": 1, "failed": 1}


def test_decode_events(spark):
    msgs = spark.createDataFrame([
        ('{"timestamp":"2025-01-15T10:30:00","method":"get","path":"/a","statusCode":500,"responseTimeMs":12.5}',),
        ('{"timestamp":"2025-01-15T10:30:00","method":"GET","statusCode":"404"}',),
        ('{"timestamp":"2025-01-15T10:30:00","method":"GET"}',),
        ("garbage",)], "value string")
    rows, bad = ingest.decode_events(msgs)
    got = sorted((r["status_code"], r["response_time_ms"], r["method"]) for r in rows.collect())
    assert got == [(200, 0.0, "GET"), (404, 0.0, "GET"), (500, 12.5, "GET")]
    assert bad.count() == 1


def test_encode_events_key(spark):
    df = spark.createDataFrame([(1, T0, "GET", "/a", 200, 1.0, None, None, 0)],
                               "id long, timestamp timestamp_ntz, method string, path string, status_code int, "
                               "response_time_ms double, user_agent string, ip_address string, bytes_sent int")
    r = ingest.encode_events(df).first()
    assert r["key"] == "GET" and '"statusCode":200' in r["value"] and '"responseTimeMs":1.0' in r["value"]


def test_load_first_nonempty(spark):
    def broken():
        raise RuntimeError("database down")

    empty = spark.createDataFrame([], "x int")
    full = spark.createDataFrame([(1,)], "x int")
    got = ingest.load_first_nonempty([broken, lambda: empty, lambda: full])
    assert got.count() == 1
    assert ingest.load_first_nonempty([broken]) is None


def test_read_logs_table(spark, sf_dir, tmp_path):
    from weblog_engine.sources.tables import read_logs, weblogs
    w = weblogs(spark, sf_dir)
    path = str(tmp_path / "web_logs")
    w.drop("user_agent").withColumn("bytes_sent", F.lit(None).cast("int")).write.parquet(path)
    r = read_logs(spark, path)
    assert r.columns == w.columns and r.count() == w.count()
    assert r.where("bytes_sent != 0 OR user_agent IS NOT NULL").count() == 0


def test_decimal_and_unusable_numbers(spark):
    msgs = spark.createDataFrame([
        ('{"timestamp":"2025-01-15T10:30:00.123456789","statusCode":500.0,"responseTimeMs":1}',),
        ('{"timestamp":"2025-01-15T10:30:00.5","statusCode":"abc","bytesSent":7.9}',),
        ('{"timestamp":"2025-01-15T10:30:00","statusCode":1e12}',)], "value string")
    rows = sorted(ingest.decode_events(msgs)[0].collect(), key=lambda r: r["timestamp"])
    assert [r["status_code"] for r in rows] == [200, 500, 200]
    assert [r["timestamp"].microsecond for r in rows] == [0, 123456, 500000] and rows[2]["bytes_sent"] == 7


def test_quoted_newline_is_one_record(spark):
    p = write('timestamp,method,path,status_code,response_time_ms\n'
              '2025-01-15T10:30:00,GET,"/a\nb",200,1\n2025-01-15T10:30:00,GET,/c,200,NaN\n2025-01-15T10:30:00,GET,/d,200,2\n')
    ing = ingest.ingest_csv(spark, p)
    assert sorted(r["path"] for r in ing.good.collect()) == ["/a\nb", "/d"]
    assert [r["reject_reason"] for r in ing.rejects.collect()] == ["bad response_time_ms"]


def test_parts_with_different_headers(spark, tmp_path):
    folder = tmp_path / "up.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("timestamp,method,status_code,response_time_ms\n2025-01-15T10:30:00,GET,500,300\n")
    (folder / "part-1.csv").write_text("timestamp,method,response_time_ms,status_code\n2025-01-15T10:30:01,GET,7,404\n")
    rows = sorted((r["status_code"], r["response_time_ms"]) for r in ingest.ingest_csv(spark, str(folder)).good.collect())
    assert rows == [(404, 7.0), (500, 300.0)]


def test_ids_differ_between_uploads(spark):
    df = spark.range(5).select(F.lit(1).alias("x"))
    ids = [r.id for u in ("a", "b") for r in ingest.with_ingest_columns(df, upload=u).collect()]
    assert len(set(ids)) == 10


def test_means_cover_the_values_they_count(spark):
    from weblog_engine.functions.scalar import exact_mean
    df = spark.createDataFrame([(float("nan"),), (1.0,), (1e33,), (3.0,), (None,)], "x double")
    assert df.agg(exact_mean("x")).first()[0] == 2.0
