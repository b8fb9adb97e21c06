"""Structured Streaming lifecycle on a file source (FIXTURES F-8)."""

import json
import os
import tempfile

from weblog_engine.streaming import jobs


def msg(t, m, rt, st):
    return json.dumps({"timestamp": f"2025-01-15T{t}", "method": m, "path": "/a",
                       "statusCode": st, "responseTimeMs": rt})


def test_window_stream_late_rows_and_emit_on_close(spark):
    root = tempfile.mkdtemp(prefix="stream-")
    src, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    batches = [[msg("00:01:00", "GET", 10, 200), msg("00:04:59", "GET", 20, 500)],
               [msg("00:05:00", "POST", 30, 200)],
               [msg("00:02:00", "GET", 99, 200)],
               [msg("00:12:00", "GET", 5, 200), "garbage"]]
    events, _ = jobs.event_stream(jobs.file_source(spark, src, 1), observe="decoded")
    q = jobs.start_window_job(events, out, ck)
    seen = []
    try:
        for i, b in enumerate(batches):
            with open(os.path.join(src, f"{i:03d}.json"), "w") as fh:
                fh.write("\n".join(b) + "\n")
            q.processAllAvailable()
            rows = spark.read.parquet(out).collect() if os.path.exists(os.path.join(out, "_spark_metadata")) else []
            seen.append(sorted((r["method"], r["window_start"].strftime("%H:%M"), r["count"],
                                r["avg_response_time_ms"], r["error_count"]) for r in rows))
        told = jobs.accounted(q, "decoded").collect()
    finally:
        q.stop()
    # every message is counted: six came, one was no JSON, one came too late
    assert [sum(r[c] for r in told) for c in ("messages", "undecodable", "late_groups")] == [6, 1, 1]
    assert seen[0] == []
    assert seen[1] == [("GET", "00:00", 2, 15.0, 1)]
    assert seen[2] == seen[1]
    assert seen[3] == [("GET", "00:00", 2, 15.0, 1), ("POST", "00:05", 1, 30.0, 0)]


def test_persist_stream_restart_no_duplicates(spark):
    root = tempfile.mkdtemp(prefix="persist-")
    src, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write(msg("00:01:00", "GET", 10, 200) + "\n")
    for _ in range(2):  # second run restarts from the checkpoint
        events, _ = jobs.event_stream(jobs.file_source(spark, src))
        q = jobs.persist_stream(events, out, ck)
        q.processAllAvailable()
        q.stop()
    assert spark.read.parquet(out).count() == 1


def test_live_alerts_follow_the_registry(spark, tmp_path):
    """The version that scores changes while the stream runs."""
    import datetime as dt

    from weblog_engine.operators import anomaly, train
    source, out, meta = (str(tmp_path / x) for x in ("in", "out", "meta"))
    os.makedirs(source)

    def publish(version, mean, day):
        det = anomaly.Detector(["response_time_ms"], [mean], [10.0], 5, baseline_mean=mean, baseline_std=10.0)
        path = anomaly.save_detector(spark, det, str(tmp_path / version))
        train.detector_row(spark, det, version, path, dt.datetime(2025, 1, day)).write.mode("append").parquet(meta)

    events, _ = jobs.event_stream(jobs.file_source(spark, source, 1))
    q = jobs.start_live_alert_job(events, meta, out, str(tmp_path / "ck"))
    try:
        for k, step in enumerate((None, ("v1", 100.0, 1), ("v2", 500.0, 2))):
            if step:
                publish(*step)
            with open(os.path.join(source, f"{k}.json"), "w") as fh:
                fh.write("\n".join(msg(f"00:0{k}:0{i}", "GET", rt, 200) for i, rt in enumerate((100, 500, 5000))) + "\n")
            q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(out).selectExpr("_batch", "model_version", "get_json_object(log_data, '$.response_time_ms') AS rt").collect()
    assert sorted((r._batch, r.model_version, float(r.rt)) for r in got) == [
        (0, None, 5000.0), (1, "v1", 500.0), (1, "v1", 5000.0), (2, "v2", 100.0), (2, "v2", 5000.0)]
