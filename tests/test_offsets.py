"""The offset-exact table under replays, crashes and compaction; readable state."""

import json
import os

from pyspark.sql import functions as F

from weblog_engine.streaming import jobs, offsets

SCHEMA = "topic string, partition int, offset long, value string"


def rows(parts, first, last):
    return [("t", p, o, f"{p}-{o}") for p in range(parts) for o in range(first, last)]


def stored(spark, target):
    return sorted((r.topic, r.partition, r.offset, r.value) for r in offsets.read_table(spark, target, SCHEMA).collect())


def test_replays_add_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    assert stored(spark, target) == []
    offsets.append(frame(rows(2, 0, 5) * 2), target)  # a row twice in one batch
    offsets.append(frame(rows(3, 3, 8)), target)  # overlaps, and a new partition
    want = sorted(rows(2, 0, 8) + [r for r in rows(3, 3, 8) if r[1] == 2])
    assert stored(spark, target) == want
    offsets.append(frame(rows(3, 0, 8)), target)  # the whole topic again
    assert stored(spark, target) == want
    # a run that died before its commit
    frame(rows(3, 8, 9)).write.parquet(os.path.join(target, "data", "dead"))
    assert stored(spark, target) == want
    offsets.append(frame(rows(3, 8, 9)), target)
    want = sorted(want + rows(3, 8, 9))
    assert stored(spark, target) == want
    offsets.compact(spark, target, SCHEMA)
    assert stored(spark, target) == want and len(offsets.live_folders(spark, target)) == 1
    assert set(os.listdir(os.path.join(target, "data"))) == {*offsets.live_folders(spark, target), "dead"}
    offsets.append(frame(rows(3, 0, 9)), target)
    assert stored(spark, target) == want
    assert {(r.partition, r["last"]) for r in offsets.high_water_marks(spark, target).collect()} == {(0, 8), (1, 8), (2, 8)}


def test_stream_under_a_new_checkpoint(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    for k in range(4):
        spark.createDataFrame(rows(2, 5 * k, 5 * k + 5), SCHEMA).coalesce(1).write.mode("append").json(source)
    for name in ("c1", "c1", "c2"):  # a start, a restart, a new consumer
        q = offsets.persist_messages(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(source), target,
                                     str(tmp_path / name), compact_at=3)
        q.processAllAvailable()
        q.stop()
        assert stored(spark, target) == rows(2, 0, 20)
    assert len(offsets.live_folders(spark, target)) < 3


def test_open_windows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    msg = lambda t, m, rt, st: json.dumps({"timestamp": f"2025-01-15T{t}", "method": m, "path": "/a", "statusCode": st,
                                           "responseTimeMs": rt})
    (source / "a.json").write_text("\n".join([msg("00:01:00", "GET", 10, 200), msg("00:07:00", "GET", 20, 500),
                                              msg("00:08:00", "GET", 25, 500), msg("00:06:00", "POST", 7.5, 200)]) + "\n")
    events, _ = jobs.event_stream(jobs.file_source(spark, str(source)))
    q = jobs.start_window_job(events, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = jobs.open_windows(spark, str(tmp_path / "ck")).select(
        "method", F.date_format("window_start", "HH:mm").alias("s"), "count", "avg_response_time_ms", "error_count").collect()
    assert sorted(map(tuple, got)) == [("GET", "00:05", 2, 22.5, 2), ("POST", "00:05", 1, 7.5, 0)]
