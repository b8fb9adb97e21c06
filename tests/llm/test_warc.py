"""Archives read back as written; bytes do not depend on the partitioning."""

import gzip
import hashlib
import os
import random

import pytest

from weblog_engine.llm import warc

SCHEMA = "page_id long, url string, html string, key string, shard int, is_page string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", 5, "x") for r in rows], SCHEMA).repartition(parts)


def brute(rows):
    least = {}
    for i, _, h in rows:
        h = h or ""
        least[h] = min(least.get(h, (2, 0)), (i is None, i or 0))
    seen, out = set(), []
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (h or "").encode()
        first = least[h or ""] == (i is None, i or 0) and (h or "") not in seen
        seen |= {h or ""} if first else set()
        to = None if first or least[h or ""][0] else least[h or ""][1]
        out.append((i, len(raw), warc.digest_text(hashlib.sha1(raw).digest()), "response" if first else "revisit", to))
    return sorted(map(str, out))


def shown(got):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def pages():
    rng = random.Random(3)
    rows = [(i, f"http://a.example/{i}?q=ü {i}", "".join(rng.choices("<p>éab \r\n\r\n", k=rng.randrange(300)))) for i in range(120)]
    rows += [(200 + i, f"http://b.example/{i}", "same text") for i in range(60)]  # a third has one payload
    rows += [(500, None, None), (501, "", ""), (None, "x\r\ny", "same text"), (None, None, "own"), (None, None, "own"),
             (7, "http://again", rows[7][2]), (rows[9]), (502, "long", "é" * 300_000), (-3, "http://c", "same text")]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages()
    path = str(tmp_path / "a")
    files = warc.write(frame(spark, rows), path, shard_bytes=20_000, file_bytes=4_000).collect()
    assert len(files) > 8 and any(f.name.endswith("-0001.warc.gz") for f in files)
    assert sorted(os.listdir(path)) == sorted([*(f.name for f in files), "manifest"])
    got = warc.read(spark, path, payloads=True).collect()
    assert shown(got) == brute(rows)
    text = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(warc.digest_text(hashlib.sha1(v).digest()) == k for k, v in text.items())
    # each record can be read at its offset, and files hold falling shares of the order
    for r in got[:20]:
        with open(os.path.join(path, r.archive), "rb") as f:
            f.seek(r.record_offset)
            assert parse_id(next(warc.members(f))[1]) == r.page_id
    order = [parse_id(m) for f in sorted(files, key=lambda f: f.name)
             for m in split(gzip.open(os.path.join(path, f.name)).read()) if b"WARC-Type: warcinfo" not in m]
    assert [(x is not None, x or 0) for x in order] == sorted((x is not None, x or 0) for x in order)


def parse_id(record):
    f, _ = warc.parse(record)
    return int(f["x-page-id"]) if "x-page-id" in f else None


def split(data):
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        size = int([x for x in data[at:head].split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b":")[1])
        yield data[at:head + 4 + size + 4]
        at = head + 4 + size + 4


def test_same_bytes_whatever_the_partitions(spark, tmp_path):
    table = str(tmp_path / "pages")
    frame(spark, pages(), 4).write.parquet(table)
    found = []
    for name, size, parts in (("a", "128m", 4), ("b", "2k", 9)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            files = warc.write(spark.read.parquet(table), str(tmp_path / name), shard_bytes=30_000, file_bytes=6_000)
            found.append({(f.name, f.bytes, f.records, f.sha1) for f in files.collect()})
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert found[0] == found[1] and len(found[0]) > 5


def test_small_payloads_are_not_revisited(spark):
    rows = [(i, "u", "short" if i < 5 else "somewhat longer") for i in range(10)]
    got = warc.round_trip(frame(spark, rows), revisit_bytes=10).collect()
    assert {r.page_id: r.record_type for r in got} == {i: "revisit" if i > 5 else "response" for i in range(10)}


def test_a_changed_archive_is_noticed(spark, tmp_path):
    path = str(tmp_path / "a")
    name = warc.write(frame(spark, pages()), path).first().name
    with open(os.path.join(path, name), "ab") as f:
        f.write(warc.gzip_member(warc.page_record(1, "u", b"x", "0" * 40, None)))
    with pytest.raises(Exception, match="size of"):
        warc.read(spark, path).count()


def test_empty_table(spark, tmp_path):
    assert warc.write(frame(spark, pages()).limit(0), str(tmp_path / "a")).count() == 0
    assert warc.read(spark, str(tmp_path / "a")).count() == 0
