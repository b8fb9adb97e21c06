"""Records cut from split files equal those of a whole-file reader."""

import csv
import random

import pytest

from weblog_engine.sources.records import read_records


def write(path, seed, end):
    rng = random.Random(seed)
    pieces = ['"', '""', "\n", "\r\n", ",", "a", "é", " ", "word", '"\n"', "\n\n"]
    rows = [["".join(rng.choices(pieces, k=rng.randrange(0, 9))) for _ in range(3)] for _ in range(120)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)
    return rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_whole_reader(spark, tmp_path, end):
    want = [write(str(tmp_path / f"{k}.csv"), k, end) for k in range(3)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_records(spark, str(tmp_path))
        rows = sorted(got.collect(), key=lambda r: (r.file, r.block, r.line))
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert tasks > 20
    for k, rows_of in enumerate(want):
        mine = [r.record for r in rows if r.file.endswith(f"{k}.csv")]
        assert [next(csv.reader([x], strict=True)) if "\n" not in x and "\r" not in x else next(csv.reader(x.splitlines(keepends=True)))
                for x in mine] == rows_of


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x\n\n"open\nto the\nend')
    (tmp_path / "b.csv").write_text("")
    got = sorted(read_records(spark, str(tmp_path)).collect(), key=lambda r: r.line)
    assert [r.record for r in got] == ["x", "", '"open\nto the\nend']
