"""Optimal buckets by brute force; batches keep the budget."""

import itertools
import random

import numpy as np

from weblog_engine.llm import packing


def least_padding(lengths, buckets):
    """The least total padding of documents of these lengths, by trying all ends."""
    ends = sorted(set(lengths))
    return min(sum(next(e for e in (*some, ends[-1]) if e >= x) - x for x in lengths)
               for r in range(min(buckets, len(ends))) for some in itertools.combinations(ends[:-1], r))


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(200):
        lengths = sorted(rng.sample(range(rng.choice((12, 100))), rng.randrange(1, 10)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        every = [x for x, c in zip(lengths, counts) for _ in range(c)]
        k = rng.randrange(1, 6)
        ends = packing.best_buckets(lengths, counts, k)
        assert len(ends) <= k and ends == sorted(ends) and set(ends) <= set(lengths)
        assert sum(next(e for e in ends if e >= x) - x for x in every) == least_padding(every, k)


def test_many_lengths():
    rng = random.Random(3)
    lengths = list(range(0, 60_000, 3))
    ends = packing.best_buckets(lengths, [rng.randrange(1, 1000) for _ in lengths], 16)
    assert len(ends) == 16 and ends[-1] == lengths[-1]


def test_padding_of_whole_tables_is_least(spark):
    rng = random.Random(5)
    for lengths, k in (([65] * 200, 16), ([rng.choice((1, 2, 70, 71, 400, 5000, 5001)) for _ in range(300)], 3)):
        df = spark.createDataFrame([(i, "w " * n, 1, 2, "p", "r") for i, n in enumerate(lengths)],
                                   "doc_id long, text string, _part int, `index` int, part string, row string")
        got = packing.pack(df, buckets=k, parts=4)
        assert got.agg({"padding": "sum"}).first()[0] == least_padding(lengths, k)
        assert {(r._part, r["index"], r.part, r.row) for r in got.collect()} == {(1, 2, "p", "r")}


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(int(rng.paretovariate(.7))))[:200_000], "s") for i in range(500)]
    rows += [(7, rows[7][1], "s"), (7, rows[7][1], "s"), (None, None, None), (501, "", "s"), (502, "  \n", "s"), (503, "x " * 30_000, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packing.pack(df, budget=2000, buckets=6, parts=8).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        n = len((r.text or "").split())
        assert r.n_tokens == n <= r.bucket_len and r.padding == r.bucket_len - n
        batches.setdefault((r.bucket, r.batch_id), []).append(r)
    assert len({r.bucket for r in got}) <= 6
    for b in batches.values():
        assert len(b) == 1 or len(b) * b[0].bucket_len <= 2000
        assert sorted(r.batch_pos for r in b) == list(range(len(b)))
    for k in {r.bucket for r in got}:  # all batches but a bucket's last are full
        sizes = [len(batches[x]) for x in sorted(batches) if x[0] == k]
        assert len(set(sizes[:-1])) <= 1 and sorted(x[1] for x in batches if x[0] == k) == list(range(len(sizes)))
    assert packing.pack(df.limit(0)).count() == 0
    assert np.isfinite(len(got))
