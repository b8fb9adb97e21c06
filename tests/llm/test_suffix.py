"""Removal of repeated passages equals a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weblog_engine.llm import suffix


def brute(texts, w):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + w] for r in raws for i in range(len(r) - w + 1))
    out = []
    for r in raws:
        cover = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - w + 1):
            if seen[r[i:i + w]] > 1:
                cover[i:i + w] = True
        c = cover[:len(r)]
        n = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~c])
        out.append((len(r), int(c.sum()), n, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "η", "theta", "iota", "k"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base = [text(rng.randrange(5, 120)) for _ in range(12)]
    out = list(base)
    line = text(6)
    for _ in range(30):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            a = rng.choice(base).split(" ")
            i = rng.randrange(len(a))
            parts += [text(rng.randrange(3, 15)), *a[i:i + rng.randrange(5, 40)]]
        out.append(" ".join(parts + ([line] if rng.random() < .5 else [])))
    out += [base[0], base[0], None, "", "a" * 400, "ab" * 150, "x", line * 4]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,group", [(1, suffix.GROUP), (2, suffix.GROUP), (3, 2)])
def test_equals_brute_force(spark, seed, group):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix.report(df, window=60, k=24, group=group).orderBy("doc_id").collect()
    want = brute(texts, 60)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    assert sum(x[2] > 1 for x in want) > 3


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, long, 1), (7, long[5000:9000], 2), (7, "other " * 3, 3), (8, None, 4), (7, "other " * 3, 5)]
    df = spark.createDataFrame([(a, b, str(c), "s") for a, b, c in rows], "doc_id long, text string, doc string, spans string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.report(df).collect())
    assert got == Counter([(None, len(long), 4000, 1), (7, 4000, 4000, 1), (7, 18, 0, 0), (7, 18, 0, 0), (8, 0, 0, 0)])
    assert suffix.report(df.limit(0)).count() == 0
    kept = suffix.dedup(df, keep=("doc", "spans")).collect()
    assert sorted((r.row.doc, r.row.spans) for r in kept) == [(str(i), "s") for i in range(1, 6)]


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(5)
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    at = rng.permutation(2900)
    group = np.sort(rng.integers(0, 7, len(at)))
    s = suffix.Suffixes(buf, 40)
    order = s.sort(at, group)
    for g in range(7):
        mine = order[group == g]
        assert sorted(mine) == np.flatnonzero(group == g).tolist()
        keys = [bytes(buf[a:a + 40]) for a in at[mine]]
        assert keys == sorted(keys)


def test_null_ids_with_equal_32_bit_hashes(spark):
    # two texts of one F.hash, the second with a passage that occurs elsewhere
    passage, other = "p" * 30 + "q" * 30, "r" * 30 + "s" * 30
    pair = spark.sql("SELECT min(id) a, max(id) b, max(id % 2) x, min(id % 2) y FROM (SELECT id, hash(concat(id, if(id % 2 = 1, "
                     f"'{passage}', '{other}'))) h FROM range(300000)) GROUP BY h HAVING count(*) = 2 AND max(id % 2) > min(id % 2) "
                     "ORDER BY a LIMIT 1").collect()[0]
    odd, even = (pair.a, pair.b) if pair.a % 2 else (pair.b, pair.a)
    texts = [(None, f"{odd}{passage}"), (None, f"{even}{other}"), (1, f"zz {passage}")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert df.where("doc_id IS NULL").selectExpr("count(DISTINCT hash(text)) n").collect()[0].n == 1
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in suffix.report(df, window=40, k=16).collect())
    assert got == [(0, 0, 0), (0, 60, 1), (1, 60, 1)]
