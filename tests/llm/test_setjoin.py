"""The set join equals brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from weblog_engine.llm import setjoin


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    found = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(found[i] & found[j])
            if found[i] and 100 * both >= 75 * len(found[i] | found[j]):
                up[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    name = {}
    for i, (k, _) in enumerate(rows):
        name[root(i)] = min(name.get(root(i), k), k)
    return {k: (len(found[i]), name[root(i)], links[i]) for i, (k, _) in enumerate(rows)}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    line = [rng.choice(vocab) for _ in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(3, 80))] for _ in range(15)]
    out = []
    for _ in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(words))
            words[i:i + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            words = words or ["x"]
        if rng.random() < .3:
            words += line
        out.append(" ".join(words).upper() if rng.random() < .2 else "\t".join(words))
    return out + ["", None, "  \n", "one two", "One TWO ", line[0]]


@pytest.mark.parametrize("seed,block", [(1, setjoin.BLOCK_BYTES), (2, 3000)])
def test_equals_brute_force(spark, seed, block):
    rows = [(1000 - i * 3, t) for i, t in enumerate(corpus(seed))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.links) for r in setjoin.join(df, block_bytes=block).collect()}
    want = brute(rows)
    assert got == want
    assert sum(v[1] != k for k, v in want.items()) > 20


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, long), (5, long + " end"), (None, None)]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n long, component string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.links) for r in setjoin.join(df).collect())
    assert got == sorted([("None", 2, "3", 2), ("3", 2, "3", 2), ("3", 2, "3", 2), ("4", 49996, "4", 1),
                          ("5", 49997, "4", 1), ("None", 0, "None", 0)])
    assert setjoin.join(df.limit(0)).count() == 0


def test_answer_equals_pairs():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    found = []
    for _ in range(12):
        s = rng.choice(pool, 60, replace=False)
        for _ in range(8):
            found.append(np.unique(np.concatenate([s[rng.random(60) > .1], rng.choice(pool, 4)])))
    side = rng.integers(0, 2, len(found))
    for sides in (None, side):
        x, y = setjoin.answer(found, sides, 75)
        want = set()
        for j in range(len(found)):
            for i in range(j):
                both = len(np.intersect1d(found[i], found[j]))
                if 100 * both >= 75 * (len(found[i]) + len(found[j]) - both) and (sides is None or side[i] != side[j]):
                    want.add((i, j))
        assert set(zip(x.tolist(), y.tolist())) == want and len(x) == len(want) > 5


def test_null_ids_with_equal_32_bit_hashes(spark):
    from corpus_pipeline import near_duplicates

    pair = spark.sql("SELECT min(id) a, max(id) b FROM (SELECT id, hash(concat('one two three four five six ', id)) h "
                     "FROM range(300000)) GROUP BY h HAVING count(*) = 2 ORDER BY a LIMIT 1").collect()[0]
    text = lambda i: f"one two three four five six {i}"
    # the second text of the pair has a copy under an id, the first has none
    rows = [(None, text(pair.a)), (None, text(pair.b)), (1, text(pair.b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.selectExpr("count(DISTINCT hash(text)) n").collect()[0].n == 1
    links = sorted((r.doc_id or 0, r.links) for r in setjoin.join(df, percent=100).collect())
    assert links == [(0, 0), (0, 1), (1, 1)]
    got = {(r.doc_id, r.text) for r in near_duplicates(spark, df, "").collect()}
    assert got == {(None, text(pair.a)), (1, text(pair.b))}
