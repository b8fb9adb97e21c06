"""Code lengths equal a plain context-tree coder; held-out accuracy."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from weblog_engine.llm import ppm
from weblog_engine.llm.common import documents


def plain_bits(train, text):
    tree = defaultdict(Counter)
    for t in train:
        for i, c in enumerate(t):
            for k in range(min(i, ppm.ORDER) + 1):
                tree[t[i - k:i]][c] += 1
    bits = 0.0
    for i, c in enumerate(text):
        for k in range(min(i, ppm.ORDER), -2, -1):
            if k < 0:
                bits += 8
                break
            seen = tree.get(text[i - k:i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if c in seen:
                bits -= math.log2(seen[c] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths(spark):
    rng = random.Random(1)
    train = {"aa": ["banana bandana", "ana"], "bb": ["zyzzyva zoo", "é über"], "cc": ["x"]}
    rows = [(i, t, g, True) for i, (g, t) in enumerate((g, t) for g, ts in train.items() for t in ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, readable boolean")
    model = ppm.train(df)
    assert model.langs == ["aa", "bb", "cc"]
    texts = ["banana", "", "zoo é", "q", "".join(rng.choices("banzé ", k=300))]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    bits = model.code_lengths(data, offsets)
    for i, t in enumerate(raw):
        for k, lang in enumerate(model.langs):
            assert abs(bits[i, k] - plain_bits([x.encode() for x in train[lang]], t)) < 1e-2
    old = ppm._SLICE
    try:
        ppm._SLICE = 70
        assert np.allclose(model.code_lengths(data, offsets), bits, atol=1e-3)
    finally:
        ppm._SLICE = old


def test_predictions(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = ppm.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(i, f"some words here {i}" if i % 2 else f"mots ici là {i}", "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, "123 !?", "fr"), (None, "some words", None), (1, "some words here 1", "en"),
             (103, "some words " * 40_000, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in ppm.predictions(df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[103].lang_pred == "en" and got[None].lang_pred == "en"
    assert ppm.predictions(df).count() == len(rows)
    assert ppm.predictions(df.limit(0)).count() == 0
    assert {r.lang_pred for r in ppm.predictions(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_counts_do_not_follow_the_partitions(spark, sf_dir):
    rows = ppm.sample(documents(spark, sf_dir), "lang", 30, "doc_id", "text")
    seen = {}
    for parts in (1, 211):
        dealt = rows.repartition(parts)
        counted = ppm.count_grams(dealt)
        seen[parts] = {(r.g, r["size"], r.gram): r.n for r in counted.collect()}
        # rows that leave the counting tasks, before they are added up
        tasks = dealt.coalesce(ppm.COUNTERS).rdd.getNumPartitions()
        assert tasks <= ppm.COUNTERS
    assert seen[1] == seen[211]


def test_counts_are_merged(monkeypatch):
    monkeypatch.setattr(ppm, "_SLICE", 10)
    rng, c, want = random.Random(2), ppm.Counts(), Counter()
    for _ in range(50):
        codes = [rng.randrange(30) for _ in range(rng.randrange(9))]
        want.update(codes)
        c.add(("g", 1), np.array(codes, np.uint32))
    (_, (codes, n)), = c.items()
    assert dict(zip(codes.tolist(), n.tolist())) == dict(want)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ppm, "MOST_LANGUAGES", 2)
    rows = [(i, f"words number {i}", lang) for i, lang in enumerate(["a", "b", "b", "c", "c", "d"] * 4)]
    assert ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs == ["b", "c"]
