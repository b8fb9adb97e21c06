"""The grammar's patterns, and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from weblog_engine.llm import toxicity as tox
from weblog_engine.llm.common import documents


def test_patterns():
    g = tox.Grammar({"idiot": 4.0, "lowe*": 5.0})
    of = lambda text: tox.match_clause(g.classify(tox._WORD.findall(text.lower()))[0])
    assert of("what an idiot") == "insult"
    assert of("you are an idiot") == "aimed_insult"
    assert of("the idiot, the loweschaft") == "repeated_insult"
    assert of("i will kill") == "threat"
    assert of("I will kill you") == "aimed_threat"
    assert of("he is not an idiot") == "negated"
    assert of("he said idiot") == "reported"
    assert of("not that it matters much but an idiot") == "insult"
    assert of("a lowe thing") is None and of("nothing here") is None and of("") is None
    assert g.features("Nice day. You idiot! Not an idiot.")[[1, 5]].all()
    assert not g.features(None).any() and not g.features("x" * 100_000).any()


def test_clauses_of_any_length():
    g = tox.Grammar({"idiot": 4.0})
    for filler in ("", "and so on " * 1_000, "word " * 40_000):
        for text, pattern in ((f"he said {filler}you are an idiot", "reported"), (f"hm. you {filler}idiot", "aimed_insult"),
                              (f"he said. {filler}you idiot; well", "aimed_insult"), (f"idiot. {filler}he said", "insult")):
            assert np.flatnonzero(g.features(text)).tolist() == [tox.PATTERNS.index(pattern)], text[:30]


def test_probe_finds_whole_words():
    g = tox.Grammar({"idiot": 4.0, "idio*": 3.0, "scum": 2.0})
    assert [m.start() for m in g.probe.finditer("scum scummy idiotic idio ascum")] == [0, 12]


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    got = tox.predictions(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert len(got) > 30 and right > 0.9
    clean = [r for r in got if not r.toxic]
    assert sum(r.predicted for r in clean) / len(clean) < 0.05


def test_odd_rows(spark):
    rows = [(i, f"you stupid {i} thing" if i % 3 == 0 else f"a fine {i} thing") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(60)] + [(0, 1, 1), (None, 1, 1), (70, None, 1)],
                                   "doc_id long, toxic int, text int")
    odd = rows + [(100, None), (101, ""), (None, "you stupid thing"), (102, "fine " * 50_000), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, 5) for r in odd], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in tox.predictions(df, labels).collect()}
    assert got[None].predicted == 1 and not any(got[i].predicted for i in (100, 101, 102))
    assert all(got[i].predicted == (i % 3 == 0) for i in range(60))
    assert tox.predictions(df, labels).count() == len(odd)
    none = tox.predictions(df, labels.where(F.lit(False)))
    assert none.agg(F.max("score"), F.count("*")).first() == (0.0, len(odd))
    assert tox.predictions(df.limit(0), labels).count() == 0
