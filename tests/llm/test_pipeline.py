"""The pipeline stage by stage against brute force on a small table."""

import random

import pytest

import corpus_pipeline
from test_pii import brute as personal
from test_setjoin import brute as groups
from test_suffix import brute as passages
from weblog_engine.llm import ppm

NAMES = ["row", "lang_pred", "_new", "_base", "_found", "_other", "_freed", "_part", "found", "tag", "marked"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)


def corpus():
    rng = random.Random(8)
    en = [a + b for a in ("th", "wh", "str", "sh") for b in ("ing", "ough", "ere", "ick", "and")]
    fr = [a + b for a in ("qu", "ch", "é", "vo") for b in ("eux", "oir", "ment", "elle", "age")]
    rows = []
    for i in range(60):
        words, lang = (en, "en") if i % 2 else (fr, "fr")
        rows.append([i, " ".join(rng.choice(words) for _ in range(rng.randrange(20, 150))), lang])
    for i in range(60, 90):
        copy = list(rng.choice(rows[:20]))
        parts = copy[1].split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        rows.append([i, " ".join(parts), copy[2]])
    shared = " ".join(rng.choice(en) for _ in range(60))
    for i in range(30, 36):
        rows[i][1] += " " + shared + " tail" + str(i)
    rows[40][1] += " call +49 30 1234567 or a.b@c.de from 10.1.2.3"
    rows += [[200, None, "en"], [201, "", "en"], [202, "123 456", "fr"], [203, " ".join(f"x{i}y" for i in range(40_000)), "en"],
             [None, rows[3][1] + " more", None], [3, rows[3][1], "en"]]
    return [(i, t, lang, "s", len(t or ""), *["x"] * len(NAMES)) for i, t, lang in rows]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.saved(f(spark, out[-1], ""), "stage"))
    return [sorted((r.asDict() for r in x.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")) for x in out]


def test_columns_pass(stages):
    for rows in stages[1:-1]:
        assert set(rows[0]) == {c.split(" ")[0] for c in COLUMNS.split(", ")}
        assert all(r["n_chars"] == len(r["text"] or "") and all(r[c] == "x" for c in NAMES) for r in rows)


def test_language(stages):
    kept = {(r["doc_id"], r["text"]) for r in stages[1]}
    assert {(r["doc_id"], r["text"]) for r in stages[0]} - kept == {(200, None), (201, ""), (202, "123 456")}
    assert all(r["lang"] for r in stages[1]) and len(stages[1]) == len(stages[0]) - 3


def test_near_duplicates(stages):
    rows = [(i, r["text"]) for i, r in enumerate(stages[1])]
    name = groups(rows)
    want = [stages[1][i] for i, (_, first, _) in name.items() if i == first]
    assert stages[2] == want and len(want) < len(rows) - 20


def test_passages(stages):
    want = passages([r["text"] for r in stages[2]], 200)
    assert [len(r["text"].encode()) for r in stages[3]] == [n - gone for n, gone, _, _ in want]
    assert sum(gone > 200 for _, gone, _, _ in want) >= 6


def test_personal_data(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3]}
    for r in stages[4]:
        assert not personal(r["text"])
        if not personal(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert any("[PHONE]" in r["text"] and "[EMAIL]" in r["text"] and "[IP]" in r["text"] for r in stages[4])


def test_packing(stages):
    assert len(stages[5]) == len(stages[4])
    for r in stages[5]:
        assert r["n_tokens"] == len(r["text"].split()) <= r["bucket_len"]


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(f(spark, docs, ""), "empty")
        assert docs.count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= 200 and ppm.UNDETERMINED not in {r.lang for r in out.select("lang").distinct().collect()}
