"""The encoder equals the tokenizers library."""

import hashlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from weblog_engine.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REF = Tokenizer.from_file(PATH)
REF.no_padding()
REF.no_truncation()
OWN = bpe.Bpe(open(PATH, encoding="utf-8").read())


def check(text):
    want = REF.encode(text, add_special_tokens=False).ids
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want, repr(text[:80])
    assert OWN.decode(got) == REF.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "Hello, World's BEST 42nd don't'll", "a\x1cb\x1f c\u0085d e", "<|endoftext|> x<|startoftext|>Y",
    "ΣΑΣ İstanbul ẞ ﬁ", "é Å", "x" * 5000, "ab" * 700 + "é" * 300, "<|", "<|endoftext|", "1234567",
    "你好 \U0001f600\U0001f600!!", "١٢ ½", "##" * 400])
def test_fixed(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any(text):
    check(text)


def test_heap_equals_scan(monkeypatch):
    words = ["".join(chr(97 + (i * k + j) % 26) for j in range(50)) for i in range(1, 20) for k in (3, 7)]
    a = [OWN._chunk(w) for w in words]
    monkeypatch.setattr(bpe, "SCAN_MAX", 1)
    assert [OWN._chunk(w) for w in words] == a


def test_query(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (3, ""), (4, "word " * 40000), (None, "x")]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, ids string, decoded string")
    out = bpe.digests(df, PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        ids = REF.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(REF.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    arr = bpe.encode(df, PATH).select("doc_id", bpe.ids_array().alias("a")).where("doc_id = 1").collect()[0].a
    assert arr == REF.encode("Hello there", add_special_tokens=False).ids
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_two_vocabularies_in_one_session(spark, tmp_path):
    import json
    doc = json.load(open(PATH, encoding="utf-8"))
    doc["model"]["merges"] = doc["model"]["merges"][:300]
    other = str(tmp_path / "other.json")
    json.dump(doc, open(other, "w", encoding="utf-8"))
    df = spark.createDataFrame([(i, f"some words {i} thereafter") for i in range(20)], "doc_id long, text string").coalesce(1)
    want = {p: {i: Tokenizer.from_file(p).encode(t, add_special_tokens=False).ids for i, t in df.collect()} for p in (PATH, other)}
    assert want[PATH] != want[other]
    for path in (PATH, other) * 4:
        got = {r.doc_id: r.ids for r in bpe.encode(df, path).select("doc_id", bpe.ids_array().alias("ids")).collect()}
        assert got == want[path]
