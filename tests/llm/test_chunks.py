"""Fingerprints, edits and neighbours against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from weblog_engine.llm import chunks


def test_gear_hash_is_a_window_sum():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    h = chunks.gear(data)
    for i in (0, 5, 31, 32, 499):
        want = sum(int(chunks._GEAR[data[i - j]]) << j for j in range(min(i + 1, 32))) % (1 << 32)
        assert int(h[i]) == want


def test_cuts_follow_the_rule():
    rng = np.random.default_rng(2)
    for n in (0, 1, 15, 300, 5000):
        data = rng.integers(97, 123, n).astype(np.uint8) if n != 300 else np.full(n, 97, np.uint8)
        h, want, start = chunks.gear(data), [], 0
        for p in range(1, n + 1):
            top, size = int(h[p - 1]), p - start
            strict, loose = top >> 32 - chunks.STRICT_BITS == 0, top >> 32 - chunks.LOOSE_BITS == 0
            if size == chunks.MAX or (size >= chunks.MIN and strict) or (size >= chunks.NORMAL and loose):
                want.append(p)
                start = p
        assert chunks.cut(data) == want + ([n] if start < n else [])


def test_shift_resistance():
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000))
    a, b = chunks.fingerprint(text), chunks.fingerprint("inserted " + text[:5000] + "X" + text[5000:])
    assert chunks.likeness(a, b) > 0.95 and chunks.likeness(a, a) == 1
    assert chunks.likeness(chunks.fingerprint(""), chunks.fingerprint("")) == 1 and chunks.likeness(a, chunks.fingerprint("")) == 0


@pytest.mark.parametrize("n", [1, 2, 200])
def test_report(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 % 1009, rng.choice(["", None, "ab é😀 " * rng.randrange(300), "x" * rng.randrange(9)])) for i in range(n)]
    if n == 200:
        rows[5] = (rows[5][0], "long " * 30_000)
        rows += [(rows[3][0], "second"), (None, "last")]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, k string, range_no int")
    got = {(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
           for r in chunks.edit_report(df).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = set()
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        e = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        a, b, c = map(chunks.fingerprint, (t, e, nxt))
        want.add((i, len(t), hashlib.sha256(e.encode()).hexdigest(), chunks.as_text(a), chunks.as_text(b),
                  chunks.likeness(a, b), chunks.likeness(a, c)))
    assert got == want
    assert chunks.edit_report(df.limit(0)).count() == 0
