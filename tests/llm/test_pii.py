"""Base spans equal Python's matches; redaction cuts them."""

import hashlib
import re

import numpy as np

from weblog_engine.llm import pii


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            s = m[0]
            d = re.sub("[^0-9]", "", s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TEXTS = [
    None, "", "no data here", "mail a.b+c@ex-am.co.uk, x@y.z. @a.b q@w", "é😀 user@host.org ü 10.0.0.1 and 256.1.1.1 1.2.3.4.5",
    "000.255.0001.9 1.2.3.4444 99999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111",
    "41111111111111110000 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+49 (30) 123-45 67 +1 2 +1234567890123456 +12345678",
    "a@b.c_d@e.f.g%h@i.j", "1.2.3.4.5.6.7.8.9", "+1 (2)", "x" * 60000 + "@a.b", "7" * 50000, "a." * 40000, "1 2-" * 9000 + "+1" * 300,
    "tel 030 1234567, fax 030-7654321 DE89 3704 0044 0532 0130 00 4111111111111111\n4111111111111111",
]


def test_base_spans(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, 0, "b") for i, t in rows], "doc_id long, text string, fold int, base string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                  for r in pii.report(df).collect()))
    want = []
    for i, t in rows:
        b = brute(t)
        text = ",".join(f"{k}:{a}:{z}" for k, a, z in b)
        want.append((i is None, i or 0, *[sum(x[0] == k for x in b) for k in pii.KINDS], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.report(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, _base string")
    got = {r.doc_id: r.text for r in pii.redact(df.select("doc_id", "text")).collect()}
    assert got[0] is None and got[1] == "" and got[2] == TEXTS[2]
    assert got[3].startswith("mail [EMAIL], [EMAIL]. @a.b")
    assert "é😀 [EMAIL] ü [IP] and" in got[4]
    assert all(not brute(t) for i, t in got.items() if i not in (10, 8, 15))


def test_trees_learn():
    x = np.array([[a, b] for a in range(4) for b in range(4)])
    yes = np.where((x[:, 0] > 1) & (x[:, 1] <= 2), 90.0, 1.0)
    trees = pii.boost(x, yes, 91 - yes)
    score = sum(pii._value(t, x) for t in trees)
    assert (score[yes > 50] > 0).all() and (score[yes < 50] < 0).all()
    a, b = pii.calibrate(score, yes, 91 - yes)
    p = 1 / (1 + np.exp(-(a * score + b)))
    assert abs((p * 91).sum() - yes.sum()) < 5


def iban(i, wrong=0):
    body = f"{37040044:08d}{i:010d}"
    check = 98 - int(body + "131400") % 97
    return f"DE{(check + wrong - 2) % 97 + 2:02d}{body}"


def others(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.other] for r in pii.detect(df).collect()}


def test_sure_at_every_size(spark):
    spaced = "DE89 3704 0044 0532 0130 00"
    texts = [f"pay {spaced} 41 now", "tel. 030 1234567, hotel 030 7654321", "GB82WEST12345698765432 x DE88370400440532013000"]
    want = [[spaced], ["030 1234567"], ["GB82WEST12345698765432"]]
    for i, t in enumerate(texts):
        assert others(spark, [t]) == {0: want[i]}
    got = others(spark, texts + [f"nothing {i} here {10 ** 8 + i}" for i in range(300)])
    assert [got[i] for i in range(3)] == want


def test_trees_add_candidates(spark):
    texts = [f"iban: {iban(i)} ok" for i in range(200)] + [f"iban: {iban(900, 1)} ok"] \
        + [f"lot {10 ** 8 + i} ok" for i in range(200)] + [f"+1 (811) 555-{1000 + i} ok" for i in range(50)]
    got = others(spark, texts)
    assert all(got[i] == [iban(i)] for i in range(200))
    assert got[200] == [iban(900, 1)]  # like the others but for its check digits
    assert not any(got[i] for i in range(201, 451))
