"""Personal data by gradient-boosted candidates, in DataFrame functions only.

Base spans follow fixed patterns and checks. Besides, high-recall generators
propose overlapping candidate spans; small integer features tell their format
(digits, separators, groups, signs) and context (neighbouring characters, a
keyword before). Candidates that no base span overlaps can be emitted. Of them,
IBANs of their country's length that pass mod 97 and numbers of 7 to 15 digits
right after a word for phone are sure, by themselves, in a table of any size.

Boosted trees add candidates of like format and context. They learn from the
sure candidates and from base phones with their sign masked, against all other
candidates that can be emitted. A logistic calibration on the held-out
documents' candidates that can be emitted, with Platt's smoothed targets, turns
scores into probabilities; those of the wanted precision are emitted. The trees
are fitted to the counts per feature vector over all rows, a table bounded by
the features' ranges, and applied as SQL expressions.

Cases: null and empty texts have no spans. Texts are searched whole. Repeated
rows give repeated results; with no candidates no trees are grown. Patterns are
possessive and anchored so that long runs cost linear time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# The base kinds in order, with the characters their patterns use.
KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
# The countries of each IBAN length.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in _IBAN_LENGTHS.items())
# Generators of candidates, and a character without which they find nothing.
_GENERATORS = (
    (r"(?<!\S)[^\s@]*+@\S*+", "@"),
    (r"\+?[0-9](?:[ ().,/:-]{0,2}[0-9]){6,}+", None),
    (rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:(?:{_IBAN})(?![A-Z0-9])|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}+(?: ?[A-Z0-9]{{1,3}}\b)?+\b)", None),
)
NUMBER, IBAN = 1, 2
# Words before a candidate that speak for personal data.
_KEYWORDS = (("phone", "tel", "call", "fax", "mobil"), ("mail", "contact"), ("card", "visa", "account", "iban"),
             ("address", "server", "ip"))
# What stands right before a number that is surely a phone's.
_CALLED = (r"(?:^|[^\p{L}])(?:tel|tele(?:ph|f)one?|téléphone|teléfono|phone|fon|fax|mobile?|móvil|handy|cell|call|whatsapp)"
           r"(?: ?(?:no|nr|number|nummer))?[.:]{0,2}\s{0,3}\(?$")
FEATURES = ("generator", "digits", "separators", "groups", "plus", "dotted", "keyword", "before", "after")
ROUNDS, DEPTH, RATE, PENALTY = 20, 3, 0.3, 1.0
PRECISION = 0.95  # least calibrated probability of a candidate that the trees add
_SPAN = "array<struct<start:int,end:int,text:string>>"
_KINDS_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    back = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.zip_with(back, F.sequence(F.lit(0), F.greatest(F.size(back) - 1, F.lit(0))),
                   lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                       d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    signs = F.regexp_extract_all(s, F.lit("[A-Z0-9]"), F.lit(0))
    turned = F.concat(F.slice(signs, 5, 64), F.slice(signs, 1, 4))
    step = lambda a, c: F.when(c <= "9", a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    if kind == "ip":
        # a part over 255 has four digits, or three that exceed 255, after zeros
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255)
        return F.forall(F.split(s, r"\."), part)
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(s))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, valid, sign: str | None = None) -> Column:
    """Matches of the pattern that are valid, with their code point positions:
    the pieces between matches and the matches give the positions by summing
    lengths."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        first = acc["at"] + F.length(x["gap"])
        last = first + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(first.alias("start"), last.alias("end"), x["hit"].alias("text")))
        good = x["hit"].isNotNull() & valid(x["hit"])
        return F.struct(last.cast("int").alias("at"),
                        F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    possible = text.isNotNull() & (text.contains(sign) if sign else text.rlike(pattern))
    return F.when(possible, found).otherwise(F.array().cast(_SPAN))


def _base(text: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(matches(text, _PATTERNS[kind], lambda s: _valid(kind, s), _SIGN[kind]),
                       lambda x: F.struct(number, x["start"].alias("start"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> by kind, then start; kind as a number."""
    return F.concat(*[_base(text, k) for k in KINDS])


def _class_of(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 1).when(c.rlike(r"^\w"), 2).otherwise(3)


def _lead(text: Column, x: Column) -> Column:
    return F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))


def _sure(text: Column, x: Column, generator: int) -> Column:
    """Whether a candidate is personal data by its own checks."""
    if generator == IBAN:
        return x["text"].rlike(f"^(?:{_IBAN})$") & mod97(x["text"])
    if generator == NUMBER:
        return ~x["text"].startswith("+") & F.length(_digits(x["text"])).between(7, 15) \
            & (_class_of(F.substring(text, x["end"] + 1, F.lit(1))) != 2) & _lead(text, x).rlike(_CALLED)
    return F.lit(False)


def _features(text: Column, x: Column, generator: int) -> Column:
    s = x["text"]
    n = F.length(_digits(s))
    seps = F.regexp_replace(s, "[0-9+]", "")
    lead = _lead(text, x)
    keyword = F.lit(0)
    for i, words in reversed(list(enumerate(_KEYWORDS, 1))):
        keyword = F.when(lead.rlike("|".join(words)), i).otherwise(keyword)
    values = {
        "generator": F.lit(generator),
        "digits": F.when(n < 7, 0).when(n < 8, 1).when(n < 11, 2).when(n < 14, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        "separators": F.when(seps == "", 0).when(seps.rlike("^ +$"), 1).when(seps.rlike("^-+$"), 2)
                       .when(seps.rlike(r"^\.+$"), 3).when(seps.rlike("^[^A-Za-z]+$"), 4).otherwise(5),
        "groups": F.least(F.size(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))), F.lit(5)),
        "plus": s.startswith("+").cast("int"),
        "dotted": s.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z0-9]").cast("int"),
        "keyword": keyword,
        "before": F.when(x["start"] == 0, 0).otherwise(_class_of(F.substring(text, x["start"], F.lit(1)))),
        "after": _class_of(F.substring(text, x["end"] + 1, F.lit(1))),
    }
    return F.struct(*[values[f].cast("int").alias(f) for f in FEATURES])


def _proposed(text: Column, generator: int) -> Column:
    pattern, sign = _GENERATORS[generator]
    return F.transform(matches(text, pattern, lambda s: F.lit(True), sign),
                       lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"),
                                          _sure(text, x, generator).alias("sure"), _features(text, x, generator).alias("f")))


def candidates(text: Column) -> Column:
    """array<struct<start, end, sure, f>> of all generators, overlaps included."""
    return F.concat(*[_proposed(text, g) for g in range(len(_GENERATORS))])


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fold, base, found): base spans and candidates of each row. Three
    folds of four train, one calibrates."""
    text = F.col(text_col)
    fold = (F.pmod(F.xxhash64(id_col), F.lit(4)) == 0).cast("int")
    return df.select(F.col(id_col), fold.alias("fold"), base_spans(text).alias("base"), candidates(text).alias("found"))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on the gradients: (feature, limit, left, right) or a
    leaf's value."""
    leaf = RATE * g.sum() / (h.sum() + PENALTY)
    best = (1e-9, None)
    if depth:
        whole = g.sum() ** 2 / (h.sum() + PENALTY)
        for f in range(x.shape[1]):
            for limit in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= limit
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl ** 2 / (hl + PENALTY) + (g.sum() - gl) ** 2 / (h.sum() - hl + PENALTY) - whole
                if gain > best[0]:
                    best = (gain, (f, int(limit)))
    if best[1] is None:
        return float(leaf)
    f, limit = best[1]
    left = x[:, f] <= limit
    return f, limit, _tree(x[left], g[left], h[left], depth - 1), _tree(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, limit, left, right = tree
    return np.where(x[:, f] <= limit, _value(left, x), _value(right, x))


def _expression(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    at, limit, left, right = tree
    return F.when(f[FEATURES[at]] <= limit, _expression(left, f)).otherwise(_expression(right, f))


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> list:
    """Boosted trees on counts of positive and negative rows per vector."""
    trees, score = [], np.zeros(len(x))
    for _ in range(ROUNDS if len(x) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, yes * (1 - p) - no * p, (yes + no) * p * (1 - p), DEPTH))
        score += _value(trees[-1], x)
    return trees


def calibrate(score: np.ndarray, yes: np.ndarray, no: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic fit of labels to scores, the labels
    smoothed by one more candidate of either kind (Platt)."""
    high, low = (yes.sum() + 1) / (yes.sum() + 2), 1 / (no.sum() + 2)
    yes, no = yes * high + no * low, yes * (1 - high) + no * (1 - low)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        g, w = yes * (1 - p) - no * p, (yes + no) * p * (1 - p)
        hess = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(hess, [(g * score).sum() - 1e-3 * (a - 1), g.sum() - 1e-3 * b])
        a, b = a + float(np.clip(da, -2, 2)), b + float(np.clip(db, -2, 2))
    return a, b


class Detector:
    """Trees and calibration; ``precision`` is the least probability."""

    def __init__(self, trees: list, slope: float, intercept: float, precision: float):
        self.trees, self.slope, self.intercept, self.precision = trees, slope, intercept, precision

    def probability(self, f: Column) -> Column:
        score = F.lit(0.0)
        for t in self.trees:
            score = score + _expression(t, f)
        return 1 / (1 + F.exp(-(F.lit(self.slope) * score + F.lit(self.intercept))))

    def selected(self, base: Column, found: Column) -> Column:
        """Of the candidates that can be emitted, the sure and the probable."""
        chosen = F.filter(emittable(base, found), lambda x: x["sure"] | (self.probability(x["f"]) >= self.precision))
        return F.array_sort(F.transform(chosen, lambda x: F.struct(
            F.lit(len(KINDS)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))


def emittable(base: Column, found: Column) -> Column:
    """Candidates that overlap neither a base span nor, if not sure, a sure one."""
    sure = F.filter(found, lambda x: x["sure"])
    return F.filter(found, lambda x: ~_overlaps(x, base) & (x["sure"] | ~_overlaps(x, sure)))


def fit(found: DataFrame, precision: float = PRECISION) -> Detector:
    """Fit to the candidates of ``find``: counts per feature vector and fold,
    and of masked base phones, which only train."""
    phones = F.filter("base", lambda b: b["kind"] == KINDS.index("phone"))
    masked = F.transform(F.filter("found", lambda x: F.exists(phones, lambda b: _same(x, b))),
                         lambda x: F.struct(x["f"].withField("plus", F.lit(0)).alias("f"), F.lit(2).alias("hit")))
    free = F.transform(emittable(F.col("base"), F.col("found")),
                       lambda x: F.struct(x["f"].alias("f"), x["sure"].cast("int").alias("hit")))
    rows = found.select("fold", F.explode(F.concat(free, masked)).alias("x")).select("fold", "x.f.*", "x.hit")
    counts = rows.groupBy(*FEATURES).agg(*[
        F.sum(((F.col("fold") == fold) & (F.col("hit") == hit)).cast("long")).alias(f"n{fold}{hit}")
        for fold in (0, 1) for hit in (0, 1, 2)]).orderBy(*FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in counts], np.int64).reshape(-1, len(FEATURES))
    n = {c: np.array([r[c] for r in counts], float) for c in ("n00", "n01", "n02", "n10", "n11")}
    trees = boost(x, n["n01"] + n["n02"], n["n00"])
    score = sum((_value(t, x) for t in trees), np.zeros(len(x)))
    return Detector(trees, *calibrate(score, n["n11"], n["n10"]), precision)


def _same(x: Column, b: Column) -> Column:
    return (x["start"] == b["start"]) & (x["end"] == b["end"])


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, other): arrays of (kind, start, end) in code points."""
    found = saved(find(df, id_col, text_col), "pii")
    detector = fit(found)
    return found.select(id_col, "base", detector.selected(F.col("base"), F.col("found")).alias("other"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, OTHER)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return detect(df, id_col, text_col).select(
        id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
        _named(F.concat("base", "other")).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` with each span of the text replaced by its kind in
    brackets; overlapping spans become one, under the first one's name."""
    detector = fit(saved(find(df, id_col, text_col), "pii"))
    text = F.col("text")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    rows = rows.withColumn("base", base_spans(text)).withColumn("found", candidates(text))
    rows = rows.withColumn("other", detector.selected(F.col("base"), F.col("found"))) \
        .withColumn("text", _cut(text, F.concat("base", "other")))
    # cutting a candidate can free a base span from the digits beside it
    freed = F.when(F.size("other") > 0, base_spans(text)).otherwise(F.array().cast(_KINDS_SPAN))
    return rows.withColumn("freed", freed).withColumn("text", _cut(text, F.col("freed"))) \
        .select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in df.columns])


def _cut(text: Column, spans: Column) -> Column:
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, OTHER)])
    cut_type = "struct<at:int,out:string>"

    def step(acc, s):
        new = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), new.alias("out"))) \
            .otherwise(F.struct(F.greatest(s["end"], acc["at"]).alias("at"), acc["out"].alias("out"))).cast(cut_type)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(cut_type), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
