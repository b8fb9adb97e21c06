"""Secret scans with a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: texts
that lack it cannot match. A block of documents (one Arrow batch) is indexed:
for each trigram that some rule asks for, the posting list of the block's
documents that hold it. The queries intersect and unite posting lists, and only
the candidates are matched. A rule without mandatory trigrams scans all texts.

Cases: null and empty texts have no spans. Texts are scanned whole, rows
independently of each other, so repeated rows give repeated results and hot
sources need no care. Extra columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, text_bytes

# The keywords, signs and sizes of the three base rules.
_KEYWORDS = "(?:password|passwd|secret|token|api_?key)"
_ASSIGN = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def either_case(pattern: str) -> str:
    """The pattern with each ASCII letter matching both its cases."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match whose ``group`` is under ``least`` characters
    long is dropped."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    compiled: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def spans(self, text: str) -> list[tuple[int, int]]:
        g = self.group
        return [m.span() for m in self.compiled.finditer(text) if m.end(g) - m.start(g) >= self.least]


RULES = (
    Rule("assign", either_case(_KEYWORDS) + _ASSIGN, group=1, least=6, base=True),
    Rule("access", "AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", "[0-9a-f]{24,}", least=24, base=True),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abpr]-[0-9A-Za-z-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]{16,}"),
    # runs are taken whole and begin at their first character, so that a text is
    # read once however long its runs are
    Rule("jwt", r"(?<![\w-])eyJ[\w-]{10,}+\.eyJ[\w-]{10,}+\.[\w-]{10,}+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", "[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
    Rule("login_url", r"(?<![a-z])[a-z]{2,}+://[^\s:/@]++:[^\s:/@]++@"),
)

# A trigram query: True (no condition), a trigram, or ("and" | "or", parts).
_MOST = 128  # alternatives followed for one run of characters


def _both(op: str, parts: list):
    if op == "and":
        parts = [p for p in parts if p is not True]
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_string(s: str):
    raw = s.lower().encode()
    return _both("and", [raw[i:i + 3] for i in range(len(raw) - 2)])


def _walk(items) -> tuple[set[str] | None, object]:
    """All texts the items can match, where those are few, and what any match
    of them must hold."""
    found, runs, exact = [], {""}, True

    def end_run():
        nonlocal runs, exact
        found.append(_both("or", [_of_string(s) for s in runs]))
        runs, exact = {""}, False

    for op, arg in items:
        name, texts, need = str(op), None, True
        if name == "LITERAL":
            texts = {chr(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            texts = {chr(a) for _, a in arg}
        elif name == "SUBPATTERN":
            texts, need = _walk(arg[-1])
        elif name == "BRANCH":
            sides = [_walk(x) for x in arg[1]]
            need = _both("or", [n for _, n in sides])
            if all(t is not None for t, _ in sides):
                texts = set().union(*(t for t, _ in sides))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = arg
            texts, need = _walk(inner)
            if texts is not None and (least, most) == (0, 1):
                texts = texts | {""}
            elif texts is not None and least == most and len(texts) ** least <= _MOST:
                texts = {"".join(x) for x in itertools.product(texts, repeat=least)}
            else:
                texts = None
            if not least:
                need = True
        if texts is not None:
            # lower-cased already here: the index knows no case
            joined = {a + b.lower() for a in runs for b in texts}
            if len(joined) <= _MOST:
                runs = joined
                continue
        end_run()
        found.append(need)
    if exact:
        return runs, _both("or", [_of_string(s) for s in runs])
    end_run()
    return None, _both("and", found)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression."""
    return _walk(re._parser.parse(pattern))[1]


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class BlockIndex:
    """Posting lists of the wanted trigrams over one block of documents."""

    def __init__(self, wanted: list[bytes]):
        self.number = {t: i for i, t in enumerate(wanted)}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            self.table[int.from_bytes(t, "big")] = i

    def build(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n_docs = len(offsets) - 1
        found = []
        for at in range(0, max(len(data) - 2, 0), 1 << 20):
            part = data[at:at + (1 << 20) + 2]
            part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint32)
            which = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            hit = np.flatnonzero(which >= 0)
            doc = np.searchsorted(offsets, at + hit, "right") - 1
            inside = at + hit + 3 <= offsets[doc + 1]
            found.append(np.unique(which[hit[inside]].astype(np.int64) << 32 | doc[inside]))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        edges = np.searchsorted(keys >> 32, np.arange(len(self.number) + 1))
        self.lists = [keys[a:b] & 0xFFFFFFFF for a, b in zip(edges, edges[1:])]

    def search(self, query) -> np.ndarray:
        """The block's documents that satisfy the query."""
        if query is True:
            return np.arange(self.n_docs)
        if isinstance(query, bytes):
            return self.lists[self.number[query]]
        op, parts = query
        out = [self.search(p) for p in parts]
        if op == "or":
            return np.unique(np.concatenate(out))
        least = min(out, key=len)
        for x in out:
            if x is not least:
                least = np.intersect1d(least, x, assume_unique=True)
        return least


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): array of (kind, start, end) in code points, by start and
    then the order of the rules."""
    prepare(df.sparkSession)
    specs = [(r.kind, r.pattern, r.group, r.least, r.base) for r in rules]
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Rule(*s) for s in specs]
        wanted = [trigram_query(r.pattern) for r in own]
        index = BlockIndex(sorted(set().union(*map(trigrams, wanted))))
        for b in batches:
            index.build(*text_bytes(b.column(1)))
            texts = b.column(1)
            spans: list[list] = [[] for _ in range(len(texts))]
            for k, (rule, query) in enumerate(zip(own, wanted)):
                for i in index.search(query).tolist():
                    if text := texts[i].as_py():
                        spans[i] += [(a, k, z) for a, z in rule.spans(text)]
            out = [[{"kind": own[k].kind, "start": a, "end": z} for a, k, z in sorted(s)] for s in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, found_type)], [id_col, "spans"])

    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, "
             "spans array<struct<kind: string, start: int, end: int>>")


def report(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of the spans of ``scan``."""
    from pyspark.sql import functions as F
    base = [r.kind for r in rules if r.base]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return scan(df, rules, id_col, text_col).select(
        id_col, *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
