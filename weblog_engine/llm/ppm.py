"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of 0 to ``ORDER`` bytes with the
counts of the bytes that followed. A byte's code length in a context that knows
it is -log2(count / (total + distinct)); a context that does not know it pays
the escape -log2(distinct / (total + distinct)) and asks the context one byte
shorter; below the empty context a byte costs 8 bits. The statistics are frozen
after training, so for each n-gram the code length under every language, escapes
included, is worked out once; a text's code length is a sum of table lookups.

Training takes a bounded sample: about ``docs_per_language`` whole documents of
each language, chosen by a hash of id and text, and of the ``MOST_LANGUAGES``
languages with most documents (ties: first in order). The tables are bounded by
that sample and are broadcast; every document is scored whole.

Cases: null texts and texts without a letter are ``und`` with score 1. Equal
code lengths go to the language first in order. With no training rows all
documents are ``und`` with score 0. Repeated rows give repeated results; extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, prepare, text_bytes

ORDER = 3
DOCS_PER_LANGUAGE = 300
MOST_LANGUAGES = 256
COUNTERS = 4  # tasks that count the sample
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SLICE = 1 << 19


def grams(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the three before it as one 32-bit number."""
    x = data.astype(np.uint32)
    g = x.copy()
    for k in (1, 2, 3):
        g[k:] |= x[:-k] << np.uint32(8 * k)
    return g


def place(offsets: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and position in the document of bytes start to end."""
    doc = np.searchsorted(offsets, np.arange(start, end), "right") - 1 if end - start < 64 else None
    if doc is None:
        first = int(np.searchsorted(offsets, start, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        edges = np.clip(offsets[first:last + 1], start, end)
        doc = np.repeat(np.arange(first, last), np.diff(edges))
    return doc, np.arange(start, end) - offsets[doc]


def sample(df: DataFrame, group_col: str, docs_per_group: int, id_col: str, text_col: str) -> DataFrame:
    """About ``docs_per_group`` different rows of each group: those with the
    least hashes, cut off at the share that the group's size calls for."""
    rows = df.where(F.col(group_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(group_col).alias("g")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("n").desc(), "g").limit(MOST_LANGUAGES)
    place_of = F.xxhash64(id_col, text_col)
    share = F.lit(2.0 ** 63 * docs_per_group) / F.col("n")
    return rows.select(F.col(group_col).alias("g"), F.col(text_col).alias("text"), place_of.alias("h")) \
        .join(F.broadcast(sizes), "g").where(F.abs(F.col("h").cast("double")) <= share) \
        .groupBy("g", "h").agg(F.min("text").alias("text")).select("g", "text")


def count_grams(rows: DataFrame) -> DataFrame:
    """(g, size, gram, n): how often each run of 1 to ORDER + 1 bytes occurs in
    the texts of each group. ``rows`` is a bounded sample, so ``COUNTERS`` tasks
    count it, each over all its batches before it gives a row: the rows follow
    from the sample, not from how it was dealt out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counts()
        for b in batches:
            groups = b.column(0).to_pylist()
            data, offsets = text_bytes(b.column(1))
            for group in sorted(set(groups)):
                mine = np.array([x == group for x in groups])
                for at in range(0, len(data), _SLICE):
                    lead = min(at, ORDER)
                    end = min(at + _SLICE, len(data))
                    g = grams(data[at - lead:end])[lead:]
                    doc, pos = place(offsets, at, end)
                    for size in range(1, ORDER + 2):
                        ok = mine[doc] & (pos >= size - 1)
                        held.add((group, size), g[ok] & np.uint32((1 << 8 * size) - 1))
        for (group, size), (codes, n) in held.items():
            for at in range(0, len(codes), _SLICE):
                part = codes[at:at + _SLICE]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(part)), pa.array(np.full(len(part), size, np.int32)),
                     pa.array(part.astype(np.int64)), pa.array(n[at:at + _SLICE])], ["g", "size", "gram", "n"])

    return rows.coalesce(COUNTERS).mapInArrow(run, "g string, size int, gram long, n long") \
        .groupBy("g", "size", "gram").agg(F.sum("n").alias("n"))


class Counts:
    """How often each code occurs, by key: sorted codes and their counts, and
    codes not yet merged into them (at most ``_SLICE``)."""

    def __init__(self):
        self.sorted: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.new: dict[tuple, list[np.ndarray]] = {}

    def add(self, key: tuple, codes: np.ndarray) -> None:
        if len(codes):
            waiting = self.new.setdefault(key, [])
            waiting.append(codes)
            if sum(map(len, waiting)) >= _SLICE:
                self._merge(key)

    def _merge(self, key: tuple) -> None:
        codes, n = np.unique(np.concatenate(self.new.pop(key)), return_counts=True)
        old, old_n = self.sorted.get(key, (codes[:0], n[:0]))
        both, where = np.unique(np.concatenate([old, codes]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, where, np.concatenate([old_n, n]))
        self.sorted[key] = both, total

    def items(self):
        for key in list(self.new):
            self._merge(key)
        return sorted(self.sorted.items())


class Lookup:
    """Row numbers of 32-bit keys: open addressing, probed for many at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(4 * len(keys) + 1).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.row = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.row[slot] < 0
            self.row[slot[free]] = left[free]  # of several, the last stays
            self.key[slot[free]] = keys[left[free]]
            out = self.row[slot] != left
            left, slot = left[out], (slot[out] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        rows = self.row[slot]
        wrong = np.flatnonzero((rows >= 0) & (self.key[slot] != keys))
        while len(wrong):
            slot_w = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            slot[wrong] = slot_w
            rows[wrong] = self.row[slot_w]
            wrong = wrong[(rows[wrong] >= 0) & (self.key[slot_w] != keys[wrong])]
        return rows


class Model:
    """Frozen context trees of all languages."""

    def __init__(self, langs: list[str], counts: dict[int, tuple[np.ndarray, np.ndarray]]):
        """counts: by size the sorted n-grams, and their counts by language."""
        self.langs = langs
        wide = len(langs)
        below = Lookup(np.zeros(0, np.int64)), np.zeros((0, wide))
        self.levels: list[tuple] = []  # by size: n-grams, code lengths, contexts, escapes
        for size in range(1, ORDER + 2):
            keys, n = counts.get(size, (np.zeros(0, np.int64), np.zeros((0, wide))))
            ctx, where = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(ctx), wide)), np.zeros((len(ctx), wide))
            np.add.at(total, where, n)
            np.add.at(distinct, where, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                known = -np.log2(n / (total + distinct)[where])
            if size == 1:
                less = np.full((len(keys), wide), 8.0)
            else:
                less = below[1][below[0](keys & ((1 << 8 * (size - 1)) - 1))]
            cost = np.where(n > 0, known, escape[where] + less)
            below = Lookup(keys), cost
            self.levels.append((below[0], cost.astype(np.float32), Lookup(ctx), escape.astype(np.float32)))

    def cost(self, g: np.ndarray, size: int) -> np.ndarray:
        """Code length by language of the last byte of each n-gram."""
        if not size:
            return np.full((len(g), len(self.langs)), 8.0, np.float32)
        key = (g & np.uint32((1 << 8 * size) - 1)).astype(np.int64)
        find, cost, find_ctx, escape = self.levels[size - 1]
        row = find(key)
        out = cost[row] if len(cost) else np.zeros((len(g), len(self.langs)), np.float32)
        miss = np.flatnonzero(row < 0)
        if len(miss):
            ctx = find_ctx(key[miss] >> 8)
            paid = np.where((ctx >= 0)[:, None], escape[ctx], 0) if len(escape) else 0
            out[miss] = self.cost(g[miss], size - 1) + paid
        return out

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        bits = np.zeros((len(offsets) - 1, len(self.langs)))
        for at in range(0, len(data), _SLICE):
            lead, end = min(at, ORDER), min(at + _SLICE, len(data))
            g = grams(data[at - lead:end])[lead:]
            doc, pos = place(offsets, at, end)
            cost = self.cost(g, ORDER + 1)
            for p in range(ORDER):  # a document's first bytes have shorter contexts
                rows = np.flatnonzero(pos == p)
                cost[rows] = self.cost(g[rows], p + 1)
            first = int(doc[0])
            for k in range(len(self.langs)):
                own = np.bincount(doc - first, cost[:, k])
                bits[first:first + len(own), k] += own
        return bits


def train(df: DataFrame, lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of the labelled rows in ``df``."""
    prepare(df.sparkSession)
    rows = count_grams(sample(df, lang_col, docs_per_language, id_col, text_col)).toArrow()
    names = rows.column("g").to_pylist()
    langs = sorted(set(names))
    lang_no = np.array([langs.index(x) for x in names], np.int64) if names else np.zeros(0, np.int64)
    size, gram, n = (rows.column(c).to_numpy() for c in ("size", "gram", "n"))
    counts = {}
    for s in range(1, ORDER + 2):
        mine = size == s
        keys, where = np.unique(gram[mine], return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        table[where, lang_no[mine]] = n[mine]
        counts[s] = keys, table
    return Model(langs, counts)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, bits_per_byte): the language with the shortest
    code, its share 2^-bits of all languages' and its bits per byte. The
    columns named in ``keep`` come as one struct ``row``."""
    spark = df.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = df.select(id_col, F.col(text_col).alias("text"), *([F.struct(*keep).alias("row")] if keep else []))
    names = [id_col, "lang_pred", "score", "bits_per_byte", *(["row"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            texts = b.column(1)
            data, offsets = text_bytes(texts)
            readable = np.array([bool(t and _LETTER.search(t)) for t in texts.to_pylist()], bool)
            if not m.langs:
                lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                rate = np.zeros(len(texts))
            else:
                bits = m.code_lengths(data, offsets)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                score[~readable] = 1.0
                lang = [m.langs[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), readable.tolist())]
                rate = least / np.maximum(np.diff(offsets), 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang), pa.array(score), pa.array(rate), *b.columns[2:]], names)

    return rows.mapInArrow(
        run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double"
             + (f", row {rows.schema['row'].dataType.simpleString()}" if keep else ""))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(id_remainder(id_col, 4) == 2, F.lit(False))


def predictions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predictions for all rows from a model of the rows that are not held out."""
    model = train(df.where(~held_out(id_col)), id_col=id_col, text_col=text_col)
    return identify(df, model, id_col, text_col) \
        .select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "bits_per_byte")
