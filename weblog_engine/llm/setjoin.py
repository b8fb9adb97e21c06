"""Similarity self-join of documents on word shingles (Jaccard), and the groups
that its links make.

1. Each document's set: 64-bit hashes of its distinct 5-word shingles. Documents
   with equal sets are collapsed into one with a weight.
2. Two sets with Jaccard similarity t share l shingles among the first
   n - ceil(t n) + l of each, in any common order. A first order by hash, the
   most common shingles last, sets aside the sets of whose prefixes other sets
   hold fewer than l, ``EXTRA`` percent of the set. Among the others all
   shingles are counted: sets with too many shingles of their own drop out, and
   the prefixes of the rest, rarest first and with l = 1, give the index lists. In each list, sorted by size, neighbours are chained
   unless the smaller has less than t times the size of the larger: similar sets
   end up in one chained component, and no list's pairs are written out.
3. A component's sets meet in tasks, large components in pairs of blocks. There,
   an inverted index over all shingles answers one set after another: index lists
   are ordered by size, so a list's blocks outside a set's size bounds are
   skipped, and a set that differs little from the one answered before it takes
   over that set's overlaps and only adds and takes away the lists of the
   shingles in which they differ.
4. The links found become components; each document takes its set's component.

Cases: documents without words or text have no shingles, link with nothing and
are their own component; null ids form components of their own rows and never
give a component its name; with fewer words than five the whole sequence is one
shingle. Rows with equal ids are one document each in ``links`` and share a
component only through their texts. Texts are read whole; extra columns are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import byte_codes, mix64, prepare, saved, signed, text_bytes, text_key

WORDS = 5
PERCENT = 75  # links from 100 * intersection >= PERCENT * union
EXTRA = 8  # percent of a set that the first prefixes must share
COMMON = 1 << 16  # shingles whose frequency enters the order; bounds a broadcast
COMMON_IN_TASK = 8  # occurrences in a task from which a shingle is counted
MARKS = 1 << 26  # bits of the map of documents that may have partners
BLOCK_BYTES = 8 << 20  # text that a block of a component holds

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = byte_codes(21)
_BASE = 0xA0761D6478BD642F
_STEPS = (byte_codes(22) | np.uint64(1))[:WORDS]
_SIZE = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        p[done:done + k] = p[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return p


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SIZE, 1 << n.bit_length())
    if size not in _TABLES:
        _TABLES[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _TABLES[size]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each lower-cased word of a text's bytes."""
    data = _LOWER[data]
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[:len(data)], out=p[1:])
    return mix64((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))


def shingles(data: np.ndarray) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    w = word_hashes(data)
    if not len(w):
        return w
    m = min(WORDS, len(w))
    n = len(w) - m + 1
    s = np.full(n, m, np.uint64)
    for k in range(m):
        s += w[k:k + n] * _STEPS[k]
    return np.unique(mix64(s))


def _texts(column) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:z]


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Length of the first prefix of a set of ``n``. A partner has at least
    ``percent`` of n elements, so it and this set share that many percent of
    the extra entries, ``least_shared``."""
    return min(n, n - -(-percent * n // 100) + max(1, -(-EXTRA * n // 100))) if n else 0


def least_shared(n, percent: int = PERCENT):
    """How many prefix entries of a set of ``n`` (a column) other sets hold
    where it has a partner."""
    return F.greatest(F.lit(1), F.ceil(F.ceil(n * percent / 100) * EXTRA / 100))


def digest(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a set."""
    if not len(s):
        return np.uint64(0), np.uint64(0)
    return np.bitwise_xor.reduce(s), (mix64(s) * (s | np.uint64(1))).sum()


def set_ids(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    return signed(mix64(d1 ^ mix64(d2)))


_SCAN = "key long, tag binary, n long, d1 long, d2 long, id long, s long, times long"


def scan(rows: DataFrame) -> DataFrame:
    """Two kinds of rows from one pass over the texts: size, digest and id of
    each set; and, with ``times``, how often a task saw a shingle that it saw
    ``COMMON_IN_TASK`` times. What the latter miss only moves a shingle's place
    in an order."""
    def merge(keys, n, waiting):
        new, m = np.unique(np.concatenate(waiting), return_counts=True)
        keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
        total = np.bincount(where, np.concatenate([n, m])).astype(np.int64)
        if len(keys) > 1 << 20:  # bounded: the rare ones go
            keep = total > np.partition(total, len(total) - (1 << 19))[len(total) - (1 << 19)]
            keys, total = keys[keep], total[keep]
        return keys, total

    names = [x.split(" ")[0] for x in _SCAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting, size = [], 0
        for b in batches:
            found = [shingles(data) for data in _texts(b.column(2))]
            n = np.array([len(s) for s in found], np.int64)
            d = np.array([digest(s) for s in found], np.uint64).reshape(-1, 2)
            nothing = pa.nulls(len(found), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n), pa.array(signed(d[:, 0].copy())), pa.array(signed(d[:, 1].copy())),
                 pa.array(set_ids(d[:, 0], d[:, 1])), nothing, nothing], names)
            waiting += found
            size += int(n.sum())
            if size > 1 << 20:
                keys, times = merge(keys, times, waiting)
                waiting, size = [], 0
        if waiting:
            keys, times = merge(keys, times, waiting)
        often = times >= COMMON_IN_TASK
        if often.any():
            nothing = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nothing, pa.nulls(len(nothing), pa.binary()), *[nothing] * 4, pa.array(signed(keys[often])), pa.array(times[often])], names)

    return rows.select("key", "tag", "text").mapInArrow(run, _SCAN)


def common_shingles(found: DataFrame, limit: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles from the least power of two of occurrences on that at most
    ``limit`` shingles reach, and their counts."""
    counts = saved(found.where("times IS NOT NULL").groupBy("s").agg(F.sum("times").alias("n")), "common")
    steps = counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.col("p").desc()).collect()
    power, total = 62, 0
    for r in steps:
        total += r.n
        if total > limit:
            break
        power = r.p
    top = counts.where(F.col("n") >= F.lit(1 << power)).toArrow()
    s, n = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def sharing(rows: DataFrame, common, percent: int) -> DataFrame:
    """(half, shared): by the lower half of a set's id, how many entries of its
    prefix other sets hold too. Prefixes go by hash, common shingles last. Two
    ids with equal halves look like one set here; ``join`` adds all such ids."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = shared.value
        for b in batches:
            entries, ids, size = [], [], []
            for data in _texts(b.column(0)):
                s = shingles(data)
                m = prefix_length(len(s), percent)
                if not m:
                    continue
                d1, d2 = digest(s)
                ids.append(set_ids(np.array([d1]), np.array([d2]))[0])
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    known = keys[at] == s
                    if known.any():
                        s = s[np.argsort(np.where(known, often[at], 0), kind="stable")]
                entries.append(s[:m])
                size.append(m)
            if entries:
                half = (np.repeat(np.array(ids), size) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(entries))), pa.array(half)], ["s", "half"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted. The last different row is held back until its
        successor shows, with whether its predecessor has the same entry."""
        last, held = None, False
        for b in batches:
            s, half = b.column(0).to_numpy(), b.column(1).to_numpy()
            if last is not None:
                s, half = np.append(last[0], s), np.append(last[1], half)
            if not len(s):
                continue
            new = np.append(True, (s[1:] != s[:-1]) | (half[1:] != half[:-1]))  # copies count once
            s, half = s[new], half[new]
            same = s[1:] == s[:-1]
            before = np.append(held, same)
            yield counted(half[:-1][before[:-1] | same])
            last, held = (s[-1], half[-1]), bool(before[-1])
        if held:
            yield counted(np.array([last[1]], np.int32))

    def counted(half: np.ndarray) -> pa.RecordBatch:
        half, n = np.unique(half, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(half.astype(np.int32)), pa.array(n)], ["half", "shared"])

    entries = rows.select("text").mapInArrow(prefixes, "s long, half int")
    return entries.repartition(shuffle_partitions(rows.sparkSession), "s").sortWithinPartitions("s", "half") \
        .mapInArrow(near, "half int, shared long") \
        .groupBy(F.col("half").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")).agg(F.sum("shared").alias("shared"))


def mark(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds ``marked``: whether a row's (key, tag) may be among the wanted, by
    a bitmap of ``MARKS`` bits, at most ``MARKS`` / 64 broadcast rows whatever
    the data. So only few texts need a shuffle for the join that decides."""
    place = F.pmod(F.xxhash64("key", "tag"), F.lit(MARKS))
    bit = lambda p: F.expr(f"shiftleft(1L, CAST({p} & 63 AS INT))")
    words = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("_word")).agg(F.bit_or(bit("p")).alias("_bits"))
    return rows.withColumn("_place", place).withColumn("_word", F.shiftright("_place", 6)) \
        .join(F.broadcast(words), "_word", "left") \
        .withColumn("marked", F.coalesce(F.col("_bits").bitwiseAND(bit("_place")) != 0, F.lit(False))) \
        .drop("_place", "_word", "_bits")


def rare_prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """(id, n, s): the entries of each set's prefix that other sets hold too,
    where prefixes go by the number of sets that hold a shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signed(shingles(data)) for data in _texts(b.column(1))]
            ids = np.repeat(b.column(0).to_numpy(), [len(s) for s in found])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found))], ["id", "s"])

    held = texts.select("id", "text").mapInArrow(run, "id long, s long")
    shared = held.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("df > 1")
    lists = shared.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared")) \
        .join(texts.select("id", "n"), "id")
    # what is left of the prefix after the shingles of the set's own
    room = F.size("shared") - F.ceil(F.col("n") * percent / 100) + 1
    return lists.where(room > 0).select("id", "n", F.explode(F.slice("shared", F.lit(1), room.cast("int"))).alias("e")) \
        .select("id", "n", F.col("e.s").alias("s"))


class Forest:
    """Union-find over arbitrary integers."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def chains(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, per stretch of rows, of the pairs of
    neighbours in the size-ordered list of each shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            s, n, d = (b.column(c).to_numpy() for c in ("s", "n", "id"))
            if last is not None:
                s, n, d = (np.concatenate([[x], y]) for x, y in zip(last, (s, n, d)))
            if not len(s):
                continue
            last = s[-1], n[-1], d[-1]
            near = np.flatnonzero((s[1:] == s[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            pairs = np.unique(np.stack([d[near], d[near + 1]], axis=1), axis=0) if len(near) else np.zeros((0, 2), np.int64)
            forest = Forest()
            kept = [(x, y) for x, y in pairs.tolist() if x != y and forest.join(x, y)]
            if kept:
                a, z = zip(*kept)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return postings.repartition(shuffle_partitions(postings.sparkSession), "s") \
        .sortWithinPartitions("s", "n", "id").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the least id reachable from each id of the edges.

    Alternating star contraction: each node's larger neighbours, then its
    smaller ones, are linked to the least node it knows; the number of rounds
    is logarithmic. Rounds are written to the shared folder."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("x"), F.col("b").alias("y"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
        else:
            both = both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        linked = both.join(least, "x")
        if large:
            out = linked.where("y > x").select(F.col("y").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("y").alias("a"), F.col("m").alias("b")) \
                .unionByName(least.select(F.col("x").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    sign = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == sign or not now.n:
            break
        sign = now
        e = saved(star(star(e, True), False), name)
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")) \
        .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def answer(found: list[np.ndarray], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of linked sets; with ``side`` only pairs from
    different sides. found: sorted shingle hashes of each set."""
    size = np.array([len(x) for x in found], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    n = len(order)
    owner = np.repeat(np.arange(n), size)
    element = np.concatenate([found[i] for i in order]) if n else np.zeros(0, np.uint64)
    by_element = np.lexsort((owner, element))
    element, owner_of = element[by_element], owner[by_element]  # lists, each in order of size
    start = np.concatenate([[0], np.flatnonzero(element[1:] != element[:-1]) + 1]) if len(element) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(element))
    number = np.empty(len(element), np.int64)
    number[by_element] = np.repeat(np.arange(len(start)), end - start)
    at = np.concatenate([[0], np.cumsum(size)])
    side = None if side is None else side[order]
    # all matches of set i among the smaller ones lie from first[i] on
    first = np.searchsorted(100 * size, percent * size, "left")
    posting = np.repeat(np.arange(len(start)), end - start) * n + owner_of  # ascending

    def count(lists: np.ndarray, low: int, high: int) -> np.ndarray:
        """How many of the lists hold each of the sets low..high-1; what lies
        before and after in the lists is skipped."""
        a = np.searchsorted(posting, lists * n + low)
        z = np.searchsorted(posting, lists * n + high)
        some = z > a
        a, z = a[some], z[some]
        total = int((z - a).sum())
        if not total:
            return np.zeros(high - low, np.int64)
        pos = np.arange(total) + np.repeat(z - np.cumsum(z - a), z - a)
        return np.bincount(owner_of[pos] - low, minlength=high - low)

    left, right = [], []
    base = None  # the set answered last: its lists, its range of sets and its overlaps
    # sets that share their least shingle follow each other: similar ones often do
    least = np.array([found[i][0] if len(found[i]) else 0 for i in order], np.uint64)
    for i in np.lexsort((size, least)).tolist():
        lists = np.sort(number[at[i]:at[i + 1]])
        if base is not None and base[1] <= first[i] and i < base[2]:
            gone = np.setdiff1d(base[0], lists, assume_unique=True)
            new = np.setdiff1d(lists, base[0], assume_unique=True)
            if len(gone) + len(new) >= len(lists) // 2:
                base = None
        else:
            base = None
        if base is not None:
            low, high = base[1], base[2]
            overlap = base[3] - count(gone, low, high) + count(new, low, high)
        else:
            low = int(np.searchsorted(100 * size, percent * size[i] * 0.9, "left"))
            high = int(np.searchsorted(size, size[i] * 1.1, "right"))
            overlap = count(lists, low, high)
        base = lists, low, high, overlap
        j = np.arange(first[i], i)
        both = overlap[first[i] - low:i - low]
        hit = j[100 * both >= percent * (size[i] + size[j] - both)]
        if side is not None:
            hit = hit[side[hit] != side[i]]
        left.append(order[hit])
        right.append(np.full(len(hit), order[i]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return np.minimum(a, b), np.maximum(a, b)


def compare(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, links): rows with b are links between sets, one spanning forest
    per tile; rows without b give the weight of a's links found there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by tile, so one tile is held at a time."""
        held, tile = [], None
        for b in batches:
            t = np.stack([b.column(c).to_numpy() for c in ("component", "i", "j")])
            cuts = np.flatnonzero((t[:, 1:] != t[:, :-1]).any(axis=0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if a == z:
                    continue
                if tile != tuple(t[:, a]):
                    yield from finish(held, tile)
                    held, tile = [], tuple(t[:, a])
                held.append(b.slice(a, z - a))
        yield from finish(held, tile)

    def finish(held, tile) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids = np.concatenate([b.column("id").to_numpy() for b in held])
        block = np.concatenate([b.column("block").to_numpy() for b in held])
        weight = np.concatenate([b.column("weight").to_numpy() for b in held])
        found = [shingles(d) for b in held for d in _texts(b.column("text"))]
        ids, once = np.unique(ids, return_index=True)  # repeated rows bring a text twice
        block, weight, found = block[once], weight[once], [found[i] for i in once]
        x, y = answer(found, block if tile[1] != tile[2] else None, percent)
        links = np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids)) if len(x) else np.zeros(len(ids))
        forest = Forest()
        kept = [(p, q) for p, q in zip(ids[x].tolist(), ids[y].tolist()) if forest.join(p, q)]
        some = np.flatnonzero(links)
        a = [p for p, _ in kept] + ids[some].tolist()
        b = [q for _, q in kept] + [None] * len(some)
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array([0] * len(kept) + links[some].astype(np.int64).tolist(), pa.int64())], ["a", "b", "links"])

    return rows.repartition(shuffle_partitions(rows.sparkSession), "component", "i", "j") \
        .sortWithinPartitions("component", "i", "j") \
        .select("component", "i", "j", "id", "block", "weight", "text").mapInArrow(run, "a long, b long, links long")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, tag, n_shingles, component_id, links, group): one row per input row;
    tag: 128 bits of its text. links: how many other rows it is linked with.
    group: a number for the component, null for rows without shingles."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(F.col(id_col).cast("long").alias("key"), text_key(text_col).alias("tag"), F.col(text_col).alias("text"))
    seen = saved(scan(rows), "sets")
    found = seen.where("times IS NULL").select("key", "tag", "n", "d1", "d2", "id")
    # one representative of equal sets
    classes = saved(found.where("n > 0").groupBy("id", "n", "d1", "d2").agg(
        F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "tag")).alias("r"),
        F.count(F.lit(1)).alias("weight"))
        .select("id", "n", "d1", "d2", "r.key", "r.tag", F.col("weight").cast("long").alias("weight"),
                F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)).cast("long").alias("half")), "set_classes")
    twins = classes.groupBy("half").agg(F.count(F.lit(1)).alias("twins"))
    halves = sharing(rows, common_shingles(seen), percent)
    near = saved(classes.join(twins, "half").join(halves, "half", "left")
                 .where((F.col("twins") > 1) | (F.col("shared") >= least_shared(F.col("n"), percent)))
                 .select("id", "n", "weight", "key", "tag"), "sharing_sets")
    texts = saved(mark(rows, near).where("marked").alias("r").join(
        near.alias("m"), F.col("r.key").eqNullSafe(F.col("m.key")) & (F.col("r.tag") == F.col("m.tag")))
        .select("m.id", "m.n", "m.weight", "r.text").dropDuplicates(["id"]), "set_texts")
    chained = components(chains(rare_prefixes(texts, percent), percent), "chain_rounds")
    picked = saved(texts.join(chained, "id").select("id", "component", "weight", "text"), "chained_texts")
    sizes = picked.groupBy("component").agg(
        F.ceil(F.sum(F.octet_length("text").cast("long") + 200) / F.lit(block_bytes)).cast("int").alias("blocks"))
    placed = picked.join(sizes, "component").withColumn("block", F.pmod(F.col("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    linked = saved(compare(placed, percent), "links")
    groups = components(linked.where("b IS NOT NULL").select("a", "b"), "link_rounds")
    degree = linked.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = classes.join(groups, "id", "left").join(degree, "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))
    name_of = named.groupBy("component").agg(F.min("key").alias("component_id"))
    answered = named.join(name_of, "component").select(
        "n", "d1", "d2", "component_id", F.col("component").alias("group"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return found.drop("id").join(answered, ["n", "d1", "d2"], "left").select(
        F.col("key").alias(id_col), "tag", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"), "group")
