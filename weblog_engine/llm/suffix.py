"""Removal of passages that occur elsewhere, by a hash-compared suffix sort.

A text's windows of ``window`` bytes are its suffixes cut to that length. Each
window is anchored at the ``K``-byte gram with the least hash in it, so equal
windows have equal anchors at equal distances. Consecutive windows with the
same anchor form a unit; its bytes are its segment.

1. Units are sorted by (anchor hash, segment hash). A unit whose segment occurs
   twice is repeated in full; one whose anchor occurs nowhere else is not. Of a
   segment that occurs twice in one batch a single unit goes to the sort, so a
   passage in a third of all texts makes no large task.
2. Of the other units, and of one unit of each repeated segment under the same
   anchor, the segments go to the anchor's task. Their windows are suffix
   sorted by a merge sort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes. Neighbours with
   ``window`` bytes in common, compared byte by byte, are repeated.
3. A document's repeated windows are united to spans and cut out.

An anchor with over ``GROUP`` different segments is dealt out window by window
instead, sorted by their bytes, so that no task holds a large group.

Hashes: prefix sums of byte codes times powers of an odd base, modulo 2^64.
Equality of segments rests on two of them with different codes and bases, 128
bits together.

Cases: null and empty texts keep nothing of nothing (0 bytes, 0 spans); texts
shorter than the window stay whole. Matches never cross documents. Repeated
rows are documents of their own: their windows occur in each other. Rows are
told apart by id and 128 bits of the text, so null and repeated ids do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .common import byte_codes, mix64, prepare, saved, signed, text_key

WINDOW, K = 200, 80
GROUP = 1 << 13  # different segments of one anchor that a task sorts together
_SLICE = 1 << 18  # window starts handled at once


def _powers(base: int, n: int) -> np.ndarray:
    p = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        p[done:done + k] = p[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return p


class Hasher:
    """Prefix hashes of byte strings up to ``n`` bytes."""

    def __init__(self, seed: int, base: int, n: int):
        self.codes = byte_codes(seed)
        self.up, self.down = _powers(base, n), _powers(pow(base, -1, 1 << 64), n)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        p = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:len(data)], out=p[1:])
        return p

    def of(self, p: np.ndarray, start: np.ndarray, size) -> np.ndarray:
        """Hash of ``size`` bytes from each start."""
        return (p[start + size] - p[start]) * self.down[start]


_HASHERS: dict[tuple, Hasher] = {}


def hasher(which: int, n: int) -> Hasher:
    size = max(1 << 19, 1 << int(n + 1).bit_length())
    if (which, size) not in _HASHERS:
        _HASHERS[which, size] = Hasher(11 + which, (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)[which], size)
    return _HASHERS[which, size]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[:len(x)] = x
    block = full.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def units(data: np.ndarray, window: int = WINDOW, k: int = K) -> list[np.ndarray]:
    """First window, number of windows, anchor less first window, anchor hash
    and segment hash of the units of one text. Long texts go in slices; a unit
    cut at a slice's end is only another way to state the same windows."""
    found = []
    for at in range(0, len(data) - window + 1, _SLICE):
        part = data[at:at + _SLICE + window - 1]
        one, two = hasher(0, len(part)), hasher(1, len(part))
        p = one.prefix(part)
        starts = np.arange(len(part) - k + 1)
        grams = mix64(one.of(p, starts, k))
        # least hash, the leftmost among equals: the place stands below it
        place = np.uint64(2 * _SLICE - 1)
        anchor = (sliding_min(grams & ~place | starts.astype(np.uint64), window - k + 1) & place).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        count = np.diff(np.append(first, len(anchor)))
        a = anchor[first]
        size = count + window - 1
        seg = mix64(two.of(two.prefix(part), first, size) + ((a - first) * 65536 + count).astype(np.uint64))
        found.append((first + at, count, a - first, grams[a], seg))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def _key(id_col: str, text_col: str):
    """A row's key: id and 128 bits of the text."""
    return F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("tag")


_UNIT = "anchor long, segment long, doc long, tag binary, first int, shape int"
_ALONE, _SETTLED, _STANDS = 0, 1, 2


def known_here(anchor: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Of units with equal segments the first stands for them, the others are
    settled."""
    order = np.lexsort((seg, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (seg[order][1:] == seg[order][:-1])
    out = np.zeros(len(order), np.int32)
    out[order[:-1][same]] = _STANDS
    out[order[1:][same]] = _SETTLED
    return out


def unit_rows(df: DataFrame, window: int, k: int) -> DataFrame:
    """One row per unit of (doc, tag, text) rows; shape: windows and anchor;
    known: what equal segments of the batch tell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tag, texts = b.columns
            rows, parts = [], []
            for i in range(len(texts)):
                raw = texts[i].as_buffer() if texts[i].is_valid else b""
                if len(raw) >= window:
                    got = units(np.frombuffer(raw, np.uint8), window, k)
                    parts.append(got)
                    rows.append(np.full(len(got[0]), i))
            if parts:
                first, count, d, anchor, seg = (np.concatenate(x) for x in zip(*parts))
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor)), pa.array(signed(seg)), doc.take(row), tag.take(row),
                     pa.array(first.astype(np.int32)), pa.array((count << 16 | d).astype(np.int32)),
                     pa.array(known_here(anchor, seg))],
                    ["anchor", "segment", "doc", "tag", "first", "shape", "known"])

    return df.mapInArrow(run, _UNIT + ", known int")


def sort_out(rows: DataFrame) -> DataFrame:
    """Units with what is known of them. fate 0: the segment occurs twice, all
    windows are repeated; 1: to be compared with others of its anchor; 2: as 0,
    and stands for its segment in the comparisons."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (anchor, segment). The last row is held back
        until its successor is seen, and with it whether its anchor and its
        segment occurred before."""
        held, before = None, None  # the held row, and the row before it
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            yield from decide(t, before, False)
            n = t.num_rows
            if n > 1:
                before = t.column("anchor")[n - 2].as_py(), t.column("segment")[n - 2].as_py()
            held = t.slice(n - 1).to_batches()[0]
        if held is not None:
            yield from decide(pa.Table.from_batches([held]), before, True)

    def decide(t: pa.Table, before, last: bool) -> Iterator[pa.RecordBatch]:
        anchor, seg = t.column("anchor").to_numpy(), t.column("segment").to_numpy()
        same_a, same_s = anchor[1:] == anchor[:-1], seg[1:] == seg[:-1]
        same_s &= same_a
        prev_a = np.concatenate([[before is not None and before[0] == anchor[0]], same_a])
        prev_s = np.concatenate([[before == (anchor[0], seg[0])], same_s])
        next_a, next_s = np.append(same_a, False), np.append(same_s, False)
        known = t.column("known").to_numpy()
        twice = prev_s | next_s | (known == _STANDS)
        # a segment's first row stands for it; whether its anchor has other
        # segments shows before the first or after the last of its rows, so
        # representatives are sent whenever the segment occurs twice and the
        # anchors without any fate-1 unit are dropped in the next step
        fate = np.where(twice, np.where(prev_s, 0, 2), np.where(prev_a | next_a, 1, -1))
        fate[known == _SETTLED] = 0
        keep = fate >= 0
        if not last:
            keep[-1] = False
        rows = np.flatnonzero(keep)
        if len(rows):
            out = t.drop_columns(["known"]).take(pa.array(rows)).append_column("fate", pa.array(fate[rows].astype(np.int32)))
            yield from out.combine_chunks().to_batches()

    # settled units go anywhere
    deal = F.when(F.col("known") == _SETTLED, F.xxhash64("doc", "first")).otherwise(F.col("anchor"))
    return rows.repartition(shuffle_partitions(rows.sparkSession), deal) \
        .sortWithinPartitions("anchor", "segment", F.col("known") == _SETTLED).mapInArrow(run, _UNIT + ", fate int")


class Suffixes:
    """Windows of several byte strings, to be sorted within classes."""

    def __init__(self, buffer: np.ndarray, window: int):
        self.buffer, self.window = buffer, window
        self.h = hasher(0, len(buffer))
        self.p = self.h.prefix(buffer)
        self.whole = lambda at: self.h.of(self.p, at, window)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for the windows at a against those at b."""
        out = np.zeros(len(a), np.int8)
        rest = np.flatnonzero(self.whole(a) != self.whole(b))
        a, b = a[rest], b[rest]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.window - 1)
        while len(a) and (low < high).any():  # common extension by binary search
            mid = (low + high + 1) >> 1
            same = self.h.of(self.p, a, mid) == self.h.of(self.p, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        x, y = self.buffer[a + low], self.buffer[b + low]
        out[rest] = np.where(x < y, -1, 1)
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes by window within runs of equal ``group``: a
        bottom-up merge sort of all groups at once."""
        n = len(at)
        order = np.arange(n)
        start = np.searchsorted(group, group, "left")
        end = np.searchsorted(group, group, "right")
        width, most = 1, int((end - start).max()) if n else 0
        while width < most:
            i = np.arange(n)
            run = (i - start) // width
            mine = start + run * width
            left = run % 2 == 0
            # the run that this element's run is merged with
            low = np.where(left, mine + width, mine - width)
            lo = np.minimum(low, end)
            hi = np.minimum(low + width, end)
            base = np.minimum(mine, low)
            before = lo.copy()
            active = np.flatnonzero(lo < hi)
            while len(active):  # how many of the other run come before it
                mid = (before[active] + hi[active]) >> 1
                c = self.compare(at[order[mid]], at[order[active]])
                goes = (c < 0) | ((c == 0) & ~left[active])
                before[active[goes]] = mid[goes] + 1
                hi[active[~goes]] = mid[~goes]
                active = active[before[active] < hi[active]]
            new = np.empty_like(order)
            new[base + (i - mine) + (before - lo)] = order
            order = new
            width *= 2
        return order

    def repeated(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which windows have an equal one in their group."""
        order = self.sort(at, group)
        s = at[order]
        near = np.flatnonzero((group[1:] == group[:-1]) & (self.whole(s[1:]) == self.whole(s[:-1])))
        view = np.lib.stride_tricks.sliding_window_view(self.buffer, self.window)
        equal = np.zeros(len(near), bool)
        for k in range(0, len(near), 4096):  # the bytes themselves decide
            x = near[k:k + 4096]
            equal[k:k + 4096] = (view[s[x]] == view[s[x + 1]]).all(axis=1)
        out = np.zeros(len(at), bool)
        out[order[near[equal]]] = True
        out[order[near[equal] + 1]] = True
        return out


def _compare_group(t: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of repeated windows of the rows' segments."""
    bytes_ = t.column("bytes").combine_chunks()
    bytes_ = pa.concat_arrays(bytes_.chunks) if isinstance(bytes_, pa.ChunkedArray) else bytes_
    offsets = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset:bytes_.offset + len(bytes_) + 1].astype(np.int64)
    buffer = np.frombuffer(bytes_.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    shape = t.column("shape").to_numpy().astype(np.int64)
    count, d = shape >> 16, shape & 65535
    _, anchor = np.unique(t.column("anchor").to_numpy(), return_inverse=True)
    row = np.repeat(np.arange(len(count)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    group = anchor[row] * 65536 + (d[row] - j)  # anchor, and its distance
    order = np.lexsort((row, group))
    group, row, j = group[order], row[order], j[order]
    many = np.zeros(len(group), bool)
    many[1:] = group[1:] == group[:-1]
    many[:-1] |= many[1:]
    group, row, j = group[many], row[many], j[many]
    hit = Suffixes(buffer, window).repeated(offsets[row] + j, group)
    row, j = row[hit], j[hit]
    order = np.lexsort((j, row))
    row, j = row[order], j[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(row)) - 1 if len(begin) else begin
    return row[begin], j[begin], j[last]


_CONTEXT = "anchor long, doc long, tag binary, first int, shape int, fate int, large boolean, bytes binary"


def contexts(df: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The segments of the units asked for; of a large anchor's units the
    windows one by one, keyed by a hash of their bytes."""
    per_doc = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "first", "shape", "fate", "large")).alias("wants"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, tags, texts, wants = (b.column(i) for i in range(4))
            out = []
            size = 0
            for i in range(b.num_rows):
                raw = texts[i].as_buffer().to_pybytes()
                for w in wants[i].as_py():
                    count, d, first = w["shape"] >> 16, w["shape"] & 65535, w["first"]
                    row = {"doc": docs[i].as_py(), "tag": tags[i].as_py(), "fate": w["fate"], "large": w["large"]}
                    if not w["large"]:
                        part = raw[first:first + count + window - 1]
                        out.append(row | {"anchor": w["anchor"], "first": first, "shape": w["shape"], "bytes": part})
                        size += len(part)
                    else:
                        for j in range(count):
                            part = raw[first + j:first + j + window]
                            key = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "big", signed=True)
                            out.append(row | {"anchor": key, "first": first + j, "shape": 1 << 16 | d - j, "bytes": part})
                            size += window
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("tag", pa.binary()), ("first", pa.int32()),
                        ("shape", pa.int32()), ("fate", pa.int32()), ("large", pa.bool_()), ("bytes", pa.binary())])
    # null ids join too
    return df.join(per_doc, df["doc"].eqNullSafe(per_doc["doc"]) & (df["tag"] == per_doc["tag"])) \
        .select(df["doc"], df["tag"], "text", "wants").mapInArrow(run, _CONTEXT)


def compare(rows: DataFrame, window: int) -> DataFrame:
    """(doc, tag, first, until): byte spans of windows found repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (large, anchor, bytes). Whole anchors are
        gathered up to a few thousand segments, then sorted; windows of large
        anchors are compared with their neighbours as they pass."""
        held: list[pa.RecordBatch] = []
        n_held, previous = 0, None
        for b in batches:
            n_small = int(np.searchsorted(b.column("large").to_numpy(zero_copy_only=False), True))
            if n_small:
                small = b.slice(0, n_small)
                key = small.column("anchor").to_numpy()
                cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
                if held and held[-1].column("anchor")[-1].as_py() != key[0]:
                    cuts = np.append(0, cuts)
                if n_held + n_small > 2048 and len(cuts):
                    if cuts[-1]:
                        held.append(small.slice(0, cuts[-1]))
                    if held:
                        yield from spans(held)
                    held, n_held = [], 0
                    small = small.slice(cuts[-1])
                held.append(small)
                n_held += small.num_rows
            if n_small < b.num_rows:
                if held:
                    yield from spans(held)
                    held, n_held = [], 0
                large = b.slice(n_small)
                if previous is not None:
                    large = pa.Table.from_batches([previous, large]).combine_chunks().to_batches()[0]
                yield from neighbours(large, previous is not None)
                previous = large.slice(large.num_rows - 1)
        if held:
            yield from spans(held)

    def spans(held) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        row, j, last = _compare_group(t, window)
        mine = t.column("fate").to_numpy()[row] == 1
        row, j, last = row[mine], j[mine], last[mine]
        if len(row):
            at = t.column("first").to_numpy()[row]
            pick = pa.array(row)
            yield out_batch(t.column("doc").take(pick), t.column("tag").take(pick), at + j, at + last + window)

    def neighbours(t: pa.RecordBatch, overlap: bool) -> Iterator[pa.RecordBatch]:
        key, data = t.column("anchor").to_numpy(), t.column("bytes").to_pylist()
        d = t.column("shape").to_numpy()
        same = np.array([key[i] == key[i + 1] and d[i] == d[i + 1] and data[i] == data[i + 1]
                         for i in range(len(key) - 1)], bool)
        hit = np.append(same, False) | np.insert(same, 0, False)
        row = np.flatnonzero(hit & (t.column("fate").to_numpy() == 1))
        if len(row):
            at = t.column("first").to_numpy()[row]
            pick = pa.array(row)
            yield out_batch(t.column("doc").take(pick), t.column("tag").take(pick), at, at + window)

    def out_batch(doc, tag, first, until):
        one = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        flat = lambda x: pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
        return pa.RecordBatch.from_arrays(
            [flat(one(doc)), flat(one(tag)), pa.array(first.astype(np.int32)), pa.array(until.astype(np.int32))],
            ["doc", "tag", "first", "until"])

    return rows.repartition(shuffle_partitions(rows.sparkSession), "anchor") \
        .sortWithinPartitions("large", "anchor", "shape", "bytes") \
        .mapInArrow(run, "doc long, tag binary, first int, until int")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   k: int = K, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(doc, tag, text) rows, and (doc, tag, first, until) byte spans of
    repeated windows in them, overlapping and in any order."""
    spark = df.sparkSession
    prepare(spark)
    rows = df.select(*_key(id_col, text_col), F.col(text_col).alias("text"))
    found = saved(sort_out(unit_rows(rows, window, k)), "units")
    whole = found.where("fate <> 1").select(
        "doc", "tag", "first", (F.col("first") + F.shiftright("shape", 16) + F.lit(window - 1)).alias("until"))
    sizes = found.where("fate > 0").groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("fate").alias("least")) \
        .where("n > 1 AND least = 1").select("anchor", (F.col("n") > group).alias("large"))
    asked = found.where("fate > 0").join(sizes, "anchor")
    parts = compare(contexts(rows, asked, window), window)
    return rows, whole.unionByName(parts)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K,
          group: int = GROUP, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, tag, kept, n_bytes, n_spans) for every row: the bytes that are
    left of its text, and how many runs were removed; the columns named in
    ``keep`` come as one struct ``row``."""
    _, spans = repeated_spans(df, id_col, text_col, window, k, group)
    per_doc = spans.groupBy(F.col("doc").alias("d"), F.col("tag").alias("t")) \
        .agg(F.collect_list(F.struct("first", "until")).alias("spans"))
    rows = df.select(*_key(id_col, text_col), F.col(text_col).alias("text"),
                     *([F.struct(*keep).alias("row")] if keep else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, size, n_spans = [], [], []
            for text, found in zip(b.column("text"), b.column("spans")):
                raw = text.as_py().encode() if text.is_valid else b""
                left, n, end = [], 0, 0
                if found.is_valid:
                    first, until = found.values.field("first").to_numpy(), found.values.field("until").to_numpy()
                    order = np.argsort(first, kind="stable")
                    for x, y in zip(first[order].tolist(), until[order].tolist()):
                        if x > end or not n:
                            left.append(raw[end:x])
                            n += 1
                        end = max(end, y)
                left.append(raw[end:])
                kept.append(b"".join(left))
                size.append(len(raw))
                n_spans.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), b.column("tag"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(n_spans, pa.int64()), *b.columns[4:]],
                ["doc", "tag", "kept", "n_bytes", "n_spans", *b.schema.names[4:]])

    joined = rows.join(per_doc, rows["doc"].eqNullSafe(per_doc["d"]) & (rows["tag"] == per_doc["t"]), "left") \
        .select("doc", "tag", "text", "spans", *(["row"] if keep else []))
    kept_types = "".join(f", {f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[4:])
    return joined.mapInArrow(run, "doc long, tag binary, kept binary, n_bytes long, n_spans long" + kept_types)


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K,
           group: int = GROUP) -> DataFrame:
    out = dedup(df, id_col, text_col, window, k, group)
    return out.select(
        F.col("doc").alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
