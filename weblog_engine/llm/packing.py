"""Packing documents into length buckets and token-budget batches.

The global histogram of lengths (words) is counted exactly. Dynamic programming
over it chooses the bucket boundaries with the least total padding: for one more
bucket the best boundary before each length is the lower hull of straight lines,
walked once, in whole numbers. Inside a bucket, batches take as many documents as
the token budget holds at the bucket's length. Documents are numbered in their
bucket from the counts of its parts, so no task needs a whole bucket.

The histogram has a row for each length that occurs, at most as many as the
longest text has words (n different lengths take n^2 / 2 words); it is all that
the driver holds.

Cases: null and empty texts and texts without words have length 0 and take the
first bucket; a document over the budget is a batch of its own. Rows with the
same id are numbered in order of id and text; an empty table gives an empty
one; other columns, whatever their names, pass through unless they are named like
those added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BUCKETS, BUDGET, PARTS = 16, 16384, 256


def n_tokens(text: Column) -> Column:
    """Number of words (runs between white space)."""
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]++")
    return F.size(F.array_remove(words, "")).cast("long")


def best_buckets(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least padding, where
    every document is padded to its bucket's end. ``lengths`` ascend."""
    n = len(lengths)
    if not n:
        return []
    below, words = [0], [0]  # documents and words of the first so many lengths
    for x, c in zip(lengths, counts):
        below.append(below[-1] + c)
        words.append(words[-1] + x * c)
    best: list = [0] + [None] * n  # least padding of the first so many lengths
    choices = []
    for _ in range(min(buckets, n)):
        now: list = [None] * (n + 1)
        choice = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # lines (slope, height, start), slopes fall
        at = 0
        for end in range(1, n + 1):
            start = end - 1
            if best[start] is not None:
                # a last bucket of lengths start..end-1 pads by top * (documents) - (words)
                line = (-below[start], best[start] + words[start], start)
                while len(hull) > 1 and _never_least(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if not hull:
                continue
            top = lengths[end - 1]
            value = lambda x: x[0] * top + x[1]
            while at + 1 < len(hull) and value(hull[at + 1]) <= value(hull[at]):
                at += 1
            choice[end] = hull[at][2]
            now[end] = value(hull[at]) + top * below[end] - words[end]
        best = now
        choices.append((now[n], choice))
    used = min((k for k in range(len(choices)) if choices[k][0] is not None), key=lambda k: choices[k][0])
    ends, at = [], n
    for k in range(used, -1, -1):
        ends.append(lengths[at - 1])
        at = choices[k][1][at]
    return ends[::-1]


def _never_least(a: tuple, b: tuple, c: tuple) -> bool:
    """Of lines with falling slopes: the middle one is nowhere below both others."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
         budget: int = BUDGET, parts: int = PARTS) -> DataFrame:
    """Adds n_tokens, bucket, bucket_len, batch_id, batch_pos and padding."""
    added = ["n_tokens", "bucket", "bucket_len", "batch_id", "batch_pos", "padding"]
    kept = [c for c in df.columns if c not in added]
    # other columns travel as one, whatever their names; id and text, which order
    # the rows, beside them, so that a text is moved once
    others = [c for c in kept if c not in (id_col, text_col)]
    rows = df.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row"),
                     F.col(id_col).alias("id"), F.col(text_col).alias("text"), n_tokens(F.col(text_col)).alias("n_tokens"),
                     F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("int").alias("part"))
    sizes = saved(rows.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = sizes.groupBy("n_tokens").agg(F.sum("n").alias("n")).orderBy("n_tokens").toArrow()
    ends = best_buckets(histogram.column("n_tokens").to_pylist(), histogram.column("n").to_pylist(), buckets)
    bucket_of = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(i)) for i, e in enumerate(ends)]) if ends else F.lit(0)
    # documents of the bucket in parts before this one: buckets x parts rows
    before = sizes.withColumn("bucket", bucket_of).groupBy("bucket", "part").agg(F.sum("n").alias("n")) \
        .withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n")) \
        .select("bucket", "part", "before")
    length = F.element_at(F.array(*[F.lit(int(e)).cast("long") for e in ends or [0]]), F.col("bucket") + 1)
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(length, F.lit(1)))).cast("long")
    in_part = Window.partitionBy("bucket", "part").orderBy("id", "text")
    index = F.col("before") + F.row_number().over(in_part) - 1
    back = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col("row")[f"c{i}"] for i, c in enumerate(others)}
    # every part of a bucket is in ``before``; a left join spares the null check
    # on its keys, which would count the words of each text many times over
    return rows.withColumn("bucket", bucket_of).join(F.broadcast(before), ["bucket", "part"], "left") \
        .withColumn("index", index.cast("long")).withColumn("bucket_len", length) \
        .withColumn("batch_id", F.floor(F.col("index") / per_batch)) \
        .withColumn("batch_pos", (F.col("index") % per_batch).cast("int")) \
        .withColumn("padding", F.col("bucket_len") - F.col("n_tokens")) \
        .select(*[back[c].alias(c) for c in kept], *added)
