"""Deterministic train/test split and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import with_scalar
from ..functions.scalar import with_scalar
from .prefix import running_sums

# Seed and test fraction of the reference's training job.
SEED = 42
TEST_FRACTION = 0.2


def hash_order(id_col: str = "id", seed: int = SEED):
    """md5 of "<id><seed>": the same text in Spark and DuckDB."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))


def _cut_off(df: DataFrame, frac: float, seed: int, by: str | None, id_col: str, buckets: int | None) -> DataFrame:
    """Per group the (hash, id) of the last row that belongs to the test part:
    the ceil(frac * n_group)-th in hash order. Only ids, hashes and groups are
    shuffled, as a bucketed running count, so a class with most rows is still
    spread over many tasks."""
    groups = [by] if by else []
    h = hash_order(id_col, seed)
    # 15 leading hex digits as a number: monotone with the hash text.
    x = df.select(*groups, F.col(id_col), h.alias("_h")) \
        .withColumn("_hk", F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))
    ps = running_sums(x, ["_hk", "_h", id_col], {"_pos": F.lit(1).cast("long")}, by=groups, buckets=buckets)
    if groups:
        # one row per group; adaptive execution sizes the join
        ps = ps.join(x.groupBy(*groups).agg(F.count(F.lit(1)).alias("_gn")), on=groups, how="left")
    else:
        ps = ps.withColumn("_gn", x.agg(F.count(F.lit(1))).scalar())
    return ps.where(F.col("_pos") <= F.ceil(F.lit(float(frac)) * F.col("_gn"))) \
        .groupBy(*groups).agg(F.max(F.struct("_h", id_col)).alias("_cut"))


def split(df: DataFrame, frac: float = TEST_FRACTION, seed: int = SEED, by: str | None = None,
          id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """Add ``split`` in {'train','test'}: within each ``by`` group (the label
    for a stratified split), rows ordered by md5(id||seed); the first
    ceil(frac * n_group) are test. Exact and reproducible in SQL."""
    return split_multi(df, {"split": by}, frac, seed, id_col, buckets)


def split_multi(df: DataFrame, outputs: dict[str, str | None], frac: float = TEST_FRACTION,
                seed: int = SEED, id_col: str = "id", buckets: int | None = None) -> DataFrame:
    """Several splits: ``outputs`` maps an output column to the column to
    stratify by (None = not stratified). Each compares rows with their group's
    cut-off; the rows themselves are not shuffled for it."""
    out = df
    for name, by in outputs.items():
        cut = _cut_off(df, frac, seed, by, id_col, buckets)
        out = out.join(cut, on=by, how="left") if by else with_scalar(out, "_cut", cut.select("_cut._h", f"_cut.{id_col}"))
        test = F.struct(hash_order(id_col, seed).alias("_h"), F.col(id_col)) <= F.col("_cut")
        out = out.withColumn(name, F.when(test, "test").otherwise("train")).drop("_cut")
    return out.select(*df.columns, *outputs)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """'balanced' weights n / (k * n_c), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k"))
    return with_scalar(counts, "_t", tot).select(
        label, "n_c", (F.col("_t.n") / (F.col("_t.k") * F.col("n_c"))).cast("double").alias("weight"))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight",
                       positive_weight: float | None = None) -> DataFrame:
    """Attach a weight column: balanced weights (one row per class, joined
    without a hint so adaptive execution broadcasts it once measured) or,
    with ``positive_weight``, that weight on label 1 and 1.0 else."""
    if positive_weight is not None:
        return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(positive_weight)))
                             .otherwise(F.lit(1.0)))
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(w, on=label, how="left")
