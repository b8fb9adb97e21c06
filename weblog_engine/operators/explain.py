"""Per-row feature contributions as Shapley values.

``exact`` gives those of a tree ensemble over its cover-weighted trees (see
``treeshap``; boosted trees in log-odds, a random forest in probability) and of
a linear or logistic model (coefficient * (value - mean), in log-odds), for every
row unless ``n_rows`` bounds them.

``shapley`` is a sampled form for any model. For an explained row x, a permutation p of the features and a background
row b, the chain z_0 = b, z_j = z_{j-1} with feature p_j taken from x
gives feature p_j the contribution f(z_j) - f(z_{j-1}); the contributions
of one chain add up to f(x) - f(b) exactly. Averaging over chains gives
the estimate. Chains are rows of a DataFrame scored by the model in one
``transform``; nothing is done per row on the driver.

Sizes are parameters: ``n_rows`` explained rows (the first by a seeded
hash, 200 by default), ``n_chains`` chains per row, ``n_background``
background rows. Each explained row pairs with the background row and the
permutation picked by its chain number (an equi-join on a computed index,
not a product of the two tables)."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import treeshap
from .native import NativeModel
from .split import hash_order
from .train import Trained, forest_nodes, positive_score

SAMPLE_ROWS = 200


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = 42, id_col: str = "id") -> DataFrame:
    """At most ``n`` rows chosen by a seeded hash of the id (a sampling
    operator: the limit is the feature)."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def exact(trained: Trained, df: DataFrame, n_rows: int | None = None, seed: int = 42, id_col: str = "id") -> DataFrame:
    """(id, feature, contribution, mean) of all rows of ``df``, or of ``n_rows`` of
    them; mean plus the contributions is the model's output (log-odds, probability
    or value)."""
    feats, x = list(trained.features), df if n_rows is None else sample_rows(df, n_rows, seed, id_col)
    est = trained.model if isinstance(trained.model, NativeModel) else trained.model.stages[-1]
    if isinstance(est, NativeModel) and est.kind == "boosted":
        m = est.model
        scale, shift = (1.0, m.base) if m.objective == "logistic" else (m.scale, m.centre + m.scale * m.base)
        out = treeshap.shapley(x, m.nodes, feats, id_col)
        return out.withColumn("contribution", F.col("contribution") * scale).withColumn("mean", F.col("mean") * scale + shift)
    if isinstance(est, NativeModel) and est.kind == "forest":
        return treeshap.shapley(x, est.model.nodes, feats, id_col)
    if hasattr(est, "trees"):
        path = scratch_path(df.sparkSession, f"forest-{uuid.uuid4().hex}")
        return treeshap.shapley(x, forest_nodes(trained.model, path), feats, id_col)
    weights = est.model.coefficients if isinstance(est, NativeModel) else est.coefficients.toArray().tolist()
    intercept = est.model.intercept if isinstance(est, NativeModel) else est.intercept
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first()
    mean = intercept + sum(b * means[f] for f, b in zip(feats, weights))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(b) * (F.col(f).cast("double") - F.lit(means[f]))).alias("contribution"))
                      for f, b in zip(feats, weights)])
    return x.select(id_col, F.inline(cells)).withColumn("mean", F.lit(mean))


def shapley(trained: Trained, df: DataFrame, n_rows: int = SAMPLE_ROWS, n_chains: int = 16,
            n_background: int = 32, seed: int = 42, id_col: str = "id") -> DataFrame:
    feats = list(trained.features)
    d = len(feats)
    rng = random.Random(seed)
    perms = [rng.sample(range(d), d) for _ in range(n_chains)]
    spark = df.sparkSession
    # rank_of[k] = position of feature k in the permutation (bounded: n_chains x d).
    perm_df = spark.createDataFrame([(c, [p.index(k) for k in range(d)]) for c, p in enumerate(perms)],
                                    "chain int, rank_of array<int>")
    x = sample_rows(df, n_rows, seed, id_col).select(id_col, *feats)
    bg = sample_rows(df, n_background, seed + 1, id_col).select(*feats)
    # Index the background rows: at most n_background rows (a parameter),
    # so this small ordered window is bounded.
    bg = bg.withColumn("_bi", F.row_number().over(Window.orderBy(*feats)) - 1)
    n_bg = max(1, bg.count())          # bounded by n_background
    chains = x.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(n_chains - 1)))) \
        .withColumn("_bi", F.pmod(F.xxhash64(F.col(id_col), F.col("chain"), F.lit(seed)), F.lit(n_bg)))
    chains = chains.join(F.broadcast(bg.select("_bi", *[F.col(f).alias(f"_b_{f}") for f in feats])), "_bi") \
        .join(F.broadcast(perm_df), "chain")
    steps = chains.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    hybrid = steps.select(id_col, "chain", "step", "rank_of",
                          *[F.when(F.col("rank_of")[k] < F.col("step"), F.col(f)).otherwise(F.col(f"_b_{f}"))
                            .alias(f) for k, f in enumerate(feats)])
    scored = trained.model.transform(hybrid)
    if "probability" in scored.columns:
        scored = positive_score(scored)
    else:
        scored = scored.withColumn("score", F.col("prediction"))
    w = Window.partitionBy(id_col, "chain").orderBy("step")
    delta = scored.select(id_col, "chain", "step", "rank_of",
                          (F.col("score") - F.lag("score").over(w)).alias("delta")).where(F.col("step") > 0)
    # The feature added at step s is the one whose rank is s - 1.
    names = F.array(*[F.lit(f) for f in feats])
    added = F.array_position(F.col("rank_of"), F.col("step") - 1).cast("int")
    contrib = delta.select(id_col, F.element_at(names, added).alias("feature"), "delta")
    return contrib.groupBy(id_col, "feature").agg(F.avg("delta").alias("contribution"),
                                                  F.count(F.lit(1)).alias("n_chains"))


def base_and_total(trained: Trained, df: DataFrame, contributions: DataFrame, id_col: str = "id") -> DataFrame:
    """Per explained row: the model output and the sum of contributions (for
    checks: output - sum equals the mean output over the paired background)."""
    scored = trained.model.transform(df.join(contributions.select(id_col).distinct(), id_col))
    if "probability" in scored.columns:
        scored = positive_score(scored)
    else:
        scored = scored.withColumn("score", F.col("prediction"))
    tot = contributions.groupBy(id_col).agg(F.sum("contribution").alias("total"))
    return scored.select(id_col, "score").join(tot, id_col)
