"""Model evaluation: ROC/PR curves, exact AUC, confusion counts,
classification report and regression errors. Curves and AUC are prefix sums
over scores grouped by value, so the work is a grouped count plus one
bucketed running sum, never a global sort on one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import with_scalar
from .prefix import BUCKET, running_sums


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score; map-side partial aggregation."""
    return df.where(F.col(score).isNotNull()).groupBy(score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def _desc_prefix(df: DataFrame, label: str, score: str, buckets=None) -> DataFrame:
    """Counts of positives/negatives with score >= s, per distinct s, and
    ``k`` = 1-based position of s in descending order."""
    sc = score_counts(df, label, score).withColumn("_key", -F.col(score))
    ps = running_sums(sc, ["_key"], {"tp": F.col("pos"), "fp": F.col("neg"),
                                     "k": F.lit(1).cast("long")}, buckets=buckets,
                      edge_source=df.select((-F.col(score)).alias("_key")))
    return ps.drop("_key", BUCKET)


def _totals(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: P (positives) and N (negatives) among scored rows."""
    return df.where(F.col(score).isNotNull()).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("P"),
        F.sum((F.col(label) != 1).cast("long")).alias("N"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties counted half (Mann-Whitney).
    The numerator is a sum of half-integers, exact in doubles."""
    sc = score_counts(df, label, score)
    ps = running_sums(sc, [score], {"neg_below": F.col("neg")}, inclusive=False, buckets=buckets,
                      edge_source=df.select(score))
    num = ps.agg(F.sum(F.col("pos").cast("double") *
                       (F.col("neg_below").cast("double") + F.lit(0.5) * F.col("neg"))).alias("u"))
    num = with_scalar(num, "_t", _totals(df, label, score))
    return num.select(F.try_divide(F.col("u"), (F.col("_t.P") * F.col("_t.N")).cast("double")).alias("roc_auc"),
                      F.col("_t.P").alias("n_pos"), F.col("_t.N").alias("n_neg"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score",
               buckets: int | None = None, drop_intermediate: bool = False) -> DataFrame:
    """One point per distinct threshold (score >= threshold is positive):
    threshold, tp, fp, tpr, fpr. With ``drop_intermediate`` the curve is
    the compact form: points where neither count bends are dropped (the
    neighbours come from equi-joins on the threshold position, not a
    global window) and a (0, 0) point at threshold +inf leads."""
    ps = _desc_prefix(df, label, score, buckets)
    if drop_intermediate:
        prev = ps.select((F.col("k") + 1).alias("k"), F.col("tp").alias("tp_p"), F.col("fp").alias("fp_p"))
        nxt = ps.select((F.col("k") - 1).alias("k"), F.col("tp").alias("tp_n"), F.col("fp").alias("fp_n"))
        j = ps.join(prev, "k", "left").join(nxt, "k", "left")
        bend = (F.col("tp_n") - 2 * F.col("tp") + F.col("tp_p") != 0) | \
            (F.col("fp_n") - 2 * F.col("fp") + F.col("fp_p") != 0)
        kept = j.where(F.col("tp_p").isNull() | F.col("tp_n").isNull() | bend).select(score, "tp", "fp")
        start = df.sparkSession.range(1).select(F.lit(float("inf")).alias(score), F.lit(0).cast("long").alias("tp"),
                                                F.lit(0).cast("long").alias("fp"))
        ps = start.unionByName(kept)
    ps = with_scalar(ps, "_t", _totals(df, label, score))
    return ps.select(F.col(score).alias("threshold"), "tp", "fp",
                     F.try_divide(F.col("tp"), F.col("_t.P")).cast("double").alias("tpr"),
                     F.try_divide(F.col("fp"), F.col("_t.N")).cast("double").alias("fpr"))


def pr_points(df: DataFrame, label: str = "label", score: str = "score",
              buckets: int | None = None, stop_at_full_recall: bool = False,
              end_point: bool | None = None) -> DataFrame:
    """Precision and recall per distinct threshold. ``end_point`` adds the
    point (precision 1, recall 0, no threshold) that curve tools append;
    ``stop_at_full_recall`` leaves out thresholds below the first one that
    reaches full recall (older tool versions; implies the end point)."""
    out = with_scalar(_desc_prefix(df, label, score, buckets), "_t", _totals(df, label, score))
    if stop_at_full_recall:
        out = out.where(F.col("tp") - F.col("pos") < F.col("_t.P"))
    res = out.select(F.col(score).alias("threshold"),
                     (F.col("tp") / (F.col("tp") + F.col("fp"))).cast("double").alias("precision"),
                     F.try_divide(F.col("tp"), F.col("_t.P")).cast("double").alias("recall"))
    if end_point or (end_point is None and stop_at_full_recall):
        end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                              F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
        res = res.unionByName(end)
    return res


def predictions(df: DataFrame, score: str = "score", threshold: float = 0.5,
                out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= threshold).cast("int"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """2x2 counts in long form (label, prediction, count), zeros included."""
    c = df.agg(*[F.sum(((F.col(label) == a) & (F.col(prediction) == b)).cast("long"))
                 .alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    cells = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"),
                               F.coalesce(F.col(f"c{a}{b}"), F.lit(0)).alias("count"))
                      for a in (0, 1) for b in (0, 1)])
    return c.select(F.inline(cells))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision/recall/F1/support, plus accuracy, macro and
    weighted averages (rows named '0','1','macro avg','weighted avg','accuracy').
    Undefined ratios are 0, as in the common report convention."""
    c = df.agg(*[F.sum(((F.col(label) == a) & (F.col(prediction) == b)).cast("long"))
                 .alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])

    def z(x):
        return F.coalesce(x, F.lit(0.0))

    per = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = F.col(f"c{k}{k}"), F.col(f"c{o}{k}"), F.col(f"c{k}{o}")
        p = z(F.try_divide(tp, tp + fp).cast("double"))
        rc = z(F.try_divide(tp, tp + fn).cast("double"))
        f1 = z(F.try_divide(2 * p * rc, p + rc))
        per.append((str(k), p, rc, f1, (tp + fn).cast("double")))
    n = (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")).cast("double")
    acc = z(F.try_divide((F.col("c00") + F.col("c11")).cast("double"), n))
    rows = [F.struct(F.lit(nm).alias("class"), p.alias("precision"), rc.alias("recall"),
                     f1.alias("f1"), s.alias("support")) for nm, p, rc, f1, s in per]
    macro = [(per[0][i] + per[1][i]) / 2 for i in (1, 2, 3)]
    weighted = [z(F.try_divide(per[0][i] * per[0][4] + per[1][i] * per[1][4], n)) for i in (1, 2, 3)]
    rows.append(F.struct(F.lit("macro avg").alias("class"), macro[0].alias("precision"),
                         macro[1].alias("recall"), macro[2].alias("f1"), n.alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("class"), weighted[0].alias("precision"),
                         weighted[1].alias("recall"), weighted[2].alias("f1"), n.alias("support")))
    rows.append(F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"),
                         acc.alias("recall"), acc.alias("f1"), n.alias("support")))
    return c.select(F.inline(F.array(*rows)))


def accuracy_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    rep = class_report(df, label, prediction)
    return rep.agg(F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
                   F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("f1_weighted"))


def accuracy_f1_from_counts(cm: dict) -> dict:
    """Accuracy and support-weighted F1 from the four confusion counts
    {(label, prediction): count} (same conventions as ``class_report``)."""
    n = sum(cm.values())
    if n == 0:
        return {"accuracy": 0.0, "f1_weighted": 0.0}
    f1w = 0.0
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = cm.get((k, k), 0), cm.get((o, k), 0), cm.get((k, o), 0)
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        f1w += f1 * (tp + fn)
    return {"accuracy": (cm.get((0, 0), 0) + cm.get((1, 1), 0)) / n, "f1_weighted": f1w / n}


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """rmse, mae, r2 in one aggregate pass (r2 from the centred sum of squares)."""
    err = F.col(prediction) - F.col(label)
    a = df.agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("sse"),
               F.sum(F.abs(err)).alias("sae"), F.var_pop(label).alias("vp"))
    return a.select(
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.col("sse"), F.col("vp") * F.col("n"))).alias("r2"),
        F.col("n").alias("n_samples"))


# Z of a two-sided 95 % interval; fallback relative width.
Z95 = 1.96
FALLBACK_RMSE_SHARE = 0.2


def interval_95(df: DataFrame, prediction: str = "prediction", rmse=None) -> DataFrame:
    """pred +- 1.96*RMSE, lower bound clipped at 0, both rounded 2dp. With no
    RMSE known the half-width uses 0.2 * prediction."""
    from ..functions.scalar import round_half_up
    p = F.col(prediction)
    e = (rmse if isinstance(rmse, Column) else F.lit(float(rmse))) if rmse is not None else p * F.lit(FALLBACK_RMSE_SHARE)
    return df.withColumn("lower_bound_ms", round_half_up(F.greatest(F.lit(0.0), p - F.lit(Z95) * e), 2)) \
        .withColumn("upper_bound_ms", round_half_up(p + F.lit(Z95) * e, 2)) \
        .withColumn("confidence_level", F.lit(0.95))
