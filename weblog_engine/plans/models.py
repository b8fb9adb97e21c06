"""Queries of trained models: the forest and its uses, least squares, boosted
trees, attributions, the training job and its records.

The isolation forest, least squares and the first boosted tree are functions of
the table alone, and their oracles fit them again in SQL. The candidates that the
training job compares are not, in SQL; their queries have no oracle."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import functions as F

from ..functions.scalar import round_half_up
from ..operators import (anomaly, boost, drift, explain, features, iforest, ols, score, split, train as training,
                         training_job)
from ..session import scratch_path
from ..sources.tables import table, weblogs
from .catalog import _FEATURES_CTE, _requests
from .registry import register
from .sql import r, with_weblogs

CLF, REG = features.CLASSIFICATION_FEATURES, features.REGRESSION_FEATURES

# --- isolation forest ------------------------------------------------------------

K = len(CLF)
_LO = "[" + ", ".join(f"lo{i}" for i in range(K)) + "]"
_HI = "[" + ", ".join(f"hi{i}" for i in range(K)) + "]"
_USABLE = "list_filter([" + ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i + 1} END" for i in range(K)) + \
    "], lambda v: v IS NOT NULL)"


def _draw(at: int) -> str:
    return f"(CAST(('0x' || substr(md5(tree || '|' || node || '|{iforest.SEED}'), {at}, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def _split_of(source: str) -> str:
    """The split of each node of ``source``, which has lo, hi, size and depth."""
    return f"""SELECT *, list_extract({_LO}, f) + {_draw(9)} * (list_extract({_HI}, f) - list_extract({_LO}, f)) AS threshold
    FROM (SELECT *, CASE WHEN size > 1 AND depth < max_depth AND len({_USABLE}) > 0 THEN
                 list_extract({_USABLE}, CAST(floor({_draw(1)} * len({_USABLE})) AS BIGINT) + 1) END AS f FROM ({source}))"""


_ENDS = ", ".join(f"min(x[{i + 1}]) {{w}} AS lo{i}, max(x[{i + 1}]) {{w}} AS hi{i}" for i in range(K))
_PATH = "CASE WHEN size <= 1 THEN CAST(0 AS DOUBLE) WHEN size = 2 THEN CAST(1 AS DOUBLE) ELSE " \
        "CAST(2 AS DOUBLE) * (ln(CAST(size - 1 AS DOUBLE)) + CAST(0.5772156649015329 AS DOUBLE)) " \
        "- CAST(2 AS DOUBLE) * CAST(size - 1 AS DOUBLE) / CAST(size AS DOUBLE) END"
_X = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in CLF) + "] AS x"

FOREST = [f"""fp AS (
  SELECT n, psi, least({iforest.N_TREES}, greatest(1, n // psi)) AS per_round,
         CAST(ceil(log2(greatest(psi, 2))) AS INTEGER) AS max_depth
  FROM (SELECT count(*) AS n, least({iforest.MAX_SAMPLES}, count(*)) AS psi FROM feats))""",
          f"""sample AS MATERIALIZED (
  SELECT CAST(round * per_round + place // psi AS INTEGER) AS tree, x
  FROM (SELECT round, {_X}, row_number() OVER (PARTITION BY round ORDER BY md5(id || '|' || round || '|{iforest.SEED}'), id) - 1 AS place
        FROM feats, (SELECT unnest(range(0, CAST(ceil(CAST({iforest.N_TREES} AS DOUBLE) / per_round) AS BIGINT))) AS round FROM fp)), fp
  WHERE place < per_round * psi AND round * per_round + place // psi < {iforest.N_TREES})""",
          f"""grown AS (
  SELECT tree, CAST(1 AS BIGINT) AS node, 0 AS depth, x FROM sample
  UNION ALL
  SELECT tree, 2 * node + CASE WHEN x[f] <= threshold THEN 0 ELSE 1 END, depth + 1, x
  FROM ({_split_of("SELECT g.*, max_depth, count(*) OVER w AS size, " + _ENDS.format(w="OVER w")
                   + " FROM grown g, fp WINDOW w AS (PARTITION BY tree, node)")}) WHERE f IS NOT NULL)""",
          f"""nodes AS MATERIALIZED (
  SELECT tree, node, f, threshold, depth * CAST({iforest.UNIT} AS BIGINT)
         + CAST(round(({_PATH}) * CAST({iforest.UNIT} AS DOUBLE)) AS BIGINT) AS path
  FROM ({_split_of("SELECT tree, node, depth, max_depth, count(*) AS size, " + _ENDS.format(w="")
                   + " FROM grown, fp GROUP BY tree, node, depth, max_depth")}))""",
          f"""cn AS (SELECT {_PATH.replace("size", "psi")} AS c_psi, n, psi FROM fp)"""]


def _walked(name: str, rows: str) -> list[str]:
    """The path sums (id, s) of the rows (id, x) of ``rows`` as table ``name``,
    and their scores."""
    out = [f"{name}_x AS MATERIALIZED ({rows})",
           f"{name}_0 AS (SELECT id, tree, CAST(1 AS BIGINT) AS node FROM {name}_x, (SELECT DISTINCT tree FROM nodes))"]
    for level in range(8):
        out.append(f"""{name}_{level + 1} AS MATERIALIZED (
  SELECT id, w.tree, CASE WHEN f IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN x[f] <= threshold THEN 0 ELSE 1 END END AS node
  FROM {name}_{level} w JOIN {name}_x USING (id) JOIN nodes n ON n.tree = w.tree AND n.node = w.node)""")
    return [*out, f"{name}_s AS (SELECT id, CAST(sum(path) AS BIGINT) AS s FROM {name}_8 w JOIN nodes n ON n.tree = w.tree "
                  "AND n.node = w.node GROUP BY id)",
            f"""{name} AS MATERIALIZED (SELECT id, s, -pow(CAST(2 AS DOUBLE), -(CAST(s AS DOUBLE) / CAST({iforest.N_TREES} AS DOUBLE)
  / CAST({iforest.UNIT} AS DOUBLE)) / c_psi) AS score FROM {name}_s, cn)"""]


_P = f"CAST({iforest.CONTAMINATION} AS DOUBLE) * (n - 1)"
SCORED = [*FOREST, *_walked("trained", f"SELECT id, {_X} FROM feats"), f"""offs AS (
  SELECT lo + (hi - lo) * (p - floor(p)) AS offs FROM (
    SELECT any_value({_P}) AS p, max(CASE WHEN k = floor({_P}) THEN score END) AS lo,
           max(CASE WHEN k = ceil({_P}) THEN score END) AS hi
    FROM (SELECT score, row_number() OVER (ORDER BY s) - 1 AS k FROM trained), cn))"""]


def _recursive(*ctes: str) -> str:
    return with_weblogs(_FEATURES_CTE, *ctes).replace("WITH", "WITH RECURSIVE", 1)


def _features(spark, d):
    """The features of all logs, the columns that models take. They come from
    shuffles and windows and feed many passes (moments, samples, edges, scores):
    they are worked out once and go to the shared folder."""
    path = scratch_path(spark, f"features-{uuid.uuid4().hex}")
    features.engineer_features(weblogs(spark, d)).select("id", "response_time_ms", *REG).write.parquet(path)
    return spark.read.parquet(path)


def _detector(spark, d) -> tuple:
    """Features of all logs and the detector fitted on them."""
    feats = _features(spark, d)
    return feats, anomaly.fit_detector(feats, CLF)


def _forest(spark, d):
    feats, det = _detector(spark, d)
    return iforest.score(feats, det.forest).select("id", round_half_up("if_score", 6).alias("if_score"), "if_anomaly")


register("isolation_forest", _recursive(*SCORED) + f"""
SELECT id, {r("score - offs", 6)} AS if_score, score - offs < 0 AS if_anomaly FROM trained, offs""")(_forest)


def _detect_batch(spark, d):
    feats, det = _detector(spark, d)
    return anomaly.detect_batch(feats, det).select("id", "is_anomaly", round_half_up("anomaly_score", 6).alias("anomaly_score"))


register("detect_batch", _recursive(
    *SCORED, "zm AS (SELECT avg(response_time_ms) AS m, stddev_pop(response_time_ms) AS sd FROM feats)") + f"""
SELECT id, score - offs < 0 OR coalesce(abs((response_time_ms - m) / nullif(sd, 0)) > 3, false) AS is_anomaly,
       {r("score - offs", 6)} AS anomaly_score
FROM trained JOIN feats USING (id), offs, zm""")(_detect_batch)

# Anomaly requests: one a log row; every seventh asks with a negative time.


def _anomaly_requests(spark, d):
    time = F.when(F.col("id") % 7 == 3, -F.col("response_time_ms")).otherwise(F.col("response_time_ms"))
    return weblogs(spark, d).select("id", "method", F.hour("timestamp").alias("hour"),
                                    F.weekday("timestamp").alias("day_of_week"), time.alias("response_time_ms"))


def _detect_requests(spark, d):
    _, det = _detector(spark, d)
    out = anomaly.detect_requests(_anomaly_requests(spark, d), det)
    return out.select("id", "is_anomaly", "score", F.col("details.z_score.value").alias("z_score"),
                      F.col("details.isolation_forest.score").alias("if_score"), "reject_reason")


_REQUEST_X = "[" + ", ".join({
    "hour": "CAST(hour AS DOUBLE)", "day_of_week": "CAST(day_of_week AS DOUBLE)",
    "is_business_hours": "CAST(hour BETWEEN 8 AND 18 AND day_of_week <= 4 AS DOUBLE)",
    "rolling_avg_response": "response_time_ms", "hourly_frequency": "CAST(50 AS DOUBLE)"}.get(
        c, f"CAST(method = '{c.removeprefix('method_')}' AS DOUBLE)") for c in CLF) + "] AS x"
_Z = """CASE WHEN z > 3 THEN CAST(-1 AS DOUBLE) WHEN z < -3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"""
_ZM = "zm AS (SELECT avg(response_time_ms) AS m, greatest(stddev_pop(response_time_ms), CAST(1e-6 AS DOUBLE)) AS sd FROM feats)"

register("anomaly_detect_requests", _recursive(
    *SCORED, """asked AS (SELECT id, method, CAST(hour("timestamp") AS INTEGER) AS hour,
  CAST(isodow("timestamp") - 1 AS INTEGER) AS day_of_week,
  CASE WHEN id % 7 = 3 THEN -response_time_ms ELSE response_time_ms END AS response_time_ms FROM weblogs)""",
    *_walked("answered", f"SELECT id, {_REQUEST_X} FROM asked WHERE response_time_ms > 0"), _ZM,
    """zs AS (SELECT a.id, (a.response_time_ms - m) / sd AS z, t.score - offs AS f
  FROM asked a JOIN answered t USING (id), zm, offs)""") + f"""
SELECT id, abs(z) > 3 OR f < 0 AS is_anomaly, {r(f"({_Z} + f) / 2", 4)} AS score, {r("z", 4)} AS z_score,
       {r("f", 4)} AS if_score, CAST(NULL AS VARCHAR) AS reject_reason FROM zs
UNION ALL
SELECT id, NULL, NULL, NULL, NULL, 'invalid response_time_ms' FROM asked WHERE NOT (response_time_ms > 0)""")(_detect_requests)


def _alerts_forest(spark, d):
    _, det = _detector(spark, d)
    a = anomaly.alerts(weblogs(spark, d), det, forest_scorer=lambda x: iforest.score(x, det.forest))
    found = F.from_json("anomaly_details", "is_anomaly boolean, details struct<z_score struct<value double>, "
                                           "isolation_forest struct<score double, is_anomaly boolean>>")
    return a.select("id", "severity", "score", found.alias("f")).select(
        "id", "severity", "score", F.col("f.details.z_score.value").alias("z_score"),
        F.col("f.details.isolation_forest.score").alias("if_score"),
        F.col("f.details.isolation_forest.is_anomaly").alias("if_anomaly"))


register("alert_stream_forest", _recursive(
    *SCORED, """asked AS (SELECT id, upper(method) AS method, CAST(hour("timestamp") AS INTEGER) AS hour,
  2 AS day_of_week, response_time_ms FROM weblogs)""",
    *_walked("answered", f"SELECT id, {_REQUEST_X} FROM asked"), _ZM,
    """zs AS (SELECT a.id, (a.response_time_ms - m) / sd AS z, t.score - offs AS f
  FROM asked a JOIN answered t USING (id), zm, offs)""") + f"""
SELECT id, CASE WHEN abs(z) >= 6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, {r(f"({_Z} + f) / 2", 4)} AS score,
       {r("z", 4)} AS z_score, {r("f", 4)} AS if_score, f < 0 AS if_anomaly
FROM zs WHERE abs(z) > 3 OR f < 0""")(_alerts_forest)

# --- least squares -----------------------------------------------------------------


def _ols(spark, d):
    feats = features.engineer_features(weblogs(spark, d))
    terms = ols.coefficients(ols.fit(feats, REG, "response_time_ms"), feats)
    return terms.select("position", "term", round_half_up("coefficient", 5).alias("coefficient"), "aliased")


def _ols_sql(features_: list[str], label: str) -> list[str]:
    """Normal equations from the same decimal sums, solved by elimination."""
    x = [f"CAST({c} AS DOUBLE)" for c in [*features_, label]]
    k = len(features_)
    total = lambda e: f"CAST(coalesce(sum(CAST({e} AS DECIMAL(38, {ols.SCALE}))), 0) AS DOUBLE)"
    sums = ", ".join(total(a) for a in x)
    rows = ", ".join("[" + ", ".join(total(f"{x[min(i, j)]} * {x[max(i, j)]}") for j in range(k + 1)) + "]" for i in range(k))
    return [f"ss AS (SELECT CAST(count(*) AS DOUBLE) AS n, [{sums}] AS s, [{rows}] AS p FROM feats)",
            f"centred AS (SELECT n, s, [[p[i][j] - s[i] * s[j] / n for j in range(1, {k + 2})] for i in range(1, {k + 1})] AS c FROM ss)",
            f"""swept AS (
  SELECT 1 AS k, c, c AS own, CAST([] AS BOOLEAN[]) AS aliased FROM centred
  UNION ALL
  SELECT k + 1, CASE WHEN c[k][k] <= CAST({ols.DEPENDENT} AS DOUBLE) * own[k][k] THEN c ELSE
    [[CASE WHEN i = k THEN c[k][j] / c[k][k] ELSE c[i][j] - c[i][k] / c[k][k] * c[k][j] END
      for j in range(1, {k + 2})] for i in range(1, {k + 1})] END,
    own, list_append(aliased, c[k][k] <= CAST({ols.DEPENDENT} AS DOUBLE) * own[k][k])
  FROM swept WHERE k <= {k})""",
            f"solved AS (SELECT c, aliased FROM swept WHERE k = {k + 1})"]


register("ols_coefficients", _recursive(*_ols_sql(REG, "response_time_ms")) + f"""
SELECT 0 AS position, 'intercept' AS term, {r(f"s[{len(REG) + 1}] / n - list_sum([CASE WHEN aliased[i] THEN CAST(0 AS DOUBLE) ELSE solved.c[i][{len(REG) + 1}] * s[i] / n END for i in range(1, {len(REG) + 1})])", 5)} AS coefficient,
       false AS aliased FROM solved, centred
UNION ALL
SELECT CAST(i AS INTEGER), list_extract([{", ".join(f"'{c}'" for c in REG)}], i),
       CASE WHEN NOT aliased[i] THEN {r(f"c[i][{len(REG) + 1}]", 5)} END, aliased[i]
FROM solved, range(1, {len(REG) + 1}) t(i)""")(_ols)

# --- boosted trees -------------------------------------------------------------------

_BINS = 64


def _first_sums(spark, d):
    """Gradient and Hessian sums at the root of the first tree, over all rows."""
    feats = _features(spark, d)
    return boost.root_sums(feats, CLF, "is_error", positive_weight=training.CLF_BOOST_POS_WEIGHT, bins=_BINS).select(
        "feature", "bin", "edge", round_half_up("g", 6).alias("g"), round_half_up("h", 6).alias("h"))


_B = ", ".join(f"CAST(floor((rank() OVER (ORDER BY CAST({c} AS DOUBLE)) - 1) * {_BINS} / count(*) OVER ()) AS BIGINT)" for c in CLF)

register("boost_first_sums", with_weblogs(
    _FEATURES_CTE, f"""binned AS (SELECT [{_B}] AS bs, {_X}, is_error AS y,
  CASE WHEN is_error = 1 THEN CAST({training.CLF_BOOST_POS_WEIGHT} AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS w FROM feats)""",
    """base AS (SELECT 1 / (1 + exp((CAST(0.5 AS DOUBLE) * sum(w) - sum(w * y)) / (CAST(0.25 AS DOUBLE) * sum(w)))) AS p,
  pow(CAST(2 AS DOUBLE), least(24, 51 - ceil(log2(greatest(sum(w), 1))))) AS unit FROM binned)""",
    f"""alike AS (SELECT bs, round((any_value(p) * sum(w) - sum(w * y)) * any_value(unit)) AS g,
  round(any_value(p) * (1 - any_value(p)) * sum(w) * any_value(unit)) AS h FROM binned, base GROUP BY bs)""",
    f"""sums AS (SELECT f, bs[f] AS b, sum(g) / any_value(unit) AS g, sum(h) / any_value(unit) AS h
  FROM alike, base, range(1, {K + 1}) t(f) GROUP BY 1, 2)""",
    f"edges AS (SELECT f, bs[f] AS b, max(x[f]) AS edge FROM binned, range(1, {K + 1}) t(f) GROUP BY 1, 2)") + f"""
SELECT list_extract([{", ".join(f"'{c}'" for c in CLF)}], f) AS feature, row_number() OVER (PARTITION BY f ORDER BY b) - 1 AS bin,
       edge, {r("g", 6)} AS g, {r("h", 6)} AS h
FROM sums JOIN edges USING (f, b)""")(_first_sums)

# --- the training job ------------------------------------------------------------------

_TRAINED: dict = {}
_LOCK = threading.Lock()


def _stamp(spark, d) -> tuple:
    """What tells one state of the log table from another: its files, their
    sizes and times."""
    m = F.col("_metadata")
    files = table(spark, d, "events").select(m.file_path.alias("p"), m.file_size.alias("s"), m.file_modification_time.alias("t"))
    one = files.distinct().agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("p", "s", "t")).alias("h")).first()
    return one.n, one.h


def _trained(spark, d) -> training_job.TrainResult:
    """The training job of the log table as it is now. Queries of one session
    share its result (a job takes minutes) until the table changes; the first
    one to ask bears its time."""
    key = (spark.sparkContext.applicationId, d, _stamp(spark, d))
    with _LOCK:
        if key not in _TRAINED:
            _TRAINED.clear()
            _TRAINED[key] = training_job.train_all(weblogs(spark, d), scratch_path(spark, f"train-{uuid.uuid4().hex}"))
        return _TRAINED[key]


register("train_classifiers")(lambda spark, d: _trained(spark, d).classifier_table)
register("train_regressors")(lambda spark, d: _trained(spark, d).regressor_table)


def _score_error(spark, d):
    return score.score_error(_requests(spark, d), _trained(spark, d).classifier).select(
        "id", "error_probability", "risk_level", "model_used")


register("score_error_requests")(_score_error)


def _score_rt(spark, d):
    req = _requests(spark, d).withColumn("is_error", F.lit(0))
    return score.score_response_time(req, _trained(spark, d).regressor).select(
        "id", "predicted_response_time_ms", "lower_bound_ms", "upper_bound_ms", "model_used")


register("score_response_time_requests")(_score_rt)
register("feature_importance")(lambda spark, d: training.feature_importance(_trained(spark, d).classifier))


def _shapley(spark, d):
    t = _trained(spark, d)
    return explain.exact(t.classifier, t.features)


register("shapley_values")(_shapley)

# Every row, with what its contributions miss of the model's output. Rows are told
# apart by number, as ids may repeat.


def _additivity(spark, d):
    feats = _features(spark, d)
    model = training.Trained("regressor", "linear_regression", training.LinearFit().fit(feats, REG, "response_time_ms"), REG)
    rows = model.model.transform(feats).withColumn("row", F.struct(F.monotonically_increasing_id(), "id", "prediction"))
    parts = explain.exact(model, rows, id_col="row").groupBy("row").agg(F.sum("contribution").alias("c"), F.first("mean").alias("m"))
    return parts.select("row.id", round_half_up("row.prediction", 3).alias("prediction"),
                        round_half_up(F.abs(F.col("row.prediction") - F.col("c") - F.col("m")), 5).alias("missing"))


register("shapley_additivity", _recursive(*_ols_sql(REG, "response_time_ms"), f"""fitted AS (
  SELECT id, s[{len(REG) + 1}] / n + list_sum([CASE WHEN aliased[i] THEN CAST(0 AS DOUBLE) ELSE
    solved.c[i][{len(REG) + 1}] * (x[i] - s[i] / n) END for i in range(1, {len(REG) + 1})]) AS prediction
  FROM (SELECT id, [{", ".join(f"CAST({c} AS DOUBLE)" for c in REG)}] AS x FROM feats), solved, centred)""") + f"""
SELECT id, {r("prediction", 3)} AS prediction, CAST(0 AS DOUBLE) AS missing
FROM fitted""")(_additivity)


def _registry(spark, d):
    """Active models with their names, versions and metrics."""
    meta = spark.read.parquet(_trained(spark, d).paths["model_metadata"])
    return training.active_models(meta).select("model_type", "model_name", "version", "metrics", "is_active")


register("model_registry")(_registry)


def _runs(spark, d):
    return spark.read.parquet(_trained(spark, d).paths["training_runs"]).select(
        "run_id", "status", "num_samples", "best_classifier", "best_regressor", "classifier_metrics", "regressor_metrics")


register("training_runs")(_runs)


def _run_samples(spark, d):
    """What the run's records say of its rows: how many it took, and how many of
    each split and class the candidates were judged on."""
    t = _trained(spark, d)
    run = spark.read.parquet(t.paths["training_runs"]).select("status", "num_samples")
    parts = t.features.groupBy(F.col("split_clf").alias("part"), "is_error").agg(F.count(F.lit(1)).alias("rows"))
    return run.crossJoin(F.broadcast(parts))  # one run, four parts


register("training_run_samples", with_weblogs(f"""ranked AS (
  SELECT CAST(status_code >= 400 AS INTEGER) AS is_error,
         row_number() OVER (PARTITION BY status_code >= 400 ORDER BY md5(id || '{split.SEED}'), id) AS k,
         count(*) OVER (PARTITION BY status_code >= 400) AS n FROM weblogs)""") + f"""
SELECT 'success' AS status, (SELECT count(*) FROM weblogs) AS num_samples,
       CASE WHEN k <= ceil(CAST({split.TEST_FRACTION} AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS part, is_error, count(*) AS rows
FROM ranked GROUP BY ALL""")(_run_samples)


def _health(spark, d):
    t = _trained(spark, d)
    meta = spark.read.parquet(t.paths["model_metadata"])
    return training.model_health(meta, drift.load_snapshot(spark, t.paths["reference"]) is not None)


register("model_health", """
SELECT count(*) > 0 AS classifier, count(*) > 0 AS regressor, count(*) > 0 AS anomaly_detector,
       count(*) > 0 AS reference_data, count(*) > 0 AS healthy FROM events""")(_health)


def _reload(spark, d):
    t = _trained(spark, d)
    m = training.load_model(t.paths["classifier"])
    req = _requests(spark, d)
    a = score.score_error(req, t.classifier).select("id", F.col("error_probability").alias("a"))
    b = score.score_error(req, m).select("id", F.col("error_probability").alias("b"))
    return a.join(b, "id").select("id", (F.col("a") == F.col("b")).alias("same_score"))


register("model_reload_scores", with_weblogs() + """
SELECT id, true AS same_score FROM weblogs""")(_reload)

# --- drift ---------------------------------------------------------------------------

from ..operators import fewvalued  # noqa: E402
from .catalog import _DRIFT_LONG, _KS_SQL, _drift_frames  # noqa: E402

_FEW = ["status_code", "is_error", "is_business_hours", "day_of_week"]


def _few_valued(spark, d):
    ref, cur = _drift_frames(spark, d)
    t = fewvalued.few_valued_tests(ref, cur, _FEW)
    six = lambda c: round_half_up(c, 6).alias(c)
    return t.select("column", "n_values", "n_ref", "n_cur", *[six(c) for c in ("chi_square", "chi_square_p", "z", "z_p", "js_distance")],
                    "stattest_name", "drift_detected")


def _down(least: str, terms: str, body: str, first: str = "CAST(1 AS DOUBLE)") -> str:
    """A fold over terms, ..., 1: ``body`` of acc and n."""
    return f"list_reduce(list_prepend({first}, list_transform(range({terms}, 0, -1), lambda i: CAST(i AS DOUBLE))), lambda acc, n: {body})"


def _erfc_sql(z: str) -> str:
    series = _down("1", str(fewvalued.TERMS), f"CAST(1 AS DOUBLE) + CAST(2 AS DOUBLE) * {z} * {z} / (CAST(2 AS DOUBLE) * n + 1) * acc")
    fraction = _down("1", str(fewvalued.TERMS), f"{z} + n / CAST(2 AS DOUBLE) / acc", z)
    pi = f"CAST({fewvalued.ROOT_PI} AS DOUBLE)"
    return f"CASE WHEN {z} < 2.5 THEN 1 - CAST(2 AS DOUBLE) * {z} / {pi} * exp(-{z} * {z}) * {series} ELSE exp(-{z} * {z}) / {pi} / {fraction} END"


_H = "(chi_square / CAST(2 AS DOUBLE))"
_HALF = "((n_values - 1) // 2 - 1)"
_CHI_P = f"""CASE WHEN n_values < 2 OR {_H} <= 0 THEN CAST(1 AS DOUBLE)
  WHEN (n_values - 1) % 2 = 0 THEN exp(-{_H}) * {_down("1", _HALF, f"1 + {_H} / n * acc")}
  ELSE {_erfc_sql(f"sqrt({_H})")} + CASE WHEN n_values > 2 THEN exp(-{_H}) * sqrt({_H}) / CAST({fewvalued.ROOT_PI / 2} AS DOUBLE)
    * {_down("1", _HALF, f"1 + {_H} / (n + CAST(0.5 AS DOUBLE)) * acc")} ELSE 0 END END"""

register("drift_few_valued", with_weblogs(
    *_DRIFT_LONG, """ct AS (SELECT "column", value, CAST(count(*) FILTER (WHERE src = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE src = 1) AS DOUBLE) AS b
  FROM long WHERE "column" IN ('""" + "', '".join(_FEW) + """') AND value IS NOT NULL GROUP BY 1, 2)""",
    """sz AS (SELECT "column", sum(a) AS ta, sum(b) AS tb FROM ct GROUP BY 1)""",
    """cells AS (SELECT "column", value, ta, tb, (b - a / ta * tb) * (b - a / ta * tb) / (a / ta * tb) AS x,
    CASE WHEN a > 0 THEN a / ta * ln(a / ta / ((a / ta + b / tb) / 2)) ELSE 0 END
    + CASE WHEN b > 0 THEN b / tb * ln(b / tb / ((a / ta + b / tb) / 2)) ELSE 0 END AS js,
    (a / ta - b / tb) / sqrt((a + b) / (ta + tb) * (1 - (a + b) / (ta + tb)) * (1 / ta + 1 / tb)) AS z FROM ct JOIN sz USING ("column"))""",
    """g AS (SELECT "column", count(*) AS n_values, CAST(max(ta) AS BIGINT) AS n_ref, CAST(max(tb) AS BIGINT) AS n_cur, sum(x) AS chi_square,
    sqrt(greatest(sum(js) / 2, 0)) AS js_distance, CASE WHEN count(*) = 2 THEN arg_max(z, value) END AS z FROM cells GROUP BY 1)""",
    f"""t AS (SELECT *, {_CHI_P} AS chi_square_p,
    CASE WHEN z IS NOT NULL THEN {_erfc_sql("(abs(coalesce(z, 0)) / sqrt(CAST(2 AS DOUBLE)))")} END AS z_p FROM g)""") + f"""
SELECT "column", n_values, n_ref, n_cur, {r("chi_square", 6)} AS chi_square, {r("chi_square_p", 6)} AS chi_square_p, {r("z", 6)} AS z,
       {r("z_p", 6)} AS z_p, {r("js_distance", 6)} AS js_distance,
       CASE WHEN n_ref > 1000 THEN 'jensenshannon' WHEN n_values = 2 THEN 'z' ELSE 'chisquare' END AS stattest_name,
       CASE WHEN n_ref > 1000 THEN js_distance > 0.1 WHEN n_values = 2 THEN z_p < 0.05 ELSE chi_square_p < 0.05 END AS drift_detected
FROM t""")(_few_valued)


def _gate(spark, d):
    """The gate over the whole current window, against a stored snapshot; on
    drift it fits a new detector."""
    ref, cur = _drift_frames(spark, d)
    path = scratch_path(spark, f"snapshot-{uuid.uuid4().hex}")
    drift.save_snapshot(ref, path)
    return drift.drift_gate(drift.current_window(cur), drift.load_snapshot(spark, path),
                            lambda: anomaly.fit_moments(cur, ["hour", "response_time_ms"]))


register("drift_gate", _KS_SQL + """
SELECT sum(CAST(p_value < 0.05 AS INTEGER)) > 0.5 * count(*) AS drift_detected,
       CASE WHEN sum(CAST(p_value < 0.05 AS INTEGER)) > 0.5 * count(*) THEN 'retrained' ELSE 'none' END AS action,
       CASE WHEN sum(CAST(p_value < 0.05 AS INTEGER)) > 0.5 * count(*) THEN 'dataset drift detected' ELSE 'no significant drift' END AS reason,
       sum(CAST(p_value < 0.05 AS INTEGER)) / CAST(greatest(count(*), 1) AS DOUBLE) AS drift_share,
       CAST(sum(CAST(p_value < 0.05 AS INTEGER)) AS BIGINT) AS n_drifted_columns FROM p""")(_gate)
