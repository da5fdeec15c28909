"""ML jobs (M keys), prediction sinks (S08, S09) and recommendations (X keys).

The forest (M03, M04, S08 and the recommendations on predicted status) cannot be reproduced by SQL and is checked on
rows and by property tests; everything else has a SQL formulation: the ridge regression is stated as normal equations
solved by a chain of elimination steps.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from linepulse.operators import forest, marts, ml, recommend
from linepulse.plans.registry import query
from linepulse.session import shared_dir

_CACHE: dict[tuple, tuple[str, object]] = {}
_FROM = ["events", "part", "lineitem", "supplier"]     # the test tables that models are fitted on


def _cached(t, name, build):
    """What ``build`` made for these files; made again when one of them has changed."""
    key, state = (t.spark.sparkContext.applicationId, t.sf_dir, name), t.state(*_FROM)
    if _CACHE.get(key, ("", None))[0] != state:
        _CACHE[key] = state, build()
    return _CACHE[key][1]


ENC_SQL = """
WITH s AS (SELECT *, COALESCE(CAST(product_id AS VARCHAR), 'nan') AS _p, COALESCE(operator_name, 'nan') AS _o,
                  COALESCE(shift, 'nan') AS _s FROM {src})
SELECT {cols}, CAST(DENSE_RANK() OVER (ORDER BY _p) - 1 AS INTEGER) AS product_code,
       CAST(DENSE_RANK() OVER (ORDER BY _o) - 1 AS INTEGER) AS operator_code,
       CAST(DENSE_RANK() OVER (ORDER BY _s) - 1 AS INTEGER) AS shift_code
FROM s"""


@query("status_features", "M01", """
SELECT batch_id, CAST(product_id AS VARCHAR) AS product_id, operator_name, shift, CAST(month(prod_date) AS INTEGER) AS month,
       CAST(day(prod_date) AS INTEGER) AS day, CAST(start_min // 60 AS INTEGER) AS start_hour, min_batch_time, status
FROM j01""")
def status_features(t):
    return ml.status_features(marts.batch_with_product(t))


@query("label_encode", "M02", ENC_SQL.format(src="batches", cols="batch_id"))
def label_encode(t):
    return ml.encode_alphabetical(t.b, ["product_id", "operator_name", "shift"]).select(
        "batch_id", "product_code", "operator_code", "shift_code")


def _oof(t, num_trees=100):
    def build():
        said = forest.out_of_bag(ml.status_rows(marts.batch_with_product(t)), "batch_id", "status", ["product_id", "operator_name", "shift"],
                                 ["month", "day", "start_hour", "min_batch_time"], num_trees=num_trees)
        return said.withColumnRenamed("predicted", "predicted_status").checkpoint(eager=True)
    return _cached(t, ("oof", num_trees), build)


@query("status_classifier_oof", "M03")
def status_classifier_oof(t):
    return _oof(t).select("batch_id", "status", "predicted_status")


@query("classification_report", "M04")
def classification_report(t):
    return ml.classification_report(_oof(t).where(F.col("status").isNotNull()))


@query("classification_report_rule", "M04", """
WITH p AS (SELECT status, CASE WHEN min_batch_time >= 45 THEN 'ON TIME' ELSE 'DELAY' END AS said FROM j01 WHERE status IS NOT NULL),
c AS (SELECT cls, COUNT(*) FILTER (WHERE status = cls AND said = cls) AS tp, COUNT(*) FILTER (WHERE status = cls) AS sup,
             COUNT(*) FILTER (WHERE said = cls) AS np
      FROM p, (SELECT DISTINCT status AS cls FROM p UNION SELECT DISTINCT said FROM p) k GROUP BY cls),
r AS (SELECT cls, sup, tp, CASE WHEN np > 0 THEN tp * 1.0E0 / np ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp * 1.0E0 / sup ELSE 0 END AS rc FROM c),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM r)
SELECT cls AS class, ROUND(pr, 4) AS precision, ROUND(rc, 4) AS recall, ROUND(f1, 4) AS f1, CAST(sup AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND(SUM(tp) * 1.0E0 / SUM(sup), 4), CAST(SUM(sup) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', ROUND(AVG(pr), 4), ROUND(AVG(rc), 4), ROUND(AVG(f1), 4), CAST(SUM(sup) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', ROUND(SUM(pr * sup) / SUM(sup), 4), ROUND(SUM(rc * sup) / SUM(sup), 4), ROUND(SUM(f1 * sup) / SUM(sup), 4),
                 CAST(SUM(sup) AS BIGINT) FROM f""")
def classification_report_rule(t, target_from: int = 45):
    """The report over a rule instead of a model: products with a long target time are said to be on time."""
    rule = F.when(F.col("min_batch_time") >= target_from, "ON TIME").otherwise("DELAY")
    said = marts.batch_with_product(t).where(F.col("status").isNotNull()).select("status", rule.alias("predicted_status"))
    return ml.classification_report(said)


DT_SRC = """(SELECT i.downtime_id, i.batch_id, i.factor_id, i.downtime_min, f.operator_error, b.product_id,
                    b.operator_name, b.shift, b.min_batch_time
             FROM incidents i LEFT JOIN factors f ON i.factor_id = f.factor_id
             LEFT JOIN j01 b ON i.batch_id = b.batch_id)"""


@query("downtime_features", "M05", ENC_SQL.format(
    src=DT_SRC, cols="downtime_id, factor_id, CASE operator_error WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END "
                     "AS operator_error_flag, min_batch_time, downtime_min"))
def downtime_features(t):
    d = ml.downtime_features(marts.ml_incident_frame(t))
    return d.select("downtime_id", "factor_id", "operator_error_flag", "product_code", "operator_code", "shift_code",
                    "min_batch_time", "downtime_min")


# --- the regressor, and its SQL: scaling, normal equations, elimination -----------------------

FEATURES = ml.DOWNTIME_FEATURES
SPLIT_SQL = (f"CASE WHEN ((downtime_id % {ml.SPLIT_PRIME}) * {ml.SPLIT_STEP} % {ml.SPLIT_PRIME}) % 100 < 80 THEN 'train' ELSE 'test' END")
FRAME_SQL = ENC_SQL.format(src=DT_SRC, cols="downtime_id, batch_id, factor_id, CASE operator_error WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END "
                           "AS operator_error_flag, min_batch_time, downtime_min, operator_error, product_id, operator_name, shift")


def _scaled_ctes() -> str:
    stats = ", ".join(f"AVG({f}) FILTER (split = 'train') AS m{k}, STDDEV_POP({f}) FILTER (split = 'train') AS s{k}" for k, f in enumerate(FEATURES))
    scaled = ", ".join(f"CASE WHEN s{k} > 0 THEN ({f} - m{k}) / s{k} ELSE {f} - m{k} END AS {f}_scaled" for k, f in enumerate(FEATURES))
    return (f"enc AS ({FRAME_SQL}), spl AS (SELECT *, {SPLIT_SQL} AS split FROM enc), sta AS (SELECT {stats} FROM spl), "
            f"sca AS (SELECT spl.*, {scaled} FROM spl, sta)")


def _ridge_ctes(alpha: float = 1.0) -> str:
    """Gaussian elimination of (covariance + alpha I | covariance with the label), one step a CTE."""
    k = len(FEATURES)
    x = [f"COALESCE({f}_scaled, 0)" for f in FEATURES] + ["CAST(downtime_min AS DOUBLE)"]
    sums = ", ".join([f"AVG({v}) AS e{i}" for i, v in enumerate(x)]
                     + [f"AVG({x[i]} * {x[j]}) AS q{i}_{j}" for i in range(k + 1) for j in range(i, k + 1)])
    cells = ", ".join(f"n * (q{min(i, j)}_{max(i, j)} - e{i} * e{j}){f' + {alpha}' if i == j else ''} AS a{i}_{j}" for i in range(k) for j in range(k + 1))
    means = ", ".join(f"e{i}" for i in range(k + 1))
    out = [f"mom AS (SELECT COUNT(*) AS n, {sums} FROM sca WHERE split = 'train' AND downtime_min IS NOT NULL)", f"g0 AS (SELECT {means}, {cells} FROM mom)"]
    for p in range(k):
        new = ", ".join(f"a{i}_{j} / a{p}_{p} AS a{i}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}"
                        for i in range(k) for j in range(p + 1, k + 1))
        out.append(f"g{p + 1} AS (SELECT {means}, {new} FROM g{p})")
    dot = " - ".join([f"e{k}", *[f"e{i} * a{i}_{k}" for i in range(k)]])
    out.append(f"rid AS (SELECT {', '.join(f'a{i}_{k} AS w{i}' for i in range(k))}, {dot} AS b FROM g{k})")
    said = " + ".join(["b", *[f"w{i} * {x[i]}" for i in range(k)]])
    out.append(f"prd AS (SELECT sca.*, {said} AS predicted_downtime FROM sca, rid)")
    return ", ".join(out)


RIDGE_SQL = f"WITH {_scaled_ctes()}, {_ridge_ctes()}"


def _scaled(t):
    d = ml.downtime_features(marts.ml_incident_frame(t))
    return ml.scale_features(ml.split_80_20(d), FEATURES)


@query("train_test_split_80_20", "M06", f"SELECT downtime_id, {SPLIT_SQL} AS split FROM incidents")
def train_test_split_80_20(t):
    return ml.split_80_20(t.i.select("downtime_id"))


@query("scale_features", "M07", f"WITH {_scaled_ctes()} SELECT downtime_id, split, "
       + ", ".join(f"ROUND({f}_scaled, 6) AS {f}_scaled" for f in FEATURES) + " FROM sca")
def scale_features(t):
    return _scaled(t).select("downtime_id", "split", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in FEATURES])


def _ridge(t, alpha=1.0):
    def build():
        s = _scaled(t)      # a projection of the stored detail beside small tables: read again where it is used, not written a second time
        return s, ml.downtime_ridge(s, FEATURES, alpha)
    return _cached(t, ("ridge", alpha), build)


@query("downtime_ridge", "M08", RIDGE_SQL + " " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, ROUND({w}, 6) AS coefficient FROM rid" for f, w in [*[(f, f"w{k}") for k, f in enumerate(FEATURES)], ("intercept", "b")]))
def downtime_ridge(t):
    _, weights = _ridge(t)
    return t.spark.createDataFrame(list(weights.items()), "feature string, coefficient double").select(
        "feature", F.round("coefficient", 6).alias("coefficient"))


def _predictions(t):
    s, weights = _ridge(t)
    return ml.predict(weights, s, FEATURES)


@query("regression_report", "M09", RIDGE_SQL + """
SELECT ROUND(AVG((downtime_min - predicted_downtime) ** 2), 4) AS mse,
       ROUND(1 - SUM((downtime_min - predicted_downtime) ** 2) / NULLIF(VAR_POP(downtime_min) * COUNT(*), 0), 4) AS r2, COUNT(*) AS n_test
FROM prd WHERE split = 'test'""")
def regression_report(t):
    return ml.regression_report(_predictions(t))


@query("downtime_predictions_all", "M10", RIDGE_SQL + " SELECT downtime_id, split, downtime_min, ROUND(predicted_downtime, 6) AS predicted_downtime FROM prd")
def downtime_predictions_all(t):
    return _predictions(t).select("downtime_id", "split", "downtime_min", F.round("predicted_downtime", 6).alias("predicted_downtime"))


def _sink_path(t, name):
    tag = hashlib.sha1(t.sf_dir.encode()).hexdigest()[:10]
    return f"{shared_dir(t.spark).rstrip('/')}/linepulse/predictions/{tag}/{name}"


def _write(t, out, name, fmt):
    """Write in the given format and read back (text formats come back with the types of ``out``)."""
    path = _sink_path(t, f"{name}-{fmt}")
    out.write.mode("overwrite").format(fmt).option("header", True).save(path)
    return t.spark.read.format(fmt).option("header", True).schema(out.schema).load(path)


@query("write_status_predictions", "S08")
def write_status_predictions(t, fmt: str = "parquet"):
    """The batches with month, day, start hour and target beside them, and the prediction; also batches without a status."""
    out = _oof(t).select("batch_id", "prod_date", "product_id", "operator_name", "start_min", "end_min", "duration_min", "shift", "status",
                         "month", "day", "start_hour", "min_batch_time", F.col("predicted_status").alias("status_prediction"))
    return _write(t, out, "status", fmt)


S09_COLUMNS = ["downtime_id", "batch_id", "factor_id", "downtime_min", "operator_error", "product_id", "operator_name", "shift", "min_batch_time"]


@query("write_downtime_predictions", "S09", RIDGE_SQL + f" SELECT {', '.join(S09_COLUMNS)}, ROUND(predicted_downtime, 6) AS predicted_downtime FROM prd")
def write_downtime_predictions(t, fmt: str = "parquet"):
    """The incidents with their factor's and batch's attributes, and the prediction."""
    out = _predictions(t).select(*S09_COLUMNS, F.round("predicted_downtime", 6).alias("predicted_downtime"))
    return _write(t, out, "downtime", fmt)


# --- recommendations ------------------------------------------------------------------------

BEST_SQL = """
best_{c} AS (SELECT product_id, {c} AS best FROM (
    SELECT product_id, {c}, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY COUNT(*) DESC, {c}) AS rn
    FROM batches WHERE status = 'ON TIME' GROUP BY product_id, {c}) x WHERE rn = 1)"""


def _planned(t):
    """Planned batches with the recorded status standing in for the predicted one."""
    return t.b.withColumn("predicted_status", F.col("status"))


@query("recommend_operator", "X01", f"""
WITH {BEST_SQL.format(c='operator_name')}
SELECT b.batch_id, b.product_id, b.operator_name, o.best AS recommended_operator
FROM batches b LEFT JOIN best_operator_name o ON b.product_id = o.product_id WHERE b.status = 'DELAY'""")
def recommend_operator(t):
    return recommend.recommend_operator(_planned(t), t.b)


@query("recommend_shift", "X02", f"""
WITH {BEST_SQL.format(c='shift')}
SELECT b.batch_id, b.product_id, b.shift, CASE WHEN s.best <> b.shift THEN s.best END AS recommended_shift
FROM batches b LEFT JOIN best_shift s ON b.product_id = s.product_id WHERE b.status = 'DELAY'""")
def recommend_shift(t):
    return recommend.recommend_shift(_planned(t), t.b)


BUFFER_SQL = ("printf('Operational Warning: High MTTR expected. Inject a standard buffer of %d minutes in the "
              "downstream assembly schedule.', CAST(ROUND({x}) AS BIGINT))")


@query("buffer_warning", "X03", f"""
SELECT downtime_id, batch_id, CASE WHEN downtime_min > 20 THEN CAST(ROUND(downtime_min) AS BIGINT) END AS buffer_minutes,
       CASE WHEN downtime_min > 20 THEN {BUFFER_SQL.format(x='downtime_min')} END AS warning
FROM incidents""")
def buffer_warning(t):
    d = t.i.withColumn("predicted_downtime", F.col("downtime_min").cast("double"))
    return recommend.buffer_warning(d).select("downtime_id", "batch_id", "buffer_minutes", "warning")


@query("mitigation_plan", "X04", f"""
WITH {BEST_SQL.format(c='operator_name')}, {BEST_SQL.format(c='shift')},
r AS (SELECT b.batch_id, list_filter([
        CASE WHEN b.status = 'DELAY' AND o.best IS NOT NULL THEN
             printf('Recommendation 1: Consider reassigning this batch to Operator [%s] to minimize delay risks.', o.best) END,
        CASE WHEN b.status = 'DELAY' AND s.best IS NOT NULL AND s.best <> b.shift THEN
             printf('Recommendation 2: Historical data indicates optimal performance on [%s] Shift for this product variant.', s.best) END,
        CASE WHEN CAST(bd.total_downtime AS DOUBLE) > 20 THEN {BUFFER_SQL.format(x='CAST(bd.total_downtime AS DOUBLE)')} END
      ], lambda x: x IS NOT NULL) AS recs
      FROM batches b LEFT JOIN best_operator_name o ON b.product_id = o.product_id
      LEFT JOIN best_shift s ON b.product_id = s.product_id LEFT JOIN bd ON b.batch_id = bd.batch_id)
SELECT batch_id, CAST(len(recs) AS INTEGER) AS n_recommendations, array_to_string(recs, ' | ') AS plan_text FROM r""")
def mitigation_plan(t):
    per_batch = marts.batch_downtime(t).select("batch_id", F.col("total_downtime").cast("double")
                                               .alias("predicted_downtime"))
    plan = recommend.mitigation_plan(_planned(t), t.b, per_batch)
    return plan.select("batch_id", F.size("recommendations").alias("n_recommendations"),
                       F.array_join("recommendations", " | ").alias("plan_text"))


# --- recommendations on predictions (the models' own frames in place of the records) --------------

def _predicted_status(t):
    return _oof(t).select(*[F.col(c) for c in ("batch_id", "product_id", "operator_name", "shift", "predicted_status")])


def _history(t):
    return t.b.withColumn("product_id", F.col("product_id").cast("string"))


@query("recommend_operator_predicted", "X01")
def recommend_operator_predicted(t):
    return recommend.recommend_operator(_predicted_status(t), _history(t))


@query("recommend_shift_predicted", "X02")
def recommend_shift_predicted(t):
    return recommend.recommend_shift(_predicted_status(t), _history(t))


@query("buffer_warning_predicted", "X03", RIDGE_SQL + f"""
SELECT downtime_id, batch_id, CASE WHEN predicted_downtime > 20 THEN CAST(ROUND(predicted_downtime) AS BIGINT) END AS buffer_minutes,
       CASE WHEN predicted_downtime > 20 THEN {BUFFER_SQL.format(x='predicted_downtime')} END AS warning FROM prd""")
def buffer_warning_predicted(t):
    return recommend.buffer_warning(_predictions(t)).select("downtime_id", "batch_id", "buffer_minutes", "warning")


@query("mitigation_plan_predicted", "X04")
def mitigation_plan_predicted(t):
    per_batch = _predictions(t).groupBy("batch_id").agg(F.sum("predicted_downtime").alias("predicted_downtime"))
    plan = recommend.mitigation_plan(_predicted_status(t), _history(t), per_batch)
    return plan.select("batch_id", F.size("recommendations").alias("n_recommendations"),
                       F.array_join("recommendations", " | ").alias("plan_text"))
