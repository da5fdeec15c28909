"""Distributed ML jobs: status classifier (out-of-fold) and downtime regressor (ridge).

Feature preparation is plain DataFrame work; models are Spark ML estimators trained on the
executors.  Categorical text columns get alphabetical integer codes (the same codes a label
encoder fitted on the whole column gives), computed from the distinct values only.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.functions.expr import is_human
from linepulse.functions.scale import dense_index

STATUS_FEATURES = ["product_code", "operator_code", "shift_code", "month", "day", "start_hour", "min_batch_time"]
DOWNTIME_FEATURES = ["factor_id", "operator_error_flag", "product_code", "operator_code", "shift_code",
                     "min_batch_time"]
MISSING_TEXT = "nan"


CODE_NAMES = {"product_id": "product_code", "operator_name": "operator_code", "shift": "shift_code"}


BROADCAST_CODES = 50_000    # a vocabulary of at most so many values is sent to all tasks


def encode_alphabetical(df: DataFrame, cols: Sequence[str], names: dict | None = None) -> DataFrame:
    """Each text column -> 0-based code in alphabetical order of its distinct values (missing -> 'nan').

    One pass collects the distinct values of all columns (map-side).  If they are counted to be few (BROADCAST_CODES a column), they are
    numbered as they are and sent to the tasks, so no row is shuffled.  Otherwise each column is numbered by a distributed dense
    index and joined by shuffle, with the missing values kept out of the join (they may be a third of all rows) and given their
    code as a literal.
    """
    spark = df.sparkSession
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING_TEXT)).alias("v")) for c in cols]))
    values = df.select(pairs.alias("x")).select("x.c", "x.v").distinct()
    most = BROADCAST_CODES * len(cols)
    few = values.limit(most + 1).collect()                    # bounded: at most BROADCAST_CODES values a column on average
    if len(few) <= most:
        out = df
        for col in cols:
            out_name = (names or CODE_NAMES).get(col, f"{col}_code")
            codes = [(v, i) for i, v in enumerate(sorted(r["v"] for r in few if r["c"] == col))]
            vocab = spark.createDataFrame(codes, f"_v string, `{out_name}` int")
            out = out.join(F.broadcast(vocab), F.coalesce(F.col(col).cast("string"), F.lit(MISSING_TEXT)) == F.col("_v"), "left").drop("_v")
        return out
    values = values.checkpoint(eager=True)
    sizes = {r["c"]: r["n"] for r in values.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = df
    for col in cols:
        out_name = (names or CODE_NAMES).get(col, f"{col}_code")
        vocab = dense_index(values.where(F.col("c") == col).select(F.col("v").alias("_v")), ["_v"], "_ix").select(
            "_v", (F.col("_ix") - 1).cast("int").alias(out_name))
        text = F.col(col).cast("string")
        if sizes.get(col, 0) <= BROADCAST_CODES:
            out = out.join(F.broadcast(vocab), F.coalesce(text, F.lit(MISSING_TEXT)) == F.col("_v"), "left").drop("_v")
            continue
        missing = vocab.where(F.col("_v") == MISSING_TEXT).first()
        known = out.where(F.col(col).isNotNull()).join(vocab, text == F.col("_v"), "left").drop("_v")
        rest = out.where(F.col(col).isNull()).withColumn(out_name, F.lit(missing[out_name] if missing else None).cast("int"))
        out = known.unionByName(rest)
    return out


def status_features(b_with_product: DataFrame) -> DataFrame:
    """Product, operator, shift, month, day, start hour, target; the end time and the actual
    duration are left out (they would leak the label)."""
    return b_with_product.select(*STATUS_COLUMNS[:1], F.col("product_id").cast("string").alias("product_id"), "operator_name", "shift",
                                 *_calendar(), "min_batch_time", "status")


STATUS_COLUMNS = ["batch_id", "product_id", "operator_name", "shift", "month", "day", "start_hour", "min_batch_time", "status"]


def _calendar() -> list:
    return [F.month("prod_date").alias("month"), F.dayofmonth("prod_date").alias("day"),
            F.floor(F.col("start_min") / 60).cast("int").alias("start_hour")]


def status_rows(b_with_product: DataFrame) -> DataFrame:
    """The whole batches with the features of M01 beside them."""
    return b_with_product.withColumn("product_id", F.col("product_id").cast("string")).select(
        "batch_id", "prod_date", "product_id", "operator_name", "start_min", "end_min", "duration_min", "shift", "status",
        *_calendar(), "min_batch_time")


def fold_of(key: str, k: int) -> F.Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(k)).cast("int")


def status_classifier_oof(feats: DataFrame, k: int = 5, num_trees: int = 100, seed: int = 42,
                          features: Sequence[str] = STATUS_FEATURES, parallelism: int = 5,
                          max_memory_mb: int = 1024, max_depth: int = 8, max_bins: int | None = None) -> DataFrame:
    """Out-of-fold predictions of the batch status with a balanced random forest.

    Every batch, also one without a recorded status, is predicted by a model that did not see it (k hash folds), with
    class weights n / (classes * n of the class) of that model's own training rows.  ``max_depth`` bounds the trees
    (Spark allows 30; deeper trees cost memory for split statistics); ``max_bins`` is at least the number of codes of any
    feature (default), so that no two codes share a bin; ``max_memory_mb`` is the per-task budget for split statistics.
    The label index is alphabetical (DELAY=0, ON TIME=1) so all folds share it.  Returns ``feats`` with predicted_status.
    """
    names = [r[0] for r in feats.select("status").where(F.col("status").isNotNull()).distinct().orderBy("status").limit(101).collect()]
    if len(names) > 100:
        raise ValueError("more than 100 classes")
    if not names:
        return feats.withColumn("predicted_status", F.lit(None).cast("string"))
    label = F.lit(None).cast("double")
    for n, name in enumerate(names):
        label = F.when(F.col("status") == name, float(n)).otherwise(label)
    data = feats.withColumn("label", label).withColumn("fold", fold_of("batch_id", k))
    inputs = [f"_x_{c}" for c in features]
    filled = data.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(x) for c, x in zip(features, inputs)])
    data = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(filled).drop(*inputs)
    # k fits read the same training frame: materialise it once in the shared folder
    data = data.checkpoint(eager=True)
    if max_bins is None:
        top = data.agg(*[F.max(c).alias(c) for c in features]).first()
        max_bins = max(32, *(int(x) + 2 for x in top if x is not None))

    def fold_predictions(f: int) -> DataFrame:
        train = data.filter((F.col("fold") != f) & F.col("label").isNotNull())
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        held = data.filter(F.col("fold") == f)
        if not counts:
            return held.withColumn("prediction", F.lit(None).cast("double"))
        weight = F.lit(0.0)
        for y, n in counts.items():
            weight = F.when(F.col("label") == y, sum(counts.values()) / (len(counts) * n)).otherwise(weight)
        rf = RandomForestClassifier(numTrees=num_trees, seed=seed, weightCol="weight", labelCol="label", featuresCol="features",
                                    maxMemoryInMB=max_memory_mb, maxDepth=max_depth, maxBins=max_bins)
        return rf.fit(train.withColumn("weight", weight)).transform(held).drop("rawPrediction", "probability")

    # the k fits are independent Spark jobs: submit them concurrently (as Spark ML's own tuning does)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
        preds = list(pool.map(fold_predictions, range(k)))
    out = preds[0]
    for p in preds[1:]:
        out = out.unionByName(p)
    said = F.get(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int"))
    return out.withColumn("predicted_status", said).select(*feats.columns, "predicted_status")


def classification_report(pred: DataFrame, label: str = "status", predicted: str = "predicted_status") -> DataFrame:
    """Precision / recall / F1 / support per class, plus accuracy, macro and weighted averages.
    Computed from the confusion counts (one row per label x prediction pair)."""
    conf = pred.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    classes = conf.select(F.col(label).alias("cls")).union(conf.select(F.col(predicted).alias("cls"))).distinct()
    tp = conf.filter(F.col(label) == F.col(predicted)).select(F.col(label).alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col(label).alias("cls")).agg(F.sum("n").alias("support"))
    npred = conf.groupBy(F.col(predicted).alias("cls")).agg(F.sum("n").alias("npred"))
    per = (classes.join(tp, "cls", "left").join(sup, "cls", "left").join(npred, "cls", "left")
           .na.fill(0, subset=["tp", "support", "npred"]))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
    tot = per.agg(F.sum("support").alias("total"), F.sum("tp").alias("correct"),
                  F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                  (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                  (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    rows = per.select(F.col("cls").alias("class"), "precision", "recall", "f1", F.col("support").cast("long"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("correct") / F.col("total")).alias("f1"),
                     F.col("total").cast("long").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("total").cast("long").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                          F.col("total").cast("long").alias("support"))
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


def downtime_features(ml_frame: DataFrame) -> DataFrame:
    """Factor id, operator-error flag (1/0), product / operator / shift codes, target."""
    d = ml_frame.withColumn("operator_error_flag", F.when(is_human(), 1).when(F.col("operator_error") == "No", 0))
    return encode_alphabetical(d, ["product_id", "operator_name", "shift"])


SPLIT_PRIME, SPLIT_STEP = 2147483647, 48271     # a multiplicative step by which ids are spread over 0..99


def split_80_20(df: DataFrame, key: str = "downtime_id", train_pct: int = 80) -> DataFrame:
    """Deterministic split by id arithmetic (stable under re-runs and executor loss)."""
    spread = (F.col(key) % SPLIT_PRIME) * SPLIT_STEP % SPLIT_PRIME % 100
    return df.withColumn("split", F.when(spread < train_pct, "train").otherwise("test"))


def scale_features(df: DataFrame, features: Sequence[str], fit_on: str = "train") -> DataFrame:
    """Standardise with the mean and population std of the training rows (one-row aggregate)."""
    stats = df.filter(F.col("split") == fit_on).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    out = df.crossJoin(F.broadcast(stats))
    for c in features:
        s = F.col(f"_s_{c}")
        out = out.withColumn(f"{c}_scaled", F.when(s > 0, (F.col(c) - F.col(f"_m_{c}")) / s)
                             .otherwise(F.col(c) - F.col(f"_m_{c}")))
    return out.drop(*[f"_m_{c}" for c in features], *[f"_s_{c}" for c in features])


def downtime_ridge(scaled: DataFrame, features: Sequence[str], alpha: float = 1.0, label: str = "downtime_min") -> dict[str, float]:
    """Ridge regression ``||y - Xw - b||^2 + alpha ||w||^2`` on the training rows, by its normal equations.

    One distributed aggregate gives the moments of the features and the label; the few-by-few system is solved on the
    driver.  Missing features count as their mean (0 after scaling).  Returns feature -> weight, and ``intercept``.
    """
    xs = [F.coalesce(F.col(f"{c}_scaled"), F.lit(0.0)) for c in features] + [F.col(label).cast("double")]
    train = scaled.filter((F.col("split") == "train") & F.col(label).isNotNull())
    k = len(xs)
    row = train.agg(F.count(F.lit(1)), *[F.avg(x) for x in xs], *[F.avg(xs[i] * xs[j]) for i in range(k) for j in range(i, k)]).first()
    n, mean = row[0], np.array([0.0 if v is None else v for v in row[1:k + 1]])
    moments = np.zeros((k, k))
    moments[np.triu_indices(k)] = [0.0 if v is None else v for v in row[k + 1:]]
    cov = n * (moments - np.triu(np.outer(mean, mean)))
    cov = cov + np.triu(cov, 1).T
    w = np.linalg.solve(cov[:-1, :-1] + alpha * np.eye(k - 1), cov[:-1, -1])
    return {**{f: float(x) for f, x in zip(features, w)}, "intercept": float(mean[-1] - mean[:-1] @ w)}


def predict(weights: dict[str, float], scaled: DataFrame, features: Sequence[str], out: str = "predicted_downtime") -> DataFrame:
    total = F.lit(weights["intercept"])
    for f in features:
        total = total + F.lit(weights[f]) * F.coalesce(F.col(f"{f}_scaled"), F.lit(0.0))
    return scaled.withColumn(out, total)


def regression_report(pred: DataFrame, label: str = "downtime_min", p: str = "predicted_downtime") -> DataFrame:
    """MSE and R^2 on the test rows, as one aggregate."""
    test = pred.filter(F.col("split") == "test")
    m = test.agg(F.avg(F.pow(F.col(label) - F.col(p), 2)).alias("mse"), F.avg(label).alias("_ybar"),
                 F.sum(F.pow(F.col(label) - F.col(p), 2)).alias("_sse"), F.count(F.lit(1)).alias("n_test"))
    sst = test.crossJoin(F.broadcast(m.select("_ybar"))).agg(F.sum(F.pow(F.col(label) - F.col("_ybar"), 2)).alias("_sst"))
    return m.crossJoin(sst).select(F.round("mse", 4).alias("mse"),
                                   F.round(1 - F.col("_sse") / F.nullif(F.col("_sst"), F.lit(0.0)), 4).alias("r2"),
                                   "n_test")
