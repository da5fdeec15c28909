"""The models: ridge against numpy, the forest's folds, encoding with small and large vocabularies, lazily built tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from linepulse.operators import ml


def test_ridge_equals_numpy(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = x @ [2.0, -1.0, 4.0] + draw.normal(size=300)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    df = ml.split_80_20(spark.createDataFrame(rows, "downtime_id long, a double, b double, c double, downtime_min double"))
    scaled = ml.scale_features(df, ["a", "b", "c"])
    got = ml.downtime_ridge(scaled, ["a", "b", "c"])
    train = np.array([(i % ml.SPLIT_PRIME) * ml.SPLIT_STEP % ml.SPLIT_PRIME % 100 < 80 for i in range(300)])
    z = (x - x[train].mean(0)) / x[train].std(0)
    zt, yt = z[train], y[train]
    want = np.linalg.solve(zt.T @ zt + np.eye(3), zt.T @ (yt - yt.mean()))
    assert np.allclose([got["a"], got["b"], got["c"], got["intercept"]], [*want, yt.mean()], atol=1e-8)
    assert 0.7 < train.mean() < 0.9
    said = ml.predict(got, scaled, ["a", "b", "c"]).orderBy("downtime_id").collect()
    assert np.allclose([r["predicted_downtime"] for r in said], z @ want + yt.mean(), atol=1e-8)


def test_each_batch_is_predicted_once_by_a_model_that_never_saw_it(spark):
    draw = random.Random(1)
    rows = []
    for i in range(300):
        late = draw.random() < 0.3
        status = None if i % 25 == 0 else ("DELAY" if late else "ON TIME")
        rows.append((i, draw.randrange(4), draw.randrange(3), draw.randrange(3), 1, 1, draw.randrange(10, 20) if late else draw.randrange(0, 9), 30 if i % 9 else None, status))
    feats = spark.createDataFrame(rows, "batch_id long, product_code int, operator_code int, shift_code int, month int, day int, start_hour int, min_batch_time int, status string")
    got = ml.status_classifier_oof(feats, k=3, num_trees=8, max_depth=4).collect()
    assert sorted(r["batch_id"] for r in got) == list(range(300))
    assert all(r["predicted_status"] in ("DELAY", "ON TIME") for r in got)
    known = [r for r in got if r["status"]]
    hits = np.mean([r["status"] == r["predicted_status"] for r in known])
    assert hits > max(np.mean([r["status"] == s for r in known]) for s in ("DELAY", "ON TIME")) and hits > 0.95
    assert {r["min_batch_time"] for r in got} == {30, None}
    # a label flipped in one fold leaves that fold's own predictions as they are
    flipped = feats.withColumn("status", F.when(ml.fold_of("batch_id", 3) == 0, F.when(F.col("status") == "DELAY", "ON TIME").otherwise("DELAY")).otherwise(F.col("status")))
    again = {r["batch_id"]: r["predicted_status"] for r in ml.status_classifier_oof(flipped, k=3, num_trees=8, max_depth=4).where(ml.fold_of("batch_id", 3) == 0).collect()}
    assert again == {r["batch_id"]: r["predicted_status"] for r in got if r["batch_id"] in again}


@pytest.mark.parametrize("limit", [50_000, 1])
def test_codes_are_alphabetical_for_any_vocabulary(spark, monkeypatch, limit):
    monkeypatch.setattr(ml, "BROADCAST_CODES", limit)
    values = ["b", None, "a", "zz", "b", None, "nan2"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, shift string")
    got = {r["id"]: r["shift_code"] for r in ml.encode_alphabetical(df, ["shift"]).collect()}
    order = sorted({v or "nan" for v in values})
    assert got == {i: order.index(v or "nan") for i, v in enumerate(values)}


def test_encoding_small_vocabularies_moves_no_rows(spark):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("shift"))
    plan = ml.encode_alphabetical(df, ["shift"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_a_report_builds_only_what_it_reads(spark):
    from linepulse.plans.registry import load_all
    from linepulse.sources.testmap import StoredTables
    t = StoredTables(spark, SF_SMALL)
    t.root += "-lazy"
    load_all()["distinct_products"].fn(t).collect()
    assert t.built == ["products"]
    load_all()["status_counts"].fn(t).collect()
    assert "incidents_tagged" not in t.built
    t.release()
    assert t.built == []


def test_changed_files_are_read_again(spark, tmp_path):
    from linepulse.sources.testmap import StoredTables
    cols = spark.read.parquet(f"{SF_SMALL}/part.parquet")
    cols.limit(5).write.parquet(str(tmp_path / "part.parquet"))
    t = StoredTables(spark, str(tmp_path))
    assert t.p.count() == 5
    cols.limit(9).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    assert t.p.count() == 9


def test_split_windows_on_one_hot_minute(spark):
    from pyspark.sql import Window

    from linepulse.functions.scale import seq_cumsum, seq_lag, seq_number
    rows = [(i, "d1" if i % 3 else None, 600 if i % 2 else i % 7, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, day string, minute int, v long")
    w = Window.partitionBy("day").orderBy("minute", "id")
    want = {r["id"]: (r["n"], r["p"], r["s"]) for r in df.select(
        "id", F.row_number().over(w).alias("n"), F.lag("v").over(w).alias("p"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s")).collect()}
    got = seq_number(df, ["day"], ["minute", "id"], ["minute"], "n")
    got = seq_lag(got, ["day"], ["minute", "id"], ["minute"], ["v"], ["p"])
    got = seq_cumsum(got, ["day"], ["minute", "id"], ["minute"], "v", "s")
    assert {r["id"]: (r["n"], r["p"], r["s"]) for r in got.collect()} == want


def test_one_shuffle_for_join_and_window(spark):
    from linepulse.functions.scale import seq_lag
    rows = [(i, "d", i % 9) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, day string, minute int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = seq_lag(df, ["day"], ["minute", "id"], ["minute"], ["id"], ["p"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    join = plan.index("SortMergeJoin")
    assert "Exchange" not in plan[plan.index("Window"):join]


def small_tables(spark, at, parts):
    """The test tables below ``at``, with so many rows of ``part`` and ``lineitem``."""
    for name in ("events", "supplier", "part", "lineitem"):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        if name in ("part", "lineitem"):
            df = df.limit(parts if name == "part" else 40 * parts)
        df.limit(300).write.mode("overwrite").parquet(str(at / f"{name}.parquet"))


def test_exports_and_models_follow_the_files(spark, tmp_path):
    from linepulse.plans import ml_plans, sources_plans
    from linepulse.sources.testmap import StoredTables
    small_tables(spark, tmp_path, 5)
    t = StoredTables(spark, str(tmp_path))
    assert sources_plans.read_products(t).count() == 5
    assert {r["table_name"]: r["row_count"] for r in sources_plans.read_all(t).collect()}["products"] == 5
    weights = {r["feature"]: r["coefficient"] for r in ml_plans.downtime_ridge(t).collect()}
    n = ml_plans.downtime_predictions_all(t).count()
    small_tables(spark, tmp_path, 7)
    assert sources_plans.read_products(t).count() == 7
    assert {r["table_name"]: r["row_count"] for r in sources_plans.read_all(t).collect()}["products"] == 7
    assert ml_plans.downtime_predictions_all(t).count() == t.i.count() > n
    assert ml_plans.write_downtime_predictions(t).count() == t.i.count()
    assert {r["feature"]: r["coefficient"] for r in ml_plans.downtime_ridge(t).collect()} != weights
