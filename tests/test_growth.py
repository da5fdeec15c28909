"""Work that has to hold on larger tables: exports cut into parts, incidents without ids, the forest's arithmetic, the wide sheet."""

import datetime
import time

import numpy as np
import pytest

from linepulse.operators import forest, marts
from linepulse.plans.registry import load_all
from linepulse.sources import csv_layout as L
from linepulse.sources.testmap import Tables

BATCHES = ("batch_id long, prod_date date, product_id long, operator_name string, start_min int, end_min int, duration_min int, "
           "shift string, status string")


def _tables(spark, n=400):
    day = datetime.date(2024, 1, 1)
    b = spark.createDataFrame([(k, day + datetime.timedelta(k % 9), k % 7, f'op "{k % 3}", line', k % 1440, (k + 5) % 1440, k % 60, "Night", "ON TIME")
                               for k in range(1, n + 1)], BATCHES)
    p = spark.createDataFrame([(k, "Cola", "2 L", 2.0, 20 + k) for k in range(6)], "product_id long, flavor string, size string, size_l double, min_batch_time int")
    i = spark.createDataFrame([(k, k % (n + 40) or None, k % 14 or None, None if k % 11 == 0 else k % 50) for k in range(1, 3 * n)],
                              "downtime_id long, batch_id long, factor_id int, downtime_min int")
    f = spark.createDataFrame([(k, f"Factor {k}", "Yes" if k % 2 else "No") for k in range(1, 13)], "factor_id int, description string, operator_error string")
    return Tables(b, p, i, f, sf_dir="growth")


def test_rejects_of_an_export_cut_into_parts(spark):
    """a part of a file that begins below the header is read as records."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {r["reason"]: r["rejected_rows"] for r in load_all()["csv_rejects"].fn(_tables(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    many, few = sum(k % 37 == 0 for k in range(1, 401)), sum(k % 53 == 0 and k % 37 != 0 for k in range(1, 401))
    assert got == {"too many fields": many, "too few fields": few, "good": 400 - many - few}


def test_lines_are_written_as_they_stand(spark, tmp_path):
    lines = ['1,"a, ""b"""', ' 2 , \\ ', "#3,", '"']
    path = L.write_lines(spark.createDataFrame([(x,) for x in lines], "value string"), ["k", "v"], str(tmp_path / "x"))
    got = [r[0] for r in spark.read.text(path).collect()]
    assert sorted(x for x in got if x != "k,v") == sorted(lines) and "k,v" in got


def test_counting_reports_sort_no_incidents(spark, tmp_path):
    """Counts and sums build the detail without ids."""
    from linepulse.sources.testmap import StoredTables
    t = StoredTables(spark, "/root/testdata/sf0.001")
    t.root = str(tmp_path / "tables")
    for key in ("operator_closest_to_target", "product_avg_time_inc", "daily_downtime", "shift_factor_downtime", "fk_orphans", "top5_factors_by_duration"):
        load_all()[key].fn(t).collect()
    assert "incident_rows" in t.built and not {"incidents_tagged", "incident_detail"} & set(t.built)


@pytest.mark.parametrize("view", ["detail", "incident_factor", "batch_incident", "batch_incident_factor", "batch_product_incident",
                                  "batch_product_incident_factor", "complete_table"])
def test_views_without_ids_keep_every_row(spark, view):
    t, make = _tables(spark, 60), getattr(marts, view)
    full, rows = make(t), make(t, ids=False)
    rest = [c for c in full.columns if c != "downtime_id"]
    assert [c for c in rows.columns if c != "incident"] == rest
    a = full.selectExpr("downtime_id IS NOT NULL AS incident", *rest).collect()
    b = rows.selectExpr("incident IS NOT NULL AS incident", *rest).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and a


def test_ids_need_only_the_columns_that_incidents_are_made_of(spark):
    """the sort for the ids carries no other column; line items alike in these are the same incident."""
    from linepulse.sources import testmap as T
    rows = [(k % 5, k % 3, 1, k % 4, float(k % 2), 90.0 - k, 0.1 * k, 0.0, datetime.datetime(2024, 1, 1 + k % 20)) for k in range(60)]
    items = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                                        "l_discount double, l_tax double, l_shipdate timestamp")
    tagged = T.incidents_tagged(items)
    assert "l_extendedprice" not in tagged._jdf.queryExecution().optimizedPlan().toString().split("Project")[1]
    tagged = tagged.checkpoint() if spark.sparkContext.getCheckpointDir() else tagged.cache()
    got = [tuple(r) for r in T.incidents_numbered(tagged, T.partition_offsets(tagged)).orderBy("downtime_id").collect()]
    key = sorted(rows)
    assert got == [(n + 1, r[0], r[3] % 12 + 1, int(r[4] * (1 + r[3] % 4) // 2)) for n, r in enumerate(key)]


def test_wide_sheet_is_one_aggregate(spark):
    """One row a batch in memory, and the sums of a pivot."""
    t = _tables(spark, 50)
    wide = L.wide_downtime(t.i, t.f)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "pivotfirst" not in plan
    want = {}
    for r in t.i.collect():
        row = want.setdefault(r["batch_id"], {})
        if r["factor_id"] is not None and r["downtime_min"] is not None:
            row[r["factor_id"]] = row.get(r["factor_id"], 0) + r["downtime_min"]
    got = {r["batch_id"]: {int(k[2:]): v for k, v in r.asDict().items() if k != "batch_id" and v is not None} for r in wide.collect()}
    assert got == want


def test_forest_steps_and_weights_match_plain_ones():
    """rows go down the trees by tables of steps, weights come from the first bits of a hash."""
    rng = np.random.default_rng(3)
    h = rng.integers(-2 ** 63, 2 ** 63 - 1, 20_000)
    x = h.view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * 6 + 42) & (2 ** 64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2 ** 53
    assert (forest.poisson_weights(h, 5, 42) == np.searchsorted(forest._POISSON, u)).all()
    trees = forest.Trees(1, 4, 2, 1)
    for node in (1, 2, 3, 5, 11):
        trees.feature[0, node], trees.mask[0, node] = node % 3, int(rng.integers(1, 2 ** 62))
    rows = rng.integers(0, 62, (500, 3)).astype(np.uint8)
    for levels in range(5):
        want = []
        for r in rows:
            at = 1
            for _ in range(levels):
                if trees.feature[0, at] >= 0:
                    at = 2 * at + (int(trees.mask[0, at]) >> int(r[trees.feature[0, at]]) & 1)
            want.append(at)
        assert trees.place(trees.steps(0, levels), rows, levels).tolist() == want


def test_predictions_write_no_second_copy_of_the_incidents(spark, monkeypatch):
    """the frame of the regression is read from the detail, not checkpointed."""
    t, calls = _tables(spark, 60), []
    plain = type(t.b).checkpoint
    monkeypatch.setattr(type(t.b), "checkpoint", lambda self, *a, **k: calls.append(1) or plain(self, *a, **k))
    rows = load_all()["downtime_predictions_all"].fn(t).collect()
    assert len(rows) == t.i.count() and not calls


def test_incidents_are_not_dealt_by_factor(spark, tmp_path):
    """a dozen factors go to all tasks also where Spark sends no table by itself; rows dealt by factor would meet in a dozen tasks."""
    from linepulse.sources.testmap import StoredTables
    day = datetime.datetime(2024, 1, 1, 7)
    made = {"supplier": spark.createDataFrame([(k,) for k in range(1, 9)], "s_suppkey long"),
            "part": spark.createDataFrame([(k, "LARGE", 30 + k) for k in range(5)], "p_partkey long, p_type string, p_size int"),
            "events": spark.createDataFrame([(k, day, k % 3, 40.0) for k in (*range(1, 30), 5)], "event_id long, ts timestamp, user_id long, value double"),
            "lineitem": spark.createDataFrame([(k % 40 or None, 1, 1, k % 14 or None, 2.0) for k in range(1, 200)],
                                              "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")}
    for name, df in made.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    t = StoredTables(spark, str(tmp_path))
    t.root, plain = str(tmp_path / "tables"), t._stored
    t._stored = lambda name, sources, make: make() if name in ("incident_rows", "incident_detail", "batches_wide") else plain(name, sources, make)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame in (t.dr, t.d, t.bt):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(batch_id" in plan and "hashpartitioning(factor_id" not in plan
        rows, full = t.dr.collect(), t.d.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    names = [c for c in t.d.columns if c != "downtime_id"]
    assert sorted(repr([r[c] for c in names]) for r in rows) == sorted(repr([r[c] for c in names]) for r in full)
    assert len(rows) == 199 + sum(k % 40 == 5 for k in range(1, 200)) and all(r["incident"] for r in rows)
    assert sum(r["has_factor"] for r in full) == sum(k % 14 > 0 and k % 14 % 12 + 1 in range(2, 10) for k in range(1, 200) for _ in range(1 + (k % 40 == 5)))


def test_orphans_are_counted_by_key_before_they_meet_parents(spark):
    """however many rows share a key, they meet its parent as one row."""
    from linepulse.operators import quality
    child = spark.createDataFrame([(k % 5 or None,) for k in range(1000)], "factor_id int")
    parent = spark.createDataFrame([(1,), (1,), (4,), (None,), (9,)], "factor_id int")
    found = quality.orphans(child, parent, "factor_id", "incident->factor")
    assert [tuple(r) for r in found.collect()] == [("incident->factor", 400)]
    assert [tuple(r) for r in quality.orphans(child.limit(0), parent, "factor_id", "x").collect()] == [("x", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [factor_id" in plan.split("LeftAnti")[1]


def test_a_written_step_leaves_no_shuffle_files(spark):
    """Pipeline's disk: shuffle files go with the step that made them, not when the driver happens to collect its garbage."""
    from linepulse.llm.common import DONE_SHUFFLES, written

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in files.split("\n") if "shuffle_" in x}

    before, setting = shuffles(), spark.conf.get(DONE_SHUFFLES, None)
    many = spark.range(2000).selectExpr("id % 97 AS k", "id")
    step = many.join(many.groupBy("k").count().hint("shuffle_hash"), "k")
    got = written(step, "growth-step")
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(DONE_SHUFFLES, None) == setting
    assert sorted(map(tuple, got.collect())) == sorted((k % 97, k, len(range(k % 97, 2000, 97))) for k in range(2000))
    assert step.count() == 2000      # the frame itself can still be used
