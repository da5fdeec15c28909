"""Invented rows in the line's text layout, read back by header names, give values worked out by hand.

Cases: exactly at target, slight and critical delay, product change, overnight wrap, unexplained delay, zero duration, a product that is
not in the dimension, a missing operator, missing minutes, an orphan incident.
"""

import pytest
from pyspark.sql import functions as F

from linepulse.operators.features import size_litres
from linepulse.sources import csv_layout as L
from linepulse.sources.testmap import Tables

PRODUCTS = """Product_id,Flavor,Size,Min batch time
A,Cola,600 ml,60
B,Orange,2 L,98
C,Lime,2 L,70
"""
# columns in another order than the line's, and a byte-order mark
BATCHES = """﻿Date,Batch,Operator_Name,Product_id,Start Time,End Time,Production Duration,Shift,Production_status
8/29/2024,1,x,A,6:00:00 AM,7:00:00 AM,1:00:00 AM,Morning,On Time
8/29/2024,2,x,A,7:00:00 AM,8:15:00 AM,1:15:00 AM,Morning,Delayed
8/29/2024,3,x,A,8:30:00 AM,10:10:00 AM,1:40:00 AM,Morning,Delayed
8/29/2024,4,x,A,10:10:00 AM,11:10:00 AM,1:00:00 AM,Morning,On Time
8/29/2024,5,y,B,1:30:00 PM,3:30:00 PM,2:00:00 AM,Morning,Delayed
8/29/2024,6,y,B,10:55:00 PM,1:05:00 AM,2:10:00 AM,Night,Delayed
8/30/2024,7,y,A,2:00:00 PM,3:40:00 PM,1:40:00 AM,Afternoon,Delayed
8/30/2024,8,y,A,3:40:00 PM,3:40:00 PM,12:00:00 AM,Afternoon,On Time
8/30/2024,9,x,Z,5:59:00 AM,6:59:00 AM,1:00:00 AM,Night,Delayed
8/30/2024,10,,A,9:59:00 PM,10:59:00 PM,1:00:00 AM,Afternoon,On Time
"""
INCIDENTS = """Downtime_id,Batch,Fact_id,DownTime_MIn
1,2,7,15
2,3,2,20
3,3,7,20
4,5,2,22
5,6,11,32
6,9,7,10
7,10,2,
8,99,7,5
"""
FACTORS = """Factor_ID,Description,Operator Error
2,Batch change,Yes
7,Machine failure,No
11,Label switch,Yes
"""


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("line")
    for name, text in (("p", PRODUCTS), ("b", BATCHES), ("i", INCIDENTS), ("f", FACTORS)):
        (at / f"{name}.csv").write_text(text, encoding="utf-8")
    return Tables(b=L.read_batches(spark, str(at / "b.csv")), p=L.read_products(spark, str(at / "p.csv")).withColumn("size_l", size_litres("size")),
                  i=L.read_incidents(spark, str(at / "i.csv")), f=L.read_factors(spark, str(at / "f.csv")), sf_dir=str(at))


def _q(key):
    from linepulse.plans.registry import load_all
    return load_all()[key].fn


def test_reading(t):
    row = t.b.agg(F.count(F.lit(1)).alias("n"), F.sum("duration_min").alias("d"), F.count("operator_name").alias("o")).first()
    assert tuple(row) == (10, 765, 9)
    got = {r["batch_id"]: (r["start_min"], r["end_min"], r["duration_min"]) for r in t.b.collect()}
    assert got[6] == (1375, 65, 130) and got[8] == (940, 940, 0) and got[9] == (359, 419, 60)


def test_shift_and_wrapped_duration(t):
    assert _q("shift_name")(t).filter(~F.col("matches_stored")).count() == 0
    wrapped = _q("duration_minutes")(t).join(t.b.select("batch_id", F.col("duration_min").alias("d0")), "batch_id")
    assert wrapped.filter(F.col("duration_min") != F.col("d0")).count() == 0


def test_status_and_totals(t):
    assert {r["status"]: r["total_batches"] for r in _q("status_counts")(t).collect()} == {"ON TIME": 4, "DELAY": 6}
    assert _q("total_downtime")(t).first()[0] == 124
    assert _q("mttr")(t).first()[0] == pytest.approx(124 / 7, abs=0.005)


def test_factors(t):
    # machine failure 50, batch change 42, label switch 32 of 124 minutes
    got = {r["description"]: r["total_downtime_min"] for r in _q("factor_downtime_share")(t).collect()}
    assert got == {"Machine failure": 50, "Batch change": 42, "Label switch": 32}


def test_sequences(t):
    assert {str(r["prod_date"]): r["changeover_count"] for r in _q("changeovers_daily")(t).collect()} == {"2024-08-29": 1, "2024-08-30": 1}
    # 15 + 140 + 445 on the first day, 421 + 0 + 379 on the second
    assert {str(r["prod_date"]): r["total_idle_gap_min"] for r in _q("idle_gap_daily")(t).collect()} == {"2024-08-29": 600, "2024-08-30": 800}


def test_unexplained_delay(t):
    assert [r["batch_id"] for r in _q("unexplained_delays")(t).collect()] == [7]


def test_matrix_keeps_unlisted_kinds(t, spark):
    more = spark.createDataFrame([(13, "Spilled paint", "Yes"), (14, None, "Yes")], t.f.schema)
    also = spark.createDataFrame([(20, 2, 13, 7), (21, 2, 14, 8)], t.i.schema)
    wide = Tables(b=t.b, p=t.p, i=t.i.unionByName(also), f=t.f.unionByName(more), sf_dir=t.sf_dir)
    x = {r["operator_name"]: r for r in _q("operator_error_matrix")(wide).collect()}["x"]
    assert (x["batch_change"], x["spilled_paint"], x["other_errors"], x["total_errors"]) == (1, 1, 1, 3)


def test_wide_sheet_keeps_every_factor(t, spark, tmp_path):
    also = spark.createDataFrame([(20, 2, 13, 50)], t.i.schema)
    i = t.i.unionByName(also).where("downtime_min IS NOT NULL")
    path = L.write_csv(L.wide_downtime(i, t.f), str(tmp_path / "wide"))
    back = L.unpivot_downtime(L.read_wide_downtime(spark, path))
    assert back.agg(F.sum("downtime_min")).first()[0] == 174
    assert [tuple(r) for r in back.where("factor_id = 13").collect()] == [(2, 13, 50)]


def test_long_durations_survive(t, spark, tmp_path):
    long = t.b.where("batch_id = 1").withColumn("duration_min", F.lit(1500).cast("int")).unionByName(t.b.where("batch_id = 6"))
    path = L.write_csv(L.batches_text(long), str(tmp_path / "b"))
    assert {r["batch_id"]: r["duration_min"] for r in L.read_batches(spark, path).collect()} == {1: 1500, 6: 130}


def test_headers_are_checked_and_a_title_row_is_skipped(spark, tmp_path):
    (tmp_path / "swapped.csv").write_text("Flavor,Product_id,Min batch time,Size\nCola,A,60,600 ml\n")
    assert tuple(L.read_products(spark, str(tmp_path / "swapped.csv")).first()) == ("A", "Cola", "600 ml", 60)
    (tmp_path / "missing.csv").write_text("Flavor,Product_id,Size\nCola,A,600 ml\n")
    with pytest.raises(ValueError, match="Min batch time"):
        L.read_products(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "titled.csv").write_text("Products of the line,,,\n" + PRODUCTS)
    assert L.read_products(spark, str(tmp_path / "titled.csv"), banner=True).count() == 3


def test_sinks(t, spark):
    from linepulse.plans import ml_plans
    for fmt in ("parquet", "csv"):
        out = ml_plans.write_downtime_predictions(t, fmt)
        assert out.columns == [*ml_plans.S09_COLUMNS, "predicted_downtime"] and out.count() == 8
        status = ml_plans.write_status_predictions(t, fmt)
        assert {"month", "day", "start_hour", "min_batch_time", "status_prediction"} <= set(status.columns) and status.count() == 10
