"""Daily sketches within their error, rank correlation against a plain computation, several lines, cold incident sums."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from linepulse.operators import ranks, sketches
from linepulse.sources.testmap import BATCH_COLS, StoredTables, Tables


def test_distinct_counts_of_any_period_from_daily_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 30).cast("int").alias("day"), (F.col("id") * 7 % 20_000).alias("code"), F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("few"))
    daily = sketches.daily_distinct(df, "day", ["code", "few"]).cache()
    assert daily.count() == 30
    for days in (1, 7, 30):
        exact = df.where(F.col("day") < days).agg(F.count_distinct("code").alias("code"), F.count_distinct("few").alias("few")).first()
        got = sketches.distinct_over(daily.where(F.col("day") < days), ["code", "few"]).first()
        assert abs(got["code"] - exact["code"]) < 0.06 * exact["code"] and got["few"] == exact["few"]


def test_quantiles_of_any_period_from_daily_sketches(spark):
    draw = np.random.default_rng(1)
    values = {p: draw.gamma(3, 20, 20_000).astype(int) for p in (1, 2)}
    rows = [(p, i % 50, int(v)) for p, vs in values.items() for i, v in enumerate(vs)] + [(3, 1, 7), (1, 0, None)]
    daily = sketches.daily_quantiles(spark.createDataFrame(rows, "product int, day int, minutes int"), "product", "day", "minutes").cache()
    for days in (5, 50):
        got = {r["product"]: r for r in sketches.outlier_rates(daily.where(F.col("day") < days), "product").collect()}
        for p, vs in values.items():
            mine = np.sort(vs[np.arange(len(vs)) % 50 < days])
            for name, share in (("q1", 0.25), ("q3", 0.75)):          # rank error
                lo, hi = np.searchsorted(mine, got[p][name], "left") / len(mine), np.searchsorted(mine, got[p][name], "right") / len(mine)
                assert lo - 0.03 <= share <= hi + 0.03
            q1, q3 = got[p]["q1"], got[p]["q3"]
            rate = np.mean((mine < q1 - 1.5 * (q3 - q1)) | (mine > q3 + 1.5 * (q3 - q1)))
            assert abs(got[p]["outlier_rate"] - rate) < 0.03 and got[p]["n"] == len(mine)
        assert (got[3]["q1"], got[3]["q3"], got[3]["outlier_rate"]) == (7, 7, 0)


def average_ranks(x):
    x = np.asarray(x, dtype=float)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_rank_correlation_with_ties_and_nulls(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([None, 1, 1, 2, 5]), draw.randrange(30), i % 7 if i % 3 else None, 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int, d int").repartition(3)
    pairs = [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")]
    got = {(r["metric_a"], r["metric_b"]): (r["correlation"], r["n"]) for r in ranks.rank_correlations(df, pairs).collect()}
    for x, y in pairs[:3]:
        known = [(r["abc".index(x) + 1], r["abc".index(y) + 1]) for r in rows if r["abc".index(x) + 1] is not None and r["abc".index(y) + 1] is not None]
        want = np.corrcoef(*[average_ranks(v) for v in zip(*known)])[0, 1]
        assert abs(got[x, y][0] - want) < 1e-6 and got[x, y][1] == len(known)
    assert got["b", "d"] == (None, 400)
    empty = ranks.rank_correlations(df.limit(0), pairs).collect()
    assert [(r["correlation"], r["n"]) for r in empty] == [(None, 0)] * 4


@pytest.mark.parametrize("key", ["changeovers_daily", "idle_gap_daily", "changeovers_running", "idle_time_rows", "sequence_impact", "fatigue_by_worked_minutes"])
def test_two_lines_give_each_lines_own_answers(spark, key):
    from linepulse.plans.registry import load_all
    draw = random.Random(3)
    day = dt.date(2024, 8, 29)
    rows = [(i, day + dt.timedelta(days=draw.randrange(3)), f"p{draw.randrange(3)}", f"o{draw.randrange(2)}", draw.randrange(1300), 0, draw.randrange(20, 90), "Morning", "DELAY", draw.choice("xy"))
            for i in range(60)]
    kinds = ["bigint", "date", "string", "string", "int", "int", "int", "string", "string"]
    b = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(BATCH_COLS, kinds)) + ", line_id string").cache()
    p = spark.createDataFrame([(f"p{i}", "Cola", "2 L", 2.0, 50 + i) for i in range(3)], "product_id string, flavor string, size string, size_l double, min_batch_time int")
    i = spark.createDataFrame([(1, 1, 7, 10)], "downtime_id long, batch_id long, factor_id int, downtime_min int")
    f = spark.createDataFrame([(7, "Machine failure", "No")], "factor_id int, description string, operator_error string")
    run = load_all()[key].fn
    both = run(Tables(b, p, i, f))
    got = sorted(map(tuple, both.select("line_id", *[c for c in both.columns if c != "line_id"]).collect()), key=str)
    want = []
    for line in "xy":
        one = run(Tables(b.where(F.col("line_id") == line).drop("line_id"), p, i, f))
        want += [(line, *r) for r in one.select(*[c for c in both.columns if c != "line_id"]).collect()]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("key", ["mttr", "total_downtime", "downtime_ratio", "kpi_summary", "downtime_statistics"])
def test_sums_over_incidents_sort_nothing(spark, key):
    from linepulse.plans.registry import load_all
    t = StoredTables(spark, SF_SMALL)
    t.root += f"-cold-{key}"
    load_all()[key].fn(t).collect()
    assert not {"incidents_tagged", "incident_offsets", "incident_detail"} & set(t.built)
    t.release()
