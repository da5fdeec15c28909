"""Marts by date, footers, two-phase duplicates, spellings one edit apart, work stretches."""

import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from linepulse.operators import dated, footers, quality, spelling, stretches


def listing(path):
    return {d: sorted(f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def test_a_correction_rewrites_only_its_dates(spark, tmp_path):
    path, day = str(tmp_path / "mart"), dt.date(2024, 8, 29)
    rows = [(i, day + dt.timedelta(days=i % 5) if i != 7 else None, i * 10) for i in range(40)] + [(99, day + dt.timedelta(days=9), 5)]
    shape = "batch_id long, prod_date date, actual_min int"
    report = spark.createDataFrame(rows, shape)
    dated.store(report, path)
    before = listing(path)
    # a late duration, a batch that moves to another day (and leaves its own empty), a batch whose date becomes known
    fixed = [(i, day if i in (99, 7) else d, 77 if i == 3 else m) for i, d, m in rows]
    after = spark.createDataFrame(fixed, shape)
    ids = F.col("batch_id").isin(3, 99, 7)
    dates = dated.touched(report.where(ids), after.where(ids), "batch_id")
    assert set(dates) == {day, day + dt.timedelta(days=3), day + dt.timedelta(days=9), None}
    dated.refresh(after, path, dates)
    now = listing(path)
    assert {d for d in before if now.get(d) != before[d]} == {f"prod_date={x}" if x else "prod_date=__HIVE_DEFAULT_PARTITION__" for x in dates}
    spark.catalog.refreshByPath(path)
    assert sorted(map(tuple, dated.load(spark, path, report).collect()), key=str) == sorted(fixed, key=str)


def test_profiles_come_from_footers(spark, tmp_path):
    from linepulse.plans.quality_cleaning import stored_table_profile
    from linepulse.sources.testmap import StoredTables
    path = str(tmp_path / "t")
    spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") * 3).cast("int")).alias("v"), F.col("id").cast("string").alias("s")).write.parquet(path)
    agg = footers.footer_aggregate(spark, path, ["id", "v", "s"])
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(id), COUNT(v), COUNT(s), MIN(id), MAX(id), MIN(v), MAX(v)]" in plan
    got = {r["column_name"]: tuple(r)[1:] for r in footers.footer_profile(spark, path, ["id", "v", "s"]).collect()}
    assert got == {"id": (1000, 1000, "0", "999"), "v": (1000, 857, "3", "2997"), "s": (1000, 1000, None, None)}
    t = StoredTables(spark, SF_SMALL)
    t.root += "-footers"
    assert {r["row_count"] for r in stored_table_profile(t).where("table_name = 'batches'").collect()} == {t.b.count()}
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""
    t.release()


def test_duplicates_compare_only_rows_of_repeated_digests(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(draw.randrange(40), draw.choice([None, "a", "b"]), draw.choice([None, "a", "b"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "x int, y string, z string").repartition(4)
    for few in (quality.FEW_DIGESTS, 0):
        monkeypatch.setattr(quality, "FEW_DIGESTS", few)
        assert quality.full_row_duplicates(df, "t").first()["duplicate_rows"] == len(rows) - len(set(rows))
        assert sorted(map(tuple, quality.without_full_duplicates(df).collect()), key=str) == sorted(set(rows), key=str)
    assert quality.full_row_duplicates(df.limit(0), "t").first()["duplicate_rows"] == 0
    monkeypatch.setattr(quality, "FEW_DIGESTS", 100)
    once = spark.range(500).select("id", F.lit("x").alias("y"))
    digests, n = quality.repeated_digests(once.unionByName(once.limit(20)))
    assert n == 20 and quality.candidates(once, digests, n).count() == 20


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spellings_equal_all_pairs(spark):
    draw = random.Random(4)
    words = {"".join(draw.choices("abé", k=draw.randrange(0, 6))) for _ in range(150)} | {"Charlie", "Charly", "Chalie", "charlie", "Charliee", "C", ""}
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "name string")
    pairs = spelling.one_edit_apart(df, "name")
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if distance(a, b) == 1}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    names = spark.createDataFrame([("Charlie",)] * 9 + [("Charli",)] * 2 + [("Chalie",)] * 4 + [("Dan",)] * 3, "name string")
    assert {tuple(r) for r in spelling.proposals(names, "name").collect()} == {("Charli", 2, "Charlie", 9)}


@pytest.mark.parametrize("seed", range(2))
def test_stretches_run_over_midnight(spark, seed):
    draw, day = random.Random(seed), dt.date(2024, 8, 29)
    rows = [(i, day + dt.timedelta(days=draw.randrange(6)), draw.choice(["a", "a", "b", None]), draw.randrange(1440), draw.randrange(5, 400)) for i in range(120)]
    rows += [(900, day, "night", 1380, 100), (901, day + dt.timedelta(days=1), "night", 50, 30), (902, day + dt.timedelta(days=1), "night", 140, 10), (903, None, "night", 1, 1), (904, day, "night", 1, None)]
    b = spark.createDataFrame(rows, "batch_id long, prod_date date, operator_name string, start_min int, duration_min int").repartition(3)
    got = {(r["operator_name"], r["stretch"]): (r["started_at"], r["ended_at"], r["batches"], r["worked_min"]) for r in stretches.work_stretches(b).collect()}
    want, epoch = {}, dt.date(1970, 1, 1)
    for who in {r[2] for r in rows}:
        mine = sorted(((r[1] - epoch).days * 1440 + r[3], r[0], r[4]) for r in rows if r[2] == who and r[1] and r[4] is not None)
        n, until = 0, None
        for at, _, minutes in mine:
            if until is None or at - until >= stretches.GAP_MIN:
                n += 1
                want[who, n] = (at, at, 0, 0)
            until = max(until or 0, at + minutes)
            s = want[who, n]
            want[who, n] = (s[0], max(s[1], at + minutes), s[2] + 1, s[3] + minutes)
    assert got == want
    assert [v[2] for k, v in sorted(got.items(), key=str) if k[0] == "night"] == [2, 1]
