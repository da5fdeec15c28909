"""Split windows and the distributed index agree with plain single-partition windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from linepulse.functions.scale import dense_index, seq_cumsum, seq_lag, seq_lead, seq_number


def _frame(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # one hot group ('g0') holding about a third of the rows
        g = "g0" if rnd.random() < 0.34 else f"g{rnd.randint(1, 20)}"
        rows.append((i, g, rnd.randint(0, 50), rnd.randint(0, 9), rnd.randint(1, 30)))
    return spark.createDataFrame(rows, "id long, grp string, bucket int, val int, dur int")


def test_seq_lag_lead_number_cumsum(spark):
    df = _frame(spark)
    order = ["bucket", "id"]
    w = Window.partitionBy("grp").orderBy(*order)
    ref = (df.withColumn("lag_ref", F.lag("val").over(w)).withColumn("lead_ref", F.lead("val").over(w))
             .withColumn("rn_ref", F.row_number().over(w))
             .withColumn("cs_ref", F.coalesce(F.sum("dur").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0))))
    got = seq_lag(df, ["grp"], order, ["bucket"], ["val"], ["lag"])
    got = seq_lead(got, ["grp"], order, ["bucket"], ["val"], ["lead"])
    got = seq_number(got, ["grp"], order, ["bucket"], "rn")
    got = seq_cumsum(got, ["grp"], order, ["bucket"], "dur", "cs", exclusive=True)
    j = ref.join(got.select("id", "lag", "lead", "rn", "cs"), "id")
    bad = j.filter(~F.col("lag").eqNullSafe(F.col("lag_ref")) | ~F.col("lead").eqNullSafe(F.col("lead_ref"))
                   | (F.col("rn") != F.col("rn_ref")) | (F.col("cs") != F.col("cs_ref")))
    assert j.count() == df.count()
    assert bad.count() == 0


def test_seq_lag_without_group(spark):
    df = _frame(spark, 800, seed=3)
    order = ["grp", "bucket", "id"]
    ref = df.withColumn("lag_ref", F.lag("val").over(Window.orderBy(*order)))
    got = seq_lag(df, [], order, ["grp", "bucket"], ["val"], ["lag"])
    j = ref.join(got.select("id", "lag"), "id")
    assert j.filter(~F.col("lag").eqNullSafe(F.col("lag_ref"))).count() == 0


def test_dense_index_matches_row_number(spark):
    df = _frame(spark, 2000, seed=11)
    keys = ["grp", "bucket", "val", "id"]
    got = dense_index(df, keys, "ix", partitions=5)
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy(*keys)))
    j = ref.join(got.select("id", "ix"), "id")
    assert j.count() == 2000
    assert j.filter(F.col("ix") != F.col("rn")).count() == 0


def test_global_split_windows_three_levels(spark):
    """A global order split two levels deep (group, bucket) gives the plain global window."""
    df = _frame(spark, 1500, seed=5)
    order = ["grp", "bucket", "id"]
    w = Window.orderBy(*order)
    ref = (df.withColumn("lag_ref", F.lag("val").over(w)).withColumn("lead_ref", F.lead("val").over(w))
             .withColumn("rn_ref", F.row_number().over(w))
             .withColumn("cs_ref", F.coalesce(F.sum("dur").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0))))
    got = seq_lag(df, [], order, ["grp", "bucket"], ["val"], ["lag"])
    got = seq_lead(got, [], order, ["grp", "bucket"], ["val"], ["lead"])
    got = seq_number(got, [], order, ["grp", "bucket"], "rn")
    got = seq_cumsum(got, [], order, ["grp", "bucket"], "dur", "cs", exclusive=True)
    j = ref.join(got.select("id", "lag", "lead", "rn", "cs"), "id")
    assert j.count() == 1500
    bad = j.filter(~F.col("lag").eqNullSafe(F.col("lag_ref")) | ~F.col("lead").eqNullSafe(F.col("lead_ref"))
                   | (F.col("rn") != F.col("rn_ref")) | (F.col("cs") != F.col("cs_ref")))
    assert bad.count() == 0
