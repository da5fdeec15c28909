"""Boundary cases of the column rules (shift edges, midnight wrap, delay levels, label cleaning)."""

from pyspark.sql import functions as F


def test_shift_edges_and_wrap(spark):
    from linepulse.functions.expr import shift_of, wrap_minutes
    rows = [(359, 419), (360, 420), (839, 899), (840, 900), (1319, 1379), (1320, 1380), (1375, 65), (0, 0)]
    df = spark.createDataFrame(rows, "s int, e int").select("s", shift_of("s").alias("shift"),
                                                          wrap_minutes("s", "e").alias("d"))
    got = {r["s"]: (r["shift"], r["d"]) for r in df.collect()}
    assert got[359] == ("Night", 60) and got[360] == ("Morning", 60)
    assert got[839][0] == "Morning" and got[840][0] == "Afternoon"
    assert got[1319][0] == "Afternoon" and got[1320][0] == "Night"
    assert got[1375] == ("Night", 130)          # 22:55 -> 01:05 crosses midnight
    assert got[0] == ("Night", 0)


def test_delay_levels(spark):
    from linepulse.operators.features import status_three_level
    from linepulse.functions.expr import status_of
    rows = [(60, 60), (75, 60), (76, 60), (10, None)]
    df = spark.createDataFrame(rows, "d int, t int").select(
        "d", "t", status_three_level("d", "t").alias("s3"), status_of("d", "t").alias("s2"))
    got = [(r["s3"], r["s2"]) for r in df.orderBy("d").collect()]
    assert got == [("Critical Delay", "DELAY"), ("On Time", "ON TIME"), ("Slight Delay", "DELAY"),
                   ("Critical Delay", "DELAY")]


def test_label_cleaning(spark):
    from linepulse.operators import cleaning
    from linepulse.operators.features import size_litres
    sizes = ["600", "0.6L", "600 ML", "2 L", "2000", "2000 ML", "1.5 L"]
    df = spark.createDataFrame([(s,) for s in sizes], "size string")
    std = {r["raw"]: (r["size"], r["size_l"]) for r in
           cleaning.standardize_size(df.withColumn("raw", F.col("size"))).collect()}
    assert std["0.6L"] == ("600ml", 0.6) and std["2 L"] == ("2000ml", 2.0) and std["1.5 L"] == ("1.5 L", None)
    lit = {r["size"]: r["l"] for r in df.select("size", size_litres("size").alias("l")).collect()}
    assert lit["600 ML"] == 0.6 and lit["2 L"] == 2.0 and lit["2000 ML"] == 2.0
    names = spark.createDataFrame([("Charly",), ("charli",), ("Chalie",), ("Dee",), (None,), ("  ",)], "operator_name string")
    fixed = [r[0] for r in cleaning.fill_operator_unknown(
        cleaning.fix_values(names, "operator_name", cleaning.OPERATOR_FIXES)).collect()]
    assert fixed == ["Charlie", "Charlie", "Charlie", "Dee", "Unknown", "Unknown"]


def test_dedup_keeps_first_in_order(spark):
    from linepulse.operators.cleaning import dedup
    rows = [(1, 5, "b"), (1, 3, "z"), (1, 3, "a"), (2, 9, "q"), (None, 1, "n"), (None, 0, "m")]
    df = spark.createDataFrame(rows, "k long, o int, v string")
    got = sorted(((r["k"] if r["k"] is not None else -1), r["o"], r["v"]) for r in dedup(df, ["k"], ["o", "v"]).collect())
    assert got == [(-1, 0, "m"), (1, 3, "a"), (2, 9, "q")]
