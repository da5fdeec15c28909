"""Work stretches: batches of an operator that follow one another without a long pause, also over midnight.

A stretch ends where the next batch begins ``gap_min`` minutes or more after the latest end so far.  Everything is computed per operator and day, with one row
a day carrying what came before (the latest end, the number of stretches), so an operator with a third of all batches is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepulse.functions.scale import seq_cumsum
from linepulse.sources.testmap import line_of

GAP_MIN = 60


def work_stretches(b: DataFrame, gap_min: int = GAP_MIN) -> DataFrame:
    """[line_id,] operator_name, stretch (1, 2, ...), started_at, ended_at (minutes since 1970-01-01), batches, worked_min.

    Batches without a date, start or duration belong to no stretch; those without an operator form one group of their own.
    """
    who = [*line_of(b), "operator_name"]
    known = b.where("prod_date IS NOT NULL AND start_min IS NOT NULL AND duration_min IS NOT NULL")
    day0 = F.datediff("prod_date", F.lit("1970-01-01").cast("date")).cast("long") * 1440
    rows = known.select(*who, "prod_date", "batch_id", (day0 + F.col("start_min")).alias("at"), (day0 + F.col("start_min") + F.col("duration_min")).alias("until"), "duration_min")
    rows = rows.withColumn("_who", F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("0")) for c in who]))
    days = rows.groupBy("_who", "prod_date").agg(F.max("until").alias("latest"))
    before = Window.partitionBy("_who").orderBy("prod_date").rowsBetween(Window.unboundedPreceding, -1)       # one row a day
    days = days.select("_who", "prod_date", F.max("latest").over(before).alias("_before"))
    earlier = Window.partitionBy("_who", "prod_date").orderBy("at", "batch_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(days, ["_who", "prod_date"]).withColumn("_until", F.greatest(F.max("until").over(earlier), F.col("_before")))
    first = F.col("_until").isNull() | (F.col("at") - F.col("_until") >= gap_min)
    numbered = seq_cumsum(rows.withColumn("_first", first.cast("int")), ["_who"], ["prod_date", "at", "batch_id"], ["prod_date"], "_first", "stretch")
    return numbered.groupBy(*who, "stretch").agg(F.min("at").alias("started_at"), F.max("until").alias("ended_at"), F.count(F.lit(1)).alias("batches"),
                                                  F.sum("duration_min").cast("long").alias("worked_min"))
