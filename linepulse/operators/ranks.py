"""Rank correlation on whole tables: average ranks with ties, from counts of values.

Rows are counted once by (pair of columns, value, value); everything after that works on these counts, so a value that a third of all rows share is
one row.  The ranks come from running counts of the distinct values, by a range sort and one offset for each of its partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepulse.functions.scale import range_tag
from linepulse.session import shared_dir


def running_counts(df: DataFrame, order: Sequence[str], count: str, name: str) -> DataFrame:
    """``df`` with the sum of ``count`` over all rows before each in the total order; no window spans partitions."""
    shared_dir(df.sparkSession)
    tagged = range_tag(df, order).checkpoint(eager=True)
    before, rows = 0, []
    for r in tagged.groupBy("_lp_pid").agg(F.sum(count).alias("n")).orderBy("_lp_pid").collect():     # one row per partition
        rows.append((r["_lp_pid"], before))
        before += r["n"]
    offsets = df.sparkSession.createDataFrame(rows, "_lp_pid int, _lp_off long")
    inside = Window.partitionBy("_lp_pid").orderBy("_lp_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn(name, F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), "_lp_pid").withColumn(name, F.col(name) + F.col("_lp_off")).drop("_lp_pid", "_lp_pos", "_lp_off")


def rank_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """metric_a, metric_b, correlation (of average ranks), n: over the rows where both columns are known; NULL if one does not vary."""
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for k, (a, b) in enumerate(pairs)]))
    cells = df.select(both.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.checkpoint(eager=True) if shared_dir(df.sparkSession) else cells
    sides = cells.select("pair", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(v).alias("v")) for s, v in enumerate("xy")])).alias("e"))
    values = sides.groupBy("pair", "e.side", "e.v").agg(F.sum("n").alias("n"))
    counted = running_counts(values, ["pair", "side", "v"], "n", "before")
    first = counted.groupBy("pair", "side").agg(F.min("before").alias("first"), F.sum("n").alias("total"))
    # two rows for each pair
    ranked = counted.join(F.broadcast(first), ["pair", "side"]).select(
        "pair", "side", "v", (F.col("before") - F.col("first") + (F.col("n") - F.col("total")) / 2).alias("r"))        # rank less the mean rank
    of = [ranked.where(F.col("side") == s).select("pair", F.col("v").alias(v), F.col("r").alias(f"r{v}")) for s, v in enumerate("xy")]
    placed = cells.join(of[0], ["pair", "x"]).join(of[1], ["pair", "y"])
    sums = placed.groupBy("pair").agg(F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"), F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("xx"),
                                      F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("yy"), F.sum("n").alias("n"))
    names = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, metric_a string, metric_b string")
    return names.join(F.broadcast(sums), "pair", "left").select(
        "metric_a", "metric_b", F.round(F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0)), 6).alias("correlation"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
