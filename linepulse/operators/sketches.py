"""Mergeable daily sketches: approximate distinct counts and quantiles over any period, without reading the facts again.

Opt-in beside the exact reports.  One row for each day (and group) is stored; a period is answered by merging its days' sketches.  Distinct counts: a
HyperLogLog sketch of 2 ^ LG_K buckets, relative standard error about 1.04 / 2 ^ (LG_K / 2) (1.6 % at 12; exact in practice up to some hundred values).
Quantiles: a KLL sketch, normalised rank error about 1.3 % at k = 200; exact while a merged sketch has at most k values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
KLL_K = 200


def daily_distinct(df: DataFrame, day: str, columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """One row a day with a distinct sketch of each column (NULLs are not counted)."""
    return df.groupBy(day).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(c) for c in columns])


def distinct_over(daily: DataFrame, columns: Sequence[str], by: Sequence[Column] = ()) -> DataFrame:
    """Approximate distinct counts of each column over the rows of ``daily`` (of each group ``by``)."""
    return daily.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in columns])


def daily_quantiles(df: DataFrame, group: str, day: str, value: str, k: int = KLL_K) -> DataFrame:
    """One row a group and day: a quantile sketch of the whole-number column, and the number of its values."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(group, day).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def quantiles_over(daily: DataFrame, group: str, shares: Sequence[float]) -> DataFrame:
    """group, n, sketch and ``q`` (the values at the given shares) over the rows of ``daily``."""
    merged = daily.groupBy(group).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.withColumn("q", F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit(float(s)) for s in shares])))


STEPS = 500     # of the grid on which a rate is read off a quantile sketch


def fences(daily: DataFrame, group: str, k: float = 1.5) -> DataFrame:
    """group, n, q1, q3, low, high and the merged sketch: the outlier rule's limits q1 - k * iqr and q3 + k * iqr."""
    q = quantiles_over(daily, group, (0.25, 0.75)).withColumn("q1", F.col("q")[0]).withColumn("q3", F.col("q")[1])
    iqr = F.col("q3") - F.col("q1")
    return q.select(group, "n", "q1", "q3", (F.col("q1") - k * iqr).alias("low"), (F.col("q3") + k * iqr).alias("high"), "sketch")


def outlier_rates(daily: DataFrame, group: str, k: float = 1.5) -> DataFrame:
    """group, n, q1, q3 and the share of values outside the fences, all from stored sketches: the share of a grid of quantiles that lies outside (to 1 /
    STEPS, beside the sketch's own error)."""
    grid = F.kll_sketch_get_quantile_bigint("sketch", F.array(*[F.lit((j + 0.5) / STEPS) for j in range(STEPS)]))
    outside = F.size(F.filter("grid", lambda v: (v < F.col("low")) | (v > F.col("high"))))
    return fences(daily, group, k).withColumn("grid", grid).select(group, "n", "q1", "q3", (outside / STEPS).alias("outlier_rate"))
