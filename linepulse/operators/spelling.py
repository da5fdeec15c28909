"""Spellings one edit apart, by a deletion neighbourhood: no pair of names is compared unless they share a variant.

Two texts at edit distance 1 share a variant when each is taken as it is and with any one character left out.  The variants of the distinct spellings are
joined by equality and the pairs that meet are confirmed; a group of one variant holds at most (length + 1) times (alphabet) spellings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variants(values: DataFrame, col: str) -> DataFrame:
    """``values`` with one row for each variant of ``col``."""
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.length(col), F.lit(1))), lambda i: F.concat(F.substring(F.col(col), F.lit(1), i - 1), F.substring(F.col(col), i + 1, F.length(col))))
    return values.withColumn("_variant", F.explode(F.array_distinct(F.concat(F.array(col), without))))


def one_edit_apart(values: DataFrame, col: str) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of ``col`` at edit distance 1."""
    of = variants(values.where(F.col(col).isNotNull()).select(F.col(col).alias("v")).distinct(), "v")
    pairs = of.withColumnRenamed("v", "a").join(of.withColumnRenamed("v", "b"), "_variant").where("a < b").select("a", "b").distinct()
    return pairs.where(F.levenshtein("a", "b") == 1)


def proposals(df: DataFrame, col: str, times: int = 3) -> DataFrame:
    """spelling, n, correction, n_correction: spellings one edit from another that is at least ``times`` as frequent; the most frequent one is
    proposed (ties: the first by code point)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    pairs = one_edit_apart(counts, "v")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = both.join(counts.select(F.col("v").alias("a"), F.col("n").alias("n_a")), "a").join(counts.select(F.col("v").alias("b"), F.col("n").alias("n_b")), "b").where(F.col("n_b") >= times * F.col("n_a"))
    best = met.groupBy(F.col("a").alias("spelling"), F.col("n_a").alias("n")).agg(F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b"))).alias("x"))
    return best.select("spelling", "n", F.col("x.b").alias("correction"), (-F.col("x.m")).alias("n_correction"))
