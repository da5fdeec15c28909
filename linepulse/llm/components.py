"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.llm.common import dropped, few, written


def _stars(pairs: DataFrame, small: bool, n: int) -> DataFrame:
    """One star step.  large: each node sends its larger neighbours to its least neighbour; small: the smaller ones and itself.

    n: at most so many nodes.  Rows may come out more than once, but no more of them than went in (small: than twice as many)."""
    if small:
        near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(few(least, n), "u")
    if small:
        ends = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")
        out = joined.select(ends).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least reachable node) for every node of ``links`` (u, v).

    Every round is written to the shared folder, so that the lineage stays short, and the round before it removed.  The number of
    rounds grows with the logarithm of the longest path.
    """
    pairs = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before, nodes = state, 2 * state[0]
        after = written(_stars(_stars(pairs, small=False, n=nodes), small=True, n=nodes).distinct(), "stars")
        dropped(pairs)
        pairs = after
    else:
        raise RuntimeError("the components did not settle")
    out = written(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    dropped(pairs)
    return out
