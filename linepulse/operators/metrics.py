"""Parametrised metric operators (DataFrame in, DataFrame out; no collect).

Every metric family of the line reports reduces to a handful of shapes: grouped volumes and
shares, duration / delay / downtime statistics per group, on-time rates, Pareto cuts, top rows
per group, pivot matrices, sequence phases and grain-safe ratios.  Group-by work uses partial
(map-side) aggregation, so a hot key is combined before the shuffle; windows only run over
already-aggregated frames (one row per group) unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linepulse.functions.expr import c, count_if, is_on_time, pct, r
from linepulse.functions.scale import _cols, with_total


def grouped(df: DataFrame, by, *aggs: Column) -> DataFrame:
    by = _cols(by)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def volume(df: DataFrame, by, name: str = "total_batches", distinct: str | None = None,
           where: Column | None = None) -> DataFrame:
    """Rows (or distinct ``distinct`` values) per group."""
    if where is not None:
        df = df.filter(where)
    agg = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    return grouped(df, by, agg.alias(name))


def share(df: DataFrame, by, measure: str | None = None, name: str = "n", pct_name: str = "pct",
          digits: int = 2, where: Column | None = None, distinct: str | None = None) -> DataFrame:
    """Per group: count (or SUM(measure)) and its share of the grand total in percent."""
    if where is not None:
        df = df.filter(where)
    if measure is None:
        agg = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    else:
        agg = F.sum(measure)
    g = grouped(df, by, agg.alias(name))
    return with_total(g, name, "_total").withColumn(pct_name, pct(name, "_total", digits)).drop("_total")


def on_time_rate(df: DataFrame, by, total: str = "total_batches", on_time: str | None = "on_time_batches",
                 rate: str = "otdr_pct", status: str = "status") -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(total), count_if(is_on_time(status)).alias("_ot")]
    g = grouped(df, by, *aggs).withColumn(rate, pct("_ot", total))
    return g.withColumnRenamed("_ot", on_time) if on_time else g.drop("_ot")


def pareto(df: DataFrame, by: str, measure: str, rule: str = "before_lt", threshold: float = 80.0,
           total: str = "total_min", cum_pct: str = "cumulative_pct") -> DataFrame:
    """Pareto cut of SUM(measure) by ``by``.

    ``before_lt``: keep a group while the cumulative share *before* it is below the threshold;
    ties share one cumulative value (RANGE frame), as in a SQL running total.
    ``upto_le``: running total over rows (ties broken by the group key), keep cumulative <= threshold.
    The windows run on the aggregated frame (one row per group).
    """
    g = df.groupBy(by).agg(F.sum(measure).alias(total))
    if rule == "before_lt":
        w = Window.orderBy(F.col(total).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        w = Window.orderBy(F.col(total).desc(), F.col(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = with_total(g, total, "_grand").withColumn("_cum", F.sum(total).over(w))
    if rule == "before_lt":
        keep = (F.col("_cum") - F.col(total)).cast("double") * 100.0 / F.col("_grand") < threshold
    else:
        keep = F.col("_cum").cast("double") * 100.0 / F.col("_grand") <= threshold
    return (g.filter(keep)
             .select(by, total, pct("_cum", "_grand").alias(cum_pct)))


def stats(df: DataFrame, by, measure: str, prefix: str = "", where: Column | None = None,
          which: Sequence[str] = ("count", "sum", "avg"), digits: int | None = None,
          count_col: str | None = None) -> DataFrame:
    """count / sum / avg / min / max / stddev of ``measure`` per group."""
    if where is not None:
        df = df.filter(where)
    m = c(measure)
    table = {
        "count": F.count(c(count_col) if count_col else m),
        "rows": F.count(F.lit(1)),
        "sum": F.sum(m),
        "avg": F.avg(m) if digits is None else r(F.avg(m), digits),
        "min": F.min(m),
        "max": F.max(m),
        "stddev": F.stddev_samp(m) if digits is None else r(F.stddev_samp(m), digits),
    }
    names = {k: f"{prefix}{k}" for k in which}
    return grouped(df, by, *[table[k].alias(names[k]) for k in which])


def top_per_group(df: DataFrame, group, order: Sequence[Column], n: int = 1, ties: bool = False,
                  name: str = "_rank") -> DataFrame:
    """Rows ranked <= n per group; ``ties`` keeps equal ranks (RANK) else ROW_NUMBER.

    The ``rank <= n`` filter lets Spark insert a group limit before the shuffle (partial
    WindowGroupLimit), so only n rows per group and per input partition are exchanged.
    """
    w = Window.partitionBy(*_cols(group)).orderBy(*order)
    fn = F.rank() if ties else F.row_number()
    return df.withColumn(name, fn.over(w)).filter(F.col(name) <= n).drop(name)


def matrix(df: DataFrame, rows, col: str, values: Sequence, agg: Column, fill=0) -> DataFrame:
    """Pivot with a fixed value list (never inferred), missing cells filled; the list must hold every value of ``col``."""
    out = df.groupBy(*_cols(rows)).pivot(col, list(values)).agg(agg)
    if fill is not None:
        out = out.na.fill(fill, subset=[str(v) for v in values])
    return out


def order_by(keys: Sequence[str]) -> list[Column]:
    """Sort keys written as names; a leading ``-`` means descending."""
    return [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]
