"""Per-row feature expressions (F keys) as reusable DataFrame / Column operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linepulse.functions.expr import c

FILL_TEXT = "fill missing value"


def clock(minute_col) -> Column:
    """Minutes of the day as HH:MM text."""
    m = c(minute_col)
    return F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


def status_three_level(duration, target, slight: int = 15) -> Column:
    """On Time / Slight Delay (within ``slight`` minutes of target) / Critical Delay; unknown target is
    Critical (comparisons with NULL are not true)."""
    d, tg = c(duration), c(target)
    return (F.when(d <= tg, "On Time").when(d <= tg + F.lit(slight), "Slight Delay").otherwise("Critical Delay"))


def calendar(b: DataFrame) -> DataFrame:
    return b.withColumns({"month": F.month("prod_date"), "day": F.dayofmonth("prod_date"),
                          "start_hour": F.floor(F.col("start_min") / 60).cast("int")})


def has_reason(description="description") -> Column:
    d = c(description)
    return d.isNotNull() & (d != F.lit(FILL_TEXT))


def size_litres(size="size") -> Column:
    """Bottle size in litres from labels such as '600 ml', '0.6L', '2 L', '2000 ML'."""
    s = c(size)
    number = F.regexp_extract(s, r"([0-9.]+)", 1).cast("double")
    unit = F.lower(F.regexp_extract(s, r"([A-Za-z]+)", 1))
    return F.when(unit == "l", number).otherwise(number / 1000)


def size_category(size="size") -> Column:
    return F.when(c(size).contains("600"), "Small").otherwise("Large")
