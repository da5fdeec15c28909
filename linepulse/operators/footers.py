"""Counts, minima and maxima of stored Parquet tables from their footers.

The V2 reader answers COUNT, MIN and MAX from the statistics in the footers (aggregate pushdown), so no column chunk is read.  It is switched on in a session of
its own, and the one-row answer comes back as a frame of the caller's session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDERED = {"boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date"}      # types whose ends the footers keep exactly


def footer_aggregate(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The aggregate, planned by the V2 reader: n, n_<column> (known values), min_<column> and max_<column> where the type has them."""
    other = spark.newSession()
    other.conf.set("spark.sql.sources.useV1SourceList", "")
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = other.read.parquet(path)
    types = dict(df.dtypes)
    out = [F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns]]
    for c in columns:
        if types[c] in ORDERED:
            out += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*out)


def footer_profile(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """column_name, row_count, non_null, minimum, maximum (as text) of every column."""
    agg = footer_aggregate(spark, path, columns)
    r = agg.first().asDict()

    def text(x):
        return None if x is None else str(x).lower() if isinstance(x, bool) else str(x)

    rows = [(c, r["n"], r[f"n_{c}"], text(r.get(f"min_{c}")), text(r.get(f"max_{c}"))) for c in columns]
    return spark.createDataFrame(rows, "column_name string, row_count long, non_null long, minimum string, maximum string")
