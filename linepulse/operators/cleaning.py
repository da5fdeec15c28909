"""Cleaning operators (C keys): each is a DataFrame -> DataFrame transform (no in-place updates)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linepulse.functions.expr import c

UNKNOWN_OPERATOR = "Unknown"
UNSPECIFIED_FACTOR = "Other/Unspecified"
FILL_TEXT = "fill missing value"
# Operator-name corrections and size label standardisation.
OPERATOR_FIXES = {"Charly": "Charlie", "charli": "Charlie", "Chalie": "Charlie"}
SMALL_LABELS = ["600", "0.6l", "600 ml", "600ml"]
LARGE_LABELS = ["2000", "2 l", "2000 ml", "2000ml", "2l"]


def blank_to_null(col) -> Column:
    return F.nullif(F.trim(c(col)), F.lit(""))


def fill_operator_unknown(df: DataFrame, col: str = "operator_name", value: str = UNKNOWN_OPERATOR) -> DataFrame:
    """Missing or blank operator -> 'Unknown' (other names kept as they are)."""
    return df.withColumn(col, F.when(blank_to_null(col).isNull(), F.lit(value)).otherwise(F.col(col)))


def fill_value(df: DataFrame, col: str, value) -> DataFrame:
    """Null -> constant."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def fill_mean(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Null -> the column's mean (one-row aggregate broadcast next to every row)."""
    m = df.agg(F.avg(col).alias("_mean"))
    return (df.crossJoin(F.broadcast(m))
              .withColumn(col, F.round(F.coalesce(F.col(col).cast("double"), F.col("_mean")), digits))
              .drop("_mean"))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.na.drop(subset=list(cols))


def display_defaults(df: DataFrame) -> DataFrame:
    """Display substitutes for missing operator / product."""
    return df.select("batch_id", F.coalesce(F.col("operator_name"), F.lit("Staff Member")).alias("operator_name"),
                     F.coalesce(F.col("product_id").cast("string"), F.lit("N/A")).alias("product_id"))


def fill_all_text(df: DataFrame, value: str = FILL_TEXT) -> DataFrame:
    """Null in any string column -> fill text (numeric columns keep their nulls and type)."""
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill(value, subset=text_cols)


def trim_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C11."""
    return df.withColumns({x: F.trim(F.col(x)) for x in cols})


def strip_headers(df: DataFrame) -> DataFrame:
    """Strip surrounding spaces from column names."""
    return df.toDF(*[x.strip() for x in df.columns])


def upper_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C13."""
    return df.withColumns({x: F.upper(F.col(x)) for x in cols})


def fix_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """C14: replace listed spellings (a literal map lookup, JVM-side)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(col, F.coalesce(m[F.col(col)], F.col(col)))


def standardize_size(df: DataFrame, col: str = "size") -> DataFrame:
    """Size labels -> '600ml' / '2000ml' (case and space insensitive) plus litres."""
    norm = F.lower(F.trim(F.col(col)))
    label = (F.when(norm.isin(*SMALL_LABELS), F.lit("600ml")).when(norm.isin(*LARGE_LABELS), F.lit("2000ml"))
             .otherwise(F.col(col)))
    litres = F.when(label == "600ml", F.lit(0.6)).when(label == "2000ml", F.lit(2.0))
    return df.withColumn(col, label).withColumn("size_l", litres)


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in the order ``order`` (nulls first).

    Written as MIN over a struct led by the order columns: an aggregate, so duplicates are
    combined map-side and a key repeated a billion times never lands whole in one task.
    """
    rest = [x for x in df.columns if x not in keys and x not in order]
    first = F.min(F.struct(*[F.col(x) for x in [*order, *rest] if x not in keys])).alias("_first")
    out = df.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col("_first").getField(x).alias(x) for x in [*order, *rest] if x not in keys]) \
              .select(*df.columns)


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """C18."""
    return df.withColumnsRenamed(dict(mapping))
