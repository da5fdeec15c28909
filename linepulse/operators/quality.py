"""Profiling and data-quality operators (Q keys): one pass over a table each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.session import shared_dir


def missing_values(df: DataFrame, table: str, cols: Sequence[str], blank_as_missing: Sequence[str] = ()) -> DataFrame:
    """Row count and null count per column in a single aggregate (blank text counts for the listed columns)."""
    aggs = [F.count(F.lit(1)).alias("row_count")]
    for c in cols:
        miss = F.col(c).isNull()
        if c in blank_as_missing:
            miss = miss | (F.trim(F.col(c)) == "")
        aggs.append(F.count(F.when(miss, 1)).alias(f"null_{c}"))
    return df.agg(*aggs).select(F.lit(table).alias("table_name"), "*")


def duplicate_groups(df: DataFrame, keys: Sequence[str], name: str = "dup_count") -> DataFrame:
    """Key groups that occur more than once (partial aggregation, so hot keys are combined early)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


FEW_DIGESTS = 4_000_000     # so many 64-bit digests (32 MB) are sent to all tasks


def repeated_digests(df: DataFrame) -> tuple[DataFrame, int]:
    """Digests of whole rows that occur more than once, and their number: 8 bytes a row are shuffled, not the rows."""
    shared_dir(df.sparkSession)
    found = df.groupBy(F.xxhash64(*df.columns).alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h").checkpoint(eager=True)
    return found, found.count()


def candidates(df: DataFrame, digests: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose digest is (left_anti: is not) among ``digests``; few digests go to the rows, many meet them by shuffle."""
    side = F.broadcast(digests) if n <= FEW_DIGESTS else digests
    return df.withColumn("_h", F.xxhash64(*df.columns)).join(side, "_h", how).drop("_h")


def full_row_duplicates(df: DataFrame, table: str) -> DataFrame:
    """Rows identical to an earlier row, in two phases: only rows of repeated digests are compared whole."""
    digests, n = repeated_digests(df)
    per_row = candidates(df, digests, n).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")).select(F.lit(table).alias("table_name"), "duplicate_rows")


def without_full_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of identical rows; rows whose digest occurs once stay where they are."""
    digests, n = repeated_digests(df)
    if n > FEW_DIGESTS:
        return df.dropDuplicates()
    return candidates(df, digests, n, "left_anti").unionByName(candidates(df, digests, n).dropDuplicates())


def orphans(child: DataFrame, parent: DataFrame, key: str, relation: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``key`` has no parent row (anti join), counted.

    Rows are counted by key first, where they are: however many share a key, one row of it meets the parents."""
    per = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    o = per.join(parent.select(key), key, "left_anti")
    return o.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows")).select(F.lit(relation).alias("relation"), "orphan_rows")


# Spark type names -> SQL type names used in reports.
SQL_TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT",
                  "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
                  "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """One row per column: position, name, SQL type and non-null count (one aggregate over the table)."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"_n{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
                              F.lit(SQL_TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString().upper()))
                              .alias("data_type"), F.col(f"_n{i}").alias("non_null"))
                     for i, f in enumerate(fields)])
    return counts.select(F.lit(table).alias("table_name"), F.inline(rows))
