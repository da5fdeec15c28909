"""A mart stored by date: a correction rewrites the dates it touches and nothing else.

``store`` writes a report with one folder for each date; ``refresh`` takes the corrected report and the dates that changed, and replaces these folders (dynamic
partition overwrite).  A date that has no rows any more loses its folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_DATES = 10_000     # dates that one refresh names; more call for a rebuild


def store(report: DataFrame, path: str, date: str = "prod_date") -> None:
    report.write.mode("overwrite").partitionBy(date).parquet(path)


def load(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored mart with the columns and types of the report."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def touched(before: DataFrame, after: DataFrame, key: str, date: str = "prod_date") -> list:
    """The dates of rows that appear, disappear or change between two small sets of rows (the corrected ones as they were and as they are)."""
    old, new = (x.select(key, date) for x in (before, after))
    found = [r[0] for r in old.unionByName(new).select(date).distinct().limit(MOST_DATES + 1).collect()]
    if len(found) > MOST_DATES:
        raise ValueError(f"more than {MOST_DATES} dates: rebuild the mart")
    return found


def refresh(report: DataFrame, path: str, dates: Iterable, date: str = "prod_date") -> None:
    """Write the rows of these dates anew, from the corrected report (its filter on the dates reaches the scan)."""
    dates = list(dates)
    known = [d for d in dates if d is not None]
    wanted = F.col(date).isin(known) if known else F.lit(False)
    if None in dates:
        wanted = wanted | F.col(date).isNull()
    part = report.where(wanted)
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    left = {r[0] for r in part.select(date).distinct().collect()}           # at most the dates named
    spark = report.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in dates:
        if d not in left:
            files.delete(at(f"{path}/{date}={'__HIVE_DEFAULT_PARTITION__' if d is None else d}"), True)
