"""Dirty variants of the canonical tables, derived by deterministic rules.

They exercise the profiling (Q) and cleaning (C) operators on data that grows with the test
tables: missing / blank / padded / misspelt operators, missing keys and minutes, a missing factor
description, size labels in six spellings, padded lower-case flavours, and exact duplicate rows.
The same rules are written in SQL in ``DIRTY_CTES`` for the oracle engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.sources.testmap import Tables

# Misspellings of one operator name and the size spellings per size.
TYPO_NAMES = ["Charly", "charli", "Chalie"]
SMALL_SPELLINGS = ["600", "0.6L", "600 ML"]
LARGE_SPELLINGS = ["2 L", "2000", "2000 ML"]


def dirty_batches(t: Tables) -> DataFrame:
    b = t.b
    k = F.col("batch_id") % 17
    op = (F.when(k == 0, F.lit(None).cast("string")).when(k == 1, F.lit(""))
          .when(k == 2, F.concat(F.lit("  "), F.col("operator_name"), F.lit("  ")))
          .when(k == 3, F.lit(TYPO_NAMES[0])).when(k == 4, F.lit(TYPO_NAMES[1])).when(k == 5, F.lit(TYPO_NAMES[2]))
          .otherwise(F.col("operator_name")))
    key = F.when(F.col("batch_id") % 251 == 0, F.lit(None).cast("long")).otherwise(F.col("batch_id"))
    d = b.select(key.alias("batch_id"), "prod_date", "product_id", op.alias("operator_name"), "start_min", "end_min",
                 "duration_min", "shift", "status")
    dups = d.filter(F.col("batch_id") % 50 == 0)
    return d.unionByName(dups)


def dirty_incidents(t: Tables) -> DataFrame:
    i = t.i
    return i.select(
        "downtime_id",
        F.when(F.col("downtime_id") % 101 == 0, F.lit(None).cast("long")).otherwise(F.col("batch_id")).alias("batch_id"),
        "factor_id",
        F.when(F.col("downtime_id") % 23 == 0, F.lit(None).cast("int")).otherwise(F.col("downtime_min"))
        .alias("downtime_min"))


def dirty_products(t: Tables) -> DataFrame:
    k = F.col("product_id") % 3
    small = F.col("size_l") < 1
    size = F.when(small, F.element_at(F.array(*[F.lit(s) for s in SMALL_SPELLINGS]), (k + 1).cast("int"))) \
            .otherwise(F.element_at(F.array(*[F.lit(s) for s in LARGE_SPELLINGS]), (k + 1).cast("int")))
    flavor = F.when(F.col("product_id") % 7 == 0, F.concat(F.lit(" "), F.lower("flavor"), F.lit(" "))) \
              .otherwise(F.col("flavor"))
    return t.p.select("product_id", flavor.alias("flavor"), size.alias("size"), "min_batch_time")


def dirty_factors(t: Tables) -> DataFrame:
    return t.f.select("factor_id",
                      F.when(F.col("factor_id") == 12, F.lit(None).cast("string")).otherwise(F.col("description"))
                      .alias("description"), "operator_error")


DIRTY_CTES = f"""
dbatches0 AS (
  SELECT CASE WHEN batch_id % 251 = 0 THEN NULL ELSE batch_id END AS batch_id, prod_date, product_id,
         CASE batch_id % 17 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CONCAT('  ', operator_name, '  ')
              WHEN 3 THEN '{TYPO_NAMES[0]}' WHEN 4 THEN '{TYPO_NAMES[1]}' WHEN 5 THEN '{TYPO_NAMES[2]}'
              ELSE operator_name END AS operator_name,
         start_min, end_min, duration_min, shift, status
  FROM batches),
dbatches AS (SELECT * FROM dbatches0 UNION ALL SELECT * FROM dbatches0 WHERE batch_id % 50 = 0),
dincidents AS (
  SELECT downtime_id, CASE WHEN downtime_id % 101 = 0 THEN NULL ELSE batch_id END AS batch_id, factor_id,
         CASE WHEN downtime_id % 23 = 0 THEN NULL ELSE downtime_min END AS downtime_min
  FROM incidents),
dproducts AS (
  SELECT product_id,
         CASE WHEN product_id % 7 = 0 THEN CONCAT(' ', lower(flavor), ' ') ELSE flavor END AS flavor,
         CASE WHEN size_l < 1 THEN (['{SMALL_SPELLINGS[0]}', '{SMALL_SPELLINGS[1]}', '{SMALL_SPELLINGS[2]}'])[product_id % 3 + 1]
              ELSE (['{LARGE_SPELLINGS[0]}', '{LARGE_SPELLINGS[1]}', '{LARGE_SPELLINGS[2]}'])[product_id % 3 + 1] END AS size,
         min_batch_time
  FROM products),
dfactors AS (
  SELECT factor_id, CASE WHEN factor_id = 12 THEN NULL ELSE description END AS description, operator_error
  FROM factors)
"""
