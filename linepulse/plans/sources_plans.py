"""Sources (S keys) and the parsing steps of cleaning.

Each canonical table is exported on first use to the shared folder in the line system's text layout (plus the wide
downtime matrix), then read back by header names, so the readers are exercised on data that grows with
the test tables.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from linepulse.functions.scale import dense_index
from linepulse.plans.registry import query
from linepulse.session import shared_dir
from linepulse.sources import csv_layout as L

_TEXT = {
    "products": lambda t: L.products_text(t.p),
    "batches": lambda t: L.batches_text(t.b),
    "incidents": lambda t: L.incidents_text(t.i),
    "factors": lambda t: L.factors_text(t.f),
    "wide": lambda t: L.wide_downtime(t.ir, t.f),     # sums: no ids
}
_SOURCES = {"products": ["part"], "batches": ["events", "part"], "incidents": ["lineitem"], "factors": ["supplier"], "wide": ["lineitem", "supplier"]}
_EXPORTS: dict[tuple, tuple[str, str]] = {}


def exported(t, name: str) -> str:
    """Folder of one table's text export; written on first use and again when the files that it comes from have changed."""
    spark = t.spark
    key, state = (spark.sparkContext.applicationId, t.sf_dir, name), t.state(*_SOURCES[name])
    if _EXPORTS.get(key, ("", ""))[0] != state:
        tag = hashlib.sha1(t.sf_dir.encode()).hexdigest()[:10]
        _EXPORTS[key] = state, L.write_csv(_TEXT[name](t), f"{shared_dir(spark).rstrip('/')}/linepulse/export/{tag}/{name}-{state}")
    return _EXPORTS[key][1]


@query("read_products", "S01", """
SELECT CAST(product_id AS VARCHAR) AS product_id, flavor, size, min_batch_time FROM products""")
def read_products(t):
    return L.read_products(t.spark, exported(t, "products"))


@query("read_batches", "S02", """
SELECT batch_id, prod_date, CAST(product_id AS VARCHAR) AS product_id, operator_name, start_min, end_min, duration_min,
       shift, status FROM batches""")
def read_batches(t):
    return L.read_batches(t.spark, exported(t, "batches"))


@query("read_factors", "S03", "SELECT factor_id, description, operator_error FROM factors")
def read_factors(t):
    return L.read_factors(t.spark, exported(t, "factors"))


@query("read_incidents", "S04", "SELECT downtime_id, batch_id, factor_id, downtime_min FROM incidents")
def read_incidents(t):
    return L.read_incidents(t.spark, exported(t, "incidents"))


@query("read_all", "S05", """
SELECT 'products' AS table_name, COUNT(*) AS row_count FROM products
UNION ALL SELECT 'batches', COUNT(*) FROM batches
UNION ALL SELECT 'incidents', COUNT(*) FROM incidents
UNION ALL SELECT 'factors', COUNT(*) FROM factors""")
def read_all(t):
    frames = [("products", L.read_products(t.spark, exported(t, "products"))),
              ("batches", L.read_batches(t.spark, exported(t, "batches"))),
              ("incidents", L.read_incidents(t.spark, exported(t, "incidents"))),
              ("factors", L.read_factors(t.spark, exported(t, "factors")))]
    out = None
    for name, df in frames:
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


WIDE_SQL = ", ".join(f"CAST(SUM(CASE WHEN factor_id = {k} THEN downtime_min END) AS BIGINT) AS f_{k}"
                     for k in range(1, L.N_FACTORS + 1))


@query("read_wide_downtime", "S06", f"SELECT batch_id, {WIDE_SQL} FROM incidents GROUP BY batch_id")
def read_wide_downtime(t):
    return L.read_wide_downtime(t.spark, exported(t, "wide"))


@query("unpivot_downtime", "S07", f"""
WITH w AS (SELECT batch_id, {WIDE_SQL} FROM incidents GROUP BY batch_id),
     l AS (UNPIVOT w ON {', '.join(f'f_{k}' for k in range(1, L.N_FACTORS + 1))} INTO NAME factor_col VALUE m)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY batch_id, CAST(substr(factor_col, 3) AS INTEGER)) AS BIGINT) AS downtime_id,
       batch_id, CAST(substr(factor_col, 3) AS INTEGER) AS factor_id, CAST(m AS INTEGER) AS downtime_min
FROM l WHERE m IS NOT NULL""")
def unpivot_downtime(t):
    long = L.unpivot_downtime(L.read_wide_downtime(t.spark, exported(t, "wide")))
    return dense_index(long, ["batch_id", "factor_id"], "downtime_id").select(
        F.col("downtime_id").cast("long"), "batch_id", "factor_id", "downtime_min")


@query("csv_rejects", "S01-S06", """
SELECT 'batches' AS table_name, CASE WHEN batch_id % 37 = 0 THEN 'too many fields' ELSE 'too few fields' END AS reason, COUNT(*) AS rejected_rows
FROM batches WHERE batch_id % 37 = 0 OR batch_id % 53 = 0 GROUP BY 2
UNION ALL SELECT 'batches', 'good', COUNT(*) FROM batches WHERE batch_id % 37 <> 0 AND batch_id % 53 <> 0""")
def csv_rejects(t):
    """Records of the text export that have too many or too few fields, by reason, and the number of good ones.

    The export is dirtied by fixed rules first: every 37th batch has a field more, every 53rd ends after its third."""
    spark = t.spark
    # records by the header's names: a task may begin within a file, and every file that it writes has its own header
    rows = L.read_text(spark, exported(t, "batches"), L.BATCH_HEADERS)
    line, short = (F.to_csv(F.struct(*[F.col(x) for x in names])) for names in (L.BATCH_HEADERS, L.BATCH_HEADERS[:3]))
    key = F.col("Batch").try_cast("long")
    dirty = rows.select(F.when(key % 37 == 0, F.concat(line, F.lit(",more"))).when(key % 53 == 0, short).otherwise(line).alias("value"))
    path = L.write_lines(dirty, L.BATCH_HEADERS, f"{shared_dir(spark).rstrip('/')}/linepulse/export/dirty-{uuid.uuid4().hex}")
    bad = L.rejected(spark, path).groupBy("reason").agg(F.count(F.lit(1)).alias("rejected_rows"))
    good = L.read_batches(spark, path).agg(F.count(F.lit(1)).alias("rejected_rows")).select(F.lit("good").alias("reason"), "rejected_rows")
    return bad.unionByName(good).select(F.lit("batches").alias("table_name"), "reason", "rejected_rows")


@query("cast_types", "C09", """
SELECT 'batches' AS table_name, COUNT(*) AS row_count,
       COUNT(*) FILTER (WHERE batch_id % 41 = 0) AS failed_prod_date,
       COUNT(*) FILTER (WHERE batch_id % 43 = 0) AS failed_start_min,
       0::BIGINT AS failed_end_min, 0::BIGINT AS failed_duration_min FROM batches""")
def cast_types(t):
    """Typed conversion of the text export with a count of values that failed to parse.

    The export is dirtied by fixed rules first (an impossible date on every 41st batch, an
    impossible clock time on every 43rd start) so that the failure counts are exercised."""
    raw = _dirty_text(L.read_text(t.spark, exported(t, "batches"), L.BATCH_HEADERS))
    pairs = [("prod_date", "Date", L.parse_date("Date")), ("start_min", "Start Time", L.clock_minutes("Start Time")),
             ("end_min", "End Time", L.clock_minutes("End Time")),
             ("duration_min", "Production Duration", L.duration_minutes("Production Duration"))]
    aggs = [F.count(F.lit(1)).alias("row_count")] + [
        F.count(F.when(F.col(src).isNotNull() & e.isNull(), 1)).alias(f"failed_{n}") for n, src, e in pairs]
    return raw.agg(*aggs).select(F.lit("batches").alias("table_name"), "*")


# Unparseable stand-ins used to dirty the text export.
BAD_DATE, BAD_CLOCK = "31/31/2024", "25:99:00 XM"


def _dirty_text(raw):
    key = F.col("Batch").cast("long")
    return raw.withColumn("Date", F.when(key % 41 == 0, F.lit(BAD_DATE)).otherwise(F.col("Date"))) \
              .withColumn("Start Time", F.when(key % 43 == 0, F.lit(BAD_CLOCK)).otherwise(F.col("Start Time")))


@query("parse_dates", "C10", """
SELECT batch_id, CASE WHEN batch_id % 41 = 0 THEN NULL ELSE prod_date END AS prod_date FROM batches""")
def parse_dates(t):
    """Month-first date text with junk in some rows: unparseable text becomes NULL."""
    raw = _dirty_text(L.read_text(t.spark, exported(t, "batches"), L.BATCH_HEADERS))
    return raw.select(F.col("Batch").try_cast("long").alias("batch_id"), L.parse_date("Date").alias("prod_date"))
