"""Profiling (Q keys) and cleaning (C keys) over the dirty variants of the line tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from linepulse.operators import cleaning, footers, marts, quality, spelling
from linepulse.plans.registry import BIG, R, query
from linepulse.sources import dirty

BATCH_COLS = ["batch_id", "prod_date", "product_id", "operator_name", "start_min", "end_min", "duration_min",
              "shift", "status"]


# --- profiling ------------------------------------------------------------------------------

@query("preview_top5_batches", "Q01", "SELECT * FROM batches ORDER BY batch_id LIMIT 5")
def preview_top5_batches(t):
    return t.b.orderBy("batch_id").limit(5)


@query("preview_top5_incidents", "Q01", "SELECT * FROM incidents ORDER BY downtime_id LIMIT 5")
def preview_top5_incidents(t):
    return t.i.orderBy("downtime_id").limit(5)


@query("preview_top5_products", "Q01", "SELECT * FROM products ORDER BY product_id LIMIT 5")
def preview_top5_products(t):
    return t.p.orderBy("product_id").limit(5)


@query("preview_top5_factors", "Q01", "SELECT * FROM factors ORDER BY factor_id LIMIT 5")
def preview_top5_factors(t):
    return t.f.orderBy("factor_id").limit(5)


# Column layout of the canonical tables, used to spell the cross-check SQL of the schema report.
SCHEMA_LAYOUT = {
    "batches": ["batch_id", "prod_date", "product_id", "operator_name", "start_min", "end_min", "duration_min",
                "shift", "status"],
    "products": ["product_id", "flavor", "size", "size_l", "min_batch_time"],
    "incidents": ["downtime_id", "batch_id", "factor_id", "downtime_min"],
    "factors": ["factor_id", "description", "operator_error"],
}


@query("table_schema_report", "Q02", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, {i + 1} AS position, '{c}' AS column_name, "
    f"upper(any_value(typeof({c}))) AS data_type, COUNT({c}) AS non_null FROM {tb}"
    for tb, cols in SCHEMA_LAYOUT.items() for i, c in enumerate(cols)))
def table_schema_report(t):
    """Column name, position, SQL type name and non-null count of every canonical table."""
    out = None
    for name, df in (("batches", t.b), ("products", t.p), ("incidents", t.i), ("factors", t.f)):
        one = quality.column_profile(df, name)
        out = one if out is None else out.unionByName(one)
    return out


def _missing_sql(table, src, cols, blank=()):
    parts = [f"COUNT(*) AS row_count"]
    for c in cols:
        cond = f"{c} IS NULL" + (f" OR trim({c}) = ''" if c in blank else "")
        parts.append(f"COUNT(*) FILTER (WHERE {cond}) AS null_{c}")
    return f"SELECT '{table}' AS table_name, {', '.join(parts)} FROM {src}"


B_MISS = ["batch_id", "prod_date", "product_id", "operator_name", "start_min", "duration_min"]
I_MISS = ["downtime_id", "batch_id", "factor_id", "downtime_min"]
P_MISS = ["product_id", "flavor", "size", "min_batch_time"]
F_MISS = ["factor_id", "description", "operator_error"]


@query("missing_values_batches", "Q03", _missing_sql("batches", "dbatches", B_MISS))
def missing_values_batches(t):
    return quality.missing_values(dirty.dirty_batches(t), "batches", B_MISS)


@query("missing_values_incidents", "Q04", _missing_sql("incidents", "dincidents", I_MISS))
def missing_values_incidents(t):
    return quality.missing_values(dirty.dirty_incidents(t), "incidents", I_MISS)


@query("missing_values_products", "Q04", _missing_sql("products", "dproducts", P_MISS))
def missing_values_products(t):
    return quality.missing_values(dirty.dirty_products(t), "products", P_MISS)


@query("missing_values_factors", "Q04", _missing_sql("factors", "dfactors", F_MISS, blank=("description",)))
def missing_values_factors(t):
    return quality.missing_values(dirty.dirty_factors(t), "factors", F_MISS, blank_as_missing=("description",))


@query("null_key_rows", "Q05", "SELECT * FROM dbatches WHERE batch_id IS NULL")
def null_key_rows(t):
    return dirty.dirty_batches(t).filter(F.col("batch_id").isNull())


@query("downtime_statistics", "Q06", f"""
SELECT COUNT(downtime_min) AS incident_count, {BIG('SUM(downtime_min)')} AS total_minutes,
       {R('AVG(downtime_min)', 4)} AS avg_minutes, MIN(downtime_min) AS min_minutes, MAX(downtime_min) AS max_minutes,
       {R('STDDEV_SAMP(downtime_min)', 4)} AS stdev_minutes
FROM incidents""")
def downtime_statistics(t):
    m = F.col("downtime_min")
    return t.ir.agg(F.count(m).alias("incident_count"), F.sum(m).alias("total_minutes"),
                   F.round(F.avg(m), 4).alias("avg_minutes"), F.min(m).alias("min_minutes"),
                   F.max(m).alias("max_minutes"), F.round(F.stddev_samp(m), 4).alias("stdev_minutes"))


def orphan_incidents(t):
    """Incidents whose batch does not exist, read off the stored incident detail (no second join)."""
    d = marts.detail(t, ids=False).filter(F.col("batch_id").isNotNull() & ~F.col("matched"))
    return d.agg(F.count(F.lit(1)).alias("orphan_rows")).select(F.lit("incident->batch").alias("relation"),
                                                                 "orphan_rows")


@query("fk_orphans", "Q07", """
SELECT 'batch->product' AS relation, COUNT(*) AS orphan_rows FROM batches b
WHERE b.product_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = b.product_id)
UNION ALL
SELECT 'incident->batch', COUNT(*) FROM incidents i
WHERE i.batch_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM batches b WHERE b.batch_id = i.batch_id)
UNION ALL
SELECT 'incident->factor', COUNT(*) FROM incidents i
WHERE i.factor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM factors f WHERE f.factor_id = i.factor_id)""")
def fk_orphans(t):
    return (quality.orphans(t.b, t.p, "product_id", "batch->product")
            .unionByName(orphan_incidents(t))
            .unionByName(quality.orphans(t.ir, t.f, "factor_id", "incident->factor")))


@query("factor_statistics", "Q08", f"""
SELECT description, COUNT(*) AS frequency, {BIG('SUM(downtime_min)')} AS total_minutes,
       {R('AVG(downtime_min)')} AS avg_minutes
FROM idf GROUP BY description""")
def factor_statistics(t):
    return marts.incident_factor(t, ids=False).groupBy("description").agg(
        F.count(F.lit(1)).alias("frequency"), F.sum("downtime_min").alias("total_minutes"),
        F.round(F.avg("downtime_min"), 2).alias("avg_minutes"))


@query("operator_performance_summary", "Q09", """
SELECT operator_name, COUNT(*) AS total_batches, AVG(duration_min * 60) / 60.0E0 AS avg_minutes,
       MAX(duration_min) AS slowest_batch, MIN(duration_min) AS fastest_batch
FROM batches GROUP BY operator_name""")
def operator_performance_summary(t):
    return t.b.groupBy("operator_name").agg(
        F.count(F.lit(1)).alias("total_batches"), (F.avg(F.col("duration_min") * 60) / F.lit(60.0)).alias("avg_minutes"),
        F.max("duration_min").alias("slowest_batch"), F.min("duration_min").alias("fastest_batch"))


@query("duplicates_batches", "Q10", """
SELECT batch_id, prod_date, product_id, start_min, COUNT(*) AS dup_count FROM dbatches
GROUP BY batch_id, prod_date, product_id, start_min HAVING COUNT(*) > 1""")
def duplicates_batches(t):
    return quality.duplicate_groups(dirty.dirty_batches(t), ["batch_id", "prod_date", "product_id", "start_min"])


@query("duplicates_incidents", "Q11", """
SELECT batch_id, factor_id, downtime_min, COUNT(*) AS dup_count FROM incidents
GROUP BY batch_id, factor_id, downtime_min HAVING COUNT(*) > 1""")
def duplicates_incidents(t):
    return quality.duplicate_groups(t.ir, ["batch_id", "factor_id", "downtime_min"])


@query("duplicates_products", "Q12", """
SELECT product_id, COUNT(*) AS dup_count FROM products GROUP BY product_id HAVING COUNT(*) > 1""")
def duplicates_products(t):
    return quality.duplicate_groups(t.p, ["product_id"])


@query("duplicates_factors", "Q12", """
SELECT factor_id, COUNT(*) AS dup_count FROM factors GROUP BY factor_id HAVING COUNT(*) > 1""")
def duplicates_factors(t):
    return quality.duplicate_groups(t.f, ["factor_id"])


@query("full_row_duplicates", "Q13", """
SELECT 'batches' AS table_name, (SELECT COUNT(*) FROM dbatches) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dbatches))
       AS duplicate_rows
UNION ALL SELECT 'incidents', (SELECT COUNT(*) FROM incidents)
       - (SELECT COUNT(*) FROM (SELECT DISTINCT batch_id, factor_id, downtime_min FROM incidents))
UNION ALL SELECT 'products', (SELECT COUNT(*) FROM products) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM products))""")
def full_row_duplicates(t):
    return (quality.full_row_duplicates(dirty.dirty_batches(t), "batches")
            .unionByName(quality.full_row_duplicates(t.ir.select("batch_id", "factor_id", "downtime_min"), "incidents"))
            .unionByName(quality.full_row_duplicates(t.p, "products")))


# --- cleaning -------------------------------------------------------------------------------

@query("fill_operator_unknown", "C01", """
SELECT batch_id, CASE WHEN operator_name IS NULL OR trim(operator_name) = '' THEN 'Unknown' ELSE operator_name END
       AS operator_name FROM dbatches""")
def fill_operator_unknown(t):
    return cleaning.fill_operator_unknown(dirty.dirty_batches(t)).select("batch_id", "operator_name")


@query("fill_factor_description", "C02", """
SELECT factor_id, COALESCE(description, 'Other/Unspecified') AS description, operator_error FROM dfactors""")
def fill_factor_description(t):
    return cleaning.fill_value(dirty.dirty_factors(t), "description", cleaning.UNSPECIFIED_FACTOR)


@query("fill_downtime_zero", "C03", """
SELECT downtime_id, batch_id, factor_id, COALESCE(downtime_min, 0) AS downtime_min FROM dincidents""")
def fill_downtime_zero(t):
    return cleaning.fill_value(dirty.dirty_incidents(t), "downtime_min", 0)


@query("fill_downtime_mean", "C04", f"""
SELECT downtime_id, batch_id, factor_id,
       {R('COALESCE(CAST(downtime_min AS DOUBLE), (SELECT AVG(downtime_min) FROM dincidents))')} AS downtime_min
FROM dincidents""")
def fill_downtime_mean(t):
    return cleaning.fill_mean(dirty.dirty_incidents(t), "downtime_min")


@query("drop_null_keys", "C05", "SELECT * FROM dincidents WHERE batch_id IS NOT NULL")
def drop_null_keys(t):
    return cleaning.drop_null(dirty.dirty_incidents(t), ["batch_id"])


@query("drop_null_key_batches", "C05", "SELECT * FROM dbatches WHERE batch_id IS NOT NULL")
def drop_null_key_batches(t):
    return cleaning.drop_null(dirty.dirty_batches(t), ["batch_id"])


@query("display_defaults", "C06", """
SELECT batch_id, COALESCE(operator_name, 'Staff Member') AS operator_name,
       COALESCE(CAST(product_id AS VARCHAR), 'N/A') AS product_id FROM dbatches""")
def display_defaults(t):
    return cleaning.display_defaults(dirty.dirty_batches(t))


@query("fill_all_text", "C07", f"""
SELECT {', '.join(c if c not in ('operator_name', 'shift', 'status') else f"COALESCE({c}, 'fill missing value') AS {c}"
                  for c in BATCH_COLS)} FROM dbatches""")
def fill_all_text(t):
    return cleaning.fill_all_text(dirty.dirty_batches(t))


@query("drop_null_minutes", "C08", "SELECT * FROM dincidents WHERE downtime_min IS NOT NULL")
def drop_null_minutes(t):
    return cleaning.drop_null(dirty.dirty_incidents(t), ["downtime_min"])


@query("trim_text", "C11", """
SELECT b.batch_id, trim(b.operator_name) AS operator_name FROM dbatches b""")
def trim_text(t):
    return cleaning.trim_text(dirty.dirty_batches(t).select("batch_id", "operator_name"), ["operator_name"])


@query("trim_flavor", "C11", "SELECT product_id, trim(flavor) AS flavor FROM dproducts")
def trim_flavor(t):
    return cleaning.trim_text(dirty.dirty_products(t).select("product_id", "flavor"), ["flavor"])


@query("strip_headers", "C12", f"SELECT {', '.join(BATCH_COLS)} FROM batches")
def strip_headers(t):
    padded = t.b.toDF(*[f" {c}  " for c in t.b.columns])
    return cleaning.strip_headers(padded)


@query("upper_codes", "C13", """
SELECT upper(CAST(product_id AS VARCHAR)) AS product_code, upper(flavor) AS flavor FROM dproducts""")
def upper_codes(t):
    d = dirty.dirty_products(t).select(F.col("product_id").cast("string").alias("product_code"), "flavor")
    return cleaning.upper_codes(d, ["product_code", "flavor"])


@query("fix_operator_typos", "C14", """
SELECT batch_id, CASE WHEN operator_name IN ('Charly', 'charli', 'Chalie') THEN 'Charlie' ELSE operator_name END
       AS operator_name FROM dbatches""")
def fix_operator_typos(t):
    return cleaning.fix_values(dirty.dirty_batches(t).select("batch_id", "operator_name"), "operator_name",
                               cleaning.OPERATOR_FIXES)


@query("operator_spelling_proposals", "C14", """
WITH c AS (SELECT trim(operator_name) AS v, COUNT(*) AS n FROM dbatches WHERE operator_name IS NOT NULL GROUP BY 1),
     m AS (SELECT a.v AS spelling, a.n, b.v AS correction, b.n AS n_correction,
                  ROW_NUMBER() OVER (PARTITION BY a.v ORDER BY b.n DESC, b.v) AS rn
           FROM c a JOIN c b ON levenshtein(a.v, b.v) = 1 AND b.n >= 1 * a.n)
SELECT spelling, n, correction, n_correction FROM m WHERE rn = 1""")
def operator_spelling_proposals(t, times: int = 1):
    """Corrections for operator names that are one edit from a name at least as frequent (beside the hand list of C14)."""
    names = dirty.dirty_batches(t).select(F.trim("operator_name").alias("operator_name"))
    return spelling.proposals(names, "operator_name", times)


PROFILED = {"batches": ["batch_id", "prod_date", "start_min", "duration_min", "operator_name", "status"], "products": ["product_id", "min_batch_time", "size"]}


@query("stored_table_profile", "Q02-Q06", " UNION ALL ".join(
    f"SELECT '{tb}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, COUNT({c}) AS non_null, "
    + ("CAST(NULL AS VARCHAR) AS minimum, CAST(NULL AS VARCHAR) AS maximum" if c in ("operator_name", "status", "size")
       else f"CAST(MIN({c}) AS VARCHAR) AS minimum, CAST(MAX({c}) AS VARCHAR) AS maximum") + f" FROM {tb}"
    for tb, cols in PROFILED.items() for c in cols))
def stored_table_profile(t):
    """Row and value counts, minima and maxima of the stored tables, from their Parquet footers alone."""
    out = None
    for name, cols in PROFILED.items():
        _ = t.b if name == "batches" else t.p
        one = footers.footer_profile(t.spark, t.location(name), cols).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("standardize_size", "C15", f"""
SELECT product_id,
       CASE WHEN lower(trim(size)) IN ({', '.join(repr(x) for x in cleaning.SMALL_LABELS)}) THEN '600ml'
            WHEN lower(trim(size)) IN ({', '.join(repr(x) for x in cleaning.LARGE_LABELS)}) THEN '2000ml'
            ELSE size END AS size,
       CASE WHEN lower(trim(size)) IN ({', '.join(repr(x) for x in cleaning.SMALL_LABELS)}) THEN 0.6E0
            WHEN lower(trim(size)) IN ({', '.join(repr(x) for x in cleaning.LARGE_LABELS)}) THEN 2.0E0 END AS size_l
FROM dproducts""")
def standardize_size(t):
    return cleaning.standardize_size(dirty.dirty_products(t).select("product_id", "size"))


@query("dedup_batches", "C16", f"""
WITH k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY batch_id, product_id, start_min
                                        ORDER BY {', '.join(c + ' NULLS FIRST' for c in BATCH_COLS)}) AS rn
           FROM dbatches)
SELECT {', '.join(BATCH_COLS)} FROM k WHERE rn = 1""")
def dedup_batches(t):
    return cleaning.dedup(dirty.dirty_batches(t), ["batch_id", "product_id", "start_min"], BATCH_COLS)


@query("drop_full_duplicates", "C17", "SELECT DISTINCT * FROM dbatches")
def drop_full_duplicates(t):
    return quality.without_full_duplicates(dirty.dirty_batches(t))


# The line workbook's column names and their canonical names.
WORKBOOK_NAMES = {"Batch": "batch_id", "Product": "product_id", "Operator": "operator_name",
                  "Date": "prod_date", "Factor": "factor_id", "Downtime factor": "factor_id"}


@query("rename_columns", "C18", "SELECT batch_id, product_id, operator_name, prod_date FROM batches")
def rename_columns(t):
    src = t.b.select(F.col("batch_id").alias("Batch"), F.col("product_id").alias("Product"),
                     F.col("operator_name").alias("Operator"), F.col("prod_date").alias("Date"))
    return cleaning.rename_columns(src, {k: v for k, v in WORKBOOK_NAMES.items() if k in src.columns})

