"""Feature columns (F keys) and joined marts (J keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linepulse.functions.expr import pct, shift_of, wrap_minutes
from linepulse.operators import features, marts
from linepulse.plans.registry import PCT, query

SHIFT_SQL = ("CASE WHEN {m} BETWEEN 360 AND 839 THEN 'Morning' WHEN {m} BETWEEN 840 AND 1319 THEN 'Afternoon' "
             "ELSE 'Night' END")
WRAP_SQL = "CAST(((end_min - start_min) % 1440 + 1440) % 1440 AS INTEGER)"


@query("duration_minutes", "F01", f"""
SELECT batch_id, start_min, end_min, {WRAP_SQL} AS duration_min FROM batches""")
def duration_minutes(t):
    return t.b.select("batch_id", "start_min", "end_min", wrap_minutes("start_min", "end_min").alias("duration_min"))


@query("gross_minutes_signed", "F02", """
SELECT batch_id, end_min - start_min AS gross_minutes, end_min < start_min AS crosses_midnight FROM batches""")
def gross_minutes_signed(t):
    return t.b.select("batch_id", (F.col("end_min") - F.col("start_min")).alias("gross_minutes"),
                      (F.col("end_min") < F.col("start_min")).alias("crosses_midnight"))


@query("time_of_day", "F03", """
SELECT batch_id, printf('%02d:%02d', start_min // 60, start_min % 60) AS start_time,
       printf('%02d:%02d', end_min // 60, end_min % 60) AS end_time FROM batches""")
def time_of_day(t):
    return t.b.select("batch_id", features.clock("start_min").alias("start_time"),
                      features.clock("end_min").alias("end_time"))


@query("shift_name", "F04", f"""
SELECT batch_id, start_min, {SHIFT_SQL.format(m='start_min')} AS shift_rule,
       shift = {SHIFT_SQL.format(m='start_min')} AS matches_stored FROM batches""")
def shift_name(t):
    rule = shift_of("start_min")
    return t.b.select("batch_id", "start_min", rule.alias("shift_rule"), (F.col("shift") == rule).alias("matches_stored"))


@query("net_run_time", "F05", """
SELECT b.batch_id, b.duration_min, CAST(COALESCE(bd.total_downtime, 0) AS BIGINT) AS total_downtime,
       CAST(b.duration_min - COALESCE(bd.total_downtime, 0) AS BIGINT) AS net_run_time
FROM batches b LEFT JOIN bd ON b.batch_id = bd.batch_id""")
def net_run_time(t):
    w = marts.batches_with_totals(t)
    down = F.coalesce(F.col("total_downtime"), F.lit(0)).cast("long")
    return w.select("batch_id", "duration_min", down.alias("total_downtime"),
                    (F.col("duration_min") - down).alias("net_run_time"))


@query("efficiency_score", "F06", f"""
SELECT batch_id, {PCT('min_batch_time', 'duration_min')} AS efficiency_score FROM bp""")
def efficiency_score(t):
    return marts.batch_product(t).select("batch_id", pct("min_batch_time", "duration_min").alias("efficiency_score"))


@query("status_three_level", "F07", """
SELECT b.batch_id,
       CASE WHEN b.duration_min <= p.min_batch_time THEN 'On Time'
            WHEN b.duration_min <= p.min_batch_time + 15 THEN 'Slight Delay' ELSE 'Critical Delay' END AS status_3
FROM batches b LEFT JOIN products p ON b.product_id = p.product_id""")
def status_three_level(t, slight: int = 15):
    j = marts.batch_with_product(t)
    return j.select("batch_id", features.status_three_level("duration_min", "min_batch_time", slight).alias("status_3"))


@query("status_two_level", "F08", """
SELECT b.batch_id, CASE WHEN p.product_id IS NULL THEN NULL
                        WHEN b.duration_min <= p.min_batch_time THEN 'ON TIME' ELSE 'DELAY' END AS p_status
FROM batches b LEFT JOIN products p ON b.product_id = p.product_id""")
def status_two_level(t):
    j = marts.batch_with_product(t)
    st = F.when(F.col("min_batch_time").isNull(), F.lit(None).cast("string")).when(
        F.col("duration_min") <= F.col("min_batch_time"), "ON TIME").otherwise("DELAY")
    return j.select("batch_id", st.alias("p_status"))


@query("calendar_features", "F09", """
SELECT batch_id, CAST(month(prod_date) AS INTEGER) AS month, CAST(day(prod_date) AS INTEGER) AS day,
       CAST(start_min // 60 AS INTEGER) AS start_hour FROM batches""")
def calendar_features(t):
    return features.calendar(t.b).select("batch_id", "month", "day", "start_hour")


@query("time_deviation", "F10", """
SELECT b.batch_id, b.duration_min - p.min_batch_time AS time_deviation
FROM batches b LEFT JOIN products p ON b.product_id = p.product_id""")
def time_deviation(t):
    return marts.batch_with_product(t).select(
        "batch_id", (F.col("duration_min") - F.col("min_batch_time")).alias("time_deviation"))


@query("end_shift", "F11", f"""
SELECT batch_id, shift, {SHIFT_SQL.format(m='end_min')} AS end_shift FROM batches""")
def end_shift(t):
    return t.b.select("batch_id", "shift", shift_of("end_min").alias("end_shift"))


@query("has_downtime_reason", "F12", """
SELECT batch_id, downtime_id, (description IS NOT NULL AND description <> 'fill missing value') AS has_downtime_reason
FROM cp""")
def has_downtime_reason(t):
    cp = marts.complete_table(t)
    return cp.select("batch_id", "downtime_id", features.has_reason("description").alias("has_downtime_reason"))


@query("size_litres", "F13", """
SELECT product_id, size,
       CASE WHEN lower(regexp_extract(size, '([A-Za-z]+)', 1)) = 'l'
            THEN CAST(regexp_extract(size, '([0-9.]+)', 1) AS DOUBLE)
            ELSE CAST(regexp_extract(size, '([0-9.]+)', 1) AS DOUBLE) / 1000 END AS size_litres
FROM products""")
def size_litres(t):
    return t.p.select("product_id", "size", features.size_litres("size").alias("size_litres"))


@query("size_category", "F14", """
SELECT product_id, size, CASE WHEN size LIKE '%600%' THEN 'Small' ELSE 'Large' END AS size_category FROM products""")
def size_category(t):
    return t.p.select("product_id", "size", features.size_category("size").alias("size_category"))


# --- marts ----------------------------------------------------------------------------------

BATCH_COLS = "batch_id, prod_date, product_id, operator_name, start_min, end_min, duration_min, shift, status"


@query("batch_with_product", "J01", f"""
SELECT b.*, p.flavor, p.size, p.size_l, p.min_batch_time FROM batches b LEFT JOIN products p
ON b.product_id = p.product_id""")
def batch_with_product(t):
    return marts.batch_with_product(t)


@query("incident_with_factor", "J02", """
SELECT i.*, f.description, f.operator_error FROM incidents i LEFT JOIN factors f ON i.factor_id = f.factor_id""")
def incident_with_factor(t):
    return marts.incident_factor(t, "left")


@query("batch_with_incident", "J03", """
SELECT b.*, i.downtime_id, i.factor_id, i.downtime_min FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id""")
def batch_with_incident(t):
    return marts.batch_incident(t, "left")


@query("complete_table", "J04", f"""
SELECT {BATCH_COLS}, flavor, size, size_l, min_batch_time, downtime_id, factor_id, downtime_min, description,
       operator_error FROM cp""")
def complete_table(t):
    return marts.complete_table(t)


@query("complete_with_status", "J05", """
SELECT batch_id, prod_date, product_id, flavor, size, operator_name, start_min, end_min, duration_min, min_batch_time,
       shift, downtime_id, factor_id, description, operator_error, downtime_min, batch_status FROM cp""")
def complete_with_status(t):
    return marts.complete_with_status(t)


@query("production_master_report", "J06", """
SELECT b.batch_id, b.prod_date, b.product_id, p.flavor, b.operator_name, b.shift, b.status,
       b.duration_min AS actual_min, p.min_batch_time AS target_min,
       CAST(COALESCE(bd.total_downtime, 0) AS BIGINT) AS total_downtime_min
FROM batches b LEFT JOIN products p ON b.product_id = p.product_id LEFT JOIN bd ON b.batch_id = bd.batch_id""")
def production_master_report(t):
    return marts.production_master_report(t)


@query("ml_incident_frame", "J07", """
SELECT i.*, f.operator_error, j.product_id, j.operator_name, j.shift, j.min_batch_time
FROM incidents i LEFT JOIN factors f ON i.factor_id = f.factor_id LEFT JOIN j01 j ON i.batch_id = j.batch_id""")
def ml_incident_frame(t):
    return marts.ml_incident_frame(t)
