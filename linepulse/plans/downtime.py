"""Downtime reports (D keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linepulse.functions.expr import pct, ratio, wrap_minutes
from linepulse.operators import marts
from linepulse.operators.metrics import pareto, share
from linepulse.plans.registry import BIG, DIV, PCT, query


@query("downtime_pareto", "D09", f"""
WITH cause AS (
  SELECT description, CAST(SUM(downtime_min) AS BIGINT) AS total_min FROM idf GROUP BY description),
cum AS (
  SELECT description, total_min,
         SUM(total_min) OVER (ORDER BY total_min DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
         SUM(total_min) OVER () AS g
  FROM cause)
SELECT description, total_min, {PCT('c', 'g')} AS cumulative_pct
FROM cum WHERE (c - total_min) * 100.0E0 / g < 80
""")
def downtime_pareto(t):
    return pareto(marts.incident_factor(t, ids=False), "description", "downtime_min", "before_lt", 80.0)


def _he(col="operator_error"):
    return F.col(col) == F.lit("Yes")


def _sum_if(cond, v):
    return F.sum(F.when(cond, F.col(v)).otherwise(F.lit(0)))


def _count_if(cond):
    return F.count(F.when(cond, F.lit(1)))


@query("mttr", "D01", "SELECT AVG(downtime_min) AS mttr_minutes FROM incidents")
def mttr(t):
    return t.ir.agg(F.avg("downtime_min").alias("mttr_minutes"))


@query("downtime_ratio", "D02", f"""
SELECT {PCT('(SELECT SUM(downtime_min) FROM incidents)', '(SELECT SUM(duration_min) FROM batches)')}
       AS downtime_ratio_pct""")
def downtime_ratio(t):
    down = t.ir.agg(F.sum("downtime_min").alias("_d"))
    run = t.b.agg(F.sum("duration_min").alias("_r"))
    # two one-row aggregates side by side
    return down.crossJoin(run).select(pct("_d", "_r").alias("downtime_ratio_pct"))


@query("availability_incident_weighted", "D03", f"""
SELECT {PCT('SUM(b.duration_min) - SUM(COALESCE(i.downtime_min, 0))', 'SUM(b.duration_min)')}
       AS availability_score_pct
FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id""")
def availability_incident_weighted(t):
    j = marts.batch_incident(t, "left", ids=False)
    return j.agg(pct(F.sum("duration_min") - F.sum(F.coalesce("downtime_min", F.lit(0))),
                     F.sum("duration_min")).alias("availability_score_pct"))


@query("factor_frequency", "D04", """
SELECT description, COUNT(downtime_id) AS occurrence_count FROM idf GROUP BY description""")
def factor_frequency(t):
    return marts.incident_factor(t, ids=False).groupBy("description").agg(F.count("incident").alias("occurrence_count"))


@query("top5_factors_by_duration", "D05", f"""
SELECT description, {BIG('SUM(downtime_min)')} AS total_downtime_minutes FROM idf GROUP BY description
ORDER BY total_downtime_minutes DESC, description LIMIT 5""")
def top5_factors_by_duration(t, n: int = 5):
    g = marts.incident_factor(t, ids=False).groupBy("description").agg(F.sum("downtime_min").alias("total_downtime_minutes"))
    return g.orderBy(F.col("total_downtime_minutes").desc(), "description").limit(n)


@query("shift_downtime", "D06", f"""
SELECT shift, {BIG('SUM(downtime_min)')} AS total_downtime_min FROM bi GROUP BY shift""")
def shift_downtime(t):
    return marts.batch_incident(t, ids=False).groupBy("shift").agg(F.sum("downtime_min").alias("total_downtime_min"))


@query("daily_downtime", "D07", f"""
SELECT prod_date, {BIG('SUM(downtime_min)')} AS total_downtime_min FROM bi GROUP BY prod_date""")
def daily_downtime(t):
    return marts.batch_incident(t, ids=False).groupBy("prod_date").agg(F.sum("downtime_min").alias("total_downtime_min"))


@query("error_category_share", "D08", f"""
SELECT CASE WHEN operator_error = 'Yes' THEN 'Operator' WHEN operator_error = 'No' THEN 'Non Operator'
            ELSE 'Other' END AS error_category,
       {PCT('SUM(downtime_min)', 'SUM(SUM(downtime_min)) OVER ()')} AS loss_percentage
FROM idf GROUP BY operator_error""")
def error_category_share(t):
    s = share(marts.incident_factor(t, ids=False), "operator_error", "downtime_min", "_m", "loss_percentage")
    cat = (F.when(F.col("operator_error") == "Yes", "Operator").when(F.col("operator_error") == "No", "Non Operator")
           .otherwise("Other"))
    return s.select(cat.alias("error_category"), "loss_percentage")


@query("factor_downtime_share", "D10", f"""
SELECT description, {BIG('SUM(downtime_min)')} AS total_downtime_min,
       {PCT('SUM(downtime_min)', 'SUM(SUM(downtime_min)) OVER ()')} AS downtime_percentage
FROM idf GROUP BY description""")
def factor_downtime_share(t):
    return share(marts.incident_factor(t, ids=False), "description", "downtime_min", "total_downtime_min", "downtime_percentage")


@query("operator_downtime_share", "D11", f"""
SELECT operator_name, {BIG('SUM(downtime_min)')} AS total_downtime_min,
       {PCT('SUM(downtime_min)', 'SUM(SUM(downtime_min)) OVER ()')} AS downtime_pct
FROM bi GROUP BY operator_name""")
def operator_downtime_share(t):
    return share(marts.batch_incident(t, ids=False), "operator_name", "downtime_min", "total_downtime_min", "downtime_pct")


@query("product_failure_impact", "D12", f"""
SELECT product_id, description AS failure_type, COUNT(downtime_id) AS occurrence_count,
       {BIG('SUM(downtime_min)')} AS total_lost_time
FROM bif WHERE description IN ('Batch change', 'Label switch', 'Labeling error')
GROUP BY product_id, description""")
def product_failure_impact(t, causes=("Batch change", "Label switch", "Labeling error")):
    d = marts.batch_incident_factor(t, ids=False).filter(F.col("description").isin(*causes))
    return d.groupBy("product_id", F.col("description").alias("failure_type")).agg(
        F.count("incident").alias("occurrence_count"), F.sum("downtime_min").alias("total_lost_time"))


@query("operator_repeated_errors", "D13", """
SELECT operator_name, description AS failure_reason, COUNT(downtime_id) AS frequency
FROM bif WHERE operator_error = 'Yes' GROUP BY operator_name, description HAVING COUNT(downtime_id) > 1""")
def operator_repeated_errors(t, min_count: int = 1):
    d = marts.batch_incident_factor(t, ids=False).filter(_he())
    return (d.groupBy("operator_name", F.col("description").alias("failure_reason"))
             .agg(F.count("incident").alias("frequency")).filter(F.col("frequency") > min_count))


@query("failure_timing_morning_night", "D14", f"""
SELECT shift, AVG(downtime_min) AS avg_downtime_duration, {BIG('SUM(downtime_min)')} AS total_downtime_min,
       COUNT(downtime_id) AS number_of_incidents
FROM bi WHERE shift IN ('Morning', 'Night') GROUP BY shift""")
def failure_timing_morning_night(t, shifts=("Morning", "Night")):
    d = marts.batch_incident(t, ids=False).filter(F.col("shift").isin(*shifts))
    return d.groupBy("shift").agg(F.avg("downtime_min").alias("avg_downtime_duration"),
                                  F.sum("downtime_min").alias("total_downtime_min"),
                                  F.count("incident").alias("number_of_incidents"))


@query("changeover_setup_by_shift", "D15", f"""
SELECT shift, COUNT(downtime_id) AS number_of_setups, {BIG('SUM(downtime_min)')} AS total_setup_minutes,
       AVG(downtime_min) AS avg_setup_time_per_batch
FROM bif WHERE description = 'Batch change' GROUP BY shift""")
def changeover_setup_by_shift(t):
    d = marts.batch_incident_factor(t, ids=False).filter(F.col("description") == "Batch change")
    return d.groupBy("shift").agg(F.count("incident").alias("number_of_setups"),
                                  F.sum("downtime_min").alias("total_setup_minutes"),
                                  F.avg("downtime_min").alias("avg_setup_time_per_batch"))


@query("factor_vs_delay", "D16", f"""
SELECT description AS downtime_factor, COUNT(CASE WHEN status = 'DELAY' THEN 1 END) AS delay_occurrences,
       {BIG('SUM(downtime_min)')} AS total_downtime_min
FROM bif GROUP BY description""")
def factor_vs_delay(t):
    return marts.batch_incident_factor(t, ids=False).groupBy(F.col("description").alias("downtime_factor")).agg(
        _count_if(F.col("status") == "DELAY").alias("delay_occurrences"),
        F.sum("downtime_min").alias("total_downtime_min"))


@query("product_labeling_calibration", "D17", """
SELECT product_id, description AS failure_type, COUNT(downtime_id) AS frequency
FROM bif WHERE description IN ('Labeling error', 'Calibration error', 'Label switch')
GROUP BY product_id, description""")
def product_labeling_calibration(t, causes=("Labeling error", "Calibration error", "Label switch")):
    d = marts.batch_incident_factor(t, ids=False).filter(F.col("description").isin(*causes))
    return d.groupBy("product_id", F.col("description").alias("failure_type")).agg(
        F.count("incident").alias("frequency"))


@query("machine_failure_by_shift", "D18", f"""
SELECT shift, description AS failure_type, COUNT(downtime_id) AS incident_count,
       {BIG('SUM(downtime_min)')} AS total_minutes_lost
FROM bif WHERE description = 'Machine failure' GROUP BY shift, description""")
def machine_failure_by_shift(t, cause: str = "Machine failure"):
    d = marts.batch_incident_factor(t, ids=False).filter(F.col("description") == cause)
    return d.groupBy("shift", F.col("description").alias("failure_type")).agg(
        F.count("incident").alias("incident_count"), F.sum("downtime_min").alias("total_minutes_lost"))


@query("downtime_ratio_components", "D19", f"""
WITH d AS (SELECT {BIG('SUM(downtime_min)')} AS s FROM incidents),
     r AS (SELECT {BIG('SUM(duration_min)')} AS s FROM batches)
SELECT d.s AS total_downtime_min, r.s AS total_production_duration_min,
       {PCT('d.s', 'r.s')} AS corrected_downtime_ratio_pct
FROM d, r""")
def downtime_ratio_components(t):
    down = t.ir.agg(F.sum("downtime_min").alias("total_downtime_min"))
    run = t.b.agg(F.sum("duration_min").alias("total_production_duration_min"))
    return down.crossJoin(run).withColumn(
        "corrected_downtime_ratio_pct", pct("total_downtime_min", "total_production_duration_min"))


@query("availability_inner_incident_weighted", "D20", f"""
SELECT 100.0E0 - {PCT('SUM(downtime_min)', 'SUM(((end_min - start_min) % 1440 + 1440) % 1440)')}
       AS availability_score_pct
FROM bi""")
def availability_inner_incident_weighted(t):
    j = marts.batch_incident(t, ids=False)
    return j.agg((F.lit(100.0) - pct(F.sum("downtime_min"), F.sum(wrap_minutes("start_min", "end_min"))))
                 .alias("availability_score_pct"))


@query("lost_batches_by_product", "D21", f"""
SELECT b.product_id, {BIG('SUM(b.downtime_min)')} AS total_downtime_min, p.min_batch_time,
       {DIV('SUM(b.downtime_min)', 'p.min_batch_time', 1)} AS estimated_lost_batches
FROM bi b JOIN products p ON b.product_id = p.product_id GROUP BY b.product_id, p.min_batch_time""")
def lost_batches_by_product(t):
    j = marts.batch_product_incident(t, ids=False)
    g = j.groupBy("product_id", "min_batch_time").agg(F.sum("downtime_min").alias("total_downtime_min"))
    return g.withColumn("estimated_lost_batches", ratio("total_downtime_min", "min_batch_time", 1))


@query("mtbf_incident_weighted", "D22", """
SELECT CAST(FLOOR(CAST(SUM(((b.end_min - b.start_min) % 1440 + 1440) % 1440) AS DOUBLE)
                  / NULLIF(COUNT(i.downtime_id), 0)) AS BIGINT) AS mtbf_minutes
FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id""")
def mtbf_incident_weighted(t):
    j = marts.batch_incident(t, "left", ids=False)
    run = F.sum(wrap_minutes("start_min", "end_min")).cast("double")
    return j.agg(F.floor(run / F.nullif(F.count("incident"), F.lit(0))).cast("long").alias("mtbf_minutes"))


@query("human_error_rate", "D23", f"""
SELECT COUNT(downtime_id) AS total_incidents,
       {BIG("SUM(CASE WHEN operator_error = 'Yes' THEN 1 ELSE 0 END)")} AS human_error_count,
       {BIG("SUM(CASE WHEN operator_error = 'Yes' THEN downtime_min ELSE 0 END)")} AS human_error_total_min,
       {PCT("SUM(CASE WHEN operator_error = 'Yes' THEN downtime_min ELSE 0 END)", 'SUM(downtime_min)')}
       AS human_error_time_rate_pct,
       {PCT("SUM(CASE WHEN operator_error = 'Yes' THEN 1 ELSE 0 END)", 'COUNT(downtime_id)')}
       AS human_error_freq_rate_pct
FROM idf""")
def human_error_rate(t):
    return human_error_summary(marts.incident_factor(t, ids=False), [])


def human_error_summary(d, by):
    he_n = F.sum(F.when(_he(), F.lit(1)).otherwise(F.lit(0)))
    he_m = _sum_if(_he(), "downtime_min")
    return d.groupBy(*by).agg(
        F.count("incident").alias("total_incidents"),
        he_n.alias("human_error_count"),
        he_m.alias("human_error_total_min"),
        pct(he_m, F.sum("downtime_min")).alias("human_error_time_rate_pct"),
        pct(he_n, F.count("incident")).alias("human_error_freq_rate_pct"))


@query("unexplained_delays", "D24", """
SELECT b.batch_id, b.product_id, b.status, 'Unexplained Delay (Hidden)' AS delay_type
FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id
WHERE b.status = 'DELAY' AND i.downtime_id IS NULL""")
def unexplained_delays(t):
    d = marts.batches_with_totals(t).filter((F.col("status") == "DELAY") & (F.col("incident_count") == 0))
    return d.select("batch_id", "product_id", "status", F.lit("Unexplained Delay (Hidden)").alias("delay_type"))


@query("failure_classification", "D25", f"""
SELECT description, COUNT(downtime_id) AS frequency, {BIG('SUM(downtime_min)')} AS total_duration,
       CASE WHEN COUNT(downtime_id) > 5 AND AVG(downtime_min) < 20 THEN 'Frequent Minor Failure'
            WHEN AVG(downtime_min) > 45 THEN 'Major Failure (Long Repair)'
            WHEN COUNT(downtime_id) > 8 AND SUM(downtime_min) > 200 THEN 'Chronic High-Impact Failure'
            ELSE 'Normal' END AS failure_category
FROM idf GROUP BY description""")
def failure_classification(t, minor_n=5, minor_avg=20, major_avg=45, chronic_n=8, chronic_sum=200):
    g = marts.incident_factor(t, ids=False).groupBy("description").agg(
        F.count("incident").alias("frequency"), F.sum("downtime_min").alias("total_duration"),
        F.avg("downtime_min").alias("_avg"))
    cat = (F.when((F.col("frequency") > minor_n) & (F.col("_avg") < minor_avg), "Frequent Minor Failure")
           .when(F.col("_avg") > major_avg, "Major Failure (Long Repair)")
           .when((F.col("frequency") > chronic_n) & (F.col("total_duration") > chronic_sum),
                 "Chronic High-Impact Failure")
           .otherwise("Normal"))
    return g.select("description", "frequency", "total_duration", cat.alias("failure_category"))
