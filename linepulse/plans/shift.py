"""Shift reports (H keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linepulse.functions.expr import is_human, pct, r, shift_of, sum_if
from linepulse.operators import marts
from linepulse.operators.metrics import on_time_rate
from linepulse.plans.registry import BIG, PCT, R, query

ON_TIME_SQL = "SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)"
HE_MIN = "SUM(CASE WHEN operator_error = 'Yes' THEN downtime_min ELSE 0 END)"
HE_CNT = "SUM(CASE WHEN operator_error = 'Yes' THEN 1 ELSE 0 END)"
END_SHIFT_SQL = ("CASE WHEN end_min BETWEEN 360 AND 839 THEN 'Morning' "
                 "WHEN end_min BETWEEN 840 AND 1319 THEN 'Afternoon' ELSE 'Night' END")


@query("shift_productivity", "H01", f"""
SELECT shift, COUNT(*) AS total_batches, {BIG('SUM(duration_min)')} AS total_production_time
FROM batches GROUP BY shift""")
def shift_productivity(t):
    return t.b.groupBy("shift").agg(F.count(F.lit(1)).alias("total_batches"),
                                    F.sum("duration_min").alias("total_production_time"))


@query("shift_factor_downtime", "H02", f"""
SELECT shift, description, {BIG('SUM(downtime_min)')} AS total_downtime_minutes, COUNT(downtime_id) AS failure_count
FROM bif GROUP BY shift, description""")
def shift_factor_downtime(t):
    return marts.batch_incident_factor(t, ids=False).groupBy("shift", "description").agg(
        F.sum("downtime_min").alias("total_downtime_minutes"), F.count("incident").alias("failure_count"))


@query("shift_otdr", "H03", f"""
SELECT shift, COUNT(*) AS total_batches, {BIG(ON_TIME_SQL)} AS on_time_count,
       {PCT(ON_TIME_SQL, 'COUNT(*)')} AS otdr_percentage
FROM batches GROUP BY shift""")
def shift_otdr(t):
    return on_time_rate(t.b, "shift", on_time="on_time_count", rate="otdr_percentage")


def with_end_shift(b):
    """the shift in which a batch ends (wrap-aware end minute)."""
    return b.withColumn("end_shift", shift_of("end_min"))


@query("shift_handover", "H04", f"""
SELECT CASE WHEN shift = {END_SHIFT_SQL} THEN 'Same Shift' ELSE 'Across Shifts (Handover)' END AS execution_type,
       AVG(duration_min) AS avg_duration, COUNT(*) AS batch_count
FROM batches GROUP BY 1""")
def shift_handover(t):
    b = with_end_shift(t.b)
    kind = F.when(F.col("shift") == F.col("end_shift"), "Same Shift").otherwise("Across Shifts (Handover)")
    return b.groupBy(kind.alias("execution_type")).agg(
        F.avg("duration_min").alias("avg_duration"), F.count(F.lit(1)).alias("batch_count"))


def _human_factor(t, which):
    j = marts.batch_incident_factor(t, "left", ids=False)
    he_min = sum_if(is_human(), "downtime_min")
    he_cnt = sum_if(is_human(), F.lit(1))
    cols = {
        "grand_total_waste_minutes": F.sum("downtime_min"),
        "total_downtime_minutes": F.sum("downtime_min"),
        "total_incidents_count": F.count("incident"),
        "operator_waste_minutes": he_min,
        "operator_error_occurrence": he_cnt,
        "human_factor_pct": pct(he_min, F.sum("downtime_min")),
    }
    return j.groupBy("shift").agg(*[cols[k].alias(k) for k in which])


@query("shift_human_factor", "H05", f"""
SELECT b.shift, {BIG('SUM(i.downtime_min)')} AS grand_total_waste_minutes,
       COUNT(i.downtime_id) AS total_incidents_count,
       {BIG(HE_MIN)} AS operator_waste_minutes, {BIG(HE_CNT)} AS operator_error_occurrence,
       {PCT(HE_MIN, 'SUM(i.downtime_min)')} AS human_factor_pct
FROM batches b LEFT JOIN idfl i ON b.batch_id = i.batch_id GROUP BY b.shift""")
def shift_human_factor(t):
    return _human_factor(t, ["grand_total_waste_minutes", "total_incidents_count", "operator_waste_minutes",
                             "operator_error_occurrence", "human_factor_pct"])


@query("shift_human_factor_impact", "H06", f"""
SELECT b.shift, {BIG(HE_MIN)} AS operator_waste_minutes, {BIG('SUM(i.downtime_min)')} AS total_downtime_minutes,
       {PCT(HE_MIN, 'SUM(i.downtime_min)')} AS human_factor_pct
FROM batches b LEFT JOIN idfl i ON b.batch_id = i.batch_id GROUP BY b.shift""")
def shift_human_factor_impact(t):
    return _human_factor(t, ["operator_waste_minutes", "total_downtime_minutes", "human_factor_pct"])


@query("shift_downtime_severity", "H07", f"""
SELECT b.shift, {BIG('SUM(i.downtime_min)')} AS total_downtime_minutes, COUNT(i.downtime_id) AS number_of_incidents,
       {R('AVG(i.downtime_min)')} AS avg_downtime_per_incident
FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id GROUP BY b.shift""")
def shift_downtime_severity(t):
    return marts.batch_incident(t, "left", ids=False).groupBy("shift").agg(
        F.sum("downtime_min").alias("total_downtime_minutes"), F.count("incident").alias("number_of_incidents"),
        r(F.avg("downtime_min")).alias("avg_downtime_per_incident"))


@query("shift_error_occurrence", "H08", f"""
SELECT shift, COUNT(downtime_id) AS total_errors_count, {BIG(HE_CNT)} AS human_errors_only,
       {PCT(HE_CNT, 'COUNT(downtime_id)')} AS error_frequency_pct
FROM bif GROUP BY shift""")
def shift_error_occurrence(t):
    he_cnt = sum_if(is_human(), F.lit(1))
    return marts.batch_incident_factor(t, ids=False).groupBy("shift").agg(
        F.count("incident").alias("total_errors_count"), he_cnt.alias("human_errors_only"),
        pct(he_cnt, F.count("incident")).alias("error_frequency_pct"))
