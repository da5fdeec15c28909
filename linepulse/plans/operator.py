"""Operator reports (O keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linepulse.functions.expr import is_human, pct, r, sum_if
from linepulse.operators import marts
from linepulse.functions.scale import _null_safe_join
from linepulse.operators.metrics import on_time_rate, order_by, top_per_group, volume
from linepulse.plans.registry import BIG, PCT, R, query

ON_TIME_SQL = "SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)"
HE_MIN_SQL = "SUM(CASE WHEN operator_error = 'Yes' THEN downtime_min ELSE 0 END)"
HE_CNT_SQL = "SUM(CASE WHEN operator_error = 'Yes' THEN 1 ELSE 0 END)"


@query("top_operator", "O01", """
SELECT operator_name, COUNT(*) AS total_batches FROM batches GROUP BY operator_name
ORDER BY total_batches DESC, operator_name LIMIT 1""")
def top_operator(t):
    return volume(t.b, "operator_name").orderBy(F.col("total_batches").desc(), "operator_name").limit(1)


@query("operator_product_avg_time", "O02", """
SELECT product_id, operator_name, AVG(duration_min) AS avg_production_time FROM batches
GROUP BY product_id, operator_name""")
def operator_product_avg_time(t):
    return t.b.groupBy("product_id", "operator_name").agg(F.avg("duration_min").alias("avg_production_time"))


@query("operator_on_time", "O03", f"""
SELECT operator_name, COUNT(*) AS total_batches, {BIG(ON_TIME_SQL)} AS on_time_batches,
       {PCT(ON_TIME_SQL, 'COUNT(*)')} AS ot_percentage
FROM batches GROUP BY operator_name""")
def operator_on_time(t):
    return on_time_rate(t.b, "operator_name", rate="ot_percentage")


def _efficiency(bp, by, actual="total_actual_duration", target="total_target_duration", score="efficiency_score",
                count=None):
    aggs = [F.sum("duration_min").alias(actual), F.sum("min_batch_time").alias(target)]
    if count:
        aggs.insert(0, F.count(F.lit(1)).alias(count))
    return bp.groupBy(*by).agg(*aggs).withColumn(score, pct(target, actual))


@query("operator_target_achievement", "O04", f"""
SELECT operator_name, {BIG('SUM(duration_min)')} AS total_actual_duration,
       {BIG('SUM(min_batch_time)')} AS total_target_duration,
       {PCT('SUM(min_batch_time)', 'SUM(duration_min)')} AS real_efficiency_score
FROM bp GROUP BY operator_name""")
def operator_target_achievement(t):
    return _efficiency(marts.batch_product(t), ["operator_name"], score="real_efficiency_score")


@query("operator_error_rate", "O05", f"""
SELECT b.operator_name, COUNT(DISTINCT b.batch_id) AS total_batches_worked, COUNT(i.downtime_id) AS error_count,
       {PCT('COUNT(i.downtime_id)', 'COUNT(DISTINCT b.batch_id)')} AS error_rate_per_batch_pct
FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id
LEFT JOIN factors f ON i.factor_id = f.factor_id AND f.operator_error = 'Yes'
GROUP BY b.operator_name""")
def operator_error_rate(t, human_only: bool = False):
    """Errors per batch.  As reported, every incident counts (the error filter only limits the
    factor side of the outer join); ``human_only`` counts operator-error incidents only."""
    counted = "human_error_count" if human_only else "incident_count"
    return marts.batches_with_totals(t).groupBy("operator_name").agg(
        F.count_distinct("batch_id").alias("total_batches_worked"), F.sum(counted).alias("error_count")
    ).withColumn("error_rate_per_batch_pct", pct("error_count", "total_batches_worked"))


@query("operator_error_rate_human_only", "O05", f"""
SELECT b.operator_name, COUNT(DISTINCT b.batch_id) AS total_batches_worked, COUNT(f.factor_id) AS error_count,
       {PCT('COUNT(f.factor_id)', 'COUNT(DISTINCT b.batch_id)')} AS error_rate_per_batch_pct
FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id
LEFT JOIN factors f ON i.factor_id = f.factor_id AND f.operator_error = 'Yes'
GROUP BY b.operator_name""")
def operator_error_rate_human_only(t):
    return operator_error_rate(t, human_only=True)


@query("operator_top_error", "O06", """
WITH s AS (SELECT operator_name, description AS error_type, COUNT(downtime_id) AS frequency,
                  RANK() OVER (PARTITION BY operator_name ORDER BY COUNT(downtime_id) DESC) AS rk
           FROM bif WHERE operator_error = 'Yes' GROUP BY operator_name, description)
SELECT operator_name, error_type, frequency FROM s WHERE rk = 1""")
def operator_top_error(t):
    g = (marts.batch_incident_factor(t, ids=False).filter(is_human())
         .groupBy("operator_name", F.col("description").alias("error_type"))
         .agg(F.count("incident").alias("frequency")))
    return top_per_group(g, "operator_name", [F.col("frequency").desc()], 1, ties=True)


@query("operator_lost_time", "O07", f"""
SELECT b.operator_name, COUNT(i.downtime_id) AS total_incidents, {BIG('SUM(i.downtime_min)')} AS total_lost_minutes,
       AVG(i.downtime_min) AS avg_downtime_per_incident
FROM batches b LEFT JOIN incidents i ON b.batch_id = i.batch_id GROUP BY b.operator_name""")
def operator_lost_time(t):
    return marts.batch_incident(t, "left", ids=False).groupBy("operator_name").agg(
        F.count("incident").alias("total_incidents"), F.sum("downtime_min").alias("total_lost_minutes"),
        F.avg("downtime_min").alias("avg_downtime_per_incident"))


@query("operator_mttr", "O08", f"""
SELECT operator_name, COUNT(downtime_id) AS total_failures, {BIG('SUM(downtime_min)')} AS total_downtime_min,
       {R('AVG(downtime_min)')} AS mttr_min
FROM bi GROUP BY operator_name""")
def operator_mttr(t):
    return marts.batch_incident(t, ids=False).groupBy("operator_name").agg(
        F.count("incident").alias("total_failures"), F.sum("downtime_min").alias("total_downtime_min"),
        r(F.avg("downtime_min")).alias("mttr_min"))


@query("operator_size_efficiency", "O09", f"""
SELECT operator_name, size, COUNT(*) AS total_batches, {BIG('SUM(min_batch_time)')} AS total_target_duration,
       {BIG('SUM(duration_min)')} AS total_actual_duration,
       {PCT('SUM(min_batch_time)', 'SUM(duration_min)')} AS efficiency_score
FROM bp GROUP BY operator_name, size""")
def operator_size_efficiency(t):
    return _efficiency(marts.batch_product(t), ["operator_name", "size"], count="total_batches")


@query("operator_shift_otdr", "O10", f"""
SELECT operator_name, shift, COUNT(*) AS total_batches, {BIG(ON_TIME_SQL)} AS on_time_batches,
       {PCT(ON_TIME_SQL, 'COUNT(*)')} AS otdr_pct
FROM batches GROUP BY operator_name, shift""")
def operator_shift_otdr(t):
    return on_time_rate(t.b, ["operator_name", "shift"])


@query("operator_efficiency_index", "O11", f"""
SELECT operator_name, {BIG('SUM(min_batch_time)')} AS total_target, {BIG('SUM(duration_min)')} AS total_actual,
       {PCT('SUM(min_batch_time)', 'SUM(duration_min)')} AS efficiency_index
FROM bp GROUP BY operator_name""")
def operator_efficiency_index(t):
    return _efficiency(marts.batch_product(t), ["operator_name"], "total_actual", "total_target", "efficiency_index")


@query("operator_error_free_runtime", "O12", """
SELECT operator_name, AVG(duration_min) AS avg_run_time_without_errors FROM batches
WHERE batch_id NOT IN (SELECT DISTINCT batch_id FROM idf WHERE operator_error = 'Yes')
GROUP BY operator_name""")
def operator_error_free_runtime(t):
    clean = marts.batches_with_totals(t).where("human_error_count = 0")
    return clean.groupBy("operator_name").agg(F.avg("duration_min").alias("avg_run_time_without_errors"))


@query("operator_waste", "O13", f"""
WITH run AS (SELECT operator_name, {BIG('SUM(duration_min)')} AS s FROM batches GROUP BY operator_name),
     w AS (SELECT b.operator_name, {BIG('SUM(i.downtime_min)')} AS total_downtime_minutes,
                  {BIG(HE_MIN_SQL.replace('downtime_min', 'i.downtime_min'))} AS operator_mistake_minutes,
                  {PCT(HE_MIN_SQL.replace('downtime_min', 'i.downtime_min'), 'SUM(i.downtime_min)')}
                  AS operator_responsibility_pct
           FROM batches b LEFT JOIN idfl i ON b.batch_id = i.batch_id GROUP BY b.operator_name)
SELECT w.operator_name, run.s AS total_production_duration, w.total_downtime_minutes,
       w.operator_mistake_minutes, w.operator_responsibility_pct
FROM w JOIN run ON w.operator_name = run.operator_name""")
def operator_waste(t):
    run = t.b.groupBy("operator_name").agg(F.sum("duration_min").alias("total_production_duration"))
    he_min = sum_if(is_human(), "downtime_min")
    w = marts.batch_incident_factor(t, "left", ids=False).groupBy("operator_name").agg(
        F.sum("downtime_min").alias("total_downtime_minutes"), he_min.alias("operator_mistake_minutes"),
        pct(he_min, F.sum("downtime_min")).alias("operator_responsibility_pct"))
    return w.join(run, "operator_name")


@query("operator_fatigue_first_last2", "O14", """
WITH s AS (SELECT operator_name, duration_min,
                  ROW_NUMBER() OVER (PARTITION BY operator_name ORDER BY start_min, prod_date, batch_id) AS a,
                  ROW_NUMBER() OVER (PARTITION BY operator_name
                                     ORDER BY start_min DESC, prod_date DESC, batch_id DESC) AS z
           FROM batches)
SELECT operator_name, AVG(CASE WHEN a <= 2 THEN duration_min END) AS early_batch_avg_time,
       AVG(CASE WHEN z <= 2 THEN duration_min END) AS late_batch_avg_time
FROM s GROUP BY operator_name""")
def operator_fatigue_first_last2(t, n: int = 2):
    """Average duration of each operator's first and last ``n`` batches by time of day.  Both subsets
    come from group limits (n rows per operator leave each task); no flag is joined back."""
    b = t.b.select("batch_id", "operator_name", "start_min", "prod_date", "duration_min")
    early = top_per_group(b, "operator_name", order_by(["start_min", "prod_date", "batch_id"]), n)
    late = top_per_group(b, "operator_name", order_by(["-start_min", "-prod_date", "-batch_id"]), n)
    e = early.groupBy("operator_name").agg(F.avg("duration_min").alias("early_batch_avg_time"))
    z = late.groupBy("operator_name").agg(F.avg("duration_min").alias("late_batch_avg_time"))
    return _null_safe_join(e, z, ["operator_name"])

