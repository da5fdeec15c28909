"""Product, size and flavour reports and the closing questions (R and V keys)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linepulse.functions.expr import pct, r
from linepulse.operators import marts
from linepulse.operators.metrics import on_time_rate
from linepulse.plans.registry import BIG, PCT, R, query

ON_TIME_SQL = "SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)"
# Standard batch time per bottle size (minutes), 600 ml -> 60, 2 L -> 98.
STANDARD_TIME = {0.6: 60, 2.0: 98}


def _bpi(t, how="inner"):
    """batch x product x incident rows (incident-weighted)."""
    return marts.batch_product_incident(t, how, ids=False)


def _bpif(t):
    return marts.batch_product_incident_factor(t, ids=False)


@query("size_complexity", "R01", f"""
WITH run AS (SELECT size, {BIG('SUM(duration_min)')} AS s FROM bp GROUP BY size),
     fan AS (SELECT p.size, {BIG('SUM(i.downtime_min)')} AS total_downtime, AVG(b.duration_min) AS avg_production_time
             FROM products p LEFT JOIN batches b ON p.product_id = b.product_id
             LEFT JOIN incidents i ON b.batch_id = i.batch_id GROUP BY p.size)
SELECT fan.size, run.s AS total_production_min, fan.total_downtime, fan.avg_production_time,
       {PCT('fan.total_downtime', 'run.s')} AS delay_impact_pct
FROM fan LEFT JOIN run ON fan.size = run.size""")
def size_complexity(t):
    run = marts.batch_product(t).groupBy("size").agg(F.sum("duration_min").alias("total_production_min"))
    # incident-weighted sums per product first (a hot product is combined map-side), then the
    # products dimension (products without batches still give their size a row)
    per = marts.batch_incident(t, "left", ids=False).groupBy("product_id").agg(
        F.sum("downtime_min").alias("_m"), F.sum("duration_min").alias("_d"), F.count("duration_min").alias("_n"))
    fan = (t.p.select("product_id", "size").join(per, "product_id", "left").groupBy("size")
           .agg(F.sum("_m").alias("total_downtime"),
                (F.sum("_d").cast("double") / F.sum("_n")).alias("avg_production_time")))
    return (fan.join(run, "size", "left")
               .withColumn("delay_impact_pct", pct("total_downtime", "total_production_min")))


@query("flavor_duration", "R02", f"""
SELECT flavor, COUNT(*) AS total_batches, {BIG('SUM(duration_min)')} AS total_production_minutes,
       AVG(duration_min) AS avg_batch_duration
FROM bp GROUP BY flavor""")
def flavor_duration(t):
    return marts.batch_product(t).groupBy("flavor").agg(
        F.count(F.lit(1)).alias("total_batches"), F.sum("duration_min").alias("total_production_minutes"),
        F.avg("duration_min").alias("avg_batch_duration"))


@query("changeover_by_size", "R03", f"""
SELECT b.size, COUNT(i.downtime_id) AS changeover_count, {BIG('SUM(i.downtime_min)')} AS total_changeover_minutes,
       AVG(i.downtime_min) AS avg_changeover_duration
FROM bp b JOIN incidents i ON b.batch_id = i.batch_id WHERE i.factor_id = 2 GROUP BY b.size""")
def changeover_by_size(t, factor_id: int = 2):
    d = marts.batch_product_incident(t, ids=False).filter(F.col("factor_id") == factor_id)
    return d.groupBy("size").agg(F.count("incident").alias("changeover_count"),
                                 F.sum("downtime_min").alias("total_changeover_minutes"),
                                 F.avg("downtime_min").alias("avg_changeover_duration"))


@query("labeling_issues", "R04", f"""
SELECT b.flavor, b.size, COUNT(i.downtime_id) AS labeling_failures, {BIG('SUM(i.downtime_min)')} AS lost_minutes
FROM bp b JOIN idf i ON b.batch_id = i.batch_id WHERE i.description ILIKE '%Label%' GROUP BY b.flavor, b.size""")
def labeling_issues(t, pattern: str = "%Label%"):
    d = _bpif(t).filter(F.col("description").ilike(pattern))
    return d.groupBy("flavor", "size").agg(F.count("incident").alias("labeling_failures"),
                                           F.sum("downtime_min").alias("lost_minutes"))


@query("product_success_rate", "R05", f"""
SELECT product_id, size, COUNT(*) AS total_batches, {BIG(ON_TIME_SQL)} AS on_time_count,
       {PCT(ON_TIME_SQL, 'COUNT(*)')} AS success_rate_pct
FROM bp GROUP BY product_id, size""")
def product_success_rate(t):
    return on_time_rate(marts.batch_product(t), ["product_id", "size"], on_time="on_time_count",
                        rate="success_rate_pct")


@query("size_rate", "R06", """
SELECT size, MIN(duration_min) AS fastest_batch, MAX(duration_min) AS slowest_batch,
       AVG(duration_min) AS avg_batch_duration, MAX(duration_min) - MIN(duration_min) AS gap_duration
FROM bp GROUP BY size""")
def size_rate(t):
    return marts.batch_product(t).groupBy("size").agg(
        F.min("duration_min").alias("fastest_batch"), F.max("duration_min").alias("slowest_batch"),
        F.avg("duration_min").alias("avg_batch_duration"),
        (F.max("duration_min") - F.min("duration_min")).alias("gap_duration"))


def _flavor_cause(t, cond, n_name, m_name):
    d = _bpif(t).filter(cond)
    return d.groupBy("flavor").agg(F.count("incident").alias(n_name), F.sum("downtime_min").alias(m_name))


@query("flavor_shortage", "R07", f"""
SELECT b.flavor, COUNT(i.downtime_id) AS shortage_incidents, {BIG('SUM(i.downtime_min)')} AS lost_min_due_to_shortage
FROM bp b JOIN idf i ON b.batch_id = i.batch_id
WHERE i.description ILIKE '%Material%' OR i.description ILIKE '%Shortage%' GROUP BY b.flavor""")
def flavor_shortage(t):
    cond = F.col("description").ilike("%Material%") | F.col("description").ilike("%Shortage%")
    return _flavor_cause(t, cond, "shortage_incidents", "lost_min_due_to_shortage")


@query("flavor_spill", "R08", f"""
SELECT b.flavor, COUNT(i.downtime_id) AS spill_incidents, {BIG('SUM(i.downtime_min)')} AS waste_minutes
FROM bp b JOIN idf i ON b.batch_id = i.batch_id WHERE i.description = 'Product spill' GROUP BY b.flavor""")
def flavor_spill(t):
    return _flavor_cause(t, F.col("description") == "Product spill", "spill_incidents", "waste_minutes")


@query("size_batch_change", "R09", f"""
SELECT b.size, AVG(i.downtime_min) AS avg_changeover_time, {BIG('SUM(i.downtime_min)')} AS total_setup_time
FROM bp b JOIN idf i ON b.batch_id = i.batch_id WHERE i.description = 'Batch change' GROUP BY b.size""")
def size_batch_change(t):
    d = _bpif(t).filter(F.col("description") == "Batch change")
    return d.groupBy("size").agg(F.avg("downtime_min").alias("avg_changeover_time"),
                                 F.sum("downtime_min").alias("total_setup_time"))


@query("product_family_reliability", "R10", f"""
SELECT CASE WHEN b.flavor ILIKE '%COLA%' THEN 'Cola' ELSE 'Juice' END AS product_family,
       AVG(b.duration_min) AS avg_duration, {BIG('SUM(i.downtime_min)')} AS total_downtime
FROM bp b LEFT JOIN incidents i ON b.batch_id = i.batch_id GROUP BY 1""")
def product_family_reliability(t):
    fam = F.when(F.col("flavor").ilike("%COLA%"), "Cola").otherwise("Juice").alias("product_family")
    return _bpi(t, "left").groupBy(fam).agg(F.avg("duration_min").alias("avg_duration"),
                                            F.sum("downtime_min").alias("total_downtime"))


@query("shift_product_matrix", "R11", """
SELECT product_id,
       AVG(CASE WHEN upper(shift) = 'MORNING' THEN duration_min END) AS morning_avg_time,
       AVG(CASE WHEN upper(shift) = 'AFTERNOON' THEN duration_min END) AS afternoon_avg_time,
       AVG(CASE WHEN upper(shift) = 'NIGHT' THEN duration_min END) AS night_avg_time
FROM bp GROUP BY product_id""")
def shift_product_matrix(t):
    def avg_in(s):
        return F.avg(F.when(F.upper("shift") == s.upper(), F.col("duration_min")))
    return marts.batch_product(t).groupBy("product_id").agg(
        avg_in("Morning").alias("morning_avg_time"), avg_in("Afternoon").alias("afternoon_avg_time"),
        avg_in("Night").alias("night_avg_time"))


@query("product_avg_downtime", "R12", f"""
SELECT p.product_id, {R('AVG(COALESCE(i.downtime_min, 0) * 1.0E0)')} AS avg_downtime_minutes,
       {BIG('SUM(i.downtime_min)')} AS total_waste_minutes
FROM products p LEFT JOIN batches b ON p.product_id = b.product_id
LEFT JOIN incidents i ON b.batch_id = i.batch_id GROUP BY p.product_id""")
def product_avg_downtime(t):
    # per product over the fanned rows first, then every product (one row each side)
    per = marts.batch_incident(t, "left", ids=False).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum(F.coalesce("downtime_min", F.lit(0))).alias("_s"),
        F.sum("downtime_min").alias("total_waste_minutes"))
    j = t.p.select("product_id").join(per, "product_id", "left")
    # a product without batches is one row with no downtime: average 0
    avg = F.when(F.col("_rows").isNull(), F.lit(0.0)).otherwise(F.col("_s").cast("double") / F.col("_rows"))
    return j.select("product_id", r(avg).alias("avg_downtime_minutes"), "total_waste_minutes")


@query("size_capacity_utilization", "R13", f"""
SELECT b.size, {BIG('SUM(b.duration_min)')} AS correct_total_run_time, {BIG('SUM(bd.total_downtime)')} AS total_down_time,
       {PCT('SUM(b.min_batch_time)', 'SUM(b.duration_min)')} AS utilization_rate_pct
FROM bp b LEFT JOIN bd ON b.batch_id = bd.batch_id GROUP BY b.size""")
def size_capacity_utilization(t):
    j = marts.batches_with_totals(t).filter(F.col("has_product"))
    return j.groupBy("size").agg(
        F.sum("duration_min").alias("correct_total_run_time"), F.sum("total_downtime").alias("total_down_time"),
        pct(F.sum("min_batch_time"), F.sum("duration_min")).alias("utilization_rate_pct"))


@query("size_standard_time", "R14", """
SELECT size, MIN(duration_min) AS min_time, MAX(duration_min) AS max_time, AVG(duration_min) AS actual_avg_duration,
       CASE WHEN size_l = 0.6E0 THEN 60 ELSE 98 END AS target_time,
       AVG(duration_min) - CASE WHEN size_l = 0.6E0 THEN 60 ELSE 98 END AS variance_minutes
FROM bp GROUP BY size, size_l""")
def size_standard_time(t):
    target = F.when(F.col("size_l") == 0.6, F.lit(STANDARD_TIME[0.6])).otherwise(F.lit(STANDARD_TIME[2.0]))
    g = marts.batch_product(t).groupBy("size", "size_l").agg(
        F.min("duration_min").alias("min_time"), F.max("duration_min").alias("max_time"),
        F.avg("duration_min").alias("actual_avg_duration"))
    return g.select("size", "min_time", "max_time", "actual_avg_duration", target.alias("target_time"),
                    (F.col("actual_avg_duration") - target).alias("variance_minutes"))


@query("performance_variance", "V01", """
SELECT size, flavor, MIN(duration_min) AS best_run, MAX(duration_min) AS worst_run,
       MAX(duration_min) - MIN(duration_min) AS performance_gap
FROM bp GROUP BY size, flavor""")
def performance_variance(t):
    return marts.batch_product(t).groupBy("size", "flavor").agg(
        F.min("duration_min").alias("best_run"), F.max("duration_min").alias("worst_run"),
        (F.max("duration_min") - F.min("duration_min")).alias("performance_gap"))


@query("shift_time_of_day", "V02", f"""
SELECT shift, COUNT(downtime_id) AS number_of_stops, {BIG('SUM(downtime_min)')} AS total_downtime_minutes,
       AVG(downtime_min) AS avg_repair_time
FROM bi GROUP BY shift""")
def shift_time_of_day(t):
    return marts.batch_incident(t, ids=False).groupBy("shift").agg(
        F.count("incident").alias("number_of_stops"), F.sum("downtime_min").alias("total_downtime_minutes"),
        F.avg("downtime_min").alias("avg_repair_time"))


@query("chronic_vs_acute", "V03", f"""
SELECT description, COUNT(downtime_id) AS frequency, {BIG('SUM(downtime_min)')} AS total_impact_minutes,
       AVG(downtime_min) AS avg_duration_per_stop
FROM idf GROUP BY description""")
def chronic_vs_acute(t):
    return marts.incident_factor(t, ids=False).groupBy("description").agg(
        F.count("incident").alias("frequency"), F.sum("downtime_min").alias("total_impact_minutes"),
        F.avg("downtime_min").alias("avg_duration_per_stop"))


@query("operator_machine_issues", "V04", """
SELECT operator_name, COUNT(downtime_id) AS issues_handled, AVG(downtime_min) AS response_repair_speed
FROM bif WHERE description ILIKE '%Machine%' GROUP BY operator_name""")
def operator_machine_issues(t):
    d = marts.batch_incident_factor(t, ids=False).filter(F.col("description").ilike("%Machine%"))
    return d.groupBy("operator_name").agg(F.count("incident").alias("issues_handled"),
                                          F.avg("downtime_min").alias("response_repair_speed"))

