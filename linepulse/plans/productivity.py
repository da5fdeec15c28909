"""Productivity and efficiency reports (P keys)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linepulse.functions.expr import DELAY, count_if, is_on_time, pct, r, wrap_minutes
from linepulse.functions.scale import seq_lag, seq_lead
from linepulse.operators import marts
from linepulse.operators.metrics import on_time_rate, order_by, share, stats, top_per_group, volume
from linepulse.plans.registry import BIG, PCT, R, query
from linepulse.sources.testmap import line_of


@query("total_production_duration", "P01",
       f"SELECT {BIG('SUM(duration_min)')} AS total_production_duration FROM batches")
def total_production_duration(t):
    return t.b.agg(F.sum("duration_min").alias("total_production_duration"))


@query("avg_duration", "P02", "SELECT AVG(duration_min) AS avg_duration FROM batches")
def avg_duration(t):
    return t.b.agg(F.avg("duration_min").alias("avg_duration"))


@query("total_downtime", "P03",
       f"SELECT {BIG('SUM(downtime_min)')} AS total_downtime_min FROM incidents")
def total_downtime(t):
    return t.ir.agg(F.sum("downtime_min").alias("total_downtime_min"))


@query("status_counts", "P04", """
SELECT status, COUNT(*) AS total_batches FROM batches
WHERE status IN ('ON TIME', 'DELAY') GROUP BY status""")
def status_counts(t):
    return volume(t.b, "status", where=F.col("status").isin("ON TIME", "DELAY"))


@query("productivity_score_line", "P05", f"""
SELECT {R("(1 - CAST(SUM(COALESCE(bd.total_downtime, 0)) AS DOUBLE) / NULLIF(SUM(b.duration_min), 0)) * 100")}
       AS productivity_score
FROM batches b LEFT JOIN bd ON b.batch_id = bd.batch_id""")
def productivity_score_line(t):
    j = marts.batches_with_totals(t)
    lost = F.sum(F.coalesce("total_downtime", F.lit(0))).cast("double")
    return j.agg(r((F.lit(1) - lost / F.nullif(F.sum("duration_min"), F.lit(0))) * 100, 2)
                 .alias("productivity_score"))


@query("production_trend_daily", "P06", """
SELECT prod_date, COUNT(*) AS total_batches,
       COUNT(*) - LAG(COUNT(*)) OVER (ORDER BY prod_date) AS growth_difference
FROM batches GROUP BY prod_date""")
def production_trend_daily(t):
    # the window runs on one row per date
    d = volume(t.b, "prod_date")
    return d.withColumn("growth_difference",
                        F.col("total_batches") - F.lag("total_batches").over(Window.orderBy("prod_date")))


@query("batch_density_per_shift", "P07", """
SELECT shift, COUNT(*) AS total_batches,
       CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT prod_date) AS avg_batches_per_day
FROM batches GROUP BY shift""")
def batch_density_per_shift(t):
    return t.b.groupBy("shift").agg(
        F.count(F.lit(1)).alias("total_batches"),
        (F.count(F.lit(1)).cast("double") / F.count_distinct("prod_date")).alias("avg_batches_per_day"))


@query("product_mix_pct", "P08", f"""
SELECT product_id, COUNT(*) AS batch_count,
       {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS production_pct
FROM batches GROUP BY product_id""")
def product_mix_pct(t):
    return share(t.b, "product_id", name="batch_count", pct_name="production_pct")


@query("gap_analysis_by_product", "P09", f"""
SELECT product_id, COUNT(*) AS total_batches, {BIG('SUM(min_batch_time)')} AS target_duration_min,
       {BIG('SUM(duration_min)')} AS actual_duration_min,
       {BIG('SUM(duration_min) - SUM(min_batch_time)')} AS total_variance_min
FROM bp GROUP BY product_id""")
def gap_analysis_by_product(t):
    g = marts.batch_product(t).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total_batches"),
        F.sum("min_batch_time").alias("target_duration_min"),
        F.sum("duration_min").alias("actual_duration_min"))
    return g.withColumn("total_variance_min", F.col("actual_duration_min") - F.col("target_duration_min"))


@query("utilization_daily", "P10", f"""
SELECT prod_date, {BIG('SUM(duration_min)')} AS total_work_minutes,
       {R('CAST(SUM(duration_min) AS DOUBLE) / 1440.0E0 * 100.0E0')} AS utilization_pct
FROM batches GROUP BY prod_date""")
def utilization_daily(t):
    return t.b.groupBy("prod_date").agg(
        F.sum("duration_min").alias("total_work_minutes"),
        r(F.sum("duration_min").cast("double") / 1440.0 * 100.0, 2).alias("utilization_pct"))


def reasons_for(t, batches):
    """Comma-joined "description x incidents" per batch, in order of the description.

    Pre-aggregated to (batch, description, count) first: one entry per factor, whatever the number of
    incidents of a batch.
    """
    per = (marts.incident_factor(t, ids=False).join(batches.select("batch_id"), "batch_id", "left_semi")
           .groupBy("batch_id", "description").agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy("batch_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("description", "n"))),
                                 lambda x: F.concat(x["description"], F.lit(" x "), x["n"].cast("string"))),
                     ", ").alias("reasons"))


@query("longest_batches_with_reasons", "P11", """
WITH top5 AS (SELECT batch_id, product_id, duration_min FROM batches
              ORDER BY duration_min DESC, batch_id LIMIT 5)
SELECT t.batch_id, t.product_id, t.duration_min,
       (SELECT string_agg(description || ' x ' || n, ', ' ORDER BY description)
        FROM (SELECT batch_id, description, COUNT(*) AS n FROM idf GROUP BY batch_id, description) g
        WHERE g.batch_id = t.batch_id) AS reasons
FROM top5 t""")
def longest_batches_with_reasons(t):
    top5 = t.b.select("batch_id", "product_id", "duration_min").orderBy(
        F.col("duration_min").desc(), "batch_id").limit(5)
    return top5.join(reasons_for(t, top5), "batch_id", "left")


@query("fastest_batches", "P12", """
SELECT batch_id, product_id, duration_min FROM batches ORDER BY duration_min, batch_id LIMIT 5""")
def fastest_batches(t):
    return t.b.select("batch_id", "product_id", "duration_min").orderBy("duration_min", "batch_id").limit(5)


@query("changeovers_daily", "P13", """
WITH s AS (SELECT prod_date, product_id,
                  LAG(product_id) OVER (PARTITION BY prod_date ORDER BY start_min, batch_id) AS prev_product
           FROM batches)
SELECT prod_date, COUNT(*) AS changeover_count FROM s
WHERE prev_product IS NOT NULL AND product_id <> prev_product GROUP BY prod_date""")
def changeovers_daily(t):
    line = line_of(t.b)
    s = seq_lag(t.b.select(*line, "batch_id", "prod_date", "start_min", "product_id"), [*line, "prod_date"],
                ["start_min", "batch_id"], ["start_min"], ["product_id"], ["prev_product"])
    return volume(s, [*line, "prod_date"], "changeover_count",
                  where=F.col("prev_product").isNotNull() & (F.col("product_id") != F.col("prev_product")))


@query("idle_gap_daily", "P14", f"""
WITH s AS (SELECT prod_date, start_min + duration_min AS end_at,
                  LEAD(start_min) OVER (PARTITION BY prod_date ORDER BY start_min, batch_id) AS next_start
           FROM batches)
SELECT prod_date, {BIG('SUM(next_start - end_at)')} AS total_idle_gap_min FROM s
WHERE next_start IS NOT NULL GROUP BY prod_date""")
def idle_gap_daily(t):
    line = line_of(t.b)
    s = seq_lead(t.b.select(*line, "batch_id", "prod_date", "start_min", "duration_min"), [*line, "prod_date"],
                 ["start_min", "batch_id"], ["start_min"], ["start_min"], ["next_start"])
    gap = F.col("next_start") - (F.col("start_min") + F.col("duration_min"))
    return (s.filter(F.col("next_start").isNotNull()).groupBy(*line, "prod_date")
             .agg(F.sum(gap).cast("long").alias("total_idle_gap_min")))


@query("product_general", "P15", f"""
SELECT product_id, COUNT(*) AS total_batches, AVG(duration_min) AS avg_actual_duration,
       {PCT("SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS on_time_pct
FROM batches GROUP BY product_id""")
def product_general(t):
    return t.b.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total_batches"), F.avg("duration_min").alias("avg_actual_duration"),
        pct(count_if(is_on_time()), F.count(F.lit(1))).alias("on_time_pct"))


@query("peak_production_day", "P16", """
SELECT prod_date, COUNT(*) AS max_production_volume FROM batches GROUP BY prod_date
ORDER BY max_production_volume DESC, prod_date LIMIT 1""")
def peak_production_day(t):
    return volume(t.b, "prod_date", "max_production_volume").orderBy(
        F.col("max_production_volume").desc(), "prod_date").limit(1)


@query("efficiency_gap_by_batch", "P17", """
SELECT batch_id, product_id, min_batch_time AS target_min,
       CAST(((end_min - start_min) % 1440 + 1440) % 1440 AS INTEGER) AS actual_min,
       CAST(((end_min - start_min) % 1440 + 1440) % 1440 - min_batch_time AS INTEGER) AS gap_min
FROM bp""")
def efficiency_gap_by_batch(t):
    actual = wrap_minutes("start_min", "end_min")
    return marts.batch_product(t).select(
        "batch_id", "product_id", F.col("min_batch_time").alias("target_min"), actual.alias("actual_min"),
        (actual - F.col("min_batch_time")).alias("gap_min"))


@query("shift_duration_and_delay", "P18", f"""
SELECT shift, {BIG('SUM(duration_min)')} AS total_d_per_shift, AVG(delay) AS avg_delay_per_batch
FROM bp GROUP BY shift""")
def shift_duration_and_delay(t):
    return marts.batch_product(t).groupBy("shift").agg(
        F.sum("duration_min").alias("total_d_per_shift"), F.avg("delay").alias("avg_delay_per_batch"))


@query("size_impact", "P19", """
SELECT size, COUNT(*) AS total_batches, AVG(duration_min) AS avg_actual_time,
       AVG(min_batch_time) AS avg_target_time, AVG(delay) AS avg_efficiency_loss
FROM bp GROUP BY size""")
def size_impact(t):
    return marts.batch_product(t).groupBy("size").agg(
        F.count(F.lit(1)).alias("total_batches"), F.avg("duration_min").alias("avg_actual_time"),
        F.avg("min_batch_time").alias("avg_target_time"), F.avg("delay").alias("avg_efficiency_loss"))


def phase_delay(bp, part, order, n, first_label, rest_label, by=()):
    """Average delay of the first ``n`` batches of each group (in ``order``) versus the rest.

    No per-row flag is joined back: the first rows are taken with a group limit (at most n rows
    per group leave each task), their sums are subtracted from the per-``by`` totals, and the two
    averages follow from sums and counts (exactly what AVG over the rows gives).
    """
    by = list(by)
    tot = bp.groupBy(*by).agg(F.sum("delay").alias("_s"), F.count("delay").alias("_n"))
    firsts = top_per_group(bp.select(*dict.fromkeys([*part, *[o.lstrip("-") for o in order], *by, "delay"])),
                           part, order_by(order), n)
    head = firsts.groupBy(*by).agg(F.sum("delay").alias("_s1"), F.count("delay").alias("_n1"))
    j = tot.join(head, by, "left") if by else tot.crossJoin(head)
    s1, n1 = F.coalesce(F.col("_s1"), F.lit(0)), F.coalesce(F.col("_n1"), F.lit(0))
    rows = F.array(
        F.struct(F.lit(first_label).alias("shift_phase"), (s1.cast("double") / n1).alias("avg_delay"), n1.alias("_k")),
        F.struct(F.lit(rest_label).alias("shift_phase"),
                 ((F.col("_s") - s1).cast("double") / (F.col("_n") - n1)).alias("avg_delay"),
                 (F.col("_n") - n1).alias("_k")))
    # a phase with no rows has no group (as in a GROUP BY)
    return j.select(*by, F.inline(rows)).filter(F.col("_k") > 0).drop("_k")


@query("shift_phase_delay", "P20", """
WITH s AS (SELECT delay, ROW_NUMBER() OVER (PARTITION BY prod_date, shift, operator_name
                                            ORDER BY start_min, batch_id) AS rn FROM bp)
SELECT CASE WHEN rn <= 3 THEN 'Beginning of Shift' ELSE 'End of Shift' END AS shift_phase,
       AVG(delay) AS avg_delay
FROM s GROUP BY 1""")
def shift_phase_delay(t, n: int = 3):
    return phase_delay(marts.batch_product(t), ["prod_date", "shift", "operator_name"], ["start_min", "batch_id"],
                       n, "Beginning of Shift", "End of Shift")


@query("product_kpis", "P21", f"""
SELECT product_id,
       {R('AVG(min_batch_time * 100.0E0 / NULLIF(duration_min, 0))')} AS productivity_score_pct,
       AVG(delay) AS avg_delay_min,
       {PCT("SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS otdr_pct
FROM bp GROUP BY product_id""")
def product_kpis(t):
    return marts.batch_product(t).groupBy("product_id").agg(
        r(F.avg(F.col("min_batch_time") * F.lit(100.0) / F.nullif(F.col("duration_min"), F.lit(0))), 2)
        .alias("productivity_score_pct"),
        F.avg("delay").alias("avg_delay_min"),
        pct(count_if(is_on_time()), F.count(F.lit(1))).alias("otdr_pct"))


@query("throughput_litres_per_hour", "P22", f"""
SELECT product_id, size,
       {R('(SUM(CAST(ROUND(size_l * 10) AS BIGINT)) / 10.0E0) / NULLIF(SUM(duration_min) / 60.0E0, 0)')}
       AS litres_per_hour
FROM bp GROUP BY product_id, size""")
def throughput_litres_per_hour(t):
    # litres summed as exact tenths, so the total does not depend on summation order
    litres = F.sum(F.round(F.col("size_l") * 10).cast("long")) / F.lit(10.0)
    return marts.batch_product(t).groupBy("product_id", "size").agg(
        r(litres / F.nullif(F.sum("duration_min") / F.lit(60.0), F.lit(0.0)), 2).alias("litres_per_hour"))


@query("delay_only_by_product", "P23", """
SELECT product_id, COUNT(*) AS delayed_batches_count, AVG(delay) AS avg_delay_time_minutes
FROM bp WHERE status = 'DELAY' GROUP BY product_id""")
def delay_only_by_product(t):
    return stats(marts.batch_product(t), "product_id", "delay", where=F.col("status") == DELAY,
                 which=("rows", "avg")).select(
        "product_id", F.col("rows").alias("delayed_batches_count"), F.col("avg").alias("avg_delay_time_minutes"))


@query("otdr_by_product", "P24", f"""
SELECT product_id, COUNT(*) AS total_batches,
       {BIG("SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)")} AS on_time_batches_count,
       {PCT("SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS otdr_pct
FROM batches GROUP BY product_id""")
def otdr_by_product(t):
    return on_time_rate(t.b, "product_id", on_time="on_time_batches_count")


@query("shift_total_duration", "P25", f"""
SELECT shift, {BIG('SUM(duration_min)')} AS total_production_duration FROM batches GROUP BY shift""")
def shift_total_duration(t):
    return t.b.groupBy("shift").agg(F.sum("duration_min").alias("total_production_duration"))


@query("shift_avg_delay", "P26", "SELECT shift, AVG(delay) AS avg_delay_per_batch FROM bp GROUP BY shift")
def shift_avg_delay(t):
    return marts.batch_product(t).groupBy("shift").agg(F.avg("delay").alias("avg_delay_per_batch"))


@query("shift_on_time_pct", "P27", f"""
SELECT shift, {PCT("SUM(CASE WHEN status = 'ON TIME' THEN 1 ELSE 0 END)", 'COUNT(*)')} AS on_time_percentage
FROM batches GROUP BY shift""")
def shift_on_time_pct(t):
    return on_time_rate(t.b, "shift", on_time=None, rate="on_time_percentage").drop("total_batches")


@query("shift_batch_count", "P28", "SELECT shift, COUNT(*) AS total_batches FROM batches GROUP BY shift")
def shift_batch_count(t):
    return volume(t.b, "shift")


@query("shift_efficiency_loss", "P29", f"""
SELECT shift, {BIG('SUM(delay)')} AS total_efficiency_loss_min FROM bp GROUP BY shift""")
def shift_efficiency_loss(t):
    return marts.batch_product(t).groupBy("shift").agg(F.sum("delay").alias("total_efficiency_loss_min"))


@query("shift_daily_batches", "P30", """
SELECT shift, prod_date, COUNT(*) AS daily_batches FROM batches GROUP BY shift, prod_date""")
def shift_daily_batches(t):
    return volume(t.b, ["shift", "prod_date"], "daily_batches")


@query("operator_batch_count", "P31", """
SELECT operator_name, COUNT(*) AS total_batches FROM batches GROUP BY operator_name""")
def operator_batch_count(t):
    return volume(t.b, "operator_name")


@query("operator_avg_delay", "P32", """
SELECT operator_name, AVG(delay) AS avg_delay_per_batch FROM bp GROUP BY operator_name""")
def operator_avg_delay(t):
    return marts.batch_product(t).groupBy("operator_name").agg(F.avg("delay").alias("avg_delay_per_batch"))


@query("operator_delayed_count", "P33", """
SELECT operator_name, COUNT(*) AS delayed_batches_count FROM batches WHERE status = 'DELAY'
GROUP BY operator_name""")
def operator_delayed_count(t):
    return volume(t.b, "operator_name", "delayed_batches_count", where=F.col("status") == DELAY)


@query("operator_shift_phase_delay", "P34", """
WITH s AS (SELECT operator_name, delay,
                  ROW_NUMBER() OVER (PARTITION BY operator_name, shift ORDER BY start_min, prod_date, batch_id) AS rn
           FROM bp)
SELECT operator_name, CASE WHEN rn <= 3 THEN 'Early Shift' ELSE 'Late Shift' END AS shift_phase,
       AVG(delay) AS avg_delay
FROM s GROUP BY 1, 2""")
def operator_shift_phase_delay(t, n: int = 3):
    return phase_delay(marts.batch_product(t), ["operator_name", "shift"], ["start_min", "prod_date", "batch_id"],
                       n, "Early Shift", "Late Shift", by=["operator_name"])


@query("operator_delay_variation", "P35", f"""
SELECT operator_name, AVG(delay) AS avg_delay, {R('STDDEV_SAMP(delay)', 4)} AS delay_variation
FROM bp GROUP BY operator_name""")
def operator_delay_variation(t):
    return marts.batch_product(t).groupBy("operator_name").agg(
        F.avg("delay").alias("avg_delay"), r(F.stddev_samp("delay"), 4).alias("delay_variation"))


@query("product_batch_count", "P36", "SELECT product_id, COUNT(*) AS batch_count FROM batches GROUP BY product_id")
def product_batch_count(t):
    return volume(t.b, "product_id", "batch_count")


@query("distinct_products", "P37", "SELECT COUNT(DISTINCT product_id) AS total_products FROM products")
def distinct_products(t):
    return t.p.agg(F.count_distinct("product_id").alias("total_products"))


@query("distinct_flavors", "P38", "SELECT COUNT(DISTINCT flavor) AS total_flavors FROM products")
def distinct_flavors(t):
    return t.p.agg(F.count_distinct("flavor").alias("total_flavors"))


@query("distinct_operators", "P39", "SELECT COUNT(DISTINCT operator_name) AS total_operators FROM batches")
def distinct_operators(t):
    return t.b.agg(F.count_distinct("operator_name").alias("total_operators"))


@query("product_avg_time", "P40", """
SELECT product_id, AVG(duration_min) AS avg_production_time FROM batches GROUP BY product_id""")
def product_avg_time(t):
    return t.b.groupBy("product_id").agg(F.avg("duration_min").alias("avg_production_time"))


@query("product_avg_gap", "P41", "SELECT product_id, AVG(delay) AS avg_efficiency_gap FROM bp GROUP BY product_id")
def product_avg_gap(t):
    return marts.batch_product(t).groupBy("product_id").agg(F.avg("delay").alias("avg_efficiency_gap"))


@query("product_delayed_count", "P42", """
SELECT product_id, COUNT(*) AS delayed_batches_count FROM batches WHERE status = 'DELAY' GROUP BY product_id""")
def product_delayed_count(t):
    return volume(t.b, "product_id", "delayed_batches_count", where=F.col("status") == DELAY)


@query("product_productivity_score", "P43", f"""
SELECT product_id, {R('AVG(min_batch_time * 100.0E0 / NULLIF(duration_min, 0))')} AS productivity_score
FROM bp GROUP BY product_id""")
def product_productivity_score(t):
    return marts.batch_product(t).groupBy("product_id").agg(
        r(F.avg(F.col("min_batch_time") * F.lit(100.0) / F.nullif(F.col("duration_min"), F.lit(0))), 2)
        .alias("productivity_score"))

