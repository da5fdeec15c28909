"""Analysis-notebook questions (N keys).

Most of these run on the complete table ``cp`` (one row per batch x incident, batches without
incident once), i.e. they are incident-weighted exactly as the questions were answered; keys
marked (bat) work on one row per batch.  ``batch_status`` is the notebook's own label: Delay when
the run exceeds the target, otherwise On_time (a batch without product target counts On_time).
Repeats of keys already registered elsewhere are not registered twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linepulse.functions.expr import is_human, pct, r, shift_of
from linepulse.functions.scale import _null_safe_join, seq_cumsum, seq_lag, seq_number, with_total
from linepulse.operators import marts, stretches
from linepulse.operators.metrics import matrix, pareto, share, top_per_group
from linepulse.plans.registry import BIG, INT, PCT, R, query
from linepulse.sources.testmap import FACTORS, line_of

DELAY_LBL, ON_TIME_LBL = "Delay", "On_time"


def _label(df: DataFrame) -> DataFrame:
    return df.withColumn("batch_status", F.when(F.col("duration_min") > F.col("min_batch_time"), DELAY_LBL)
                         .otherwise(ON_TIME_LBL))


def cp(t) -> DataFrame:
    """Complete table with the notebook label and the time deviation."""
    return _label(marts.complete_table(t, ids=False)).withColumn("time_deviation", F.col("duration_min") - F.col("min_batch_time"))


def j01(t) -> DataFrame:
    """One row per batch with its product attributes (bat grain)."""
    return _label(marts.batch_with_product(t)).withColumn("time_deviation",
                                                          F.col("duration_min") - F.col("min_batch_time"))


def slug(text: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in text.strip().lower()).strip("_")


# --- Line productivity ----------------------------------------------------------------------

@query("daily_rows_inc", "N01", "SELECT prod_date, COUNT(batch_id) AS batch_rows FROM cp GROUP BY prod_date")
def daily_rows_inc(t):
    return cp(t).groupBy("prod_date").agg(F.count("batch_id").alias("batch_rows"))


@query("shift_rows_inc", "N02", "SELECT shift, COUNT(batch_id) AS batch_rows FROM cp GROUP BY shift")
def shift_rows_inc(t):
    return cp(t).groupBy("shift").agg(F.count("batch_id").alias("batch_rows"))


@query("product_mix_inc", "N03", f"""
SELECT product_id, {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS batch_percentage
FROM cp WHERE product_id IS NOT NULL GROUP BY product_id""")
def product_mix_inc(t):
    return share(cp(t).filter(F.col("product_id").isNotNull()), "product_id", name="_n",
                 pct_name="batch_percentage").drop("_n")


@query("product_batch_and_time_mix", "N04", f"""
WITH g AS (SELECT product_id, COUNT(*) AS n, COALESCE(SUM(downtime_min), 0) AS m
           FROM cp WHERE product_id IS NOT NULL GROUP BY product_id)
SELECT product_id, {PCT('n', 'SUM(n) OVER ()')} AS batch_percentage,
       {BIG('m')} AS downtime_minutes, {PCT('m', 'SUM(m) OVER ()')} AS time_percentage
FROM g""")
def product_batch_and_time_mix(t):
    g = cp(t).filter(F.col("product_id").isNotNull()).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("downtime_min"), F.lit(0)).alias("downtime_minutes"))
    # both totals in one aggregate over the same columns, so the grouped exchange is read twice, not made twice
    totals = g.agg(F.sum("_n").alias("_tn"), F.sum("downtime_minutes").alias("_tm"))
    g = g.crossJoin(F.broadcast(totals))
    return g.select("product_id", pct("_n", "_tn").alias("batch_percentage"), "downtime_minutes",
                    pct("downtime_minutes", "_tm").alias("time_percentage"))


@query("time_loss_total", "N05", f"""
SELECT {BIG('SUM(downtime_min)')} AS total_downtime_min, {BIG('SUM(min_batch_time)')} AS total_ideal_min,
       {BIG('SUM(downtime_min) - SUM(min_batch_time)')} AS time_loss_min FROM cp""")
def time_loss_total(t):
    g = cp(t).agg(F.sum("downtime_min").alias("total_downtime_min"), F.sum("min_batch_time").alias("total_ideal_min"))
    return g.withColumn("time_loss_min", F.col("total_downtime_min") - F.col("total_ideal_min"))


@query("downtime_utilization_pct", "N06", f"""
SELECT {R('CAST(SUM(downtime_min) AS DOUBLE) / (1440 * COUNT(DISTINCT prod_date)) * 100.0E0')} AS utilization_pct
FROM cp""")
def downtime_utilization_pct(t):
    c = cp(t)
    days = t.b.agg(F.count_distinct("prod_date").alias("_days"))
    down = c.agg(F.sum("downtime_min").alias("_m"))
    return down.crossJoin(days).select(
        r(F.col("_m").cast("double") / (F.lit(1440) * F.col("_days")) * F.lit(100.0)).alias("utilization_pct"))


@query("longest_shortest_incident", "N07", """
SELECT * FROM (SELECT 'longest' AS kind, batch_id, downtime_id, downtime_min, description FROM cp
               WHERE downtime_min IS NOT NULL ORDER BY downtime_min DESC, downtime_id LIMIT 1) a
UNION ALL
SELECT * FROM (SELECT 'shortest' AS kind, batch_id, downtime_id, downtime_min, description FROM cp
               WHERE downtime_min IS NOT NULL ORDER BY downtime_min ASC, downtime_id LIMIT 1) z""")
def longest_shortest_incident(t):
    d = marts.batch_incident_factor(t).select("batch_id", "downtime_id", "downtime_min", "description")
    d = d.filter(F.col("downtime_min").isNotNull())
    hi = d.orderBy(F.col("downtime_min").desc(), "downtime_id").limit(1).withColumn("kind", F.lit("longest"))
    lo = d.orderBy(F.col("downtime_min").asc(), "downtime_id").limit(1).withColumn("kind", F.lit("shortest"))
    return hi.unionByName(lo).select("kind", "batch_id", "downtime_id", "downtime_min", "description")


@query("changeovers_running", "N08", """
WITH s AS (SELECT prod_date, product_id, LAG(product_id) OVER (ORDER BY prod_date, start_min, batch_id) AS prev
           FROM batches)
SELECT prod_date, COUNT(*) FILTER (WHERE prev IS NULL OR product_id <> prev) AS product_changes
FROM s GROUP BY prod_date""")
def changeovers_running(t):
    line = line_of(t.b)
    s = seq_lag(t.b.select(*line, "batch_id", "prod_date", "start_min", "product_id"), line,
                ["prod_date", "start_min", "batch_id"], ["prod_date", "start_min"], ["product_id"], ["prev"])
    changed = F.col("prev").isNull() | (F.col("product_id") != F.col("prev"))
    return s.groupBy(*line, "prod_date").agg(F.count(F.when(changed, F.lit(1))).alias("product_changes"))


@query("idle_time_rows", "N09", """
WITH s AS (SELECT batch_id, prod_date, start_min,
                  LAG(prod_date) OVER w AS pd, LAG(start_min + duration_min) OVER w AS pe
           FROM batches WINDOW w AS (ORDER BY prod_date, start_min, batch_id))
SELECT batch_id, prod_date, start_min,
       CAST(COALESCE((prod_date - pd) * 1440 + start_min - pe, 0) AS BIGINT) AS idle_time
FROM s""")
def idle_time_rows(t):
    line = line_of(t.b)
    b = t.b.select(*line, "batch_id", "prod_date", "start_min", (F.col("start_min") + F.col("duration_min")).alias("end_at"))
    s = seq_lag(b, line, ["prod_date", "start_min", "batch_id"], ["prod_date", "start_min"],
                ["prod_date", "end_at"], ["pd", "pe"])
    gap = F.datediff("prod_date", "pd") * 1440 + F.col("start_min") - F.col("pe")
    return s.select(*line, "batch_id", "prod_date", "start_min", F.coalesce(gap, F.lit(0)).cast("long").alias("idle_time"))


@query("product_distinct_batches", "N10", """
SELECT product_id, COUNT(DISTINCT batch_id) AS total_batches FROM cp GROUP BY product_id""")
def product_distinct_batches(t):
    # cp holds every batch at least once, so distinct batches per product = batches per product
    return t.b.groupBy("product_id").agg(F.count(F.lit(1)).alias("total_batches"))


@query("product_avg_time_inc", "N11", f"""
SELECT product_id, {R('AVG(duration_min)')} AS average_actual_duration FROM cp GROUP BY product_id""")
def product_avg_time_inc(t):
    return cp(t).groupBy("product_id").agg(r(F.avg("duration_min")).alias("average_actual_duration"))


@query("status_ratio", "N12", f"""
SELECT batch_status, COUNT(*) AS batch_count, {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS percentage
FROM j01 GROUP BY batch_status""")
def status_ratio(t):
    return share(j01(t), "batch_status", name="batch_count", pct_name="percentage")


@query("daily_volume_and_peak", "N13", """
SELECT prod_date, COUNT(DISTINCT batch_id) AS batch_count FROM cp GROUP BY prod_date""")
def daily_volume_and_peak(t):
    return t.b.groupBy("prod_date").agg(F.count(F.lit(1)).alias("batch_count"))


@query("batch_deviation", "N14", f"""
SELECT {R('AVG(duration_min - min_batch_time)', 4)} AS avg_time_deviation FROM cp""")
def batch_deviation(t):
    return cp(t).agg(r(F.avg("time_deviation"), 4).alias("avg_time_deviation"))


def delay_rate(t, by: str) -> DataFrame:
    """Mean deviation over cp rows (inc) and Delay share of distinct batches (bat) per group."""
    inc = cp(t).groupBy(by).agg(r(F.avg("time_deviation")).alias("average_delay_minutes"))
    bat = j01(t).groupBy(by).agg(
        pct(F.count(F.when(F.col("batch_status") == DELAY_LBL, F.lit(1))), F.count(F.lit(1))).alias("delay_percentage"))
    return _null_safe_join(inc, bat, [by])


DELAY_RATE_SQL = """
WITH inc AS (SELECT {by}, AVG(duration_min - min_batch_time) AS a FROM cp GROUP BY {by}),
     bat AS (SELECT {by}, COUNT(*) FILTER (WHERE batch_status = 'Delay') AS d, COUNT(*) AS n FROM j01 GROUP BY {by})
SELECT inc.{by}, {avg} AS average_delay_minutes, {pct} AS delay_percentage
FROM inc JOIN bat ON inc.{by} IS NOT DISTINCT FROM bat.{by}"""


@query("shift_delay_rate", "N15", DELAY_RATE_SQL.format(by="shift", avg=R("inc.a"), pct=PCT("bat.d", "bat.n")))
def shift_delay_rate(t):
    return delay_rate(t, "shift")


@query("size_delay_rate", "N16", DELAY_RATE_SQL.format(by="size", avg=R("inc.a"), pct=PCT("bat.d", "bat.n")))
def size_delay_rate(t):
    return delay_rate(t, "size")


@query("sequence_impact", "N17", f"""
WITH u AS (SELECT duration_min - min_batch_time AS dev,
                  ROW_NUMBER() OVER (PARTITION BY prod_date, operator_name ORDER BY start_min, batch_id) AS seq
           FROM j01)
SELECT {INT('seq')} AS batch_order, {R('AVG(dev)')} AS avg_delay FROM u GROUP BY seq""")
def sequence_impact(t):
    j = j01(t)
    line = line_of(j)
    s = seq_number(j, [*line, "prod_date", "operator_name"], ["start_min", "batch_id"], ["start_min"], "batch_order")
    return s.groupBy(*line, "batch_order").agg(r(F.avg("time_deviation")).alias("avg_delay"))


@query("line_and_operator_efficiency", "N18", f"""
SELECT 'line' AS level, CAST(NULL AS VARCHAR) AS operator_name, {BIG('SUM(min_batch_time)')} AS total_min_time,
       {BIG('SUM(duration_min)')} AS total_actual, {PCT('SUM(min_batch_time)', 'SUM(duration_min)')} AS efficiency_pct
FROM j01
UNION ALL
SELECT 'operator', operator_name, {BIG('SUM(min_batch_time)')}, {BIG('SUM(duration_min)')},
       {PCT('SUM(min_batch_time)', 'SUM(duration_min)')}
FROM j01 GROUP BY operator_name""")
def line_and_operator_efficiency(t):
    u = j01(t)
    aggs = [F.sum("min_batch_time").alias("total_min_time"), F.sum("duration_min").alias("total_actual")]
    line = u.agg(*aggs).select(F.lit("line").alias("level"), F.lit(None).cast("string").alias("operator_name"), "*")
    ops = u.groupBy("operator_name").agg(*aggs).select(F.lit("operator").alias("level"), "*")
    return line.unionByName(ops).withColumn("efficiency_pct", pct("total_min_time", "total_actual"))


@query("avg_delay_overall_product_operator", "N19", f"""
SELECT 'overall' AS level, CAST(NULL AS VARCHAR) AS group_key, {R('AVG(duration_min - min_batch_time)')} AS avg_delay
FROM j01
UNION ALL SELECT 'product', CAST(product_id AS VARCHAR), {R('AVG(duration_min - min_batch_time)')}
FROM j01 GROUP BY product_id
UNION ALL SELECT 'operator', operator_name, {R('AVG(duration_min - min_batch_time)')}
FROM j01 GROUP BY operator_name""")
def avg_delay_overall_product_operator(t):
    u = j01(t)
    a = r(F.avg("time_deviation")).alias("avg_delay")
    overall = u.agg(a).select(F.lit("overall").alias("level"), F.lit(None).cast("string").alias("group_key"), "avg_delay")
    prod = u.groupBy(F.col("product_id").cast("string").alias("group_key")).agg(a).select(
        F.lit("product").alias("level"), "group_key", "avg_delay")
    oper = u.groupBy(F.col("operator_name").alias("group_key")).agg(a).select(
        F.lit("operator").alias("level"), "group_key", "avg_delay")
    return overall.unionByName(prod).unionByName(oper)


@query("line_otdr", "N20", f"""
SELECT COUNT(*) AS total_batches, COUNT(*) FILTER (WHERE batch_status = 'On_time') AS on_time_batches,
       {PCT("COUNT(*) FILTER (WHERE batch_status = 'On_time')", 'COUNT(*)')} AS on_time_pct
FROM j01""")
def line_otdr(t):
    ot = F.count(F.when(F.col("batch_status") == ON_TIME_LBL, F.lit(1)))
    return j01(t).agg(F.count(F.lit(1)).alias("total_batches"), ot.alias("on_time_batches"),
                      pct(ot, F.count(F.lit(1))).alias("on_time_pct"))


@query("production_rates", "N21", f"""
SELECT product_id, {R('AVG(60.0E0 / NULLIF(duration_min, 0))')} AS units_per_hour,
       {R('AVG(size_l * (60.0E0 / NULLIF(duration_min, 0)))')} AS litres_per_hour
FROM j01 GROUP BY product_id""")
def production_rates(t):
    uph = F.lit(60.0) / F.nullif(F.col("duration_min"), F.lit(0))
    return j01(t).groupBy("product_id").agg(r(F.avg(uph)).alias("units_per_hour"),
                                            r(F.avg(F.col("size_l") * uph)).alias("litres_per_hour"))


@query("delay_only_overall", "N23", f"""
SELECT {R('AVG(duration_min - min_batch_time)')} AS avg_delay_minutes FROM j01 WHERE batch_status = 'Delay'""")
def delay_only_overall(t):
    return j01(t).filter(F.col("batch_status") == DELAY_LBL).agg(r(F.avg("time_deviation")).alias("avg_delay_minutes"))


# --- Downtime -------------------------------------------------------------------------------

@query("factor_frequency_pct", "N24", f"""
SELECT description, COUNT(*) AS occurrence_count, {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS frequency_pct
FROM cp WHERE description IS NOT NULL GROUP BY description""")
def factor_frequency_pct(t):
    return share(cp(t).filter(F.col("description").isNotNull()), "description", name="occurrence_count",
                 pct_name="frequency_pct")


@query("factor_duration_ranking", "N25", f"""
SELECT description, {BIG('SUM(downtime_min)')} AS duration_minutes FROM cp WHERE description IS NOT NULL
GROUP BY description""")
def factor_duration_ranking(t):
    return cp(t).filter(F.col("description").isNotNull()).groupBy("description").agg(
        F.sum("downtime_min").alias("duration_minutes"))


@query("shift_downtime_share", "N26", f"""
WITH g AS (SELECT shift, COALESCE(SUM(downtime_min), 0) AS m FROM cp GROUP BY shift)
SELECT shift, {BIG('m')} AS duration_minutes, {PCT('m', 'SUM(m) OVER ()')} AS share_pct FROM g""")
def shift_downtime_share(t):
    g = cp(t).groupBy("shift").agg(F.coalesce(F.sum("downtime_min"), F.lit(0)).alias("duration_minutes"))
    return with_total(g, "duration_minutes", "_t").withColumn("share_pct", pct("duration_minutes", "_t")).drop("_t")


@query("daily_downtime_avg", "N27", f"""
WITH g AS (SELECT prod_date, COALESCE(SUM(downtime_min), 0) AS m FROM cp GROUP BY prod_date)
SELECT prod_date, {BIG('m')} AS duration_minutes, {R('AVG(m) OVER ()')} AS avg_daily_downtime FROM g""")
def daily_downtime_avg(t):
    g = cp(t).groupBy("prod_date").agg(F.coalesce(F.sum("downtime_min"), F.lit(0)).alias("duration_minutes"))
    avg = g.agg(r(F.avg("duration_minutes")).alias("avg_daily_downtime"))
    return g.crossJoin(F.broadcast(avg))


@query("failure_distribution", "N28", f"""
WITH s AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE operator_error = 'Yes') AS oe,
                  COUNT(*) FILTER (WHERE description = 'Machine failure') AS mf FROM cp)
SELECT 'Operator Error' AS failure_category, oe AS count, {PCT('oe', 'n')} AS percentage FROM s
UNION ALL SELECT 'Machine Failure', mf, {PCT('mf', 'n')} FROM s
UNION ALL SELECT 'Other Factors', n - oe - mf, {PCT('n - oe - mf', 'n')} FROM s""")
def failure_distribution(t):
    s = cp(t).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_human(), 1)).alias("oe"),
                  F.count(F.when(F.col("description") == "Machine failure", 1)).alias("mf"))
    rows = F.array(
        F.struct(F.lit("Operator Error").alias("failure_category"), F.col("oe").alias("count")),
        F.struct(F.lit("Machine Failure").alias("failure_category"), F.col("mf").alias("count")),
        F.struct(F.lit("Other Factors").alias("failure_category"),
                 (F.col("n") - F.col("oe") - F.col("mf")).alias("count")))
    return s.select("n", F.inline(rows)).select("failure_category", "count", pct("count", "n").alias("percentage"))


@query("pareto_85", "N29", f"""
WITH g AS (SELECT description, SUM(downtime_min) AS m FROM cp WHERE description IS NOT NULL GROUP BY description),
     c AS (SELECT description, m, SUM(m) OVER (ORDER BY m DESC, description ROWS BETWEEN UNBOUNDED PRECEDING
                                               AND CURRENT ROW) AS cm, SUM(m) OVER () AS tm FROM g)
SELECT description, {BIG('m')} AS duration_minutes, {PCT('cm', 'tm')} AS cum_percentage FROM c
WHERE cm * 100.0E0 / tm <= 85""")
def pareto_85(t, threshold: float = 85.0):
    d = cp(t).filter(F.col("description").isNotNull())
    return pareto(d, "description", "downtime_min", "upto_le", threshold, "duration_minutes", "cum_percentage")


def _count_matrix(df, rows, col, values, total_name, distinct=None, labels=None, other=None):
    """Counts (of ``distinct`` values) per group and listed value, and their total.

    ``other`` names a column for rows with a value beyond the list; the total holds them too.
    """
    names = labels or [slug(str(v)) for v in values]
    count = F.count_distinct if distinct else F.count
    what = F.col(distinct) if distinct else F.lit(1)
    cells = [count(F.when(F.col(col) == v, what)).alias(n) for v, n in zip(values, names)]
    if other:
        cells.append(count(F.when(~F.coalesce(F.col(col).isin(*values), F.lit(False)), what)).alias(other))
        names = [*names, other]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return df.groupBy(rows).agg(*cells).withColumn(total_name, total)


def _descriptions(t, listed, condition):
    """The listed descriptions, then those of the factor table beyond them (a small dimension: the columns of a sheet)."""
    more = t.f.where(condition).where(~F.col("description").isin(*listed)).select("description").distinct().limit(1001).collect()
    if len(more) > 1000:
        raise ValueError("more than 1000 factor descriptions do not fit a matrix")
    return [*listed, *sorted(r[0] for r in more)]


def _matrix_sql(rows, col, values, total_name, src, where, labels=None, distinct=None, match=None, other=None):
    """The SQL form of ``_count_matrix``: one conditional count per fixed value, plus their total."""
    names = labels or [slug(str(v)) for v in values]
    match = match or (lambda v: f"{col} = '{v}'")
    if distinct:
        cells = [f"COUNT(DISTINCT CASE WHEN {match(v)} THEN {distinct} END) AS {n}" for v, n in zip(values, names)]
    else:
        cells = [f"COUNT(*) FILTER (WHERE {match(v)}) AS {n}" for v, n in zip(values, names)]
    if other:
        cells.append(f"COUNT(*) FILTER (WHERE NOT coalesce({col} IN ({', '.join(repr(v) for v in values)}), false)) AS {other}")
        names = [*names, other]
    total = " + ".join(names)
    return (f"SELECT {rows}, {', '.join(n for n in names)}, {total} AS {total_name} FROM "
            f"(SELECT {rows}, {', '.join(cells)} FROM {src} WHERE {where} GROUP BY {rows}) m")


N30_VALUES = [d for fid, d, _ in FACTORS if fid in (2, 3)]


@query("product_factor_matrix", "N30", _matrix_sql("product_id", "description", N30_VALUES, "total_issues", "cp",
                                                   "factor_id IN (2, 3)", other="other_issues"))
def product_factor_matrix(t, factor_ids=(2, 3)):
    values = _descriptions(t, [d for fid, d, _ in FACTORS if fid in factor_ids], F.col("factor_id").isin(*factor_ids))
    d = cp(t).filter(F.col("factor_id").isin(*factor_ids))
    return _count_matrix(d, "product_id", "description", values, "total_issues", other="other_issues")


HE_VALUES = [d for _, d, e in FACTORS if e == "Yes"]


@query("operator_error_matrix", "N31", _matrix_sql("operator_name", "description", HE_VALUES, "total_errors", "cp",
                                                   "operator_error = 'Yes'", other="other_errors"))
def operator_error_matrix(t):
    values = _descriptions(t, HE_VALUES, is_human())
    return _count_matrix(cp(t).filter(is_human()), "operator_name", "description", values, "total_errors", other="other_errors")


@query("morning_vs_night", "N32", f"""
WITH g AS (SELECT shift, COALESCE(SUM(downtime_min), 0) AS s, AVG(downtime_min) AS a, COUNT(downtime_min) AS c
           FROM cp WHERE shift IN ('Morning', 'Night') GROUP BY shift),
     d AS (SELECT MAX(CASE WHEN shift = 'Night' THEN a END) - MAX(CASE WHEN shift = 'Morning' THEN a END) AS diff FROM g)
SELECT shift, {BIG('s')} AS total_downtime_mins, {R('a')} AS avg_downtime_per_incident, c AS incident_count,
       {R('d.diff')} AS night_minus_morning_avg
FROM g, d""")
def morning_vs_night(t):
    g = cp(t).filter(F.col("shift").isin("Morning", "Night")).groupBy("shift").agg(
        F.coalesce(F.sum("downtime_min"), F.lit(0)).alias("total_downtime_mins"), F.avg("downtime_min").alias("_a"),
        F.count("downtime_min").alias("incident_count"))
    both = Window.partitionBy(F.lit(1))      # over the two rows of the grouped frame
    d = F.max(F.when(F.col("shift") == "Night", F.col("_a"))).over(both) - F.max(F.when(F.col("shift") == "Morning", F.col("_a"))).over(both)
    return g.withColumn("_d", d).select(
        "shift", "total_downtime_mins", r("_a").alias("avg_downtime_per_incident"), "incident_count",
        r("_d").alias("night_minus_morning_avg"))


@query("batch_change_minutes", "N33", f"""
SELECT {BIG('COALESCE(SUM(downtime_min), 0)')} AS total_batch_change_minutes FROM cp WHERE factor_id = 2""")
def batch_change_minutes(t, factor_id: int = 2):
    return cp(t).filter(F.col("factor_id") == factor_id).agg(
        F.coalesce(F.sum("downtime_min"), F.lit(0)).cast("long").alias("total_batch_change_minutes"))


@query("setup_consistency_by_shift", "N34", f"""
WITH g AS (SELECT shift, COUNT(downtime_min) AS c, AVG(downtime_min) AS a, STDDEV_SAMP(downtime_min) AS s
           FROM cp WHERE factor_id = 2 GROUP BY shift)
SELECT shift, c AS changeover_count, {R('a')} AS average_minutes, {R('s', 4)} AS standard_deviation,
       {R('MAX(a) OVER () - MIN(a) OVER ()')} AS spread_minutes FROM g""")
def setup_consistency_by_shift(t):
    g = cp(t).filter(F.col("factor_id") == 2).groupBy("shift").agg(
        F.count("downtime_min").alias("changeover_count"), F.avg("downtime_min").alias("_a"),
        F.stddev_samp("downtime_min").alias("_s"))
    shifts = Window.partitionBy(F.lit(1))    # over the grouped frame, one row per shift
    return g.withColumn("_spread", F.max("_a").over(shifts) - F.min("_a").over(shifts)).select(
        "shift", "changeover_count", r("_a").alias("average_minutes"), r("_s", 4).alias("standard_deviation"),
        r("_spread").alias("spread_minutes"))


@query("factor_delay_probability", "N35", f"""
SELECT description, COUNT(*) FILTER (WHERE batch_status = 'Delay') AS delay,
       COUNT(*) FILTER (WHERE batch_status = 'On_time') AS on_time, COUNT(*) AS total_occurrences,
       {PCT("COUNT(*) FILTER (WHERE batch_status = 'Delay')", 'COUNT(*)')} AS delay_probability_pct
FROM cp WHERE description IS NOT NULL GROUP BY description""")
def factor_delay_probability(t):
    d = F.count(F.when(F.col("batch_status") == DELAY_LBL, 1))
    return cp(t).filter(F.col("description").isNotNull()).groupBy("description").agg(
        d.alias("delay"), F.count(F.when(F.col("batch_status") == ON_TIME_LBL, 1)).alias("on_time"),
        F.count(F.lit(1)).alias("total_occurrences"), pct(d, F.count(F.lit(1))).alias("delay_probability_pct"))


N36_VALUES = ["Labeling error", "Calibration error", "Machine adjustment"]


@query("product_fault_matrix", "N36", _matrix_sql(
    "product_id", "description", N36_VALUES, "total_specific_errors", "cp",
    "lower(description) IN ('labeling error', 'calibration error', 'machine adjustment')",
    match=lambda v: f"lower(description) = '{v.lower()}'"))
def product_fault_matrix(t):
    """Faults named case-insensitively (the question spells one of them with a capital E)."""
    d = cp(t).withColumn("_d", F.lower("description")).filter(F.col("_d").isin(*[v.lower() for v in N36_VALUES]))
    return _count_matrix(d, "product_id", "_d", [v.lower() for v in N36_VALUES], "total_specific_errors",
                         labels=[slug(v) for v in N36_VALUES])


@query("shift_machine_failure_rate", "N37", f"""
WITH f AS (SELECT shift, COUNT(*) AS incident_count FROM cp WHERE description = 'Machine failure' GROUP BY shift),
     b AS (SELECT shift, COUNT(*) AS total_batches FROM batches GROUP BY shift)
SELECT f.shift, f.incident_count, b.total_batches, {PCT('f.incident_count', 'b.total_batches')} AS failure_rate_pct
FROM f JOIN b ON f.shift = b.shift""")
def shift_machine_failure_rate(t):
    f = cp(t).filter(F.col("description") == "Machine failure").groupBy("shift").agg(
        F.count(F.lit(1)).alias("incident_count"))
    b = t.b.groupBy("shift").agg(F.count(F.lit(1)).alias("total_batches"))
    return f.join(b, "shift").withColumn("failure_rate_pct", pct("incident_count", "total_batches"))


@query("factor_avg_resolution", "N38", f"""
WITH g AS (SELECT description, AVG(downtime_min) AS a FROM cp WHERE description IS NOT NULL GROUP BY description)
SELECT description, {R('a')} AS avg_resolution_time, {R('(SELECT AVG(downtime_min) FROM cp)')} AS overall_avg FROM g""")
def factor_avg_resolution(t):
    g = cp(t).groupBy("description").agg(F.sum("downtime_min").cast("double").alias("_s"), F.count("downtime_min").alias("_c"))
    overall = g.agg((F.sum("_s") / F.nullif(F.sum("_c"), F.lit(0))).alias("_o"))
    return g.crossJoin(F.broadcast(overall)).filter(F.col("description").isNotNull()).select(
        "description", r(F.col("_s") / F.nullif(F.col("_c"), F.lit(0))).alias("avg_resolution_time"), r("_o").alias("overall_avg"))


@query("uptime_ratio", "N40", f"""
WITH d AS (SELECT SUM(downtime_min) AS m FROM cp), r AS (SELECT SUM(duration_min) AS s FROM batches)
SELECT {PCT('d.m', 'r.s')} AS downtime_ratio_pct,
       {R('100.0E0 - CAST(d.m AS DOUBLE) * 100.0E0 / NULLIF(r.s, 0)')} AS uptime_ratio_pct FROM d, r""")
def uptime_ratio(t):
    d = cp(t).agg(F.sum("downtime_min").alias("_m"))
    run = t.b.agg(F.sum("duration_min").alias("_s"))
    ratio_ = F.col("_m").cast("double") * F.lit(100.0) / F.nullif(F.col("_s"), F.lit(0))
    return d.crossJoin(run).select(pct("_m", "_s").alias("downtime_ratio_pct"),
                                   r(F.lit(100.0) - ratio_).alias("uptime_ratio_pct"))


@query("lost_batches_overall", "N41", f"""
SELECT {R('CAST(SUM(downtime_min) AS DOUBLE) / NULLIF(AVG(min_batch_time), 0)')} AS lost_batches FROM cp""")
def lost_batches_overall(t):
    return cp(t).agg(r(F.sum("downtime_min").cast("double") / F.nullif(F.avg("min_batch_time"), F.lit(0.0)))
                     .alias("lost_batches"))


@query("mtbf_unplanned", "N42", f"""
WITH r AS (SELECT SUM(duration_min) AS s FROM batches),
     d AS (SELECT SUM(downtime_min) AS m,
                  COUNT(*) FILTER (WHERE factor_id IS NOT NULL AND factor_id <> 2) AS n FROM cp)
SELECT {BIG('r.s - d.m')} AS total_operating_time, d.n AS failure_count,
       {R('CASE WHEN d.n > 0 THEN CAST(r.s - d.m AS DOUBLE) / d.n ELSE CAST(r.s - d.m AS DOUBLE) END')} AS mtbf
FROM r, d""")
def mtbf_unplanned(t, planned_factor: int = 2):
    """Operating time between unplanned stops: changeovers (factor 2) are planned and not failures;
    batches without incident are not failures either."""
    run = t.b.agg(F.sum("duration_min").alias("_s"))
    real = F.col("factor_id").isNotNull() & (F.col("factor_id") != planned_factor)
    d = cp(t).agg(F.sum("downtime_min").alias("_m"), F.count(F.when(real, 1)).alias("failure_count"))
    op = F.col("_s") - F.col("_m")
    return run.crossJoin(d).select(
        op.alias("total_operating_time"), "failure_count",
        r(F.when(F.col("failure_count") > 0, op.cast("double") / F.col("failure_count"))
          .otherwise(op.cast("double"))).alias("mtbf"))


@query("mtbf_unplanned_as_run", "N42", f"""
WITH r AS (SELECT SUM(duration_min) AS s FROM batches),
     d AS (SELECT SUM(downtime_min) AS m, COUNT(*) FILTER (WHERE factor_id IS DISTINCT FROM 2) AS n FROM cp)
SELECT {BIG('r.s - d.m')} AS total_operating_time, d.n AS failure_count,
       {R('CASE WHEN d.n > 0 THEN CAST(r.s - d.m AS DOUBLE) / d.n ELSE CAST(r.s - d.m AS DOUBLE) END')} AS mtbf
FROM r, d""")
def mtbf_unplanned_as_run(t, planned_factor: int = 2):
    """N42 with every row of another factor than the planned one as a failure, also the rows of batches without incident."""
    run = t.b.agg(F.sum("duration_min").alias("_s"))
    other = ~F.col("factor_id").eqNullSafe(F.lit(planned_factor))
    d = cp(t).agg(F.sum("downtime_min").alias("_m"), F.count(F.when(other, 1)).alias("failure_count"))
    op = F.col("_s") - F.col("_m")
    return run.crossJoin(d).select(
        op.alias("total_operating_time"), "failure_count",
        r(F.when(F.col("failure_count") > 0, op.cast("double") / F.col("failure_count")).otherwise(op.cast("double"))).alias("mtbf"))


@query("hidden_loss_counts", "N44", """
SELECT COUNT(DISTINCT batch_id) AS delayed_batches,
       COUNT(DISTINCT CASE WHEN description IS NULL OR description = 'fill missing value' THEN batch_id END) AS delayed_without_reason
FROM cp WHERE batch_status = 'Delay'""")
def hidden_loss_counts(t):
    no_reason = F.col("description").isNull() | (F.col("description") == "fill missing value")
    per = cp(t).filter(F.col("batch_status") == DELAY_LBL).groupBy("batch_id").agg(F.max(no_reason).alias("_hidden"))
    return per.agg(F.count("batch_id").alias("delayed_batches"), F.count(F.when(F.col("_hidden"), F.col("batch_id"))).alias("delayed_without_reason"))


@query("hidden_loss_batches", "N44", """
SELECT DISTINCT batch_id FROM cp
WHERE batch_status = 'Delay' AND (description IS NULL OR description = 'fill missing value')""")
def hidden_loss_batches(t):
    no_reason = F.col("description").isNull() | (F.col("description") == "fill missing value")
    return cp(t).filter((F.col("batch_status") == DELAY_LBL) & no_reason).select("batch_id").distinct()


# --- Operators ------------------------------------------------------------------------------

@query("fastest_operator_per_product", "N47", f"""
WITH g AS (SELECT product_id, operator_name, AVG(duration_min) AS a FROM cp GROUP BY product_id, operator_name),
     k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY a, operator_name) AS rn FROM g)
SELECT product_id, operator_name, {R('a')} AS avg_duration FROM k WHERE rn = 1""")
def fastest_operator_per_product(t):
    g = cp(t).groupBy("product_id", "operator_name").agg(F.avg("duration_min").alias("_a"))
    best = top_per_group(g, "product_id", [F.col("_a").asc(), F.col("operator_name").asc()], 1)
    return best.select("product_id", "operator_name", r("_a").alias("avg_duration"))


@query("operator_closest_to_target", "N49", f"""
SELECT operator_name, {R('AVG(duration_min - min_batch_time)')} AS avg_time_deviation FROM cp GROUP BY operator_name""")
def operator_closest_to_target(t):
    return cp(t).groupBy("operator_name").agg(r(F.avg("time_deviation")).alias("avg_time_deviation"))


@query("operator_error_counts", "N50", """
SELECT operator_name, COUNT(*) AS operator_errors FROM cp WHERE operator_error = 'Yes' AND operator_name IS NOT NULL
GROUP BY operator_name""")
def operator_error_counts(t):
    return cp(t).filter(is_human() & F.col("operator_name").isNotNull()).groupBy("operator_name").agg(
        F.count(F.lit(1)).alias("operator_errors"))


@query("operator_most_common_error", "N51", """
WITH g AS (SELECT operator_name, description, COUNT(*) AS n FROM cp WHERE operator_error = 'Yes'
           GROUP BY operator_name, description),
     k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY operator_name ORDER BY n DESC, description) AS rn FROM g)
SELECT operator_name, description AS most_common_error, n AS number_of_occurrences FROM k WHERE rn = 1""")
def operator_most_common_error(t):
    g = cp(t).filter(is_human()).groupBy("operator_name", "description").agg(F.count(F.lit(1)).alias("n"))
    best = top_per_group(g, "operator_name", [F.col("n").desc(), F.col("description").asc()], 1)
    return best.select("operator_name", F.col("description").alias("most_common_error"),
                       F.col("n").alias("number_of_occurrences"))


@query("operator_machine_failure_repair", "N53", f"""
SELECT operator_name, {R('AVG(downtime_min)')} AS average_repair_time FROM cp WHERE description = 'Machine failure'
GROUP BY operator_name""")
def operator_machine_failure_repair(t):
    return cp(t).filter(F.col("description") == "Machine failure").groupBy("operator_name").agg(
        r(F.avg("downtime_min")).alias("average_repair_time"))


SIZES = ["600 ml", "2 L"]


@query("operator_size_deviation", "N54", f"""
SELECT operator_name,
       {R("COALESCE(AVG(CASE WHEN size = '600 ml' THEN duration_min - min_batch_time END), 0)")} AS dev_600_ml,
       {R("COALESCE(AVG(CASE WHEN size = '2 L' THEN duration_min - min_batch_time END), 0)")} AS dev_2_l
FROM cp WHERE size IS NOT NULL GROUP BY operator_name""")
def operator_size_deviation(t):
    m = matrix(cp(t).filter(F.col("size").isNotNull()), "operator_name", "size", SIZES, F.avg("time_deviation"), fill=0)
    return m.select("operator_name", *[r(F.col(s)).alias("dev_" + slug(s)) for s in SIZES])


@query("operator_shift_deviation", "N55", f"""
WITH inc AS (SELECT operator_name, shift, AVG(duration_min - min_batch_time) AS a FROM cp GROUP BY operator_name, shift),
     bat AS (SELECT operator_name, shift, COUNT(*) AS n, COUNT(*) FILTER (WHERE batch_status = 'Delay') AS d
             FROM j01 GROUP BY operator_name, shift)
SELECT bat.operator_name, bat.shift, bat.n AS total_batches, {PCT('bat.d', 'bat.n')} AS delay_percentage,
       {R('inc.a')} AS avg_deviation
FROM bat JOIN inc ON bat.operator_name IS NOT DISTINCT FROM inc.operator_name AND bat.shift = inc.shift""")
def operator_shift_deviation(t):
    inc = cp(t).groupBy("operator_name", "shift").agg(r(F.avg("time_deviation")).alias("avg_deviation"))
    bat = j01(t).groupBy("operator_name", "shift").agg(
        F.count(F.lit(1)).alias("total_batches"),
        pct(F.count(F.when(F.col("batch_status") == DELAY_LBL, 1)), F.count(F.lit(1))).alias("delay_percentage"))
    return _null_safe_join(bat, inc, ["operator_name", "shift"])


@query("error_free_comparison", "N57", f"""
WITH e AS (SELECT DISTINCT batch_id FROM cp WHERE operator_error = 'Yes'),
     f AS (SELECT COUNT(*) AS n, AVG(duration_min) AS a FROM batches WHERE batch_id NOT IN (SELECT batch_id FROM e)),
     al AS (SELECT AVG(duration_min) AS a FROM batches)
SELECT f.n AS error_free_batches, {R('f.a')} AS avg_time_no_errors, {R('al.a')} AS avg_time_all,
       {R('al.a - f.a')} AS time_saved FROM f, al""")
def error_free_comparison(t):
    free = F.col("human_error_count") == 0
    one = marts.batches_with_totals(t).agg(F.count(F.when(free, 1)).alias("error_free_batches"), F.avg(F.when(free, F.col("duration_min"))).alias("_f"),
                                           F.avg("duration_min").alias("_a"))
    return one.select("error_free_batches", r("_f").alias("avg_time_no_errors"),
                                     r("_a").alias("avg_time_all"), r(F.col("_a") - F.col("_f")).alias("time_saved"))


# Worked-minutes bins (right-closed) and their labels.
FATIGUE_BINS = [(-1, 120, "0-2 Hours"), (120, 240, "2-4 Hours"), (240, 360, "4-6 Hours")]


def _fatigue_bin(col):
    e = None
    for lo, hi, lab in FATIGUE_BINS:
        cond = (col > lo) & (col <= hi)
        e = F.when(cond, lab) if e is None else e.when(cond, lab)
    return e


@query("fatigue_by_worked_minutes", "N59", f"""
WITH u AS (SELECT duration_min - min_batch_time AS dev,
                  COALESCE(SUM(duration_min) OVER (PARTITION BY prod_date, operator_name ORDER BY start_min, batch_id
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS worked
           FROM j01),
     b AS (SELECT dev, CASE {' '.join(f"WHEN worked > {lo} AND worked <= {hi} THEN '{lab}'" for lo, hi, lab in FATIGUE_BINS)}
                  END AS work_window FROM u)
SELECT work_window, {R('AVG(dev)')} AS avg_delay FROM b WHERE work_window IS NOT NULL GROUP BY work_window""")
def fatigue_by_worked_minutes(t):
    j = j01(t)
    line = line_of(j)
    s = seq_cumsum(j, [*line, "prod_date", "operator_name"], ["start_min", "batch_id"], ["start_min"],
                   "duration_min", "worked", exclusive=True)
    return (s.withColumn("work_window", _fatigue_bin(F.col("worked"))).filter(F.col("work_window").isNotNull())
             .groupBy(*line, "work_window").agg(r(F.avg("time_deviation")).alias("avg_delay")))


@query("work_stretches", "N59/O14", f"""
WITH r AS (SELECT operator_name, batch_id, duration_min, CAST(prod_date - DATE '1970-01-01' AS BIGINT) * 1440 + start_min AS at0 FROM batches),
     u AS (SELECT *, MAX(at0 + duration_min) OVER (PARTITION BY operator_name ORDER BY at0, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until0 FROM r),
     n AS (SELECT *, SUM(CASE WHEN until0 IS NULL OR at0 - until0 >= {stretches.GAP_MIN} THEN 1 ELSE 0 END)
                     OVER (PARTITION BY operator_name ORDER BY at0, batch_id ROWS UNBOUNDED PRECEDING) AS stretch FROM u)
SELECT operator_name, CAST(stretch AS BIGINT) AS stretch, MIN(at0) AS started_at, MAX(at0 + duration_min) AS ended_at, COUNT(*) AS batches,
       CAST(SUM(duration_min) AS BIGINT) AS worked_min
FROM n GROUP BY operator_name, stretch""")
def work_stretches(t):
    """Stretches of work of every operator, parted by pauses of an hour or more instead of by the calendar day."""
    return stretches.work_stretches(t.b)


# --- Shifts and products --------------------------------------------------------------------

@query("machine_vs_shortage", "N62", f"""
WITH g AS (SELECT description, COUNT(DISTINCT batch_id) AS occurrences, SUM(downtime_min) AS m FROM cp
           WHERE description IN ('Machine failure', 'Inventory shortage') GROUP BY description)
SELECT description, occurrences, {BIG('m')} AS total_downtime_minutes, {PCT('m', 'SUM(m) OVER ()')} AS percentage_of_time
FROM g""")
def machine_vs_shortage(t, causes=("Machine failure", "Inventory shortage")):
    d = cp(t).filter(F.col("description").isin(*causes))
    # distinct batches per cause: group by (cause, batch) first, then count
    per = d.groupBy("description", "batch_id").agg(F.sum("downtime_min").alias("_m"))
    g = per.groupBy("description").agg(F.count(F.lit(1)).alias("occurrences"),
                                       F.sum("_m").alias("total_downtime_minutes"))
    return with_total(g, "total_downtime_minutes", "_t").withColumn(
        "percentage_of_time", pct("total_downtime_minutes", "_t")).drop("_t")


@query("shift_avg_delay_inc", "N63", f"""
SELECT shift, {R('AVG(duration_min - min_batch_time)')} AS avg_delay_vs_target FROM cp GROUP BY shift""")
def shift_avg_delay_inc(t):
    return cp(t).groupBy("shift").agg(r(F.avg("time_deviation")).alias("avg_delay_vs_target"))


@query("handover_impact", "N64", f"""
SELECT CASE WHEN shift <> (CASE WHEN end_min BETWEEN 360 AND 839 THEN 'Morning'
                                WHEN end_min BETWEEN 840 AND 1319 THEN 'Afternoon' ELSE 'Night' END)
            THEN 'Yes (Spans 2 Shifts)' ELSE 'No (Same Shift)' END AS spans_handover,
       COUNT(duration_min - min_batch_time) AS total_batches, {R('AVG(duration_min - min_batch_time)')} AS average_delay
FROM j01 GROUP BY 1""")
def handover_impact(t):
    u = j01(t).withColumn("end_shift", shift_of("end_min"))
    kind = F.when(F.col("shift") != F.col("end_shift"), "Yes (Spans 2 Shifts)").otherwise("No (Same Shift)")
    return u.groupBy(kind.alias("spans_handover")).agg(F.count("time_deviation").alias("total_batches"),
                                                       r(F.avg("time_deviation")).alias("average_delay"))


N67_VALUES = ["Machine failure", "Machine adjustment", "Product spill"]


@query("flavor_issue_matrix", "N67", _matrix_sql(
    "flavor", "description", N67_VALUES, "total_specific_issues", "cp",
    "flavor IS NOT NULL AND description IN ('Machine failure', 'Machine adjustment', 'Product spill')",
    distinct="batch_id"))
def flavor_issue_matrix(t):
    d = (cp(t).filter(F.col("flavor").isNotNull() & F.col("description").isin(*N67_VALUES))
         .select("flavor", "description", "batch_id"))
    return _count_matrix(d, "flavor", "description", N67_VALUES, "total_specific_issues", distinct="batch_id")


@query("changeover_by_product_and_size", "N68", f"""
SELECT product_id, COUNT(downtime_min) AS changeover_count, {R('AVG(downtime_min)')} AS average_minutes,
       {BIG('SUM(downtime_min)')} AS total_minutes
FROM cp WHERE factor_id = 2 GROUP BY product_id""")
def changeover_by_product_and_size(t):
    return cp(t).filter(F.col("factor_id") == 2).groupBy("product_id").agg(
        F.count("downtime_min").alias("changeover_count"), r(F.avg("downtime_min")).alias("average_minutes"),
        F.sum("downtime_min").alias("total_minutes"))


@query("changeover_average_by_size", "N68", f"""
SELECT size, COUNT(downtime_min) AS changeover_count, {R('AVG(downtime_min)')} AS average_minutes, {BIG('SUM(downtime_min)')} AS total_minutes
FROM cp WHERE factor_id = 2 AND size IS NOT NULL GROUP BY size ORDER BY average_minutes DESC""")
def changeover_average_by_size(t):
    return cp(t).filter((F.col("factor_id") == 2) & F.col("size").isNotNull()).groupBy("size").agg(
        F.count("downtime_min").alias("changeover_count"), r(F.avg("downtime_min")).alias("average_minutes"),
        F.sum("downtime_min").alias("total_minutes")).orderBy(F.col("average_minutes").desc())


@query("label_error_contribution", "N69", f"""
SELECT product_id, COUNT(*) AS error_count, {PCT('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS contribution_pct
FROM cp WHERE factor_id = 3 GROUP BY product_id""")
def label_error_contribution(t):
    return share(cp(t).filter(F.col("factor_id") == 3), "product_id", name="error_count", pct_name="contribution_pct")


@query("product_ease", "N70", f"""
WITH bat AS (SELECT product_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE batch_status = 'On_time') AS on_time
             FROM j01 GROUP BY product_id),
     inc AS (SELECT product_id, AVG(duration_min) - AVG(min_batch_time) AS d FROM cp GROUP BY product_id)
SELECT bat.product_id, bat.on_time, bat.total, {PCT('bat.on_time', 'bat.total')} AS on_time_rate_pct,
       {R('inc.d')} AS avg_delay_mins
FROM bat JOIN inc ON bat.product_id = inc.product_id""")
def product_ease(t):
    bat = j01(t).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("batch_status") == ON_TIME_LBL, 1)).alias("on_time"))
    inc = cp(t).groupBy("product_id").agg(r(F.avg("duration_min") - F.avg("min_batch_time")).alias("avg_delay_mins"))
    return bat.join(inc, "product_id").withColumn("on_time_rate_pct", pct("on_time", "total"))


@query("product_avg_downtime_per_batch", "N72", f"""
SELECT b.product_id, {R('AVG(COALESCE(bd.total_downtime, 0))')} AS average_downtime_minutes
FROM batches b LEFT JOIN bd ON b.batch_id = bd.batch_id GROUP BY b.product_id""")
def product_avg_downtime_per_batch(t):
    j = marts.batches_with_totals(t)
    return j.groupBy("product_id").agg(
        r(F.avg(F.coalesce("total_downtime", F.lit(0)))).alias("average_downtime_minutes"))


@query("size_category_utilization", "N73", f"""
SELECT CASE WHEN COALESCE(size, 'nan') LIKE '%600%' THEN 'Small (600ml)' ELSE 'Large (2000ml)' END AS category,
       {BIG('SUM(min_batch_time)')} AS total_min_time, {BIG('SUM(duration_min)')} AS total_duration,
       {PCT('SUM(min_batch_time)', 'SUM(duration_min)')} AS utilization_ratio_pct
FROM j01 GROUP BY 1""")
def size_category_utilization(t):
    cat = F.when(F.coalesce(F.col("size"), F.lit("nan")).contains("600"), "Small (600ml)").otherwise("Large (2000ml)")
    return j01(t).groupBy(cat.alias("category")).agg(
        F.sum("min_batch_time").alias("total_min_time"), F.sum("duration_min").alias("total_duration"),
        pct(F.sum("min_batch_time"), F.sum("duration_min")).alias("utilization_ratio_pct"))


@query("standard_time_validation", "N74", f"""
WITH a AS (SELECT AVG(CASE WHEN size_l = 0.6E0 THEN duration_min END) AS s,
                  AVG(CASE WHEN size_l = 2.0E0 THEN duration_min END) AS l FROM j01)
SELECT {R('a.s')} AS avg_time_600, {R('a.l')} AS avg_time_2000, 38 AS target_diff, {R('a.l - a.s')} AS actual_diff,
       {R('a.l - a.s - 38')} AS extra_lost_time FROM a""")
def standard_time_validation(t, small_target: int = 60, large_target: int = 98):
    a = j01(t).agg(F.avg(F.when(F.col("size_l") == 0.6, F.col("duration_min"))).alias("_s"),
                   F.avg(F.when(F.col("size_l") == 2.0, F.col("duration_min"))).alias("_l"))
    diff = large_target - small_target
    return a.select(r("_s").alias("avg_time_600"), r("_l").alias("avg_time_2000"), F.lit(diff).alias("target_diff"),
                    r(F.col("_l") - F.col("_s")).alias("actual_diff"),
                    r(F.col("_l") - F.col("_s") - F.lit(diff)).alias("extra_lost_time"))

