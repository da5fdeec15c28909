"""Dashboard measures (B keys)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linepulse.functions.expr import r
from linepulse.operators import marts, ranks, sketches
from linepulse.operators.metrics import share
from linepulse.plans.registry import BIG, PCT, R, query


@query("kpi_summary", "B01", f"""
WITH d AS (SELECT SUM(downtime_min) AS m, COUNT(*) AS n, AVG(downtime_min) AS a FROM incidents),
     r AS (SELECT SUM(duration_min) AS s FROM batches)
SELECT {BIG('d.m')} AS total_downtime_min, d.n AS incident_count, {R('d.a')} AS mttr_min,
       {R('CAST(r.s AS DOUBLE) / NULLIF(d.n, 0)')} AS mtbf_min,
       {R('100.0E0 - CAST(d.m AS DOUBLE) * 100.0E0 / NULLIF(r.s, 0)')} AS availability_pct
FROM d, r""")
def kpi_summary(t):
    """One row: total downtime, incident count, MTTR, MTBF and availability, all grain-safe
    (incident measures from incidents, run time from batches; two one-row aggregates)."""
    d = t.ir.agg(F.sum("downtime_min").alias("total_downtime_min"), F.count(F.lit(1)).alias("incident_count"),
                F.avg("downtime_min").alias("_a"))
    run = t.b.agg(F.sum("duration_min").alias("_s"))
    return d.crossJoin(run).select(
        "total_downtime_min", "incident_count", r("_a").alias("mttr_min"),
        r(F.col("_s").cast("double") / F.nullif(F.col("incident_count"), F.lit(0))).alias("mtbf_min"),
        r(F.lit(100.0) - F.col("total_downtime_min").cast("double") * 100.0 / F.nullif(F.col("_s"), F.lit(0)))
        .alias("availability_pct"))


@query("product_downtime_share", "B02", f"""
SELECT product_id, {BIG('SUM(downtime_min)')} AS total_downtime_min,
       {PCT('SUM(downtime_min)', 'SUM(SUM(downtime_min)) OVER ()')} AS downtime_pct
FROM bi GROUP BY product_id""")
def product_downtime_share(t):
    return share(marts.batch_incident(t, ids=False), "product_id", "downtime_min", "total_downtime_min", "downtime_pct")


@query("monthly_downtime_trend", "B03", f"""
WITH g AS (SELECT CAST(year(prod_date) AS INTEGER) AS year, CAST(month(prod_date) AS INTEGER) AS month,
                  SUM(downtime_min) AS m, COUNT(*) AS n FROM bi GROUP BY 1, 2)
SELECT year, month, {BIG('m')} AS total_downtime_min, n AS incidents,
       {BIG('m - LAG(m) OVER (ORDER BY year, month)')} AS change_vs_previous FROM g""")
def monthly_downtime_trend(t):
    g = marts.batch_incident(t, ids=False).groupBy(F.year("prod_date").alias("year"), F.month("prod_date").alias("month")).agg(
        F.sum("downtime_min").alias("total_downtime_min"), F.count(F.lit(1)).alias("incidents"))
    # one row per month: the ordered window runs on a tiny frame
    return g.withColumn("change_vs_previous", F.col("total_downtime_min")
                        - F.lag("total_downtime_min").over(Window.orderBy("year", "month")))


KPI_COLS = ["duration_min", "min_batch_time", "total_downtime", "delay"]
KPI_PAIRS = [(a, b) for i, a in enumerate(KPI_COLS) for b in KPI_COLS[i + 1:]]


@query("kpi_correlation", "B04", f"""
WITH k AS (SELECT j.duration_min, j.min_batch_time, CAST(COALESCE(bd.total_downtime, 0) AS DOUBLE) AS total_downtime,
                  j.duration_min - j.min_batch_time AS delay
           FROM j01 j LEFT JOIN bd ON j.batch_id = bd.batch_id)
{' UNION ALL '.join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {R(f'CORR({a}, {b})', 6)} AS correlation FROM k"
                    for a, b in KPI_PAIRS)}""")
def kpi_correlation(t):
    k = (marts.batches_with_totals(t)
         .select("duration_min", "min_batch_time",
                 F.coalesce(F.col("total_downtime"), F.lit(0)).cast("double").alias("total_downtime"),
                 (F.col("duration_min") - F.col("min_batch_time")).alias("delay")))
    one = k.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in KPI_PAIRS])
    rows = F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"),
                              F.round(F.col(f"{a}__{b}"), 6).alias("correlation")) for a, b in KPI_PAIRS])
    return one.select(F.inline(rows))


def _kpis(t):
    return (marts.batches_with_totals(t)
            .select("duration_min", "min_batch_time", F.coalesce(F.col("total_downtime"), F.lit(0)).cast("double").alias("total_downtime"),
                    (F.col("duration_min") - F.col("min_batch_time")).alias("delay")))


def _rank_sql(a: str, b: str) -> str:
    def rank(x):
        return f"RANK() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0E0"
    return (f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, {R('CORR(ra, rb)', 6)} AS correlation, COUNT(*) AS n "
            f"FROM (SELECT {rank(a)} AS ra, {rank(b)} AS rb FROM k WHERE {a} IS NOT NULL AND {b} IS NOT NULL) u")


@query("kpi_rank_correlation", "B04", f"""
WITH k AS (SELECT j.duration_min, j.min_batch_time, CAST(COALESCE(bd.total_downtime, 0) AS DOUBLE) AS total_downtime,
                  j.duration_min - j.min_batch_time AS delay
           FROM j01 j LEFT JOIN bd ON j.batch_id = bd.batch_id)
{' UNION ALL '.join(_rank_sql(a, b) for a, b in KPI_PAIRS)}""")
def kpi_rank_correlation(t):
    """Spearman's correlation of the same measures: average ranks, ties shared."""
    return ranks.rank_correlations(_kpis(t), KPI_PAIRS)


DISTINCT_COLS = ["product_id", "operator_name", "flavor"]


@query("approx_distinct_monthly", "P37-P39", """
SELECT CAST(year(prod_date) AS INTEGER) AS year, CAST(month(prod_date) AS INTEGER) AS month, COUNT(DISTINCT product_id) AS product_id,
       COUNT(DISTINCT operator_name) AS operator_name, COUNT(DISTINCT flavor) AS flavor
FROM j01 GROUP BY 1, 2""")
def approx_distinct_monthly(t):
    """Opt-in approximate distinct counts a month, merged from the stored daily sketches (some hundred values are counted exactly)."""
    daily = t.kept("distinct_daily", ["events", "part"], lambda: sketches.daily_distinct(marts.batch_with_product(t), "prod_date", DISTINCT_COLS))
    return sketches.distinct_over(daily, DISTINCT_COLS, [F.year("prod_date").alias("year"), F.month("prod_date").alias("month")])


@query("approx_fences", "B05", """
WITH q AS (SELECT product_id, COUNT(*) AS n, CAST(quantile_disc(duration_min, 0.25) AS BIGINT) AS q1, CAST(quantile_disc(duration_min, 0.75) AS BIGINT) AS q3
           FROM batches GROUP BY product_id)
SELECT product_id, n, q1, q3, q1 - 1.5E0 * (q3 - q1) AS low, q3 + 1.5E0 * (q3 - q1) AS high FROM q""")
def approx_fences(t):
    """Quartiles and outlier limits of every product from stored daily quantile sketches: exact up to KLL_K batches a product, then within the
    sketch's rank error (``sketches.outlier_rates`` reads the rates off the same sketches)."""
    daily = t.kept("duration_daily", ["events", "part"], lambda: sketches.daily_quantiles(t.b, "product_id", "prod_date", "duration_min"))
    return sketches.fences(daily, "product_id").drop("sketch")


@query("outlier_flags", "B05", f"""
WITH q AS (SELECT product_id, quantile_cont(duration_min, 0.25) AS q1, quantile_cont(duration_min, 0.75) AS q3
           FROM batches GROUP BY product_id)
SELECT b.batch_id, b.product_id, b.duration_min, {R('q.q1', 4)} AS q1, {R('q.q3', 4)} AS q3,
       (b.duration_min < q.q1 - 1.5 * (q.q3 - q.q1) OR b.duration_min > q.q3 + 1.5 * (q.q3 - q.q1)) AS is_outlier
FROM batches b JOIN q ON b.product_id = q.product_id""")
def outlier_flags(t, k: float = 1.5):
    """IQR rule per product.  ``percentile`` is exact and keeps one counter per distinct duration,
    so its state per product is bounded by the number of distinct minute values, not by rows."""
    q = t.b.groupBy("product_id").agg(F.percentile("duration_min", [0.25, 0.75]).alias("_q"))
    q = q.select("product_id", F.col("_q")[0].alias("_q1"), F.col("_q")[1].alias("_q3"))
    j = t.b.select("batch_id", "product_id", "duration_min").join(q, "product_id")
    iqr = F.col("_q3") - F.col("_q1")
    out = (F.col("duration_min") < F.col("_q1") - k * iqr) | (F.col("duration_min") > F.col("_q3") + k * iqr)
    return j.select("batch_id", "product_id", "duration_min", r("_q1", 4).alias("q1"), r("_q3", 4).alias("q3"),
                    out.alias("is_outlier"))



@query("stream_factor_downtime", "B06", f"""
SELECT description, COUNT(*) AS incidents, {BIG('SUM(downtime_min)')} AS total_min FROM idf GROUP BY description""")
def stream_factor_downtime(t):
    """Per-factor totals maintained by a Structured Streaming query over the incident files
    (the live feed of the downtime dashboard); the published table is read back."""
    import uuid

    from linepulse.session import shared_dir
    from linepulse.sources.testmap import incidents_location
    from linepulse.streaming.kpi_stream import factor_downtime_stream

    base = f"{shared_dir(t.spark).rstrip('/')}/linepulse/stream/{uuid.uuid4().hex[:12]}"
    q = factor_downtime_stream(t.spark, incidents_location(t), t.f, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return t.spark.read.parquet(f"{base}/out")
