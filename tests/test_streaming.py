"""Streaming KPIs: the windows a stream closes equal the batch answer for those windows."""

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_shift_windows_match_batch(spark):
    from linepulse.sources.testmap import batches_location, load
    from linepulse.streaming.kpi_stream import shift_window_aggregate, shift_window_stream, with_event_time
    t = load(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="lp-stream-", dir="/tmp")
    q = shift_window_stream(spark, batches_location(t), f"{base}/out", f"{base}/ckpt", watermark="1 hour")
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert got.count() > 0
    ref = (with_event_time(t.b).groupBy(F.window("event_ts", "1 day"), "shift")
           .agg(F.count(F.lit(1)).alias("batches"), F.sum("duration_min").alias("run_min"))
           .select(F.col("window.start").alias("window_start"), "shift", "batches", "run_min"))
    j = got.join(ref, ["window_start", "shift"])
    assert j.count() == got.count()
    assert j.filter((got["batches"] != ref["batches"]) | (got["run_min"] != ref["run_min"])).count() == 0
    assert shift_window_aggregate(t.b).isStreaming is False


def test_factor_stream_equals_batch(spark):
    import __spark_entry__ as E
    s = E.queries()["stream_factor_downtime"](spark, SF_SMALL)
    b = E.queries()["factor_frequency"](spark, SF_SMALL)
    got = {r["description"]: r["incidents"] for r in s.collect()}
    ref = {r["description"]: r["occurrence_count"] for r in b.collect()}
    assert got == ref
