"""Incremental downtime KPIs with Structured Streaming.

``factor_downtime_stream``  running incident count and minutes per downtime factor (the input of
                            the Pareto and share reports).  The factor dimension is a fixed
                            12-row table, broadcast into the stream; the state holds one row per
                            factor, so ``complete`` output stays small however long the stream runs.
``shift_window_stream``     batches per shift and event-time window with a watermark, emitted once
                            a window is closed (append output; late rows beyond the watermark are
                            dropped by design, state for closed windows is released).

Both write through the sink of the caller's choice; the checkpoint must live in the shared folder
so a restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INCIDENT_SCHEMA = T.StructType([
    T.StructField("downtime_id", T.LongType(), True),
    T.StructField("batch_id", T.LongType(), True),
    T.StructField("factor_id", T.IntegerType(), True),
    T.StructField("downtime_min", T.IntegerType(), True),
])
BATCH_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType(), True),
    T.StructField("prod_date", T.DateType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("operator_name", T.StringType(), True),
    T.StructField("start_min", T.IntegerType(), True),
    T.StructField("end_min", T.IntegerType(), True),
    T.StructField("duration_min", T.IntegerType(), True),
    T.StructField("shift", T.StringType(), True),
    T.StructField("status", T.StringType(), True),
])


def factor_downtime_aggregate(incidents: DataFrame, factors: DataFrame) -> DataFrame:
    """Streaming-safe aggregate: incidents x factors -> per factor count and minutes."""
    return (incidents.join(factors, "factor_id")
                     .groupBy("description")
                     .agg(F.count(F.lit(1)).alias("incidents"), F.sum("downtime_min").alias("total_min")))


def factor_downtime_stream(spark: SparkSession, incidents_dir: str, factors: DataFrame, out_dir: str,
                           checkpoint: str, files_per_trigger: int = 1000, available_now: bool = True):
    """Run the factor aggregate over the incident files as a stream; each micro-batch replaces the
    table at ``out_dir`` with the current totals (written by the executors)."""
    stream = (spark.readStream.schema(INCIDENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(incidents_dir))
    agg = factor_downtime_aggregate(stream, factors)

    def publish(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(out_dir)

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def with_event_time(batches: DataFrame) -> DataFrame:
    """Batch start as an event-time timestamp (date + minutes of the day)."""
    ts = F.timestamp_seconds(F.unix_date("prod_date").cast("long") * 86400 + F.col("start_min").cast("long") * 60)
    return batches.withColumn("event_ts", ts)


def shift_window_aggregate(batches: DataFrame, window: str = "1 day", watermark: str = "2 days") -> DataFrame:
    return (with_event_time(batches).withWatermark("event_ts", watermark)
            .groupBy(F.window("event_ts", window), "shift")
            .agg(F.count(F.lit(1)).alias("batches"), F.sum("duration_min").alias("run_min"),
                 F.count(F.when(F.col("status") == "ON TIME", 1)).alias("on_time")))


def shift_window_stream(spark: SparkSession, batches_dir: str, out_dir: str, checkpoint: str,
                        window: str = "1 day", watermark: str = "2 days", available_now: bool = True):
    stream = spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", 1000).parquet(batches_dir)
    agg = shift_window_aggregate(stream, window, watermark).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "shift", "batches",
        "run_min", "on_time")
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
