"""Prescriptive recommendations (X keys) as joins against the on-time history.

For each product the history gives the operator and the shift with the most on-time batches
(ties: alphabetical).  A batch predicted to be late gets those as recommendations; a predicted
long downtime gets a schedule buffer.  Everything is a grouped aggregate plus joins: no per-batch
queries against the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.operators.metrics import top_per_group

# Recommendation texts and the downtime threshold for a buffer warning.
OPERATOR_TEXT = "Recommendation 1: Consider reassigning this batch to Operator [{}] to minimize delay risks."
SHIFT_TEXT = ("Recommendation 2: Historical data indicates optimal performance on [{}] Shift for this "
              "product variant.")
BUFFER_TEXT = ("Operational Warning: High MTTR expected. Inject a standard buffer of {} minutes in the "
               "downstream assembly schedule.")
BUFFER_THRESHOLD = 20.0


def best_by_product(history: DataFrame, col: str, status_col: str = "status", on_time: str = "ON TIME") -> DataFrame:
    """Per product: the value of ``col`` with most on-time batches (ties by value)."""
    g = history.filter(F.col(status_col) == on_time).groupBy("product_id", col).agg(F.count(F.lit(1)).alias("_n"))
    best = top_per_group(g, "product_id", [F.col("_n").desc(), F.col(col).asc()], 1)
    return best.select("product_id", F.col(col).alias(f"best_{col}"))


def recommend_operator(planned: DataFrame, history: DataFrame, late: str = "DELAY",
                       predicted: str = "predicted_status") -> DataFrame:
    """For batches predicted late, the operator with the best on-time record on the product."""
    d = planned.filter(F.col(predicted) == late).join(best_by_product(history, "operator_name"), "product_id", "left")
    return d.select("batch_id", "product_id", "operator_name",
                    F.col("best_operator_name").alias("recommended_operator"))


def recommend_shift(planned: DataFrame, history: DataFrame, late: str = "DELAY",
                    predicted: str = "predicted_status") -> DataFrame:
    """The product's best on-time shift, when it differs from the planned one."""
    d = planned.filter(F.col(predicted) == late).join(best_by_product(history, "shift"), "product_id", "left")
    rec = F.when(F.col("best_shift") != F.col("shift"), F.col("best_shift"))
    return d.select("batch_id", "product_id", "shift", rec.alias("recommended_shift"))


def buffer_warning(pred: DataFrame, col: str = "predicted_downtime", threshold: float = BUFFER_THRESHOLD) -> DataFrame:
    """A buffer of the rounded predicted minutes when a long stop is expected."""
    minutes = F.round(F.col(col)).cast("long")
    return pred.withColumn("buffer_minutes", F.when(F.col(col) > threshold, minutes)) \
               .withColumn("warning", F.when(F.col(col) > threshold,
                                             F.format_string(BUFFER_TEXT.replace("{}", "%d"), minutes)))


def mitigation_plan(planned: DataFrame, history: DataFrame, per_batch_downtime: DataFrame, late: str = "DELAY",
                    predicted: str = "predicted_status", downtime_col: str = "predicted_downtime") -> DataFrame:
    """The list of recommendation texts per planned batch (array column, empty entries dropped)."""
    d = (planned.join(best_by_product(history, "operator_name"), "product_id", "left")
                .join(best_by_product(history, "shift"), "product_id", "left")
                .join(per_batch_downtime, "batch_id", "left"))
    is_late = F.col(predicted) == late
    r1 = F.when(is_late & F.col("best_operator_name").isNotNull(),
                F.format_string(OPERATOR_TEXT.replace("{}", "%s"), F.col("best_operator_name")))
    r2 = F.when(is_late & F.col("best_shift").isNotNull() & (F.col("best_shift") != F.col("shift")),
                F.format_string(SHIFT_TEXT.replace("{}", "%s"), F.col("best_shift")))
    r3 = F.when(F.col(downtime_col) > BUFFER_THRESHOLD,
                F.format_string(BUFFER_TEXT.replace("{}", "%d"), F.round(F.col(downtime_col)).cast("long")))
    plan = F.filter(F.array(r1, r2, r3), lambda x: x.isNotNull())
    return d.select("batch_id", plan.alias("recommendations"))
