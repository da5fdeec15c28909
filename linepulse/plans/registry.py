"""Registry of report queries: key -> Spark plan builder (+ independent SQL formulation).

Every plan builder takes the canonical tables and returns a DataFrame.  Tables are built when a plan first reads them, and
model, source and streaming keys run jobs while their plan is built; reports are lazy.  The SQL text (when given) is the same question written against the canonical
WITH-list of ``sources.testmap.ORACLE_CTES``; it is run by a second engine as a cross-check.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.sources.testmap import Tables


@dataclass(frozen=True)
class Query:
    key: str
    ref: str
    fn: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}

# Order in which grouped reports present their rows; a leading "-" is descending, ties by the remaining columns.
ORDER: dict[str, list[str]] = {
    "production_trend_daily": ["prod_date"],
    "batch_density_per_shift": ["-avg_batches_per_day"],
    "product_mix_pct": ["-production_pct"],
    "gap_analysis_by_product": ["-total_variance_min"],
    "utilization_daily": ["prod_date"],
    "shift_duration_and_delay": ["-total_d_per_shift"],
    "shift_total_duration": ["-total_production_duration"],
    "shift_avg_delay": ["-avg_delay_per_batch"],
    "shift_on_time_pct": ["-on_time_percentage"],
    "shift_batch_count": ["-total_batches"],
    "shift_efficiency_loss": ["-total_efficiency_loss_min"],
    "shift_daily_batches": ["prod_date"],
    "operator_batch_count": ["-total_batches"],
    "operator_avg_delay": ["-avg_delay_per_batch"],
    "operator_delayed_count": ["-delayed_batches_count"],
    "operator_shift_phase_delay": ["operator_name", "shift_phase"],
    "operator_delay_variation": ["delay_variation"],
    "product_batch_count": ["-batch_count"],
    "product_avg_time": ["-avg_production_time"],
    "product_avg_gap": ["-avg_efficiency_gap"],
    "size_impact": ["-avg_efficiency_loss"],
    "product_delayed_count": ["-delayed_batches_count"],
    "product_productivity_score": ["-productivity_score"],
    "factor_frequency": ["-occurrence_count"],
    "shift_downtime": ["-total_downtime_min"],
    "daily_downtime": ["prod_date"],
    "operator_downtime_share": ["-total_downtime_min"],
    "product_failure_impact": ["product_id", "-total_lost_time"],
    "operator_repeated_errors": ["-frequency"],
    "changeover_setup_by_shift": ["-avg_setup_time_per_batch"],
    "factor_vs_delay": ["-delay_occurrences"],
    "product_labeling_calibration": ["-frequency"],
    "machine_failure_by_shift": ["-incident_count"],
    "failure_classification": ["-total_duration"],
    "operator_product_avg_time": ["product_id", "avg_production_time"],
    "operator_on_time": ["-ot_percentage"],
    "operator_target_achievement": ["-real_efficiency_score"],
    "operator_error_rate": ["-error_rate_per_batch_pct"],
    "operator_lost_time": ["-total_lost_minutes"],
    "operator_mttr": ["mttr_min"],
    "operator_size_efficiency": ["operator_name", "size"],
    "operator_shift_otdr": ["operator_name", "shift"],
    "operator_efficiency_index": ["-efficiency_index"],
    "operator_error_free_runtime": ["-avg_run_time_without_errors"],
    "operator_waste": ["-total_production_duration"],
    "shift_productivity": ["-total_batches"],
    "shift_factor_downtime": ["shift", "-total_downtime_minutes"],
    "shift_otdr": ["-otdr_percentage"],
    "shift_human_factor": ["-grand_total_waste_minutes"],
    "shift_downtime_severity": ["-total_downtime_minutes"],
    "flavor_duration": ["-avg_batch_duration"],
    "labeling_issues": ["-labeling_failures"],
    "product_success_rate": ["-success_rate_pct"],
    "product_avg_downtime": ["-avg_downtime_minutes"],
    "performance_variance": ["-performance_gap"],
    "chronic_vs_acute": ["-total_impact_minutes"],
    "operator_machine_issues": ["response_repair_speed"],
}


def _presented(key: str, fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """``fn`` with its rows in the report's order (one row per group, so the sort is small)."""
    def run(t, *args, **options):
        df = fn(t, *args, **options)
        first = [F.col(x[1:]).desc() if x[0] == "-" else F.col(x).asc() for x in ORDER[key]]
        return df.orderBy(*first, *[c for c in df.columns if c not in {x.lstrip("-") for x in ORDER[key]}])
    return run


def query(key: str, ref: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = Query(key, ref, _presented(key, fn) if key in ORDER else fn, sql)
        return fn
    return deco


# --- SQL helpers for the oracle text (DuckDB dialect) ---------------------------------------

def R(x: str, digits: int = 2) -> str:
    """Half-up rounding of the shortest decimal form of a DOUBLE (what Spark's ROUND does)."""
    return f"CAST(ROUND(CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def PCT(num: str, den: str, digits: int = 2) -> str:
    return R(f"CAST(({num}) AS DOUBLE) * 100.0E0 / NULLIF(({den}), 0)", digits)


def DIV(num: str, den: str, digits: int = 2) -> str:
    return R(f"CAST(({num}) AS DOUBLE) / NULLIF(({den}), 0)", digits)


def BIG(x: str) -> str:
    return f"CAST(({x}) AS BIGINT)"


def INT(x: str) -> str:
    return f"CAST(({x}) AS INTEGER)"


def DBL(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def load_all() -> dict[str, Query]:
    # importing the plan modules registers their queries
    from linepulse.plans import (  # noqa: F401
        dashboard, downtime, features_marts, ml_plans, notebook, operator, product, productivity,
        quality_cleaning, shift, sources_plans)
    return REGISTRY
