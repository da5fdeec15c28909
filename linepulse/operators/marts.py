"""Joined marts (J keys) and the shared joined views every metric family starts from.

Joins are done once, when the canonical tables are built (``sources.testmap``): the wide batches
carry their downtime totals and their product's attributes, and the incident detail carries each
incident's batch, product and factor attributes.  The views below are therefore filters,
projections and UNION ALLs over those two tables — no report joins batches with incidents, nor
the facts with the product dimension:

- ``bp``          = wide batches whose product exists, with ``delay``;
- ``bi`` (inner)  = incident detail rows whose batch exists;
- ``bi`` (left)   = the same plus the batches without any incident;
- ``bd``          = the stored per-batch totals.

The incidents' dense ids cost a sort of all incidents.  With ``ids=False`` a view reads the detail without them: it has
``incident`` (true, NULL where a batch has none) in place of ``downtime_id``, which is all that counts and sums need.

When a ``Tables`` value carries no materialised wide tables (e.g. tables read straight from CSV
exports), the same wide frames are derived on the fly with the same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linepulse.sources.testmap import (BATCH_COLS, FACTOR_ATTRS, INCIDENT_COLS, PRODUCT_ATTRS, ROW_COLS, Tables,
                                       incident_detail, line_of, wide_batches)

PRODUCT_COLS = PRODUCT_ATTRS
INCIDENT_TYPES = {"downtime_id": "long", "incident": "boolean", "factor_id": "int", "downtime_min": "int"}
FACTOR_TYPES = {"description": "string", "operator_error": "string"}


def batches_with_totals(t: Tables) -> DataFrame:
    """Wide batches: canonical columns, ``total_downtime`` (NULL when none), ``incident_count``,
    product attributes and ``has_product``."""
    return t.bt if t.bt is not None else wide_batches(t.b, t.i, t.p, t.f)


def _incident_cols(ids: bool) -> list[str]:
    return INCIDENT_COLS if ids else ROW_COLS


def detail(t: Tables, ids: bool = True) -> DataFrame:
    """Every incident with batch / product / factor attributes and ``matched`` / ``has_*`` flags."""
    if ids:
        return t.d if t.d is not None else incident_detail(t.i, batches_with_totals(t), t.f)
    return t.dr if t.dr is not None else detail(t).withColumn("incident", F.when(F.col("downtime_id").isNotNull(), True)).drop("downtime_id")


def _delay(df: DataFrame) -> DataFrame:
    return df.withColumn("delay", F.col("duration_min") - F.col("min_batch_time"))


def _nulls(types: dict, cols=None) -> list:
    return [F.lit(None).cast(types[c]).alias(c) for c in cols or types]


def batch_product(t: Tables, how: str = "inner") -> DataFrame:
    """``bp``: batches with their product's attributes and ``delay = duration - target``
    (``how='inner'`` keeps only batches whose product exists)."""
    w = batches_with_totals(t)
    if how == "inner":
        w = w.filter(F.col("has_product"))
    return _delay(w.select(*BATCH_COLS, *line_of(w), *PRODUCT_COLS))


def batch_with_product(t: Tables) -> DataFrame:
    """Batches left-joined to products."""
    w = batches_with_totals(t)
    return w.select(*BATCH_COLS, *line_of(w), *PRODUCT_COLS)


def batch_downtime(t: Tables) -> DataFrame:
    """``bd``: total downtime per batch that has incidents (stored, so no aggregation here)."""
    return (batches_with_totals(t).filter(F.col("incident_count") > 0)
            .select("batch_id", F.col("total_downtime").cast("long").alias("total_downtime")))


def incident_factor(t: Tables, how: str = "inner", ids: bool = True) -> DataFrame:
    """``idf`` / J02: incidents with their factor description and operator-error flag, a projection of the detail."""
    d = detail(t, ids)
    if how == "inner":
        d = d.filter(F.col("has_factor"))
    elif how != "left":
        raise ValueError("how must be 'inner' or 'left'")
    return d.select("batch_id", *_incident_cols(ids), *FACTOR_ATTRS)


def _lonely(t: Tables, ids: bool, *extra: str) -> DataFrame:
    """Batches without any incident, one row each (incident / factor columns NULL)."""
    return batches_with_totals(t).filter(F.col("incident_count") == 0).select(
        *BATCH_COLS, *_nulls(INCIDENT_TYPES, _incident_cols(ids)), *extra)


def batch_incident(t: Tables, how: str = "inner", ids: bool = True) -> DataFrame:
    """``bi`` / J03: one row per batch x incident; ``how='left'`` keeps batches without incident once."""
    inner = detail(t, ids).filter(F.col("matched")).select(*BATCH_COLS, *_incident_cols(ids))
    if how == "inner":
        return inner
    if how != "left":
        raise ValueError("how must be 'inner' or 'left'")
    return inner.unionByName(_lonely(t, ids))


def batch_incident_factor(t: Tables, how: str = "inner", ids: bool = True) -> DataFrame:
    """``bif``: incident detail with batch and factor attributes (left: batches without incident kept)."""
    d = detail(t, ids).filter(F.col("matched"))
    if how == "inner":
        return d.filter(F.col("has_factor")).select(*BATCH_COLS, *_incident_cols(ids), *FACTOR_ATTRS)
    return d.select(*BATCH_COLS, *_incident_cols(ids), *FACTOR_ATTRS).unionByName(_lonely(t, ids, *_nulls(FACTOR_TYPES)))


def batch_product_incident(t: Tables, how: str = "inner", ids: bool = True) -> DataFrame:
    """``bp`` x incidents: product attributes and delay on every incident row of a batch whose
    product exists (left: such batches without incident kept once)."""
    d = detail(t, ids).filter(F.col("matched") & F.col("has_product")).select(*BATCH_COLS, *_incident_cols(ids), *PRODUCT_COLS)
    if how == "left":
        lonely = (batches_with_totals(t).filter((F.col("incident_count") == 0) & F.col("has_product"))
                  .select(*BATCH_COLS, *_nulls(INCIDENT_TYPES, _incident_cols(ids)), *PRODUCT_COLS))
        d = d.unionByName(lonely)
    return _delay(d)


def batch_product_incident_factor(t: Tables, ids: bool = True) -> DataFrame:
    """``bp`` x incidents x factors (all three must exist), with delay."""
    d = detail(t, ids).filter(F.col("matched") & F.col("has_product") & F.col("has_factor"))
    return _delay(d.select(*BATCH_COLS, *_incident_cols(ids), *PRODUCT_COLS, *FACTOR_ATTRS))


def complete_table(t: Tables, ids: bool = True) -> DataFrame:
    """J04 ``cp``: batches x products x incidents x factors, batches without incident kept once."""
    cols = [*BATCH_COLS, *PRODUCT_COLS, *_incident_cols(ids), *FACTOR_ATTRS]
    inner = detail(t, ids).filter(F.col("matched")).select(*cols)
    lonely = batches_with_totals(t).filter(F.col("incident_count") == 0).select(
        *BATCH_COLS, *PRODUCT_COLS, *_nulls(INCIDENT_TYPES, _incident_cols(ids)), *_nulls(FACTOR_TYPES))
    return inner.unionByName(lonely).select(*cols)


def complete_with_status(t: Tables) -> DataFrame:
    """Complete table plus the notebook's two-level label (unknown target counts as on time)."""
    cp = complete_table(t)
    label = F.when(F.col("duration_min") > F.col("min_batch_time"), F.lit("Delay")).otherwise(F.lit("On_time"))
    return cp.select("batch_id", "prod_date", "product_id", "flavor", "size", "operator_name", "start_min",
                     "end_min", "duration_min", "min_batch_time", "shift", "downtime_id", "factor_id",
                     "description", "operator_error", "downtime_min", label.alias("batch_status"))


def production_master_report(t: Tables) -> DataFrame:
    """One row per batch with product attributes and total downtime (0 when none)."""
    return (batches_with_totals(t)
            .select("batch_id", "prod_date", "product_id", "flavor", "operator_name", "shift", "status",
                    F.col("duration_min").alias("actual_min"), F.col("min_batch_time").alias("target_min"),
                    F.coalesce(F.col("total_downtime"), F.lit(0)).cast("long").alias("total_downtime_min")))


def ml_incident_frame(t: Tables) -> DataFrame:
    """Every incident with the factor's operator-error flag and the batch's product, operator,
    shift and product target (incidents of unknown batches kept with NULL attributes)."""
    return detail(t).select("downtime_id", "batch_id", "factor_id", "downtime_min", "operator_error", "product_id",
                            "operator_name", "shift", "min_batch_time")
