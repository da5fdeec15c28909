"""Invariants across keys: shares add up, statuses partition the batches, joins to dimensions keep
the incident minutes, the complete table has the expected grain."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def q(spark):
    import __spark_entry__ as E
    qs = E.queries()
    return lambda k: qs[k](spark, SF_SMALL)


@pytest.mark.parametrize("key,col", [
    ("product_mix_pct", "production_pct"), ("factor_downtime_share", "downtime_percentage"),
    ("operator_downtime_share", "downtime_pct"), ("product_downtime_share", "downtime_pct"),
    ("shift_downtime_share", "share_pct"), ("failure_distribution", "percentage"),
    ("error_category_share", "loss_percentage"), ("status_ratio", "percentage")])
def test_shares_add_to_100(q, key, col):
    df = q(key)
    total = df.agg(F.sum(col)).first()[0]
    assert abs(total - 100.0) <= 0.005 * df.count() + 1e-9


def test_statuses_partition_batches(q, spark):
    from linepulse.sources.testmap import load
    n = load(spark, SF_SMALL).b.count()
    assert q("status_counts").agg(F.sum("total_batches")).first()[0] == n
    r = q("line_otdr").first()
    assert r["total_batches"] == n


def test_incident_minutes_survive_dimension_joins(q):
    total = q("total_downtime").first()[0]
    assert q("incident_with_factor").agg(F.sum("downtime_min")).first()[0] == total
    assert q("ml_incident_frame").agg(F.sum("downtime_min")).first()[0] == total
    assert q("factor_downtime_share").agg(F.sum("total_downtime_min")).first()[0] == total
    assert q("kpi_summary").first()["total_downtime_min"] == total


def test_complete_table_grain(q, spark):
    from linepulse.sources.testmap import load
    t = load(spark, SF_SMALL)
    matched = t.i.join(t.b.select("batch_id"), "batch_id", "left_semi").count()
    lonely = t.b.join(t.i.select("batch_id"), "batch_id", "left_anti").count()
    assert q("complete_table").count() == matched + lonely
    orphans = {r["relation"]: r["orphan_rows"] for r in q("fk_orphans").collect()}
    assert orphans["incident->batch"] == t.i.count() - matched


@pytest.mark.parametrize("key", ["operator_mttr", "product_failure_impact", "factor_frequency", "daily_downtime"])
def test_reports_come_in_their_order(q, key):
    from linepulse.plans.registry import ORDER
    rows = [r.asDict() for r in q(key).collect()]
    for c in reversed(ORDER[key]):
        rows_sorted = sorted(rows, key=lambda r: (r[c.lstrip("-")] is not None, r[c.lstrip("-")]), reverse=c[0] == "-")
        assert [r[ORDER[key][0].lstrip("-")] for r in rows] == [r[ORDER[key][0].lstrip("-")] for r in rows_sorted] or c != ORDER[key][0]
