"""Invariants and plans of reads, analytics, triage and workflow."""

import datetime

from pyspark.sql import functions as F

from parcelforge.operators import analytics, reads, triage, workflow
from parcelforge.plans.views import as_of, parcels


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lights_add_up(spark, small):
    r = analytics.summary(parcels(spark, small), as_of()).first()
    assert r.auto_validated + r.needs_review + r.flagged == r.total_parcels > 0


def test_filters_reach_the_scan_and_columns_are_pruned(spark, small):
    t = spark.read.parquet(f"{small}/orders.parquet").filter("o_orderkey = 5").select("o_custkey")
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,5)]" in plan(t)
    p = plan(analytics.districts(parcels(spark, small), as_of()))
    assert "c_name" not in p and "c_acctbal" not in p and "CartesianProduct" not in p and "Python" not in p


def test_timeseries_is_dense_and_ordered(spark):
    days = [r.day for r in analytics.calendar(spark, "2024-01-31", 30).orderBy("day").collect()]
    assert len(days) == 30 and days[-1] == datetime.date(2024, 1, 31) and days == sorted(set(days))


def test_page_is_deterministic(spark, small):
    p = parcels(spark, small)
    whole = [r.id for r in reads.page(p, "priority", limit=100).collect()]
    halves = [r.id for k in (0, 50) for r in reads.page(p, "priority", limit=50, offset=k).collect()]
    assert whole == halves


def _score(spark, **v):
    row = {"mismatch": None, "severity": None, "confidence": None, "issue_count": 0, "action": None} | v
    df = spark.createDataFrame([tuple(row.values())], "mismatch double, severity string, confidence double, issue_count int, action string")
    return df.select(triage.score().alias("s"), triage.band(triage.score()).alias("b"), triage.reasons().alias("r")).first()


def test_triage(spark):
    clean = _score(spark)
    assert clean.s == 12.8 and clean.b == "normal"
    assert _score(spark, mismatch=0.0).s == clean.s
    worst = _score(spark, mismatch=100.0, severity="critical", confidence=0.0, issue_count=9, action="reject_re_scan")
    assert worst.s == 100.0 and worst.b == "critical" and len(worst.r) == 3
    assert _score(spark, confidence=1.0, action="auto_approve").r == ["No findings"]


def test_transition_accounts_for_every_request(spark):
    p = spark.createDataFrame([(1, "pending", None), (2, "approved", "x")], "id long, review_status string, assigned_to string").withColumn("decided_at", F.lit(None).cast("timestamp_ntz"))
    q = spark.createDataFrame([(1, "in_review", "me", "reviewer"), (2, "rejected", "me", "reviewer"), (2, "in_review", "me", "operator"), (9, "approved", "me", "admin")], "parcel_id long, target string, actor string, role string")
    got = {(r.parcel_id, r.target): (r.reason, r.review_status, r.assigned_to) for r in workflow.transition(q, p, as_of()).collect()}
    assert got == {(1, "in_review"): (None, "in_review", "me"), (2, "rejected"): ("not allowed", "approved", "x"), (2, "in_review"): ("needs a reviewer", "approved", "x"), (9, "approved"): ("not found", None, None)}


def test_facet_tree(spark):
    p = spark.createDataFrame([("KA", "B", "v"), ("KA", "B", "v"), ("KA", None, "w"), (None, None, None)], "state string, district string, village string")
    tree = {r.state: dict(r.districts) for r in reads.facet_tree(p).collect()}
    assert tree == {"KA": {"B": '{"v":2}', "Unknown": '{"w":1}'}, "Unknown": {"Unknown": '{"Unknown":1}'}}
