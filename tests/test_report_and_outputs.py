from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import customers as C
from tessera.operators import recommend as R
from tessera.operators.segmentation import DEFAULT_MODEL
from tessera.plans.report import performance_report, release
from tessera.sources import sinks

AS_OF = "2024-01-31 00:00:00"


def test_performance_report_bundle(t01):
    rep = performance_report(t01, AS_OF, 30)
    r = rep["overall_metrics"].first()
    assert (r.total_customers, r.active_customers, r.total_recommendations) == (1470, 147, 11107)
    assert rep["engagement_by_segment"].count() == 5
    assert rep["top_performing_segments"].orderBy("rank").first().rank == 1
    assert rep["ab_test_results"].count() == 3
    assert rep["recommendation_roi"].first().total_recommendations > 0
    release(rep)


def test_one_customer_lookup(t001):
    tx = C.user_transactions(t001.transactions, t001.accounts, t001.customers)
    by_code = C.for_customer(tx, t001.customers, "CUS-000003").count()
    by_id = C.for_customer(tx, t001.customers, "3").count()
    assert by_code == by_id == tx.filter(F.col("customer_id") == "CUS-000003").count() > 0


def test_nested_homepage_json(t001):
    nested = R.personalization_nested(t001.customers, t001.user_segment_history, t001.segments,
                                      t001.recommendations, t001.user_activities)
    flat = {r.customer_id: r for r in R.personalization(t001.customers, t001.user_segment_history, t001.segments,
                                                         t001.recommendations, t001.user_activities).collect()}
    rows = nested.select("customer_id", F.to_json("homepage").alias("j")).collect()
    assert len(rows) == len(flat)
    for r in rows:
        h = json.loads(r.j)
        f = flat[r.customer_id]
        assert h["primary_feature"] == f.primary_feature
        assert len(h["quick_actions"]) == f.quick_action_count <= 5
        assert len(h["recommended_sections"]) == f.recommended_count


def test_model_round_trip(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    sinks.save_segment_model(spark, DEFAULT_MODEL, f"{d}/m")
    assert sinks.load_segment_model(spark, f"{d}/m") == DEFAULT_MODEL


def test_snapshot_publication(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    v1 = sinks.publish_snapshot(spark.range(3), f"{d}/t")
    v2 = sinks.publish_snapshot(spark.range(5), f"{d}/t")
    assert v1 != v2 and sinks.read_current(spark, f"{d}/t").count() == 5


def test_constraint_report_finds_violations(spark, t001):
    from tessera.operators import merge as G

    class Broken:
        pass
    b = Broken()
    for name in ["customers", "customer_profiles", "accounts", "transactions", "user_activities",
                 "analytics_events", "segments", "user_segments", "recommendations", "ab_tests",
                 "ab_test_assignments"]:
        setattr(b, name, getattr(t001, name))
    b.user_segments = t001.user_segment_history          # customer_id no longer unique
    b.analytics_events = t001.analytics_events.unionByName(
        t001.analytics_events.limit(3).withColumn("customer_id", F.lit(10**9)))  # orphans
    rep = {(r.table_name, r.constraint_name): r.violations for r in G.constraint_report(b).collect()}
    dup_rows = (t001.user_segment_history.groupBy("customer_id").count().filter("count > 1")
                .agg(F.sum("count")).first()[0])
    assert rep[("user_segments", "unique(customer_id)")] == dup_rows > 0
    assert rep[("analytics_events", "fk(customer_id)->customers")] == 3
    assert rep[("customers", "unique(id)")] == 0


def test_cascade_delete_removes_children(t001):
    from tessera.operators import merge as G

    doomed = t001.customers.filter(F.col("id") == 7)
    after = G.cascade_delete(t001, doomed)
    assert after["customers"].filter(F.col("id") == 7).count() == 0
    assert after["analytics_events"].filter(F.col("customer_id") == 7).count() == 0
    assert after["transactions"].filter(F.col("account_id") == 7).count() == 0
    before = t001.analytics_events.count()
    assert after["analytics_events"].count() == before - t001.analytics_events.filter(F.col("customer_id") == 7).count()


def test_visible_rows_admin_and_customer(t001):
    ev = t001.analytics_events
    assert C.visible_rows(ev, "admin", 49).count() == ev.count()
    mine = C.visible_rows(ev, "customer", 7)
    assert mine.count() == ev.filter(F.col("customer_id") == 7).count()
    assert C.admin_only(ev, "customer").count() == 0


def test_partitioned_events_prune_days(spark, t001):
    from tessera.operators import metrics as M
    from tessera.operators import performance as P
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    sinks.append_events(t001.analytics_events, f"{d}/events")
    stored = sinks.read_events_table(spark, f"{d}/events")
    a = P.performance_overview(t001.customers, stored, "2024-01-31 00:00:00", 7).drop("date_range").first()
    b = P.performance_overview(t001.customers, t001.analytics_events, "2024-01-31 00:00:00", 7) \
        .drop("date_range").first()
    assert a == b
    plan = M.dashboard_metrics(stored, "2024-01-31 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date#" in plan


def test_scale_conf_sizes_partitions():
    from tessera.session import scale_conf
    big = scale_conf(100 * 10**12, 8000)           # 100 TB on 1000 executors x 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 74506
    small = scale_conf(40 * 10**6, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert big["spark.sql.files.maxPartitionBytes"] == str(128 << 20)


def test_sql_views_give_the_same_report(spark, t001):
    from tessera.operators import metrics as M
    t001.register_views("t_")
    sql = spark.sql("""
        SELECT COUNT(*) AS total_events,
               COUNT_IF(event_type IN ('recommendation_click', 'recommendation_clicked')) AS clicks
        FROM t_analytics_events""").first()
    df = M.metric_summary(t001.analytics_events).first()
    assert (sql.total_events, sql.clicks) == (df.total_events, df.clicks)
