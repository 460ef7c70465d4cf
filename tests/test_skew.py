"""One customer holding a third of all rows: results stay exact, the hot
key's join input is split by AQE, and aggregations combine map-side."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions.joins import stored_aliases
from tessera.operators import customers as C
from tessera.operators import ingest as I
from tessera.operators import merge as G
from tessera.operators import metrics as M
from tessera.operators import performance as P

AS_OF = "2024-01-31 00:00:00"

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _skewed_events(spark, n=30000):
    base = dt.datetime(2024, 1, 10)
    hot = spark.range(n // 3).select(F.col("id"), F.lit(1).cast("long").alias("customer_id"))
    rest = spark.range(n // 3, n).select(F.col("id"), (F.col("id") % 140 + 2).alias("customer_id"))
    ev = hot.unionByName(rest).select(
        "id", "customer_id",
        F.when(F.col("id") % 3 == 0, "recommendation_click").otherwise("recommendation_viewed").alias("event_type"),
        F.lit("qris").alias("feature"), F.lit("{}").alias("metadata"),
        F.lit(base).cast("timestamp_ntz").alias("created_at"))
    return ev


def test_skewed_join_is_split_and_exact(spark, t001):
    ev = _skewed_events(spark)

    def run():
        vis = ev.join(t001.customers.select(F.col("id").alias("customer_id"), F.col("customer_id").alias("code")),
                      "customer_id")
        out = vis.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        rows = {r.code: r.n for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
        return rows, plan
    rows, plan = _with_conf(spark, SKEW_CONF, run)
    assert rows["CUS-000001"] == 10000
    assert sum(rows.values()) == 30000
    assert "skew=true" in plan


def test_hot_customer_pre_aggregation_exact(spark, t001):
    ev = _skewed_events(spark)
    counts = _with_conf(spark, SKEW_CONF, lambda: {
        r.customer_id: (r.n, r.clicks) for r in P.customer_event_counts(ev, AS_OF, 30).collect()})
    assert counts[1][0] == 10000 and counts[1][1] == 3334
    overview = _with_conf(spark, SKEW_CONF, lambda: P.performance_overview(
        t001.customers, ev, AS_OF, 30).first())
    # every event of an existing role=customer row, plus one row per inactive customer
    active = {c for c in counts if c < 150 and c % 50 != 49}
    assert overview.active_customers == len(active)


def test_top_assignment_with_hot_customer(spark):
    # a customer with a third of all history rows: max(struct) combines map-side
    rows = [(i, 1 if i % 3 == 0 else i, 1, (i % 97) / 100.0, dt.datetime(2024, 1, 1)) for i in range(3000)]
    us = spark.createDataFrame(rows, S.USER_SEGMENTS)
    best = {r.customer_id: r.confidence for r in C.top_assignment(us).collect()}
    assert best[1] == max(conf for _, cust, _, conf, _ in rows if cust == 1)
    plan = C.top_assignment(us)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_in_validation_is_split(spark, t001):
    raw = spark.range(30000).select(
        F.col("id").alias("raw_id"),
        F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "CUS-000001")
         .otherwise((F.col("id") % 140 + 1).cast("string")).alias("customer_id"),
        F.lit("feature_used").alias("event_type"), F.lit("qris").alias("feature"), F.lit("{}").alias("metadata"),
        F.lit(dt.datetime(2024, 1, 10)).cast("timestamp_ntz").alias("received_at"))
    batch = raw.select(F.col("raw_id").alias("pos"), "customer_id", F.lit("investor").alias("segment_name"),
                       F.lit("").alias("description"), F.lit(0.5).alias("confidence"))

    def run():
        aliases = stored_aliases(t001.customers)
        events = I.validate_events(raw, t001.customers, "admin", "CUS-000049", aliases=aliases).select("cid", "error")
        rows = G.validate_segment_batch(batch, t001.customers, aliases).select("cid", "error")
        return (_plan(events), events.filter("error IS NULL AND cid = 49").count(),
                _plan(rows), rows.filter("error IS NULL").count())
    plan, own, plan2, good = _with_conf(spark, SKEW_CONF, run)
    assert "skew=true" in plan and own >= 10000
    assert "skew=true" in plan2 and good == 20000


def test_hot_foreign_key_and_segment_dashboard_meet_the_join_once(spark, t001):
    ev = _skewed_events(spark)

    def run():
        o = G._orphans(ev, "analytics_events", "customer_id", t001.customers, "id", "customers")
        d = M.dashboard_metrics(ev, "2024-01-15 00:00:00", "investor", t001.user_segment_history, t001.segments)
        rows = o.collect()
        return rows[0], _plan(o), _plan(d)
    row, orphans, dashboard = _with_conf(spark, SKEW_CONF, run)
    assert row.checked_rows == 30000 and row.violations == 0
    # the events are aggregated below the join (plans are printed from the top down)
    for plan in (orphans, dashboard):
        assert -1 < plan.find("Join") < plan.rfind("partial_count")
