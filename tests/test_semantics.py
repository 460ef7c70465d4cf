"""Edge semantics on hand-built rows (shaped like the reference's seeds)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import expr as X
from tessera.operators import customers as C
from tessera.operators import merge as G
from tessera.operators import metrics as M
from tessera.operators import performance as P
from tessera.operators import recommend as R

AS_OF = "2024-01-31 00:00:00"


def ts(s):
    return dt.datetime.fromisoformat(s)


def events(spark, rows):
    """rows: (id, customer_id, event_type, feature, created_at)"""
    return spark.createDataFrame(
        [(i, c, e, f, "{}", ts(t)) for i, c, e, f, t in rows], S.ANALYTICS_EVENTS)


def test_rate_golden_values(spark):
    # 6 impressions, 2 clicks, 1 engagement -> ctr 33.33, conversion 50.0
    rows = [(i, 1, "recommendation_impression", "topup", "2024-01-30 10:00:00") for i in range(6)]
    rows += [(10, 1, "recommendation_click", "topup", "2024-01-30 10:00:00"),
             (11, 1, "recommendation_clicked", "", "2024-01-30 10:00:00"),
             (12, 1, "feature_used", None, "2024-01-30 10:00:00")]
    r = M.metric_summary(events(spark, rows)).first()
    assert (r.total_events, r.impressions, r.clicks, r.engagements) == (9, 6, 2, 1)
    assert r.ctr == 33.33 and r.conversion_rate == 50.0


def test_rates_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0, 5, 0, 2.5, 1.0)], "n long, d long, n2 long, d2 long, a double, b double")
    r = df.select(X.pct_rate("n", "d").alias("p"), X.change_rate("d", "d").alias("c0"),
                  X.change_rate("n2", "d2").alias("c100"), X.change_rate("a", "b").alias("c"),
                  X.fraction("n", "d").alias("f")).first()
    assert (r.p, r.c0, r.c100, r.c, r.f) == (0.0, 0.0, 100.0, 150.0, 0.0)


def test_top_features_null_and_empty_are_separate_groups(spark):
    rows = [(1, 1, "feature_used", None, "2024-01-02 00:00:00"),
            (2, 1, "feature_used", None, "2024-01-02 00:00:00"),
            (3, 1, "recommendation_click", "", "2024-01-02 00:00:00"),
            (4, 1, "recommendation_click", "qris", "2024-01-02 00:00:00")]
    out = sorted(tuple(r) for r in M.top_feature_metrics(events(spark, rows), 10).collect())
    assert out == [("", 1, 1), ("", 2, 0), ("qris", 1, 1)]


def test_weekly_chart_seven_rows_zero_filled(spark):
    rows = [(1, 1, "recommendation_click", "x", "2024-01-29 08:00:00"),
            (2, 1, "recommendation_clicked", "x", "2024-01-30 08:00:00"),
            (3, 1, "recommendation_clicked", "x", "2024-01-30 09:00:00"),
            (4, 1, "recommendation_clicked", "x", "2024-01-28 09:00:00")]  # previous week (Sunday)
    out = M.weekly_clicks_chart(events(spark, rows), AS_OF).orderBy("day_no").collect()
    assert [r.label for r in out] == list(S.WEEKDAY_LABELS)
    assert [r.clicks for r in out] == [1, 2, 0, 0, 0, 0, 0]
    assert out[0].period == "2024-01-29 s/d 2024-02-04"


def test_week_of_sunday_starts_previous_monday(spark):
    out = M.weekly_clicks_chart(events(spark, [(1, 1, "x", "x", "2024-01-01 00:00:00")]), "2024-02-04 12:00:00")
    assert out.orderBy("day_no").first().day == dt.date(2024, 1, 29)


def test_dashboard_segment_filter_normalises_names(spark, t01):
    a = M.dashboard_metrics(t01.analytics_events, AS_OF, "Digital Spender", t01.user_segment_history, t01.segments)
    b = M.dashboard_metrics(t01.analytics_events, AS_OF, "digital_spender", t01.user_segment_history, t01.segments)
    assert a.drop("segment").first() == b.drop("segment").first()


def test_overview_probe_values(t01):
    r = P.performance_overview(t01.customers, t01.analytics_events, AS_OF, 30).first()
    assert (r.total_customers, r.active_customers, r.successful_recommendations, r.total_recommendations) == \
        (1470, 147, 1956, 11107)


def test_segment_and_ab_probe_values(t01):
    seg = {r.segment_name: (r.customer_count, r.active_customers, r.recommendation_impressions,
                            r.recommendation_clicks)
           for r in P.engagement_by_segment(t01.segments, t01.user_segments, t01.analytics_events, AS_OF).collect()}
    assert seg["bill_payer"] == (257, 30, 402, 394)
    assert seg["digital_spender"] == (255, 19, 262, 280)
    assert seg["investor"] == (267, 26, 342, 352)
    assert seg["low_activity"] == (262, 25, 319, 328)
    assert seg["empty_segment"] == (0, 0, 0, 0)
    ab = {r.test_id: (r.variant_a_customer_count, r.variant_b_customer_count, r.variant_a_engagements,
                      r.variant_b_engagements)
          for r in P.ab_test_results(t01.ab_tests, t01.ab_test_assignments, t01.analytics_events, AS_OF).collect()}
    assert ab == {1: (1908, 1896, 25, 25), 2: (1205, 1089, 16, 14), 4: (0, 0, 0, 0)}


def test_top_features_and_chart_probe_values(t01):
    top = M.top_feature_metrics(t01.analytics_events, 10).collect()
    assert [(r.feature, r.event_count, r.clicks) for r in top[:3]] == \
        [("topup", 931, 163), ("bill_payment", 926, 191), ("investment", 924, 208)]
    blanks = sorted((r.event_count, r.clicks) for r in top if r.feature == "")
    assert blanks == [(803, 165), (831, 163)]
    chart = M.weekly_clicks_chart(t01.analytics_events, AS_OF).orderBy("day_no").collect()
    assert [r.clicks for r in chart] == [68, 63, 0, 0, 0, 0, 0]


def test_activity_fallback_probe(t01):
    out = R.recommendations(t01.customers, t01.user_segments, t01.segments, t01.recommendations,
                            t01.user_activities)
    assert out.filter(F.col("source") == "activity").select("customer_id").distinct().count() == 80


def test_pre_aggregated_overview_equals_naive_join(t01):
    """R2: per-customer pre-aggregation gives the reference's joined-row counts."""
    start, end = P.window_bounds(AS_OF, 30)
    c = t01.customers.filter(F.col("role") == "customer")
    ev = t01.analytics_events.filter(X.in_range("created_at", start, end))
    naive = c.join(ev, c.id == ev.customer_id, "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.when(ev.id.isNotNull(), c.id)).alias("active")).first()
    r = P.performance_overview(t01.customers, t01.analytics_events, AS_OF, 30).first()
    assert (naive.rows, naive.active) == (r.total_recommendations, r.active_customers)


def test_top_segment_tie_breaks(spark):
    us = spark.createDataFrame([
        (1, 10, 1, 0.9, ts("2024-01-01 00:00:00")),
        (2, 10, 2, 0.9, ts("2024-01-05 00:00:00")),   # same confidence, later -> wins
        (3, 11, 1, 0.5, None),                        # NULL created_at sorts first under DESC
        (4, 11, 2, 0.5, ts("2024-01-05 00:00:00")),
        (5, 12, 9, 0.99, ts("2024-01-05 00:00:00")),  # best assignment's segment missing
        (6, 12, 1, 0.10, ts("2024-01-05 00:00:00")),
    ], S.USER_SEGMENTS)
    seg = spark.createDataFrame([(1, "investor", None), (2, "bill_payer", None)], S.SEGMENTS)
    best = {r.customer_id: r.segment_id for r in C.top_assignment(us).collect()}
    assert best == {10: 2, 11: 1, 12: 9}
    assert {r.customer_id for r in C.top_segment(us, seg).collect()} == {10, 11}
    assert {r.customer_id: r.segment_id for r in C.top_segment(us, seg, join_first=True).collect()} == \
        {10: 2, 11: 1, 12: 1}


def test_resolve_customers_by_id_text_or_public_id(spark, t001):
    keys = spark.createDataFrame([("5",), ("CUS-000007",), ("X-1",), ("",)], "key string")
    out = {r.key: r.id for r in C.resolve_customers(keys, t001.customers).collect()}
    assert out == {"5": 5, "CUS-000007": 7, "X-1": None, "": None}


def test_sequence_ids_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    out = G.sequence_ids(df, ["k"], 100, "seq").orderBy("k").collect()
    assert [r.seq for r in out] == list(range(101, 5101))


def seg_batch(spark, rows):
    return spark.createDataFrame(rows, "pos long, customer_id string, segment_name string, description string, "
                                       "confidence double")


def test_segment_batch_all_or_nothing(spark, t001):
    batch = seg_batch(spark, [(1, "CUS-000001", "investor", "", 0.5),
                              (2, "CUS-000002", "investor", "", 1.1)])
    res = G.apply_segment_updates(batch, t001.customers, t001.segments, t001.user_segments, AS_OF)
    assert res["results"].count() == 0
    assert [r.error for r in res["rejected"].collect()] == ["confidence must be between 0 and 1"]
    assert res["user_segments"].count() == t001.user_segments.count()


def test_segment_batch_actions_and_descriptions(spark, t001):
    # customer 6 has no assignment (6 % 7 == 6); it appears twice
    batch = seg_batch(spark, [(1, "CUS-000006", "brand_new", "first", 0.5),
                              (2, "6", "investor", "", 0.7),
                              (3, "CUS-000001", "brand_new", "", 0.0),
                              (4, "CUS-000002", "bill_payer", "pays bills", 1.0)])
    res = G.apply_segment_updates(batch, t001.customers, t001.segments, t001.user_segments, AS_OF)
    acts = [(r.pos, r.action) for r in res["results"].orderBy("pos").collect()]
    assert acts == [(1, "inserted"), (2, "updated"), (3, "updated"), (4, "updated")]
    segs = {r.name: (r.id, r.description) for r in res["segments"].collect()}
    assert segs["brand_new"] == (6, "first")
    assert segs["bill_payer"][1] == "pays bills"
    assert segs["investor"][1] == "high balance"
    us = {r.customer_id: (r.segment_id, r.confidence) for r in res["user_segments"].collect()}
    assert us[6] == (1, 0.7) and us[1] == (6, 0.0)
    assert res["user_segments"].count() == t001.user_segments.count() + 1


def test_set_tracking_report_and_snapshot(spark, t001):
    upd = spark.createDataFrame([(1, "3", False), (2, "CUS-000004", None), (3, "nobody", True),
                                 (4, "CUS-000003", True)], "seq long, key string, is_activity_tracking_enabled boolean")
    res = G.set_tracking(upd, t001.customers)
    rep = {r.seq: (r.rows_affected, r.status) for r in res["report"].collect()}
    assert rep == {1: (1, "updated"), 2: (0, "invalid"), 3: (0, "not_found"), 4: (1, "updated")}
    snap = {r.id: r.is_activity_tracking_enabled for r in res["customers"].collect()}
    assert snap[3] is True  # last update (seq 4) wins


def test_upsert_updates_and_inserts(spark):
    tgt = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, k string, v double")
    src = spark.createDataFrame([("b", 20.0, 1), ("b", 21.0, 2), ("c", 3.0, 1)], "k string, v double, seq int")
    out = {r.k: (r.id, r.v) for r in G.upsert(tgt, src, ["k"], ["v"], order_col="seq").collect()}
    assert out == {"a": (1, 1.0), "b": (2, 21.0), "c": (3, 3.0)}


def test_engagement_dashboard_without_clicked_features(spark):
    rows = [(1, 1, "recommendation_viewed", "qris", "2024-01-30 10:00:00"),
            (2, 1, "recommendation_click", "", "2024-01-30 10:00:00")]   # a click, but no named feature
    out = M.engagement_dashboard(events(spark, rows), AS_OF).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.rank, r.feature, r.total_clicks) == (None, None, None)
    assert (r.ctr, r.total_clicks_this_week, r.period) == (100.0, 1, "2024-01-24 to 2024-01-31")


def test_empty_segment_ranks_last(t01):
    ranked = P.top_performing_segments(t01.segments, t01.user_segments, t01.analytics_events, AS_OF, 30, n=5) \
        .orderBy("rank").collect()
    assert ranked[-1].segment_name == "empty_segment"
    assert ranked[-1].engagement_rate == 0.0 and ranked[-1].customer_count == 0
    rates = [r.engagement_rate for r in ranked[:-1]]
    assert rates == sorted(rates, reverse=True)
