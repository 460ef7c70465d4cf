"""Golden cases from the reference's sample payloads and seed rows."""

from __future__ import annotations

import datetime as dt

from tessera import schemas as S
from tessera.operators import performance as P
from tessera.operators import recommend as R

AS_OF = "2024-01-31 00:00:00"
T = dt.datetime(2024, 1, 20, 10, 0, 0)


def _events(spark, rows):
    return spark.createDataFrame([(i, c, e, f, "{}", T) for i, (c, e, f) in enumerate(rows)], S.ANALYTICS_EVENTS)


def test_roi_sample(spark):
    # 9 recommendation events of which 2 clicks -> 22.22...% (unrounded), 20000 IDR
    rows = [(1, "recommendation_viewed", "x")] * 5 + [(1, "recommendation_generated", "x")] * 2 \
        + [(1, "recommendation_click", "x"), (2, "recommendation_clicked", "x"), (3, "feature_used", "x")]
    r = P.recommendation_roi(_events(spark, rows), AS_OF, 30).first()
    assert (r.total_recommendations, r.clicked_recommendations) == (9, 2)
    assert abs(r.roi_percentage - 200 / 9) < 1e-12 and r.estimated_value_idr == 20000.0


def test_overview_sample(spark):
    # 6 customers, 5 of them active with one event each -> 6 joined rows, engagement 5/6
    customers = spark.createDataFrame(
        [(i, f"CUS-{i:06d}", None, f"u{i}@x", "customer", True, T) for i in range(1, 7)]
        + [(7, "ADM-000001", None, "a@x", "admin", True, T)], S.CUSTOMERS)
    ev = _events(spark, [(c, "recommendation_viewed", "x") for c in range(1, 6)] + [(7, "recommendation_click", "x")])
    r = P.performance_overview(customers, ev, AS_OF, 30).first()
    assert (r.total_customers, r.active_customers, r.total_recommendations) == (6, 5, 6)
    assert abs(r.engagement_rate - 5 / 6) < 1e-12 and r.successful_recommendations == 0


def test_fallback_for_customer_without_segment(spark):
    # a customer with activity but no segment: top features by usage, priority from 1
    customers = spark.createDataFrame([(6, "CUS-000006", "u6", "u6@x", "customer", True, T)], S.CUSTOMERS)
    acts = spark.createDataFrame(
        [(1, 6, "feature_usage", "transfer", "{}", T), (2, 6, "feature_usage", "transfer", "{}", T),
         (3, 6, "feature_usage", "topup", "{}", T)], S.USER_ACTIVITIES)
    empty_us = spark.createDataFrame([], S.USER_SEGMENTS)
    segs = spark.createDataFrame([(1, "investor", None)], S.SEGMENTS)
    recs = spark.createDataFrame([(1, 1, "promo", "why", 1)], S.RECOMMENDATIONS)
    out = R.recommendations(customers, empty_us, segs, recs, acts).orderBy("priority").collect()
    assert [(r.feature, r.usage_count, r.priority, r.source) for r in out] == \
        [("transfer", 2, 1, "activity"), ("topup", 1, 2, "activity")]
    assert out[0].reason == S.ACTIVITY_REASON
