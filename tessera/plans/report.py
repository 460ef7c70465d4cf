"""The look-back performance report (overview, segments, A/B tests, ROI,
top segments) as one bundle sharing one per-customer pre-aggregate."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tessera import schemas as S
from tessera.operators import performance as P
from tessera.sources.fixtures import Tables


def performance_report(t: Tables, as_of, days: int = S.DEFAULT_DAYS, top_n: int = 5) -> dict[str, DataFrame]:
    """Five DataFrames over the same window. The per-customer event counts
    and the per-segment activity are computed once and kept (memory and
    disk) for the report's lifetime; a lost executor's blocks are recomputed
    from their short lineage (one scan and one aggregate). Call
    ``release(report)`` when done."""
    counts = P.customer_event_counts(t.analytics_events, as_of, days).persist(StorageLevel.MEMORY_AND_DISK)
    activity = P.segment_activity(t.segments, t.user_segments, t.analytics_events, as_of, days, counts) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    return {
        "overall_metrics": P.performance_overview(t.customers, t.analytics_events, as_of, days, counts),
        "engagement_by_segment": P.engagement_by_segment(t.segments, t.user_segments, t.analytics_events,
                                                         as_of, days, activity=activity),
        "ab_test_results": P.ab_test_results(t.ab_tests, t.ab_test_assignments, t.analytics_events, as_of,
                                             days, counts),
        "recommendation_roi": P.recommendation_roi(t.analytics_events, as_of, days),
        "top_performing_segments": P.top_performing_segments(t.segments, t.user_segments, t.analytics_events,
                                                             as_of, days, top_n, activity=activity),
        "_shared": [counts, activity],
    }


def release(report: dict) -> None:
    for df in report.get("_shared", []):
        df.unpersist()
