"""Look-back performance reports and the daily roll-up sinks.

The reference joins raw events below a fan-out (customers / segment members /
A-B assignments LEFT JOIN events) and then counts joined rows. Here events
are first reduced to one row per customer (``customer_event_counts``: n,
impressions, clicks), partially aggregated before the shuffle, and the
fan-out joins see one row per customer. The joined-row counts the reference
reports are recovered exactly: a customer contributes ``greatest(n, 1)``
rows to a LEFT JOIN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.functions import expr as X


def window_bounds(as_of, days: int):
    now = X.ntz(as_of)
    return X.days_before(now, days), now


def events_in_window(events: DataFrame, as_of, days: int) -> DataFrame:
    start, end = window_bounds(as_of, days)
    return X.time_window(events, "created_at", start, end)


def customer_event_counts(events: DataFrame, as_of, days: int = S.DEFAULT_DAYS) -> DataFrame:
    """customer_id -> n, impressions, clicks over [as_of - days, as_of)."""
    return (events_in_window(events, as_of, days)
            .groupBy("customer_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 X.count_if(X.is_impression()).alias("impressions"),
                 X.count_if(X.is_click()).alias("clicks")))


def _joined_rows() -> F.Column:
    """Rows a customer contributes to ``LEFT JOIN events``: n, or 1 if none."""
    return F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(1))


def _zero(c: str) -> F.Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


# -- L8 ------------------------------------------------------------------------
def performance_overview(customers: DataFrame, events: DataFrame, as_of, days: int = S.DEFAULT_DAYS,
                         counts: DataFrame | None = None) -> DataFrame:
    """Customers with role 'customer' against their events in the window.

    ``total_recommendations`` is the reference's ``COUNT(*)`` over the LEFT
    JOIN: all events of the window plus one per inactive customer.
    ``customers.id`` is the primary key, so COUNT(DISTINCT id) = count(*).
    """
    counts = counts if counts is not None else customer_event_counts(events, as_of, days)
    c = customers.filter(F.col("role") == "customer").select(F.col("id").alias("customer_id"))
    j = c.join(counts, "customer_id", "left")
    agg = j.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count(F.col("n")).alias("active_customers"),
        _zero("clicks").alias("successful_recommendations"),
        F.sum(_joined_rows()).cast("bigint").alias("total_recommendations"),
    )
    start, end = window_bounds(as_of, days)
    return agg.select(
        "total_customers", "active_customers",
        X.fraction("active_customers", "total_customers").alias("engagement_rate"),
        X.fraction("successful_recommendations", "total_recommendations").alias("avg_recommendation_ctr"),
        F.coalesce("total_recommendations", F.lit(0).cast("bigint")).alias("total_recommendations"),
        "successful_recommendations",
        X.period_text(start, end).alias("date_range"),
    )


# -- L9 / L12 ------------------------------------------------------------------
def segment_activity(segments: DataFrame, user_segments: DataFrame, events: DataFrame, as_of,
                     days: int = S.DEFAULT_DAYS, counts: DataFrame | None = None) -> DataFrame:
    """Per segment, empty segments included: members, active members,
    impressions and clicks of members in the window.

    user_segments.customer_id is UNIQUE, so each member row is a distinct
    customer and COUNT(DISTINCT customer) = count of member rows.
    """
    counts = counts if counts is not None else customer_event_counts(events, as_of, days)
    members = user_segments.select("customer_id", "segment_id").join(counts, "customer_id", "left")
    per_seg = members.groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.count(F.col("n")).alias("active_customers"),
        _zero("impressions").alias("recommendation_impressions"),
        _zero("clicks").alias("recommendation_clicks"),
    )
    seg = segments.select(F.col("id").alias("segment_id"), F.col("name").alias("segment_name"))
    out = seg.join(per_seg, "segment_id", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "segment_id", "segment_name",
        F.coalesce("customer_count", zero).alias("customer_count"),
        F.coalesce("active_customers", zero).alias("active_customers"),
        F.coalesce("recommendation_impressions", zero).alias("recommendation_impressions"),
        F.coalesce("recommendation_clicks", zero).alias("recommendation_clicks"),
    )


def engagement_by_segment(segments: DataFrame, user_segments: DataFrame, events: DataFrame, as_of,
                          days: int = S.DEFAULT_DAYS, counts: DataFrame | None = None,
                          activity: DataFrame | None = None) -> DataFrame:
    """Listing order (customer_count desc) belongs to the sink."""
    a = activity if activity is not None else segment_activity(segments, user_segments, events, as_of, days, counts)
    return a.select(
        "segment_name", "customer_count", "active_customers",
        X.fraction("active_customers", "customer_count").alias("engagement_rate"),
        "recommendation_impressions", "recommendation_clicks",
        X.fraction("recommendation_clicks", "recommendation_impressions").alias("ctr"),
    )


def top_performing_segments(segments: DataFrame, user_segments: DataFrame, events: DataFrame, as_of,
                            days: int = S.DEFAULT_DAYS, n: int = 5, counts: DataFrame | None = None,
                            activity: DataFrame | None = None) -> DataFrame:
    """Segments ranked by engagement rate; a segment without members has no
    rate, ranks after all others and shows 0.0. Ties by name."""
    a = activity if activity is not None else segment_activity(segments, user_segments, events, as_of, days, counts)
    rate = F.when(F.col("customer_count") > 0,
                  F.col("active_customers").cast("double") / F.col("customer_count").cast("double"))
    ranked = a.select("segment_name", "customer_count", rate.alias("rate"))
    # top n first, so the numbering window sees n rows
    order = (F.col("rate").desc_nulls_last(), F.asc("segment_name"))
    ranked = ranked.orderBy(*order).limit(n)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return ranked.select("segment_name", F.coalesce("rate", F.lit(0.0)).alias("engagement_rate"),
                         "customer_count", "rank")


# -- L10 -----------------------------------------------------------------------
def ab_test_results(ab_tests: DataFrame, assignments: DataFrame, events: DataFrame, as_of,
                    days: int = S.DEFAULT_DAYS, counts: DataFrame | None = None) -> DataFrame:
    """Tests that are active or ended inside the window, per variant:
    joined-row count (the reference's ``customer_count``), distinct clickers
    and their ratio; winner A on ties. (customer_id, ab_test_id) is UNIQUE, so
    counting assignment rows with clicks counts distinct customers."""
    counts = counts if counts is not None else customer_event_counts(events, as_of, days)
    start, end = window_bounds(as_of, days)
    tests = ab_tests.filter((F.col("status") == "active") | X.in_range("end_date", start, end))
    a = (assignments.join(tests.select(F.col("id").alias("ab_test_id")), "ab_test_id", "left_semi")
         .select("ab_test_id", "customer_id", "variant")
         .join(counts, "customer_id", "left"))
    is_a, is_b = F.col("variant") == "A", F.col("variant") == "B"
    clicked = F.coalesce(F.col("clicks"), F.lit(0)) > 0
    per_test = a.groupBy("ab_test_id").agg(
        F.sum(F.when(is_a, _joined_rows())).cast("bigint").alias("a_rows"),
        F.sum(F.when(is_b, _joined_rows())).cast("bigint").alias("b_rows"),
        X.count_if(is_a & clicked).alias("a_eng"),
        X.count_if(is_b & clicked).alias("b_eng"),
    )
    out = tests.join(per_test, tests["id"] == per_test["ab_test_id"], "left")
    zero = F.lit(0).cast("bigint")
    a_rows, b_rows = F.coalesce("a_rows", zero), F.coalesce("b_rows", zero)
    a_eng, b_eng = F.coalesce("a_eng", zero), F.coalesce("b_eng", zero)
    a_rate, b_rate = X.fraction(a_eng, a_rows), X.fraction(b_eng, b_rows)
    return out.select(
        F.col("id").alias("test_id"), "test_name", "feature", "variant_a", "variant_b", "status",
        a_rows.alias("variant_a_customer_count"), b_rows.alias("variant_b_customer_count"),
        a_eng.alias("variant_a_engagements"), b_eng.alias("variant_b_engagements"),
        a_rate.alias("variant_a_engagement_rate"), b_rate.alias("variant_b_engagement_rate"),
        zero.alias("variant_a_conversions"), zero.alias("variant_b_conversions"),
        F.when(a_rate >= b_rate, "A").otherwise("B").alias("winning_variant"),
        F.lit(0.0).alias("statistical_significance"),
    )


def ab_test_assigned(ab_tests: DataFrame, assignments: DataFrame) -> DataFrame:
    """Distinct assigned customers per test and variant (the reference's
    ``customer_count`` counts joined rows instead; this is the head count)."""
    per = assignments.groupBy("ab_test_id").agg(
        F.count_distinct(F.when(F.col("variant") == "A", F.col("customer_id"))).alias("variant_a_assigned"),
        F.count_distinct(F.when(F.col("variant") == "B", F.col("customer_id"))).alias("variant_b_assigned"))
    out = ab_tests.join(per, ab_tests["id"] == per["ab_test_id"], "left")
    zero = F.lit(0).cast("bigint")
    return out.select(F.col("id").alias("test_id"), "test_name",
                      F.coalesce("variant_a_assigned", zero).alias("variant_a_assigned"),
                      F.coalesce("variant_b_assigned", zero).alias("variant_b_assigned"))


# -- L11 -----------------------------------------------------------------------
def recommendation_roi(events: DataFrame, as_of, days: int = S.DEFAULT_DAYS) -> DataFrame:
    """Recommendation events (prefix match, pushed to the scan) and clicks;
    ROI in percent and value at a fixed amount per click. Unrounded."""
    ev = events_in_window(events, as_of, days).filter(X.is_recommendation_event())
    agg = ev.agg(F.count(F.lit(1)).alias("total_recommendations"),
                 X.count_if(X.is_click()).alias("clicked_recommendations"))
    total, clicked = F.col("total_recommendations"), F.col("clicked_recommendations")
    return agg.select(
        "total_recommendations", "clicked_recommendations",
        F.when(total > 0, clicked.cast("double") / total.cast("double") * 100).otherwise(0.0).alias("roi_percentage"),
        F.when(total > 0, clicked.cast("double") * S.VALUE_PER_CLICK_IDR).otherwise(0.0).alias("estimated_value_idr"),
    )


# -- A9 / A10 ------------------------------------------------------------------
def engagement_metrics_daily(user_segments: DataFrame, events: DataFrame, as_of,
                             days: int = S.DEFAULT_DAYS) -> DataFrame:
    """Rows of the ``engagement_metrics`` sink: per (segment, day, feature)
    with any member event: segment size, active members, impressions,
    clicks, engagement rate. NULL and '' features share the '' key."""
    ev = events_in_window(events, as_of, days)
    per_customer = ev.groupBy(
        "customer_id", F.to_date("created_at").alias("metric_date"),
        F.coalesce("feature", F.lit("")).alias("feature"),
    ).agg(X.count_if(X.is_impression()).alias("imp"), X.count_if(X.is_click()).alias("clk"))
    members = user_segments.select("customer_id", "segment_id")
    daily = (per_customer.join(members, "customer_id")
             .groupBy("segment_id", "metric_date", "feature")
             .agg(F.count(F.lit(1)).alias("active_customers"),
                  F.sum("imp").cast("bigint").alias("recommendation_impressions"),
                  F.sum("clk").cast("bigint").alias("recommendation_clicks")))
    sizes = members.groupBy("segment_id").agg(F.count(F.lit(1)).alias("total_customers"))
    out = daily.join(sizes, "segment_id")
    return out.select("segment_id", "metric_date", "feature", "total_customers", "active_customers",
                      "recommendation_impressions", "recommendation_clicks",
                      X.fraction("active_customers", "total_customers").alias("engagement_rate"))


def personalization_daily(user_segments: DataFrame, events: DataFrame, as_of,
                          days: int = S.DEFAULT_DAYS) -> DataFrame:
    """Rows of the ``personalization_performance`` sink: recommendation
    events and clicks of segment members per (segment, day)."""
    ev = events_in_window(events, as_of, days).filter(X.is_recommendation_event())
    per_customer = ev.groupBy("customer_id", F.to_date("created_at").alias("date_period")).agg(
        F.count(F.lit(1)).alias("total"), X.count_if(X.is_click()).alias("clicked"))
    members = user_segments.select("customer_id", "segment_id")
    return (per_customer.join(members, "customer_id")
            .groupBy("segment_id", "date_period")
            .agg(F.sum("total").cast("bigint").alias("total_recommendations"),
                 F.sum("clicked").cast("bigint").alias("clicked_recommendations")))
