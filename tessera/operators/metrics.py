"""Event metrics: summary, feature tables, week-over-week dashboard, chart.

Every report reads ``analytics_events`` once. Counters are conditional
aggregates (``count(when(..))``) so one scan feeds all of them, and a
global aggregate still yields its single row on empty input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.operators.customers import top_segment


def metric_summary(events: DataFrame) -> DataFrame:
    """Totals by event class plus CTR and conversion rate in percent."""
    agg = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        X.count_if(X.is_impression()).alias("impressions"),
        X.count_if(X.is_click()).alias("clicks"),
        X.count_if(X.is_engagement()).alias("engagements"),
    )
    return agg.select(
        "total_events", "impressions", "clicks", "engagements",
        X.pct_rate("clicks", "impressions").alias("ctr"),
        X.pct_rate("engagements", "clicks").alias("conversion_rate"),
    )


def top_feature_metrics(events: DataFrame, n: int = 10) -> DataFrame:
    """Events and clicks per raw feature value, top ``n``.

    Grouping is on the raw column, so NULL and '' stay separate groups; both
    are shown as ''. The order is (event_count desc, clicks desc, feature asc)
    and the limit plans as a TakeOrderedAndProject (top-n per partition).
    """
    per_feature = events.groupBy("feature").agg(
        F.count(F.lit(1)).alias("event_count"),
        X.count_if(X.is_click()).alias("clicks"),
    )
    shown = per_feature.select(F.coalesce("feature", F.lit("")).alias("feature"), "event_count", "clicks")
    return shown.orderBy(F.desc("event_count"), F.desc("clicks"), F.asc("feature")).limit(n)


def _week_counts(events: DataFrame, now, this_start, last_start, *by: str) -> DataFrame:
    this_week = X.in_range("created_at", this_start, now)
    last_week = X.in_range("created_at", last_start, this_start)
    return events.groupBy(*by).agg(
        X.count_if(this_week & X.is_impression()).alias("imp_now"),
        X.count_if(this_week & X.is_click()).alias("click_now"),
        X.count_if(this_week & X.is_engagement()).alias("eng_now"),
        X.count_if(last_week & X.is_impression()).alias("imp_last"),
        X.count_if(last_week & X.is_click()).alias("click_last"),
        X.count_if(last_week & X.is_engagement()).alias("eng_last"),
    )


def dashboard_metrics(events: DataFrame, as_of, segment: str | None = None,
                      user_segments: DataFrame | None = None,
                      segments: DataFrame | None = None) -> DataFrame:
    """CTR, conversion and clicks for [as_of-7d, as_of) against the week
    before, with change rates. With ``segment``, only events of customers
    whose top-1 segment has that name (case- and '_'/' '-insensitive).

    Both counter ranges lie inside [as_of-14d, as_of), so that range is
    applied as a plain filter first: it reaches the parquet scan and the
    segment join only sees two weeks of events.
    """
    now = X.ntz(as_of)
    this_start = X.days_before(now, 7)
    last_start = X.days_before(now, 14)
    ev = X.time_window(events, "created_at", last_start, now)
    if segment:
        if user_segments is None or segments is None:
            raise ValueError("segment filter needs user_segments and segments")
        members = (top_segment(user_segments, segments)
                   .filter(X.normalize_name("segment_name") == X.normalize_name(F.lit(segment)))
                   .select("customer_id"))
        # Six counters per customer before the join: a hot customer's events never meet in it.
        # top_segment has one row per customer, so a semi join equals the inner join.
        per_customer = _week_counts(ev, now, this_start, last_start, "customer_id")
        mine = per_customer.join(members, "customer_id", "left_semi").drop("customer_id")
        w = mine.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in mine.columns])
    else:
        w = _week_counts(ev, now, this_start, last_start)
    ctr_now = X.pct_rate("click_now", "imp_now")
    ctr_last = X.pct_rate("click_last", "imp_last")
    conv_now = X.pct_rate("eng_now", "click_now")
    conv_last = X.pct_rate("eng_last", "click_last")
    rates = w.select(
        ctr_now.alias("ctr"), ctr_last.alias("ctr_last_week"),
        conv_now.alias("conversion_rate"), conv_last.alias("conversion_rate_last_week"),
        F.col("click_now").cast("double").alias("total_clicks"),
        F.col("click_last").cast("double").alias("total_clicks_last_week"),
    )
    return rates.select(
        "ctr", "ctr_last_week", X.change_rate("ctr", "ctr_last_week").alias("ctr_change_rate"),
        "conversion_rate", "conversion_rate_last_week",
        X.change_rate("conversion_rate", "conversion_rate_last_week").alias("conversion_rate_change_rate"),
        "total_clicks", "total_clicks_last_week",
        X.change_rate("total_clicks", "total_clicks_last_week").alias("total_clicks_change_rate"),
        F.lit(segment or "").alias("segment"),
    )


def weekly_clicks_chart(events: DataFrame, as_of) -> DataFrame:
    """Clicks per day for Monday..Sunday of the week holding ``as_of``:
    always 7 rows, zero-filled, Indonesian day labels, period text."""
    spark = events.sparkSession
    now = X.ntz(as_of)
    monday = X.week_monday(now)
    week_end = F.timestamp_add("DAY", F.lit(7), monday)
    daily = (X.time_window(events, "created_at", monday, week_end).filter(X.is_click())
             .groupBy(F.to_date("created_at").alias("day"))
             .agg(F.count(F.lit(1)).alias("clicks")))
    calendar = spark.range(7).select(
        (F.col("id") + 1).cast("int").alias("day_no"),
        F.date_add(F.to_date(monday), F.col("id").cast("int")).alias("day"),
        X.weekday_label(F.col("id")).alias("label"),
    )
    # ``daily`` is filtered to one week, so it has at most 7 rows: safe to broadcast.
    out = calendar.join(F.broadcast(daily), "day", "left")
    return out.select(
        "day_no", "day", "label",
        F.coalesce("clicks", F.lit(0).cast("bigint")).alias("clicks"),
        X.period_text(monday, F.timestamp_add("DAY", F.lit(6), monday), " s/d ").alias("period"),
    )


def _clicks_by_feature(events: DataFrame) -> DataFrame:
    return (events.filter(X.is_click() & X.non_empty("feature"))
            .groupBy("feature").agg(F.count(F.lit(1)).alias("total_clicks")))


def top_clicked_features(events: DataFrame, n: int = 3) -> DataFrame:
    """All-time clicks per non-empty feature, ranked; ties by feature name."""
    order = [F.desc("total_clicks"), F.asc("feature")]
    top = _clicks_by_feature(events).orderBy(*order).limit(n)
    # the window only sees the n rows left by the top-n
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"),
                      "feature", "total_clicks")


def engagement_dashboard(events: DataFrame, as_of, n: int = 3) -> DataFrame:
    """All-time CTR and conversion, clicks since as_of-7d (no upper bound),
    and the top-``n`` clicked features: one row per ranked feature.

    One scan: events are reduced to one row per feature value first; the totals are a plain aggregate of those
    rows and the top ``n`` an ordered limit, handed over as one array of at most ``n`` items, so no task holds
    all features. Both need the same columns and filter only after the limit, so they share one shuffle of the events.
    When no feature has clicks a single row with NULL rank/feature remains.
    """
    now = X.ntz(as_of)
    since = X.days_before(now, 7)
    per_feature = events.groupBy("feature").agg(
        X.count_if(X.is_impression()).alias("imp"),
        X.count_if(X.is_click()).alias("clk"),
        X.count_if(X.is_engagement()).alias("eng"),
        X.count_if(X.is_click() & (F.col("created_at") >= since)).alias("wclk"),
    )
    ranked = X.non_empty("feature") & (F.col("clk") > 0)
    first = per_feature.withColumn("ranked", ranked).orderBy(F.desc("ranked"), F.desc("clk"), F.asc("feature")).limit(n)
    top = first.agg(F.array_sort(F.collect_list(F.when(F.col("ranked"), F.struct(
        (-F.col("clk")).alias("k"), "feature", "clk", "imp", "eng", "wclk")))).alias("top"))
    zero = F.lit(0).cast("bigint")
    totals = per_feature.agg(*[F.coalesce(F.sum(c), zero).alias(f"{c}_all") for c in ("imp", "clk", "eng", "wclk")])
    shown = totals.select("*", F.posexplode_outer(top.scalar()).alias("pos", "x"))
    return shown.select(
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("x.feature").alias("feature"),
        F.col("x.clk").alias("total_clicks"),
        X.pct_rate("clk_all", "imp_all").alias("ctr"),
        X.pct_rate("eng_all", "clk_all").alias("conversion_rate"),
        F.col("wclk_all").alias("total_clicks_this_week"),
        X.period_text(since, now).alias("period"),
    )
