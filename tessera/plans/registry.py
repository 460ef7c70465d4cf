"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus the
matching DuckDB oracle statement where one exists.

Each query reads the full input tables of ``sf_dir`` through
:class:`tessera.sources.fixtures.Tables`; report parameters are fixed here
(``as_of`` = 2024-01-31, 30 days, the sizes of the top-n reports).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.operators import customers as C
from tessera.operators import features as FE
from tessera.operators import ingest as I
from tessera.operators import merge as G
from tessera.operators import metrics as M
from tessera.operators import performance as P
from tessera.operators import recommend as R
from tessera.operators import segmentation as SG
from tessera.plans import jobs as J
from tessera.plans import oracle as O
from tessera.sources import feeds as FD
from tessera.sources.fixtures import Tables
from tessera.streaming import streams as ST

AS_OF = S.DEFAULT_AS_OF
DAYS = S.DEFAULT_DAYS

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: _fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return register


# ---------------------------------------------------------------------------
# Event metrics
# ---------------------------------------------------------------------------
@query("metric_summary", O.with_views(f"""
SELECT total_events, impressions, clicks, engagements,
       {O.pct('clicks', 'impressions')} AS ctr, {O.pct('engagements', 'clicks')} AS conversion_rate
FROM (SELECT COUNT(*) AS total_events,
             COUNT(*) FILTER (WHERE event_type IN {O.IMP}) AS impressions,
             COUNT(*) FILTER (WHERE event_type IN {O.CLK}) AS clicks,
             COUNT(*) FILTER (WHERE event_type IN {O.ENG}) AS engagements
      FROM analytics_events) t"""))
def _metric_summary(t: Tables) -> DataFrame:
    return M.metric_summary(t.analytics_events)


@query("top_feature_metrics", O.with_views(f"""
SELECT COALESCE(ae.feature, '') AS feature, COUNT(*) AS event_count,
       COUNT(*) FILTER (WHERE ae.event_type IN {O.CLK}) AS clicks
FROM analytics_events ae GROUP BY ae.feature
ORDER BY event_count DESC, clicks DESC, feature ASC LIMIT 10"""))
def _top_feature_metrics(t: Tables) -> DataFrame:
    return M.top_feature_metrics(t.analytics_events, 10)


def _dashboard_sql(source: str, segment: str) -> str:
    now, wk, lw = O.AS_OF, O.days_before(7), O.days_before(14)
    this_w = f"created_at >= {wk} AND created_at < {now}"
    last_w = f"created_at >= {lw} AND created_at < {wk}"
    return f"""
SELECT ctr, ctr_last_week, {O.change('ctr', 'ctr_last_week')} AS ctr_change_rate,
       conversion_rate, conversion_rate_last_week,
       {O.change('conversion_rate', 'conversion_rate_last_week')} AS conversion_rate_change_rate,
       total_clicks, total_clicks_last_week,
       {O.change('total_clicks', 'total_clicks_last_week')} AS total_clicks_change_rate,
       '{segment}' AS segment
FROM (SELECT {O.pct('click_now', 'imp_now')} AS ctr, {O.pct('click_last', 'imp_last')} AS ctr_last_week,
             {O.pct('eng_now', 'click_now')} AS conversion_rate, {O.pct('eng_last', 'click_last')} AS conversion_rate_last_week,
             CAST(click_now AS DOUBLE) AS total_clicks, CAST(click_last AS DOUBLE) AS total_clicks_last_week
      FROM (SELECT COUNT(*) FILTER (WHERE {this_w} AND event_type IN {O.IMP}) AS imp_now,
                   COUNT(*) FILTER (WHERE {this_w} AND event_type IN {O.CLK}) AS click_now,
                   COUNT(*) FILTER (WHERE {this_w} AND event_type IN {O.ENG}) AS eng_now,
                   COUNT(*) FILTER (WHERE {last_w} AND event_type IN {O.IMP}) AS imp_last,
                   COUNT(*) FILTER (WHERE {last_w} AND event_type IN {O.CLK}) AS click_last,
                   COUNT(*) FILTER (WHERE {last_w} AND event_type IN {O.ENG}) AS eng_last
            FROM {source}) w) r"""


@query("dashboard_metrics", O.with_views(_dashboard_sql("analytics_events", "")))
def _dashboard_metrics(t: Tables) -> DataFrame:
    return M.dashboard_metrics(t.analytics_events, AS_OF)


SEGMENT_FILTER = "digital spender"


@query("dashboard_metrics_segment", O.with_views(
    _dashboard_sql("seg_events", SEGMENT_FILTER),
    ("top1", O.top1()),
    ("seg_events", f"""
SELECT ae.* FROM analytics_events ae JOIN top1 us ON us.customer_id = ae.customer_id
JOIN segments s ON us.segment_id = s.id
WHERE lower(replace(s.name, '_', ' ')) = lower(replace('{SEGMENT_FILTER}', '_', ' '))""")))
def _dashboard_metrics_segment(t: Tables) -> DataFrame:
    return M.dashboard_metrics(t.analytics_events, AS_OF, SEGMENT_FILTER,
                               t.user_segment_history, t.segments)


@query("weekly_clicks_chart", O.with_views(f"""
SELECT cal.day_no, cal.day, cal.label, COALESCE(daily.clicks, 0) AS clicks,
       strftime(mon.m, '%Y-%m-%d') || ' s/d ' || strftime(mon.m + INTERVAL 6 DAY, '%Y-%m-%d') AS period
FROM cal CROSS JOIN mon LEFT JOIN daily ON daily.day = cal.day""",
    ("mon", f"SELECT date_trunc('week', {O.AS_OF}) AS m"),
    ("cal", """SELECT CAST(i + 1 AS INTEGER) AS day_no, CAST(m AS DATE) + CAST(i AS INTEGER) AS day,
       ['Senin', 'Selasa', 'Rabu', 'Kamis', 'Jumat', 'Sabtu', 'Minggu'][i + 1] AS label
FROM mon CROSS JOIN range(7) t(i)"""),
    ("daily", f"""SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS clicks FROM analytics_events CROSS JOIN mon
WHERE event_type IN {O.CLK} AND created_at >= m AND created_at < m + INTERVAL 7 DAY GROUP BY 1""")))
def _weekly_clicks_chart(t: Tables) -> DataFrame:
    return M.weekly_clicks_chart(t.analytics_events, AS_OF)


TOP3_SQL = f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, feature ASC) AS BIGINT) AS "rank",
       feature, COUNT(*) AS total_clicks
FROM analytics_events
WHERE event_type IN {O.CLK} AND feature IS NOT NULL AND feature <> ''
GROUP BY feature ORDER BY total_clicks DESC, feature ASC LIMIT 3"""


@query("top_clicked_features", O.with_views(TOP3_SQL))
def _top_clicked_features(t: Tables) -> DataFrame:
    return M.top_clicked_features(t.analytics_events, 3)


@query("engagement_dashboard", O.with_views(f"""
SELECT t."rank", t.feature, t.total_clicks, {O.pct('m.clk', 'm.imp')} AS ctr,
       {O.pct('m.eng', 'm.clk')} AS conversion_rate, m.wclk AS total_clicks_this_week,
       strftime({O.days_before(7)}, '%Y-%m-%d') || ' to ' || strftime({O.AS_OF}, '%Y-%m-%d') AS period
FROM m LEFT JOIN top3 t ON TRUE""",
    ("m", f"""SELECT COUNT(*) FILTER (WHERE event_type IN {O.IMP}) AS imp,
       COUNT(*) FILTER (WHERE event_type IN {O.CLK}) AS clk,
       COUNT(*) FILTER (WHERE event_type IN {O.ENG}) AS eng,
       COUNT(*) FILTER (WHERE event_type IN {O.CLK} AND created_at >= {O.days_before(7)}) AS wclk
FROM analytics_events"""),
    ("top3", TOP3_SQL)))
def _engagement_dashboard(t: Tables) -> DataFrame:
    return M.engagement_dashboard(t.analytics_events, AS_OF, 3)


# ---------------------------------------------------------------------------
# customers
# ---------------------------------------------------------------------------
def _lookup_keys(t: Tables) -> DataFrame:
    """One lookup request per event: the customer named by internal id as
    text, by public id, or by an unknown key."""
    e = t.raw("events")
    r = F.col("event_id") % 3
    key = (F.when(r == 0, F.col("user_id").cast("string"))
           .when(r == 1, F.format_string(S.CUSTOMER_ID_FORMAT, F.col("user_id")))
           .otherwise(F.concat(F.lit("X-"), F.col("user_id").cast("string"))))
    return e.select(F.col("event_id").alias("request_id"), key.alias("key"))


@query("resolve_customers", O.with_views("""
SELECT k.request_id, k.key, c.id, c.customer_id
FROM keys k LEFT JOIN customers c ON CAST(c.id AS VARCHAR) = k.key OR c.customer_id = k.key""",
    ("keys", """SELECT event_id AS request_id,
       CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN printf('CUS-%06d', user_id)
            ELSE 'X-' || CAST(user_id AS VARCHAR) END AS key FROM events""")))
def _resolve_customers(t: Tables) -> DataFrame:
    return C.resolve_customers(_lookup_keys(t), t.customers)


PRINCIPAL_ID = 7


@query("visible_rows", O.with_views(f"SELECT * FROM analytics_events WHERE customer_id = {PRINCIPAL_ID}"))
def _visible_rows(t: Tables) -> DataFrame:
    return C.visible_rows(t.analytics_events, "customer", PRINCIPAL_ID)


@query("top_segment", O.with_views("""
SELECT t.customer_id, t.segment_id, t.confidence, t.created_at AS assigned_at,
       s.name AS segment_name, s.description AS segment_description
FROM top1 t JOIN segments s ON s.id = t.segment_id""", ("top1", O.top1())))
def _top_segment(t: Tables) -> DataFrame:
    return C.top_segment(t.user_segment_history, t.segments)


# One row per customer; the profile is looked up, not joined.
PROFILE_SQL = """
SELECT c.* REPLACE (COALESCE(c.username, '') AS username),
       COALESCE((SELECT MAX(p.full_name) FROM customer_profiles p WHERE p.customer_id = c.id), '') AS full_name
FROM customers c"""


@query("user_profiles", O.with_views(PROFILE_SQL))
def _user_profiles(t: Tables) -> DataFrame:
    return C.user_profiles(t.customers, t.customer_profiles)


@query("users_with_segments", O.with_views("""
SELECT profile.*, COALESCE(held.segment, '') AS segment, COALESCE(held.confidence, 0) AS confidence, held.assigned_at
FROM profile LEFT JOIN held ON held.owner = profile.id""",
    ("top1", O.top1()), ("profile", PROFILE_SQL),
    ("held", """SELECT customer_id AS owner, confidence, created_at AS assigned_at,
       (SELECT MAX(s.name) FROM segments s WHERE s.id = top1.segment_id) AS segment FROM top1""")))
def _users_with_segments(t: Tables) -> DataFrame:
    return C.users_with_segments(t.customers, t.customer_profiles, t.user_segment_history, t.segments)


@query("user_transactions", O.with_views("""
SELECT c.customer_id, t.trx_id, t.type, CAST(t.amount AS DOUBLE) AS amount, t.status, t.created_at
FROM transactions t JOIN accounts a ON a.id = t.account_id JOIN customers c ON c.id = a.customer_id"""))
def _user_transactions(t: Tables) -> DataFrame:
    return C.user_transactions(t.transactions, t.accounts, t.customers)


@query("frequent_features", O.with_views("""
SELECT c.customer_id, ua.feature, COUNT(*) AS usage_count, MAX(ua.created_at) AS last_used_at
FROM user_activities ua JOIN customers c ON c.id = ua.customer_id
WHERE ua.feature IS NOT NULL GROUP BY c.customer_id, ua.feature"""))
def _frequent_features(t: Tables) -> DataFrame:
    return C.frequent_features(t.user_activities, t.customers)


@query("user_activity", O.with_views("""
SELECT c.customer_id, COALESCE(tx.n, 0) AS transaction_count, COALESCE(fu.n, 0) AS feature_count,
       tx.latest AS latest_transaction_at, fu.last_used AS last_feature_used_at
FROM customers c
LEFT JOIN (SELECT a.customer_id AS cid, COUNT(*) AS n, MAX(t.created_at) AS latest
           FROM transactions t JOIN accounts a ON a.id = t.account_id GROUP BY a.customer_id) tx ON tx.cid = c.id
LEFT JOIN (SELECT customer_id AS cid, COUNT(DISTINCT feature) AS n, MAX(created_at) AS last_used
           FROM user_activities WHERE feature IS NOT NULL GROUP BY customer_id) fu ON fu.cid = c.id"""))
def _user_activity(t: Tables) -> DataFrame:
    return C.user_activity(t.customers, t.transactions, t.accounts, t.user_activities)


@query("user_activity_items", O.with_views("""
SELECT c.customer_id, 'transaction' AS kind, t.trx_id AS item, t.type, CAST(t.amount AS DOUBLE) AS amount, t.status,
       CAST(NULL AS BIGINT) AS usage_count, t.created_at AS happened_at
FROM transactions t, accounts a, customers c WHERE a.id = t.account_id AND c.id = a.customer_id
UNION ALL
SELECT c.customer_id, 'feature', u.feature, NULL, NULL, NULL, COUNT(*), MAX(u.created_at)
FROM user_activities u, customers c WHERE c.id = u.customer_id AND u.feature IS NOT NULL GROUP BY c.customer_id, u.feature"""))
def _user_activity_items(t: Tables) -> DataFrame:
    return C.user_activity_items(t.customers, t.transactions, t.accounts, t.user_activities)


@query("user_segmentation", O.with_views("""
SELECT c.customer_id, s.id AS segment_id, s.name AS segment_name, COALESCE(s.description, '') AS description,
       us.confidence, us.created_at AS assigned_at, r.rec_id, r.rec_feature, r.rec_reason, r.rec_priority
FROM user_segment_history us JOIN segments s ON s.id = us.segment_id
LEFT JOIN (SELECT segment_id, id AS rec_id, COALESCE(feature, '') AS rec_feature,
                  COALESCE(reason, '') AS rec_reason, priority AS rec_priority FROM recommendations) r
       ON r.segment_id = s.id
JOIN customers c ON c.id = us.customer_id"""))
def _user_segmentation(t: Tables) -> DataFrame:
    return C.user_segmentation(t.customers, t.user_segment_history, t.segments, t.recommendations)


# ---------------------------------------------------------------------------
# Look-back performance
# ---------------------------------------------------------------------------

WIN_START, WIN_END = O.days_before(DAYS), O.AS_OF
IN_WIN = f"ae.created_at >= {WIN_START} AND ae.created_at < {WIN_END}"

# The look-back checks count events and people apart. Where a report counts the rows of
# people left-joined with events, that number is the events plus the people without any.
RECENT = ("recent", f"SELECT ae.* FROM analytics_events ae WHERE {IN_WIN}")
SEEN = "EXISTS (SELECT 1 FROM recent e WHERE e.customer_id = {})"


@query("performance_overview", O.with_views(f"""
SELECT people AS total_customers, seen AS active_customers, {O.frac('seen', 'people')} AS engagement_rate,
       {O.frac('clicks', '(events + people - seen)')} AS avg_recommendation_ctr,
       events + people - seen AS total_recommendations, clicks AS successful_recommendations,
       strftime({WIN_START}, '%Y-%m-%d') || ' to ' || strftime({WIN_END}, '%Y-%m-%d') AS date_range
FROM (SELECT (SELECT COUNT(*) FROM who) AS people, (SELECT COUNT(*) FROM who WHERE seen) AS seen,
             (SELECT COUNT(*) FROM theirs) AS events,
             (SELECT COUNT(*) FROM theirs WHERE event_type IN {O.CLK}) AS clicks) n""",
    RECENT, ("who", f"SELECT id, {SEEN.format('p.id')} AS seen FROM customers p WHERE role = 'customer'"),
    ("theirs", "SELECT event_type FROM recent WHERE customer_id IN (SELECT id FROM who)")))
def _performance_overview(t: Tables) -> DataFrame:
    return P.performance_overview(t.customers, t.analytics_events, AS_OF, DAYS)


SEGMENT_ACTIVITY = (
    RECENT,
    ("members", f"SELECT DISTINCT segment_id, customer_id, {SEEN.format('m.customer_id')} AS seen FROM user_segments m"),
    ("heads", "SELECT segment_id, COUNT(*) AS people, COUNT(*) FILTER (WHERE seen) AS seen FROM members GROUP BY segment_id"),
    ("hits", f"""
SELECT m.segment_id, COUNT(*) FILTER (WHERE e.event_type IN {O.IMP}) AS shown,
       COUNT(*) FILTER (WHERE e.event_type IN {O.CLK}) AS clicked
FROM recent e JOIN user_segments m USING (customer_id) GROUP BY m.segment_id"""),
    ("seg", """
SELECT g.name, COALESCE(heads.people, 0) AS people, COALESCE(heads.seen, 0) AS seen,
       COALESCE(hits.shown, 0) AS shown, COALESCE(hits.clicked, 0) AS clicked
FROM segments g LEFT JOIN heads ON heads.segment_id = g.id LEFT JOIN hits ON hits.segment_id = g.id"""))


@query("engagement_by_segment", O.with_views(f"""
SELECT name AS segment_name, people AS customer_count, seen AS active_customers,
       {O.frac('seen', 'people')} AS engagement_rate, shown AS recommendation_impressions,
       clicked AS recommendation_clicks, {O.frac('clicked', 'shown')} AS ctr
FROM seg""", *SEGMENT_ACTIVITY))
def _engagement_by_segment(t: Tables) -> DataFrame:
    return P.engagement_by_segment(t.segments, t.user_segments, t.analytics_events, AS_OF, DAYS)


@query("top_performing_segments", O.with_views("""
SELECT name AS segment_name, greatest(rate, 0.0) AS engagement_rate, people AS customer_count, 1 + ahead AS "rank"
FROM (SELECT a.*, (SELECT COUNT(*) FROM rated b
                   WHERE b.rate > a.rate OR (b.rate = a.rate AND b.name < a.name)) AS ahead FROM rated a) x
WHERE ahead < 5""", *SEGMENT_ACTIVITY,
    ("rated", "SELECT name, people, CASE WHEN people > 0 THEN CAST(seen AS DOUBLE) / people ELSE -1.0 END AS rate FROM seg")))
def _top_performing_segments(t: Tables) -> DataFrame:
    return P.top_performing_segments(t.segments, t.user_segments, t.analytics_events, AS_OF, DAYS, 5)


@query("ab_test_results", O.with_views(f"""
SELECT test_id, test_name, feature, variant_a, variant_b, status,
       ra AS variant_a_customer_count, rb AS variant_b_customer_count,
       ea AS variant_a_engagements, eb AS variant_b_engagements,
       fa AS variant_a_engagement_rate, fb AS variant_b_engagement_rate,
       CAST(0 AS BIGINT) AS variant_a_conversions, CAST(0 AS BIGINT) AS variant_b_conversions,
       if(fa >= fb, 'A', 'B') AS winning_variant, CAST(0.0 AS DOUBLE) AS statistical_significance
FROM (SELECT *, {O.frac('ea', 'ra')} AS fa, {O.frac('eb', 'rb')} AS fb
      FROM (SELECT k.*, COALESCE(a.joined, 0) AS ra, COALESCE(b.joined, 0) AS rb,
                   COALESCE(a.clickers, 0) AS ea, COALESCE(b.clickers, 0) AS eb
            FROM chosen k LEFT JOIN arms a ON a.ab_test_id = k.test_id AND a.variant = 'A'
            LEFT JOIN arms b ON b.ab_test_id = k.test_id AND b.variant = 'B') n) f""",
    RECENT,
    ("chosen", f"""
SELECT id AS test_id, test_name, feature, variant_a, variant_b, status FROM ab_tests
WHERE status = 'active' OR (end_date >= {WIN_START} AND end_date < {WIN_END})"""),
    ("per_person", f"""
SELECT customer_id, COUNT(*) AS events, bool_or(event_type IN {O.CLK}) AS clicked FROM recent GROUP BY customer_id"""),
    ("arms", """
SELECT ab_test_id, variant, CAST(SUM(COALESCE(events, 0)) + COUNT(*) FILTER (WHERE events IS NULL) AS BIGINT) AS joined,
       COUNT(DISTINCT customer_id) FILTER (WHERE clicked) AS clickers
FROM ab_test_assignments LEFT JOIN per_person USING (customer_id) GROUP BY ab_test_id, variant""")))
def _ab_test_results(t: Tables) -> DataFrame:
    return P.ab_test_results(t.ab_tests, t.ab_test_assignments, t.analytics_events, AS_OF, DAYS)


@query("recommendation_roi", O.with_views(f"""
SELECT shown AS total_recommendations, clicked AS clicked_recommendations,
       {O.frac('clicked', 'shown')} * 100 AS roi_percentage,
       if(shown > 0, CAST(clicked * 10000 AS DOUBLE), 0.0) AS estimated_value_idr
FROM (SELECT (SELECT COUNT(*) FROM recent WHERE starts_with(event_type, 'recommendation')) AS shown,
             (SELECT COUNT(*) FROM recent WHERE event_type IN {O.CLK}) AS clicked) n""", RECENT))
def _recommendation_roi(t: Tables) -> DataFrame:
    return P.recommendation_roi(t.analytics_events, AS_OF, DAYS)


@query("engagement_metrics_daily", O.with_views(f"""
SELECT us.segment_id, ev.metric_date, ev.feature, sz.total_customers,
       COUNT(DISTINCT ev.customer_id) AS active_customers,
       COUNT(*) FILTER (WHERE ev.event_type IN {O.IMP}) AS recommendation_impressions,
       COUNT(*) FILTER (WHERE ev.event_type IN {O.CLK}) AS recommendation_clicks,
       {O.frac('COUNT(DISTINCT ev.customer_id)', 'sz.total_customers')} AS engagement_rate
FROM ev JOIN user_segments us ON us.customer_id = ev.customer_id JOIN sz ON sz.segment_id = us.segment_id
GROUP BY us.segment_id, ev.metric_date, ev.feature, sz.total_customers""",
    ("ev", f"""SELECT ae.customer_id, CAST(ae.created_at AS DATE) AS metric_date, COALESCE(ae.feature, '') AS feature,
       ae.event_type FROM analytics_events ae WHERE {IN_WIN}"""),
    ("sz", "SELECT segment_id, COUNT(DISTINCT customer_id) AS total_customers FROM user_segments GROUP BY segment_id")))
def _engagement_metrics_daily(t: Tables) -> DataFrame:
    return P.engagement_metrics_daily(t.user_segments, t.analytics_events, AS_OF, DAYS)


@query("personalization_daily", O.with_views(f"""
SELECT us.segment_id, CAST(ae.created_at AS DATE) AS date_period, COUNT(*) AS total_recommendations,
       COUNT(*) FILTER (WHERE ae.event_type IN {O.CLK}) AS clicked_recommendations
FROM analytics_events ae JOIN user_segments us ON us.customer_id = ae.customer_id
WHERE {IN_WIN} AND ae.event_type LIKE 'recommendation%'
GROUP BY us.segment_id, CAST(ae.created_at AS DATE)"""))
def _personalization_daily(t: Tables) -> DataFrame:
    return P.personalization_daily(t.user_segments, t.analytics_events, AS_OF, DAYS)


# ---------------------------------------------------------------------------
# recommendations
# ---------------------------------------------------------------------------

REASON = S.ACTIVITY_REASON.replace("'", "''")
SEG_RECS_SQL = """
SELECT us.customer_id AS customer_pk, r.id AS rec_id, COALESCE(r.feature, '') AS feature,
       COALESCE(r.reason, '') AS reason, r.priority, s.name AS segment, us.confidence, 'segment' AS source
FROM user_segment_history us JOIN segments s ON s.id = us.segment_id JOIN recommendations r ON r.segment_id = s.id"""
RANKED_SQL = """
SELECT * FROM (SELECT customer_id, feature, COUNT(*) AS usage_count, MAX(created_at) AS last_used_at,
                      ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, MAX(created_at) DESC, feature ASC) AS rk
               FROM user_activities WHERE feature IS NOT NULL GROUP BY customer_id, feature) x WHERE rk <= 5"""


@query("segment_recommendations", O.with_views(SEG_RECS_SQL))
def _segment_recommendations(t: Tables) -> DataFrame:
    return R.segment_recommendations(t.user_segment_history, t.segments, t.recommendations)


@query("activity_recommendations", O.with_views(f"""
SELECT customer_id AS customer_pk, feature, '{REASON}' AS reason, CAST(rk AS INTEGER) AS priority,
       'activity' AS source, usage_count FROM ranked""", ("ranked", RANKED_SQL)))
def _activity_recommendations(t: Tables) -> DataFrame:
    return R.activity_recommendations(t.user_activities, 5)


@query("recommendations", O.with_views("""
SELECT * FROM seg
UNION ALL
SELECT c.customer_id, CAST(NULL AS INTEGER) AS rec_id, a.feature, '""" + REASON + """' AS reason,
       CAST(a.rk AS INTEGER) AS priority, 'activity' AS source, CAST(NULL AS VARCHAR) AS segment,
       a.usage_count, CAST(NULL AS DOUBLE) AS confidence
FROM ranked a JOIN customers c ON c.id = a.customer_id
WHERE NOT EXISTS (SELECT 1 FROM seg WHERE seg.customer_id = c.customer_id)""",
    ("ranked", RANKED_SQL),
    ("seg", """SELECT c.customer_id, r.id AS rec_id, COALESCE(r.feature, '') AS feature, COALESCE(r.reason, '') AS reason,
       r.priority, 'segment' AS source, s.name AS segment, CAST(NULL AS BIGINT) AS usage_count, us.confidence
FROM user_segment_history us JOIN segments s ON s.id = us.segment_id JOIN recommendations r ON r.segment_id = s.id
JOIN customers c ON c.id = us.customer_id""")))
def _recommendations(t: Tables) -> DataFrame:
    return R.recommendations(t.customers, t.user_segment_history, t.segments, t.recommendations,
                             t.user_activities, 5)


@query("personalization", O.with_views("""
SELECT c.customer_id, COALESCE(qa.first_action, rec.first_rec, '') AS primary_feature,
       top.segment_id, top.segment_name, top.confidence AS segment_confidence,
       COALESCE(qa.n, 0) AS quick_action_count, COALESCE(qa.features, '') AS quick_actions,
       COALESCE(rec.n, 0) AS recommended_count, COALESCE(rec.features, '') AS recommended_features
FROM customers c LEFT JOIN top ON top.customer_id = c.id LEFT JOIN qa ON qa.customer_id = c.id
LEFT JOIN rec ON rec.segment_id = top.segment_id""",
    ("ranked", RANKED_SQL),
    ("top", """SELECT * FROM (SELECT us.customer_id, us.segment_id, s.name AS segment_name, us.confidence,
       ROW_NUMBER() OVER (PARTITION BY us.customer_id ORDER BY us.confidence DESC, us.created_at DESC NULLS FIRST, us.id DESC) AS rn
       FROM user_segment_history us JOIN segments s ON s.id = us.segment_id) x WHERE rn = 1"""),
    ("qa", """SELECT customer_id, COUNT(*) AS n, string_agg(feature, ',' ORDER BY rk) AS features,
       (list(feature ORDER BY rk) FILTER (WHERE feature <> ''))[1] AS first_action
FROM ranked GROUP BY customer_id"""),
    ("rec", """SELECT segment_id, COUNT(*) AS n, string_agg(COALESCE(feature, ''), ',' ORDER BY priority, id) AS features,
       (list(COALESCE(feature, '') ORDER BY priority, id))[1] AS first_rec
FROM recommendations GROUP BY segment_id""")))
def _personalization(t: Tables) -> DataFrame:
    return R.personalization(t.customers, t.user_segment_history, t.segments, t.recommendations,
                             t.user_activities, 5)


@query("personalization_sections", O.with_views("""
SELECT c.customer_id, best.segment_id, r.position, r.rec_id, r.feature, r.reason, r.priority
FROM customers c JOIN (SELECT customer_id, arg_max(segment_id, row(confidence, created_at IS NULL, created_at, id)) AS segment_id
                       FROM user_segment_history WHERE segment_id IN (SELECT id FROM segments) GROUP BY customer_id) best
  ON best.customer_id = c.id
JOIN (SELECT segment_id, id AS rec_id, COALESCE(feature, '') AS feature, COALESCE(reason, '') AS reason, priority,
             1 + (SELECT COUNT(*) FROM recommendations b WHERE b.segment_id = a.segment_id
                  AND (b.priority, b.id) < (a.priority, a.id)) AS position FROM recommendations a) r
  ON r.segment_id = best.segment_id"""))
def _personalization_sections(t: Tables) -> DataFrame:
    return R.personalization_sections(t.customers, t.user_segment_history, t.segments, t.recommendations)


# ---------------------------------------------------------------------------
# Validation, ingestion and merges
# ---------------------------------------------------------------------------

RAW_EVENTS_SQL = """
SELECT id AS raw_id,
       CASE WHEN id % 13 = 0 THEN 'CUS-X' || CAST(customer_id AS VARCHAR) WHEN id % 5 = 0 THEN CAST(customer_id AS VARCHAR)
            WHEN id % 5 = 1 THEN '' ELSE printf('CUS-%06d', customer_id) END AS customer_id,
       CASE WHEN event_type = 'recommendation_generated' AND id % 4 = 0 THEN NULL ELSE event_type END AS event_type,
       feature,
       CASE WHEN id % 17 = 0 THEN '{broken' WHEN id % 29 = 0 THEN '{"a": 1, "a": 2}' WHEN id % 31 = 0 THEN '{} x'
            WHEN id % 37 = 0 THEN '"text"' WHEN id % 41 = 0 THEN '1],[2' WHEN id % 43 = 0 THEN '{''a'': 1}'
            WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN 'null' ELSE metadata END AS metadata,
       created_at AS received_at
FROM analytics_events"""
CHECKED_EVENTS_SQL = f"""
SELECT k.*, m.cid,
       CASE WHEN k.event_type IS NULL OR k.event_type = '' THEN 'event_type is required'
            WHEN k.feature IS NULL OR k.feature = '' THEN 'feature is required'
            WHEN m.cid IS NULL THEN 'user not found'
            WHEN NOT json_valid(k.meta) THEN 'metadata must be valid JSON' END AS error
FROM (SELECT *, CASE WHEN COALESCE(customer_id, '') = '' THEN '{I.DEFAULT_PRINCIPAL}' ELSE customer_id END AS key,
             CASE WHEN COALESCE(metadata, '') = '' THEN '{{}}' ELSE metadata END AS meta FROM raw) k
JOIN (SELECT r.raw_id, MIN(c.id) AS cid FROM (SELECT raw_id, CASE WHEN COALESCE(customer_id, '') = ''
        THEN '{I.DEFAULT_PRINCIPAL}' ELSE customer_id END AS key FROM raw) r
      LEFT JOIN customers c ON CAST(c.id AS VARCHAR) = r.key OR c.customer_id = r.key GROUP BY r.raw_id) m
  ON m.raw_id = k.raw_id"""


def _checked_events(t: Tables) -> DataFrame:
    return I.validate_events(I.raw_event_feed(t.analytics_events), t.customers, "admin", I.DEFAULT_PRINCIPAL)


@query("event_validation", O.with_views("SELECT raw_id, error FROM checked",
                                        ("raw", RAW_EVENTS_SQL), ("checked", CHECKED_EVENTS_SQL)))
def _event_validation(t: Tables) -> DataFrame:
    return _checked_events(t).select("raw_id", "error")


@query("ingest_events", O.with_views("""
SELECT (SELECT MAX(id) FROM analytics_events) + ROW_NUMBER() OVER (ORDER BY received_at, raw_id) AS id,
       cid AS customer_id, event_type, feature, meta AS metadata, received_at AS created_at
FROM checked WHERE error IS NULL""", ("raw", RAW_EVENTS_SQL), ("checked", CHECKED_EVENTS_SQL)))
def _ingest_events(t: Tables) -> DataFrame:
    raw = I.raw_event_feed(t.analytics_events)
    return I.ingest_events(raw, t.customers, t.analytics_events, "admin", I.DEFAULT_PRINCIPAL)["accepted"]


SEG_NAME_SQL = ("CASE c_mktsegment WHEN 'MACHINERY' THEN 'investor' WHEN 'FURNITURE' THEN 'low_activity' "
                "WHEN 'AUTOMOBILE' THEN 'digital_spender' WHEN 'BUILDING' THEN 'bill_payer' ELSE 'household_saver' END")
BATCH_SQL = f"""
SELECT c_custkey * 2 AS pos,
       CASE WHEN c_custkey % 2 = 0 THEN printf('CUS-%06d', c_custkey) ELSE CAST(c_custkey AS VARCHAR) END AS customer_id,
       {SEG_NAME_SQL} AS segment_name,
       CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'assigned from ' || c_mktsegment || ' #' || CAST(c_custkey AS VARCHAR) END AS description,
       CAST(c_custkey % 97 AS DOUBLE) / 100 AS confidence
FROM customer
UNION ALL
SELECT c_custkey * 2 + 1, printf('CUS-%06d', c_custkey),
       CASE WHEN c_custkey % 20 = 0 THEN 'vip_saver' ELSE 'investor' END, '', CAST(0.99 AS DOUBLE)
FROM customer WHERE c_custkey % 10 = 0"""
RESOLVED_SQL = """
SELECT b.*, (SELECT MIN(c.id) FROM customers c WHERE CAST(c.id AS VARCHAR) = b.customer_id OR c.customer_id = b.customer_id) AS cid
FROM batch b"""
BAD_ROW = """(customer_id IS NULL OR customer_id = '' OR segment_name IS NULL
  OR segment_name = '' OR COALESCE(confidence, 0) < 0 OR COALESCE(confidence, 0) > 1 OR cid IS NULL)"""
BAD_SQL = f"SELECT COUNT(*) AS n FROM resolved WHERE {BAD_ROW}"
NEW_SEGMENTS_SQL = """
SELECT s.id, s.name, COALESCE(p.last_ne, s.description) AS description FROM segments s LEFT JOIN per_name p ON p.name = s.name
UNION ALL
SELECT CAST((SELECT MAX(id) FROM segments) + ROW_NUMBER() OVER (ORDER BY p.first_pos) AS INTEGER), p.name,
       COALESCE(p.last_ne, p.first_desc)
FROM per_name p WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.name = p.name)"""
PER_NAME_SQL = """
SELECT segment_name AS name, MIN(pos) AS first_pos,
       arg_max(description, pos) FILTER (WHERE COALESCE(description, '') <> '') AS last_ne,
       arg_min(COALESCE(description, ''), pos) AS first_desc
FROM resolved WHERE (SELECT n FROM bad) = 0 GROUP BY segment_name"""
SEG_CTES = (("batch", BATCH_SQL), ("resolved", RESOLVED_SQL), ("bad", BAD_SQL), ("per_name", PER_NAME_SQL),
            ("new_segments", NEW_SEGMENTS_SQL))
UPDATE_RESULTS_SQL = """
SELECT r.pos, c.customer_id, r.segment_name, r.confidence,
       CASE WHEN r.pos = MIN(r.pos) OVER (PARTITION BY r.cid)
             AND NOT EXISTS (SELECT 1 FROM user_segments us WHERE us.customer_id = r.cid) THEN 'inserted'
            ELSE 'updated' END AS action
FROM resolved r JOIN customers c ON c.id = r.cid WHERE (SELECT n FROM bad) = 0"""


def _segment_job(t: Tables) -> dict[str, DataFrame]:
    return G.apply_segment_updates(FD.segment_batch(t), t.customers, t.segments, t.user_segments, AS_OF)


BAD_BATCH_SQL = f"""
SELECT c_custkey AS pos,
       CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN 'CUS-X' || CAST(c_custkey AS VARCHAR)
            WHEN c_custkey % 2 = 0 THEN printf('CUS-%06d', c_custkey) ELSE CAST(c_custkey AS VARCHAR) END AS customer_id,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE {SEG_NAME_SQL} END AS segment_name,
       CASE WHEN c_custkey % 19 = 0 THEN -0.1 WHEN c_custkey % 23 = 0 THEN 1.1 WHEN c_custkey % 29 = 0 THEN 0.0
            WHEN c_custkey % 31 = 0 THEN 1.0 ELSE CAST(c_custkey % 97 AS DOUBLE) / 100 END AS confidence
FROM customer"""


@query("segment_validation", O.with_views("""
SELECT b.pos,
       CASE WHEN b.customer_id IS NULL OR b.customer_id = '' OR b.segment_name IS NULL OR b.segment_name = ''
              THEN 'customer_id and segment_name are required'
            WHEN COALESCE(b.confidence, 0) < 0 OR COALESCE(b.confidence, 0) > 1 THEN 'confidence must be between 0 and 1'
            WHEN NOT EXISTS (SELECT 1 FROM customers c WHERE CAST(c.id AS VARCHAR) = b.customer_id OR c.customer_id = b.customer_id)
              THEN 'user not found' END AS error
FROM bad_batch b""", ("bad_batch", BAD_BATCH_SQL)))
def _segment_validation(t: Tables) -> DataFrame:
    return G.validate_segment_batch(FD.segment_batch_with_errors(t), t.customers).select("pos", "error")


@query("segment_update_results", O.with_views(UPDATE_RESULTS_SQL, *SEG_CTES))
def _segment_update_results(t: Tables) -> DataFrame:
    return _segment_job(t)["results"]


@query("segment_requests", O.with_views(UPDATE_RESULTS_SQL, ("batch", BAD_BATCH_SQL), ("found", RESOLVED_SQL.strip()),
    ("resolved", f"""
SELECT * FROM found WHERE pos // 3 NOT IN (SELECT pos // 3 FROM found WHERE {BAD_ROW})"""),
    ("bad", "SELECT 0 AS n")))
def _segment_requests(t: Tables) -> DataFrame:
    """Three rows a request: a bad request costs no other its rows."""
    batch = FD.segment_batch_with_errors(t).withColumn("request", F.floor(F.col("pos") / 3))
    return G.apply_segment_updates(batch, t.customers, t.segments, t.user_segments, AS_OF)["results"]


@query("segment_upsert", O.with_views("SELECT * FROM new_segments", *SEG_CTES))
def _segment_upsert(t: Tables) -> DataFrame:
    return _segment_job(t)["segments"]


@query("user_segment_upsert", O.with_views(f"""
SELECT us.id, us.customer_id, COALESCE(l.segment_id, us.segment_id) AS segment_id,
       COALESCE(l.confidence, us.confidence) AS confidence,
       CASE WHEN l.cid IS NOT NULL THEN {O.AS_OF} ELSE us.created_at END AS created_at
FROM user_segments us LEFT JOIN last_row l ON l.cid = us.customer_id
UNION ALL
SELECT (SELECT MAX(id) FROM user_segments) + ROW_NUMBER() OVER (ORDER BY l.first_pos), l.cid, l.segment_id,
       l.confidence, {O.AS_OF}
FROM last_row l WHERE NOT EXISTS (SELECT 1 FROM user_segments us WHERE us.customer_id = l.cid)""",
    *SEG_CTES, ("last_row", """
SELECT r.cid, arg_max(ns.id, r.pos) AS segment_id, arg_max(r.confidence, r.pos) AS confidence, MIN(r.pos) AS first_pos
FROM resolved r JOIN new_segments ns ON ns.name = r.segment_name WHERE (SELECT n FROM bad) = 0 GROUP BY r.cid""")))
def _user_segment_upsert(t: Tables) -> DataFrame:
    return _segment_job(t)["user_segments"]


@query("onboard_customers", O.with_views("""
SELECT id, printf('CUS-%06d', id) AS customer_id, email, 'customer' AS role
FROM (SELECT (SELECT MAX(id) FROM customers) + ROW_NUMBER() OVER (ORDER BY pos) AS id, email
      FROM regs WHERE (SELECT n FROM bad_regs) = 0) x""",
    ("regs", """SELECT s_suppkey AS pos, s_name AS full_name, lower(replace(s_name, '#', '_')) AS username,
       CASE WHEN s_suppkey = 3 THEN '' ELSE lower(s_name) || '@mail.com' END AS email FROM supplier"""),
    ("bad_regs", """SELECT COUNT(*) AS n FROM regs r WHERE EXISTS (SELECT 1 FROM customers c WHERE c.email = r.email)
       OR EXISTS (SELECT 1 FROM regs r2 WHERE r2.email = r.email AND r2.pos < r.pos)""")))
def _onboard_customers(t: Tables) -> DataFrame:
    return I.onboard_customers(FD.registrations(t), t.customers, AS_OF)["registered"]


# A request can clash with its predecessor only, and the first of three with none: so the admission of the first is its own
# fitness, that of the second looks at the first, that of the third at the second as the first leaves it.
@query("onboard_requests", O.with_views("""
SELECT id, printf('CUS-%06d', id) AS customer_id, email, 'customer' AS role
FROM (SELECT (SELECT MAX(id) FROM customers) + ROW_NUMBER() OVER (ORDER BY r.request, r.pos) AS id, r.email
      FROM regs r JOIN verdict w ON w.request = r.request AND w.ok) x""",
    ("regs", """
SELECT c_custkey AS request, CAST(1 AS BIGINT) AS pos, 'new' || c_custkey || '@mail.com' AS email FROM customer WHERE c_custkey % 23 <> 0
UNION ALL SELECT c_custkey, 2, 'new' || (c_custkey - 1) || '@mail.com' FROM customer WHERE c_custkey % 23 <> 0 AND c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 3, 'new' || c_custkey || '@mail.com' FROM customer WHERE c_custkey % 23 <> 0 AND c_custkey % 11 = 0
UNION ALL SELECT c_custkey, 4, lower(c_name) || '@mail.com' FROM customer WHERE c_custkey % 23 <> 0 AND c_custkey % 17 = 0"""),
    ("fit", """SELECT c_custkey AS request,
       (SELECT COUNT(*) > 0 AND COUNT(*) = COUNT(DISTINCT r.email) FROM regs r WHERE r.request = c_custkey)
       AND NOT EXISTS (SELECT 1 FROM regs r JOIN customers c ON c.email = r.email WHERE r.request = c_custkey) AS alone
FROM customer"""),
    ("clash", "SELECT DISTINCT a.request, b.request AS before FROM regs a JOIN regs b ON a.email = b.email AND b.request < a.request"),
    ("verdict", """
SELECT f.request, f.alone AND
       CASE WHEN f.request % 3 = 0 THEN TRUE
            WHEN f.request % 3 = 1 THEN NOT COALESCE((SELECT bool_or(g.alone) FROM clash x JOIN fit g ON g.request = x.before WHERE x.request = f.request), FALSE)
            ELSE NOT COALESCE((SELECT bool_or(g.alone AND NOT COALESCE((SELECT bool_or(h.alone) FROM clash y JOIN fit h ON h.request = y.before
                                                                     WHERE y.request = g.request), FALSE))
                               FROM clash x JOIN fit g ON g.request = x.before WHERE x.request = f.request), FALSE) END AS ok
FROM fit f""")))
def _onboard_requests(t: Tables) -> DataFrame:
    return I.onboard_requests(FD.sign_up_requests(t), t.customers, AS_OF)["registered"]


@query("set_tracking", O.with_views("""
SELECT u.seq, u.key, u.is_activity_tracking_enabled,
       CASE WHEN u.is_activity_tracking_enabled IS NULL THEN 0 ELSE m.n END AS rows_affected,
       CASE WHEN u.is_activity_tracking_enabled IS NULL THEN 'invalid' WHEN m.n = 0 THEN 'not_found' ELSE 'updated' END AS status
FROM upd u JOIN (SELECT u2.seq, COUNT(c.id) AS n FROM upd u2
                 LEFT JOIN customers c ON CAST(c.id AS VARCHAR) = u2.key OR c.customer_id = u2.key GROUP BY u2.seq) m
  ON m.seq = u.seq""", ("upd", """
SELECT c_custkey AS seq,
       CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN printf('CUS-%06d', c_custkey)
            ELSE 'CUS-X' || CAST(c_custkey AS VARCHAR) END AS key,
       CASE WHEN c_custkey % 10 = 7 THEN NULL ELSE c_acctbal >= 0 END AS is_activity_tracking_enabled
FROM customer""")))
def _set_tracking(t: Tables) -> DataFrame:
    return G.set_tracking(FD.tracking_updates(t), t.customers)["report"]


@query("upsert_accounts", O.with_views(f"""
SELECT a.id, a.customer_id, a.account_no,
       CASE WHEN s.account_no IS NOT NULL THEN s.type ELSE a.type END AS type,
       CAST(CASE WHEN s.account_no IS NOT NULL THEN s.balance ELSE a.balance END AS DOUBLE) AS balance,
       CASE WHEN s.account_no IS NOT NULL THEN s.currency ELSE a.currency END AS currency, a.created_at
FROM accounts a LEFT JOIN src s ON s.account_no = a.account_no
UNION ALL
SELECT (SELECT MAX(id) FROM accounts) + ROW_NUMBER() OVER (ORDER BY s.account_no), s.customer_id, s.account_no, s.type,
       CAST(s.balance AS DOUBLE), s.currency, s.created_at
FROM src s WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE a.account_no = s.account_no)""",
    ("src", f"""
SELECT CASE WHEN o_custkey % 9 = 0 THEN 'N' || printf('%09d', o_custkey)
            ELSE printf('%010d', o_custkey) END AS account_no,
       o_custkey AS customer_id, 'savings' AS type, CAST(o_totalprice AS DECIMAL(15,2)) AS balance, 'IDR' AS currency,
       {O.AS_OF} AS created_at
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders WHERE o_orderstatus = 'P') x WHERE rn = 1""")))
def _upsert_accounts(t: Tables) -> DataFrame:
    merged = G.upsert(t.accounts, FD.account_refresh(t, AS_OF), ["account_no"], ["type", "balance", "currency"])
    return merged.withColumn("balance", F.col("balance").cast("double"))


def _constraint_sql() -> str:
    def dupes(table, cols):
        keyed = " AND ".join(f"t.{c} IS NOT NULL" for c in cols)
        same = " AND ".join(f"t2.{c} = t.{c}" for c in cols)
        return (f"SELECT '{table}' AS table_name, 'unique({','.join(cols)})' AS constraint_name, COUNT(*) AS checked_rows, "
                f"COUNT(*) FILTER (WHERE {keyed} AND (SELECT COUNT(*) FROM {table} t2 WHERE {same}) > 1) AS violations "
                f"FROM {table} t")

    def orphans(table, fk, parent, pk="id"):
        return (f"SELECT '{table}' AS table_name, 'fk({fk})->{parent}' AS constraint_name, COUNT(*) AS checked_rows, "
                f"COUNT(*) FILTER (WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent})) AS violations "
                f"FROM {table}")
    parts = [
        dupes("customers", ["id"]), dupes("customers", ["customer_id"]), dupes("customers", ["email"]),
        dupes("customer_profiles", ["customer_id"]), orphans("customer_profiles", "customer_id", "customers"),
        dupes("accounts", ["account_no"]), orphans("accounts", "customer_id", "customers"),
        dupes("transactions", ["trx_id"]), orphans("transactions", "account_id", "accounts"),
        orphans("user_activities", "customer_id", "customers"), orphans("analytics_events", "customer_id", "customers"),
        dupes("segments", ["name"]), dupes("user_segments", ["customer_id"]),
        orphans("user_segments", "customer_id", "customers"), orphans("user_segments", "segment_id", "segments"),
        ("SELECT 'user_segments' AS table_name, 'check(0<=confidence<=1)' AS constraint_name, COUNT(*) AS checked_rows, "
         "COUNT(*) FILTER (WHERE NOT COALESCE(confidence >= 0 AND confidence <= 1, FALSE)) AS violations FROM user_segments"),
        orphans("recommendations", "segment_id", "segments"),
        dupes("ab_test_assignments", ["customer_id", "ab_test_id"]),
        orphans("ab_test_assignments", "customer_id", "customers"),
        orphans("ab_test_assignments", "ab_test_id", "ab_tests"),
    ]
    return "\nUNION ALL\n".join(parts)


@query("constraint_report", O.with_views(_constraint_sql()))
def _constraint_report(t: Tables) -> DataFrame:
    return G.constraint_report(t)


def _cascade_sql() -> str:
    doomed = "(SELECT id FROM customers WHERE role = 'admin')"
    specs = [("customers", "id")] + G.CASCADE_CHILDREN
    parts = [f"SELECT '{tb}' AS table_name, COUNT(*) AS rows_before, COUNT(*) FILTER (WHERE {fk} IN {doomed}) AS rows_deleted "
             f"FROM {tb}" for tb, fk in specs]
    parts.append("SELECT 'transactions', COUNT(*), COUNT(*) FILTER (WHERE account_id IN "
                 f"(SELECT id FROM accounts WHERE customer_id IN {doomed})) FROM transactions")
    return ("SELECT table_name, rows_before, rows_deleted, rows_before - rows_deleted AS rows_after FROM (\n"
            + "\nUNION ALL\n".join(parts) + "\n) x")


@query("cascade_delete", O.with_views(_cascade_sql()))
def _cascade_delete(t: Tables) -> DataFrame:
    return G.cascade_summary(t, t.customers.filter(F.col("role") == "admin"))


# ---------------------------------------------------------------------------
# Features, segmentation model, prediction jobs
# ---------------------------------------------------------------------------


def _norm_sql(c: str) -> str:
    return f"translate(lower(regexp_replace(COALESCE({c}, ''), '^\\s+|\\s+$', '', 'g')), '- ', '__')"


def _any_sql(needles) -> str:
    return "(" + " OR ".join(f"contains(name, '{n}')" for n in needles) + ")"


def _dom_code_sql(c: str) -> str:
    k = FE.DOMINANT_ACTIVITY_CODES
    has = lambda ns: "(" + " OR ".join(f"contains({c}, '{n}')" for n in ns) + ")"
    return (f"CASE WHEN {c} = '' THEN {k['low_activity']} WHEN {has(FE.INVESTMENT_NEEDLES)} THEN {k['wealth_investment']} "
            f"WHEN {has(FE.QRIS_NEEDLES)} THEN {k['qris_payment']} "
            f"WHEN {has(FE.PAYMENT_NEEDLES + FE.TOPUP_NEEDLES)} THEN {k['bills_topup']} "
            f"WHEN {has(FE.TRANSFER_NEEDLES)} THEN {k['transfer']} ELSE {k['low_activity']} END")


def _ratio_sql(n: str) -> str:
    return f"CASE WHEN COALESCE(p.total, 0) > 0 THEN round_even(CAST(p.{n} AS DOUBLE) / p.total, 4) ELSE 0.0 END"


MODEL_FEATURES_SQL = f"""
SELECT c.id AS customer_pk, c.customer_id,
       CAST(COALESCE(x.n_tx, 0) AS DOUBLE) AS transaction_frequency_monthly,
       CAST({FE.DEFAULT_AVG_BALANCE!r} AS DOUBLE) AS avg_balance,
       {_ratio_sql('transfer_n')} AS transfer_ratio, {_ratio_sql('payment_n')} AS payment_ratio,
       {_ratio_sql('qris_n')} AS qris_ratio, {_ratio_sql('topup_n')} AS topup_ratio,
       CAST(CASE WHEN COALESCE(p.investment_n, 0) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS investment_activity,
       CAST({FE.DEFAULT_LOAN_USAGE!r} AS DOUBLE) AS loan_usage,
       CAST({FE.DEFAULT_CREDIT_CARD_USAGE!r} AS DOUBLE) AS credit_card_usage,
       CAST({FE.DEFAULT_CARDLESS_USAGE!r} AS DOUBLE) AS cardless_usage,
       CAST({FE.DEFAULT_POIN_XTRA_ACTIVE!r} AS DOUBLE) AS poin_xtra_active,
       CAST({FE.DEFAULT_LOGIN_FREQUENCY_WEEKLY!r} AS DOUBLE) AS login_frequency_weekly,
       CAST({FE.DEFAULT_AVG_SESSION_DURATION_MIN!r} AS DOUBLE) AS avg_session_duration_min,
       CASE WHEN COALESCE(x.n_tx, 0) = 0 OR x.latest IS NULL THEN CAST({FE.DEFAULT_RECENT_TRANSACTION_DAYS!r} AS DOUBLE)
            ELSE CAST(greatest(floor((epoch_us({O.AS_OF}) - epoch_us(x.latest)) / 86400000000.0), 0) AS DOUBLE) END
         AS recent_transaction_days,
       CAST({_dom_code_sql("COALESCE(p.dom, '')")} AS DOUBLE) AS dominant_activity_enc,
       CAST({FE.DEFAULT_FREQUENT_PRODUCT_ENC} AS DOUBLE) AS frequent_product_enc,
       CAST({FE.DEFAULT_CUSTOMER_TYPE_ENC} AS DOUBLE) AS customer_type_enc,
       COALESCE(p.dom, '') AS dominant_feature, CAST(COALESCE(p.total, 0) AS BIGINT) AS total_activity
FROM customers c LEFT JOIN per p ON p.cid = c.id LEFT JOIN txs x ON x.cid = c.id"""
MODEL_FEATURE_CTES = (
    ("comb", f"""
SELECT cid, name, SUM(cnt) AS cnt FROM (
  SELECT customer_id AS cid, {_norm_sql('feature')} AS name, COUNT(*) AS cnt FROM user_activities
  WHERE feature IS NOT NULL GROUP BY 1, 2
  UNION ALL
  SELECT a.customer_id AS cid, {_norm_sql('t.type')} AS name, COUNT(*) AS cnt
  FROM transactions t JOIN accounts a ON a.id = t.account_id GROUP BY 1, 2) u
WHERE name <> '' GROUP BY cid, name"""),
    ("per", f"""
SELECT cid, SUM(cnt) AS total,
       SUM(CASE WHEN {_any_sql(FE.TRANSFER_NEEDLES)} THEN cnt ELSE 0 END) AS transfer_n,
       SUM(CASE WHEN {_any_sql(FE.PAYMENT_NEEDLES)} THEN cnt ELSE 0 END) AS payment_n,
       SUM(CASE WHEN {_any_sql(FE.QRIS_NEEDLES)} THEN cnt ELSE 0 END) AS qris_n,
       SUM(CASE WHEN {_any_sql(FE.TOPUP_NEEDLES)} THEN cnt ELSE 0 END) AS topup_n,
       SUM(CASE WHEN {_any_sql(FE.INVESTMENT_NEEDLES)} THEN cnt ELSE 0 END) AS investment_n,
       (list(name ORDER BY cnt DESC, name ASC))[1] AS dom
FROM comb GROUP BY cid"""),
    ("txs", """
SELECT a.customer_id AS cid, COUNT(*) AS n_tx, MAX(t.created_at) AS latest
FROM transactions t JOIN accounts a ON a.id = t.account_id GROUP BY a.customer_id"""),
)


def _model_features(t: Tables) -> DataFrame:
    return FE.model_features(t.customers, t.transactions, t.accounts, t.user_activities, AS_OF)


@query("model_features", O.with_views(MODEL_FEATURES_SQL, *MODEL_FEATURE_CTES))
def _model_features_q(t: Tables) -> DataFrame:
    return _model_features(t)


@query("score_segments", O.with_views(SG.score_sql(SG.DEFAULT_MODEL, "mf"), *MODEL_FEATURE_CTES,
                                      ("mf", MODEL_FEATURES_SQL)))
def _score_segments(t: Tables) -> DataFrame:
    return SG.score_segments(_model_features(t).drop("customer_pk"), SG.DEFAULT_MODEL)


@query("train_segments")
def _train_segments(t: Tables) -> DataFrame:
    feats = _model_features(t)
    pm, model, silhouette = SG.train_segments(feats, 4, 3, 7)
    return SG.cluster_summary(feats, pm, model, silhouette)


@query("feature_statistics", O.with_views(
    "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, round(AVG({f}), 4) AS mean, round(stddev_samp({f}), 4) AS std FROM mf"
                         for f in FE.FEATURE_ORDER), *MODEL_FEATURE_CTES, ("mf", MODEL_FEATURES_SQL)))
def _feature_statistics(t: Tables) -> DataFrame:
    """What the scaler learns: mean and sample deviation of every model feature."""
    row = _model_features(t).agg(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.round(F.avg(f), 4).alias("mean"), F.round(F.stddev_samp(f), 4).alias("std"))
        for f in FE.FEATURE_ORDER]).alias("s"))
    return row.select(F.inline("s"))


def _predicted_ctes(who: str) -> tuple:
    """The segment CTEs over the predictions of the customers that ``who`` names."""
    return (*MODEL_FEATURE_CTES, ("mf", MODEL_FEATURES_SQL), ("scored", SG.score_sql(SG.DEFAULT_MODEL, "mf")),
            ("batch", f"""
SELECT c.id AS pos, p.customer_id, p.segment_name, p.description, p.confidence
FROM scored p JOIN customers c ON c.customer_id = p.customer_id WHERE {who}"""), *SEG_CTES[1:])


@query("predict_and_update", O.with_views(UPDATE_RESULTS_SQL, *_predicted_ctes("TRUE")))
def _predict_and_update(t: Tables) -> DataFrame:
    return J.predict_and_update(t, AS_OF, SG.DEFAULT_MODEL, ST.scratch(t.spark, "predict"))["results"]


@query("sync_segments", O.with_views(UPDATE_RESULTS_SQL, *_predicted_ctes("c.role = 'customer' AND c.customer_id <> ''")))
def _sync_segments(t: Tables) -> DataFrame:
    return J.sync_segments(t, AS_OF, SG.DEFAULT_MODEL, ST.scratch(t.spark, "sync"))


SYNC_ONE = "CUS-000011"


@query("sync_one_customer", O.with_views(UPDATE_RESULTS_SQL, *_predicted_ctes(
    f"c.role = 'customer' AND c.customer_id = '{SYNC_ONE}'")))
def _sync_one_customer(t: Tables) -> DataFrame:
    return J.sync_segments(t, AS_OF, SG.DEFAULT_MODEL, ST.scratch(t.spark, "sync-one"), SYNC_ONE)


# ---------------------------------------------------------------------------
# Streaming (each runs a stream to completion over the inputs)
# ---------------------------------------------------------------------------

QUERIES["stream_ingest"] = lambda spark, sf_dir: ST.stream_ingest_events(spark, sf_dir)
ORACLE["stream_ingest"] = ORACLE["ingest_events"]

QUERIES["stream_daily_clicks"] = lambda spark, sf_dir: ST.stream_daily_clicks(spark, sf_dir)
ORACLE["stream_daily_clicks"] = O.with_views(f"""
SELECT CAST(created_at AS DATE) AS day, COUNT(*) AS clicks FROM analytics_events
WHERE event_type IN {O.CLK} GROUP BY CAST(created_at AS DATE)""")

QUERIES["stream_weekly_metrics"] = lambda spark, sf_dir: ST.stream_weekly_metrics(spark, sf_dir)
ORACLE["stream_weekly_metrics"] = O.with_views(f"""
SELECT window_start, window_end, impressions, clicks, engagements,
       {O.pct('clicks', 'impressions')} AS ctr, {O.pct('engagements', 'clicks')} AS conversion_rate
FROM (SELECT date_trunc('day', created_at) - to_days(CAST(k AS INTEGER)) AS window_start,
             date_trunc('day', created_at) - to_days(CAST(k AS INTEGER)) + INTERVAL 7 DAY AS window_end,
             COUNT(*) FILTER (WHERE event_type IN {O.IMP}) AS impressions,
             COUNT(*) FILTER (WHERE event_type IN {O.CLK}) AS clicks,
             COUNT(*) FILTER (WHERE event_type IN {O.ENG}) AS engagements
      FROM analytics_events CROSS JOIN range(7) t(k) GROUP BY 1, 2) w""")

QUERIES["stream_segment_updates"] = lambda spark, sf_dir: ST.stream_segment_results(spark, sf_dir, AS_OF)
ORACLE["stream_segment_updates"] = ORACLE["segment_update_results"]


@query("ab_test_assigned", O.with_views("""
SELECT t.id AS test_id, t.test_name,
       COUNT(DISTINCT CASE WHEN a.variant = 'A' THEN a.customer_id END) AS variant_a_assigned,
       COUNT(DISTINCT CASE WHEN a.variant = 'B' THEN a.customer_id END) AS variant_b_assigned
FROM ab_tests t LEFT JOIN ab_test_assignments a ON a.ab_test_id = t.id GROUP BY t.id, t.test_name"""))
def _ab_test_assigned(t: Tables) -> DataFrame:
    return P.ab_test_assigned(t.ab_tests, t.ab_test_assignments)


@query("segment_master", O.with_views(
    "SELECT id, name, COALESCE(description, '') AS description FROM new_segments", *SEG_CTES))
def _segment_master(t: Tables) -> DataFrame:
    """The segment list (L24) of the segments table as it stands after the
    derived segment batch has been applied."""
    return C.segment_master(_segment_job(t)["segments"])
