"""DuckDB SQL for the correctness oracle.

Only the raw input tables are registered on the DuckDB side, so every oracle
statement starts with the fixture views as CTEs (same contents as
:mod:`tessera.sources.fixtures`). The statements follow the meaning of each
report and count in another way than the Spark plans they check.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS: list[tuple[str, str]] = [
    ("customers", """
SELECT c_custkey AS id, printf('CUS-%06d', c_custkey) AS customer_id,
       CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE lower(c_name) END AS username,
       concat(lower(c_name), '@mail.com') AS email,
       CASE WHEN c_custkey % 50 = 49 THEN 'admin' ELSE 'customer' END AS role,
       c_custkey % 4 <> 3 AS is_activity_tracking_enabled,
       TIMESTAMP '2023-12-31 00:00:00' AS created_at
FROM customer"""),
    ("customer_profiles", """
SELECT c_custkey AS id, c_custkey AS customer_id, c_name AS full_name,
       TIMESTAMP '2023-12-31 00:00:00' AS created_at
FROM customer WHERE c_custkey % 11 <> 10"""),
    ("accounts", """
SELECT c_custkey AS id, c_custkey AS customer_id, printf('%010d', c_custkey) AS account_no,
       CASE c_custkey % 3 WHEN 0 THEN 'savings' WHEN 1 THEN 'investment' ELSE 'e_wallet' END AS type,
       CAST(c_acctbal AS DECIMAL(15,2)) AS balance, 'IDR' AS currency,
       TIMESTAMP '2023-12-31 00:00:00' AS created_at
FROM customer"""),
    ("transactions", """
SELECT o_orderkey AS id, o_custkey AS account_id, concat('TRX-', printf('%06d', o_orderkey)) AS trx_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Transfer' WHEN '2-HIGH' THEN 'bill payment' WHEN '3-MEDIUM' THEN 'topup'
            WHEN '4-NOT SPECIFIED' THEN 'qris' ELSE 'investment' END AS type,
       CAST(o_totalprice AS DECIMAL(15,2)) AS amount,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'pending' ELSE 'failed' END AS status,
       o_orderdate AS created_at
FROM orders"""),
    ("analytics_events", """
SELECT event_id AS id, user_id AS customer_id,
       CASE WHEN event_type = 'view'  AND event_id % 2 = 0 THEN 'recommendation_impression'
            WHEN event_type = 'view'  THEN 'recommendation_viewed'
            WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'recommendation_click'
            WHEN event_type = 'click' THEN 'recommendation_clicked'
            WHEN event_type = 'purchase' THEN 'recommendation_engaged'
            WHEN event_type = 'signup' THEN 'feature_used'
            ELSE 'recommendation_generated' END AS event_type,
       CASE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 12
            WHEN 0 THEN 'investment' WHEN 1 THEN 'topup' WHEN 2 THEN 'transfer' WHEN 3 THEN 'bill_payment'
            WHEN 4 THEN 'qris' WHEN 5 THEN 'e_wallet_link' WHEN 6 THEN 'reksa_dana' WHEN 7 THEN 'deposito'
            WHEN 8 THEN 'tabungan_emas' WHEN 9 THEN 'asuransi_jiwa' WHEN 10 THEN '' END AS feature,
       props AS metadata, ts AS created_at
FROM events"""),
    ("user_activities", """
SELECT id, customer_id, 'feature_usage' AS activity_type, feature, metadata, created_at
FROM analytics_events WHERE event_type IN ('feature_used', 'recommendation_engaged') AND feature IS NOT NULL"""),
    ("segments_mkt", """
SELECT * FROM (VALUES (1, 'investor', 'MACHINERY', 'high balance'), (2, 'low_activity', 'FURNITURE', 'low usage'),
       (3, 'digital_spender', 'AUTOMOBILE', 'e-wallet'), (4, 'bill_payer', 'BUILDING', NULL),
       (5, 'empty_segment', 'NONE', 'nobody')) AS t(id, name, mktsegment, description)"""),
    ("segments", "SELECT id, name, description FROM segments_mkt"),
    ("user_segments", """
SELECT c.c_custkey AS id, c.c_custkey AS customer_id, s.id AS segment_id,
       CAST(c.c_custkey % 101 AS DOUBLE) / 100 AS confidence, TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM customer c JOIN segments_mkt s ON s.mktsegment = c.c_mktsegment WHERE c.c_custkey % 7 <> 6"""),
    ("user_segment_history", """
SELECT id * 2 AS id, customer_id, segment_id, confidence, created_at FROM user_segments
UNION ALL SELECT id * 2 + 1, customer_id, segment_id % 4 + 1, CASE WHEN customer_id % 2 = 0 THEN confidence ELSE 0.5 END,
       TIMESTAMP '2024-01-10 00:00:00' FROM user_segments WHERE customer_id % 3 = 0"""),
    ("recommendations", """
SELECT * FROM (VALUES (1, 1, 'fund switch', 'invest', 1), (2, 2, 'free payout', NULL, 4),
       (3, 3, 'wallet bonus', 'cashback', 1), (5, 1, 'deposito', 'grow', 2),
       (6, 3, CAST(NULL AS VARCHAR), 'cashback2', 1)) AS t(id, segment_id, feature, reason, priority)"""),
    ("ab_tests", """
SELECT * FROM (VALUES (1, 'cta', 'topup', 'blue', 'red', CAST(NULL AS TIMESTAMP), 'active'),
       (2, 'layout', 'qris', 'grid', 'list', TIMESTAMP '2024-01-20 00:00:00', 'completed'),
       (3, 'old', 'transfer', 'x', 'y', TIMESTAMP '2023-01-01 00:00:00', 'completed'),
       (4, 'unassigned', 'investment', 'p', 'q', CAST(NULL AS TIMESTAMP), 'active'),
       (5, 'halted', 'deposito', 'm', 'n', CAST(NULL AS TIMESTAMP), 'paused'))
       AS t(id, test_name, feature, variant_a, variant_b, end_date, status)"""),
    ("ab_test_assignments", """
SELECT c_custkey * 2 + 1 AS id, c_custkey AS customer_id, 1 AS ab_test_id, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS variant
FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey * 2, c_custkey, 2, CASE WHEN c_custkey % 4 < 2 THEN 'A' ELSE 'B' END FROM customer WHERE c_custkey % 5 = 0"""),
]

IMP = "('recommendation_impression', 'recommendation_viewed')"
CLK = "('recommendation_click', 'recommendation_clicked')"
ENG = "('recommendation_engaged', 'feature_used')"


def with_views(body: str, *ctes: tuple[str, str]) -> str:
    """``WITH <fixture views>, <ctes> <body>``."""
    parts = [f"{name} AS ({sql.strip()})" for name, sql in list(VIEWS) + list(ctes)]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def pct(num: str, den: str) -> str:
    return f"(CASE WHEN {den} = 0 THEN 0.0 ELSE round(CAST({num} AS DOUBLE) / {den} * 10000) / 100 END)"


def change(now: str, last: str) -> str:
    return (f"(CASE WHEN {last} = 0 THEN (CASE WHEN {now} = 0 THEN 0.0 ELSE 100.0 END) "
            f"ELSE round((CAST({now} AS DOUBLE) - {last}) / {last} * 10000) / 100 END)")


def frac(num: str, den: str) -> str:
    return f"(CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} ELSE 0.0 END)"


def days_before(days: int, ts: str = AS_OF) -> str:
    return f"({ts} - INTERVAL {int(days)} DAY)"


def top1(table: str = "user_segment_history") -> str:
    """Top-1 assignment per customer, written as a ranking (LATERAL .. LIMIT 1)."""
    return (f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id "
            f"ORDER BY confidence DESC, created_at DESC NULLS FIRST, id DESC) AS rn FROM {table}) WHERE rn = 1")
