"""The personalisation tables, derived from the input parquet tables.

Each table is a plain DataFrame expression over the scans in
:mod:`tessera.sources.driver`, so every report's work grows with the inputs.
The three small dimension tables (segments, recommendations, A/B tests) are
literal rows joined against the derived facts.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.sources.driver import read_table

# Fixed values of the fixture tables -----------------------------------------
# Feature name by (first number in events.props) % 12; 10 -> '' and 11 -> NULL.
EVENT_FEATURES = ("investment", "topup", "transfer", "bill_payment", "qris", "e_wallet_link",
                  "reksa_dana", "deposito", "tabungan_emas", "asuransi_jiwa", "")
# (id, name, mktsegment, description)
SEGMENT_ROWS = [
    (1, "investor", "MACHINERY", "high balance"),
    (2, "low_activity", "FURNITURE", "low usage"),
    (3, "digital_spender", "AUTOMOBILE", "e-wallet"),
    (4, "bill_payer", "BUILDING", None),
    (5, "empty_segment", "NONE", "nobody"),
]
# (id, segment_id, feature, reason, priority)
RECOMMENDATION_ROWS = [
    (1, 1, "fund switch", "invest", 1),
    (2, 2, "free payout", None, 4),
    (3, 3, "wallet bonus", "cashback", 1),
    (5, 1, "deposito", "grow", 2),
    (6, 3, None, "cashback2", 1),
]
# (id, test_name, feature, variant_a, variant_b, end_date, status)
AB_TEST_ROWS = [
    (1, "cta", "topup", "blue", "red", None, "active"),
    (2, "layout", "qris", "grid", "list", dt.datetime(2024, 1, 20), "completed"),
    (3, "old", "transfer", "x", "y", dt.datetime(2023, 1, 1), "completed"),
    (4, "unassigned", "investment", "p", "q", None, "active"),
    (5, "halted", "deposito", "m", "n", None, "paused"),
]
# Load time stamped on rows whose source has no time of its own.
SEED_TIME = "2023-12-31 00:00:00"
SEGMENT_ASSIGNED_AT = "2024-01-01 00:00:00"
HISTORY_ASSIGNED_AT = "2024-01-10 00:00:00"


def ntz(text: str) -> Column:
    """TIMESTAMP_NTZ literal, independent of the session time zone."""
    return F.lit(text).cast("timestamp_ntz")


def analytics_from_events(e: DataFrame) -> DataFrame:
    """``analytics_events`` rows from rows of the input ``events`` table
    (batch or stream): both aliases of each event class; the feature is
    NULL, empty or one of ten names."""
    et = F.col("event_type")
    even = F.col("event_id") % 2 == 0
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int") % 12
    # one array lookup: the regex runs once per row (a CASE chain would
    # evaluate it again in every branch condition); bucket 11 -> NULL
    names = F.array(*[F.lit(x) for x in EVENT_FEATURES], F.lit(None).cast("string"))
    feature = F.try_element_at(names, (k + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("customer_id"),
        F.when((et == "view") & even, "recommendation_impression")
         .when(et == "view", "recommendation_viewed")
         .when((et == "click") & even, "recommendation_click")
         .when(et == "click", "recommendation_clicked")
         .when(et == "purchase", "recommendation_engaged")
         .when(et == "signup", "feature_used")
         .otherwise("recommendation_generated").alias("event_type"),
        feature.alias("feature"),
        F.col("props").alias("metadata"),
        F.col("ts").alias("created_at"),
    )


def customers_of(c: DataFrame) -> DataFrame:
    """``customers`` rows from rows of the input ``customer`` table."""
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.format_string(S.CUSTOMER_ID_FORMAT, k).alias("customer_id"),
        F.when(k % 10 == 9, F.lit(None).cast("string")).otherwise(F.lower("c_name")).alias("username"),
        F.concat(F.lower("c_name"), F.lit("@mail.com")).alias("email"),
        F.when(k % 50 == 49, "admin").otherwise("customer").alias("role"),
        (k % 4 != 3).alias("is_activity_tracking_enabled"),
        ntz(SEED_TIME).alias("created_at"),
    )


class Tables:
    """Lazily-built DataFrames of the reference tables for one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    TABLE_NAMES = ("customers", "customer_profiles", "accounts", "transactions", "analytics_events",
                   "user_activities", "segments", "user_segments", "user_segment_history", "recommendations",
                   "ab_tests", "ab_test_assignments")

    def register_views(self, prefix: str = "") -> list[str]:
        """Register every table as a temporary view, for ``spark.sql``."""
        names = []
        for name in self.TABLE_NAMES:
            getattr(self, name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    # -- facts and customer-sized tables ---------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        return customers_of(self.raw("customer"))

    @cached_property
    def customer_profiles(self) -> DataFrame:
        c = self.raw("customer")
        return (c.filter(F.col("c_custkey") % 11 != 10)
                .select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("customer_id"),
                        F.col("c_name").alias("full_name"), ntz(SEED_TIME).alias("created_at")))

    @cached_property
    def accounts(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"), k.alias("customer_id"),
            F.format_string("%010d", k).alias("account_no"),
            F.when(k % 3 == 0, "savings").when(k % 3 == 1, "investment").otherwise("e_wallet").alias("type"),
            F.col("c_acctbal").cast("decimal(15,2)").alias("balance"),
            F.lit("IDR").alias("currency"),
            ntz(SEED_TIME).alias("created_at"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        o = self.raw("orders")
        p = F.col("o_orderpriority")
        s = F.col("o_orderstatus")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("account_id"),
            F.concat(F.lit("TRX-"), F.format_string("%06d", F.col("o_orderkey"))).alias("trx_id"),
            F.when(p == "1-URGENT", "Transfer").when(p == "2-HIGH", "bill payment")
             .when(p == "3-MEDIUM", "topup").when(p == "4-NOT SPECIFIED", "qris")
             .otherwise("investment").alias("type"),
            F.col("o_totalprice").cast("decimal(15,2)").alias("amount"),
            F.when(s == "F", "success").when(s == "P", "pending").otherwise("failed").alias("status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def analytics_events(self) -> DataFrame:
        return analytics_from_events(self.raw("events"))

    @cached_property
    def user_activities(self) -> DataFrame:
        ae = self.analytics_events
        return (ae.filter(F.col("event_type").isin("feature_used", "recommendation_engaged")
                          & F.col("feature").isNotNull())
                .select("id", "customer_id", F.lit("feature_usage").alias("activity_type"),
                        "feature", "metadata", "created_at"))

    # -- dimensions ---------------------------------------------------------
    @cached_property
    def segments_with_mkt(self) -> DataFrame:
        return self.spark.createDataFrame(
            SEGMENT_ROWS, "id int, name string, mktsegment string, description string")

    @cached_property
    def segments(self) -> DataFrame:
        return self.segments_with_mkt.select("id", "name", "description")

    @cached_property
    def recommendations(self) -> DataFrame:
        return self.spark.createDataFrame(RECOMMENDATION_ROWS, S.RECOMMENDATIONS)

    @cached_property
    def ab_tests(self) -> DataFrame:
        return self.spark.createDataFrame(AB_TEST_ROWS, S.AB_TESTS)

    # -- bridges ------------------------------------------------------------
    @cached_property
    def user_segments(self) -> DataFrame:
        c = self.raw("customer").filter(F.col("c_custkey") % 7 != 6)
        s = self.segments_with_mkt
        k = F.col("c_custkey")
        return (c.join(F.broadcast(s), s.mktsegment == c.c_mktsegment)
                .select(k.alias("id"), k.alias("customer_id"), s.id.alias("segment_id"),
                        ((k % 101).cast("double") / 100).alias("confidence"),
                        ntz(SEGMENT_ASSIGNED_AT).alias("created_at")))

    @cached_property
    def user_segment_history(self) -> DataFrame:
        us = self.user_segments
        extra = (us.filter(F.col("customer_id") % 3 == 0)
                 .select((F.col("id") * 2 + 1).alias("id"), "customer_id",
                         (F.col("segment_id") % 4 + 1).alias("segment_id"),
                         F.when(F.col("customer_id") % 2 == 0, F.col("confidence"))
                          .otherwise(F.lit(0.5)).alias("confidence"),
                         ntz(HISTORY_ASSIGNED_AT).alias("created_at")))
        return us.withColumn("id", F.col("id") * 2).unionByName(extra)

    @cached_property
    def ab_test_assignments(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        t1 = c.filter(k % 3 == 0).select(
            (k * 2 + 1).alias("id"), k.alias("customer_id"), F.lit(1).alias("ab_test_id"),
            F.when(k % 2 == 0, "A").otherwise("B").alias("variant"))
        t2 = c.filter(k % 5 == 0).select(
            (k * 2).alias("id"), k.alias("customer_id"), F.lit(2).alias("ab_test_id"),
            F.when(k % 4 < 2, "A").otherwise("B").alias("variant"))
        return t1.unionByName(t2)
