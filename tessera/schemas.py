"""Table schemas and the fixed values the reports must agree on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results)
# ---------------------------------------------------------------------------
# Event classes.
IMPRESSION_EVENTS = ("recommendation_impression", "recommendation_viewed")
CLICK_EVENTS = ("recommendation_click", "recommendation_clicked")
ENGAGEMENT_EVENTS = ("recommendation_engaged", "feature_used")
RECOMMENDATION_PREFIX = "recommendation"
# Weekday labels of the clicks chart, Monday first.
WEEKDAY_LABELS = ("Senin", "Selasa", "Rabu", "Kamis", "Jumat", "Sabtu", "Minggu")
# Reason text and value per click of activity-based recommendations / ROI.
ACTIVITY_REASON = "Fitur ini relevan karena sering digunakan oleh user."
VALUE_PER_CLICK_IDR = 10000.0
CUSTOMER_ID_FORMAT = "CUS-%06d"
DEFAULT_DAYS = 30
# Reproducible clock used by tests, the oracle and the bench.
DEFAULT_AS_OF = "2024-01-31 00:00:00"

# ---------------------------------------------------------------------------
# Reference tables (Spark types)
# ---------------------------------------------------------------------------
CUSTOMERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("username", T.StringType(), True),
    T.StructField("email", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("is_activity_tracking_enabled", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

CUSTOMER_PROFILES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("full_name", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

ACCOUNTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("account_no", T.StringType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("balance", T.DecimalType(15, 2), True),
    T.StructField("currency", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("account_id", T.LongType(), True),
    T.StructField("trx_id", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("amount", T.DecimalType(15, 2), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

USER_ACTIVITIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("activity_type", T.StringType(), True),
    T.StructField("feature", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

ANALYTICS_EVENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("feature", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

SEGMENTS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
])

USER_SEGMENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("segment_id", T.IntegerType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

RECOMMENDATIONS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("segment_id", T.IntegerType(), True),
    T.StructField("feature", T.StringType(), True),
    T.StructField("reason", T.StringType(), True),
    T.StructField("priority", T.IntegerType(), True),
])

AB_TESTS = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("test_name", T.StringType(), False),
    T.StructField("feature", T.StringType(), False),
    T.StructField("variant_a", T.StringType(), False),
    T.StructField("variant_b", T.StringType(), False),
    T.StructField("end_date", T.TimestampNTZType(), True),
    T.StructField("status", T.StringType(), True),
])

AB_TEST_ASSIGNMENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("ab_test_id", T.IntegerType(), False),
    T.StructField("variant", T.StringType(), False),
])

# JSON inputs ---------------------------------------------------------------
EVENT_INPUT = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("feature", T.StringType(), True),
    # kept as raw text: validity is checked by the ingest job, not the reader
    T.StructField("metadata", T.StringType(), True),
])

SEGMENT_UPDATE_INPUT = T.StructType([
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("segment_name", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("confidence", T.DoubleType(), True),
])

SEGMENT_BATCH_INPUT = T.StructType([
    T.StructField("segments", T.ArrayType(SEGMENT_UPDATE_INPUT), True),
])

REGISTRATION_INPUT = T.StructType([
    T.StructField("full_name", T.StringType(), True),
    T.StructField("username", T.StringType(), True),
    T.StructField("email", T.StringType(), True),
    # "password" is read by the reference only to hash it; it is never loaded here.
])

TRACKING_INPUT = T.StructType([
    T.StructField("is_activity_tracking_enabled", T.BooleanType(), True),
])
