"""Customer-centric reports: key resolution, visibility, profiles, top-1
segment, transactions, feature usage, segment memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.joins import customer_aliases


# -- B1 / B11 ----------------------------------------------------------------
def resolve_customers(keys: DataFrame, customers: DataFrame, key_col: str = "key") -> DataFrame:
    """Attach ``id`` and ``customer_id`` to every key that names a customer by
    internal id (as text) or public id; unknown keys keep NULLs."""
    aliases = customer_aliases(customers)
    out = keys.join(aliases, keys[key_col] == aliases["alias"], "left").drop("alias")
    return (out.withColumnRenamed("resolved_id", "id")
            .withColumnRenamed("resolved_customer_id", "customer_id"))


def visible_rows(df: DataFrame, role: str, principal_id: int | None,
                 principal_code: str | None = None, id_col: str = "customer_id",
                 code_col: str | None = None) -> DataFrame:
    """Row visibility: an admin sees every row, anyone else only rows that
    belong to them (by internal id, or public id when ``code_col`` is given)."""
    if role == "admin":
        return df
    cond = F.col(id_col) == F.lit(principal_id)
    if code_col and principal_code is not None:
        cond = cond | (F.col(code_col) == F.lit(principal_code))
    return df.filter(cond)


def admin_only(df: DataFrame, role: str) -> DataFrame:
    """Reports that only admins may read come back empty for other roles."""
    return df if role == "admin" else df.filter(F.lit(False))


# -- E3: top-1 segment per customer --------------------------------------------
def top_assignment(user_segments: DataFrame) -> DataFrame:
    """Best assignment per customer by (confidence desc, created_at desc with
    NULL first, id desc).

    A ``max(struct)`` aggregate instead of a ranking window: it aggregates
    partially before the shuffle, so a customer with millions of history
    rows never lands whole in one task.
    """
    best = user_segments.groupBy("customer_id").agg(F.max(F.struct(
        F.col("confidence"), F.col("created_at").isNull().alias("ts_null"), F.col("created_at"),
        F.col("id"), F.col("segment_id"))).alias("b"))
    return best.select("customer_id", F.col("b.segment_id").alias("segment_id"),
                       F.col("b.confidence").alias("confidence"),
                       F.col("b.created_at").alias("assigned_at"))


def top_segment(user_segments: DataFrame, segments: DataFrame, join_first: bool = False) -> DataFrame:
    """Top-1 segment of each customer with the segment's name.

    ``join_first=False``: pick the best assignment, then require its segment
    to exist (``JOIN LATERAL (.. LIMIT 1) JOIN segments``).
    ``join_first=True``: pick the best among assignments whose segment exists
    (``.. JOIN segments .. LIMIT 1``).
    """
    seg = segments.select(F.col("id").alias("segment_id"), F.col("name").alias("segment_name"),
                          F.col("description").alias("segment_description"))
    if join_first:
        us = user_segments.join(seg.select("segment_id"), "segment_id", "left_semi")
        return top_assignment(us).join(seg, "segment_id")
    return top_assignment(user_segments).join(seg, "segment_id")


# -- L14 / L15 -----------------------------------------------------------------
def user_profiles(customers: DataFrame, profiles: DataFrame) -> DataFrame:
    p = profiles.select(F.col("customer_id").alias("pid"), "full_name")
    out = customers.join(p, customers["id"] == p["pid"], "left")
    return out.select("id", "customer_id", "email",
                      F.coalesce("username", F.lit("")).alias("username"),
                      F.coalesce("full_name", F.lit("")).alias("full_name"),
                      "role", "is_activity_tracking_enabled", "created_at")


def users_with_segments(customers: DataFrame, profiles: DataFrame, user_segments: DataFrame,
                        segments: DataFrame) -> DataFrame:
    """Profiles plus the top-1 segment: '' / 0.0 / NULL when none."""
    top = top_assignment(user_segments).withColumnRenamed("customer_id", "sid")
    seg = segments.select(F.col("id").alias("segment_id"), F.col("name").alias("segment_name"))
    top = top.join(seg, "segment_id", "left")
    out = user_profiles(customers, profiles)
    out = out.join(top, out["id"] == top["sid"], "left")
    return out.select("id", "customer_id", "email", "username", "full_name", "role",
                      "is_activity_tracking_enabled", "created_at",
                      F.coalesce("segment_name", F.lit("")).alias("segment"),
                      F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                      "assigned_at")


# -- L16 / L17 / L18 -----------------------------------------------------------
def account_owners(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """account id -> (internal customer id, public customer id). Both inputs
    are customer-sized, so the fact table joins this once instead of joining
    accounts and customers one after the other."""
    a = accounts.select(F.col("id").alias("account_id"), F.col("customer_id").alias("cid"))
    c = customers.select(F.col("id").alias("cid"), F.col("customer_id").alias("customer_code"))
    return a.join(c, "cid")


def user_transactions(transactions: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """Every transaction with its owner (transactions ⋈ accounts ⋈ customers).
    Listing order (created_at desc per customer) belongs to the sink."""
    owners = account_owners(accounts, customers)
    t = transactions.select("account_id", "trx_id", "type", "amount", "status", "created_at")
    return t.join(owners, "account_id").select(
        F.col("customer_code").alias("customer_id"), "trx_id", "type",
        F.col("amount").cast("double").alias("amount"), "status", "created_at")


def feature_usage(user_activities: DataFrame) -> DataFrame:
    """(customer, feature) -> usage_count, last_used_at. NULL features are
    left out (the reference cannot read them back)."""
    return (user_activities.filter(F.col("feature").isNotNull())
            .groupBy("customer_id", "feature")
            .agg(F.count(F.lit(1)).alias("usage_count"), F.max("created_at").alias("last_used_at")))


def frequent_features(user_activities: DataFrame, customers: DataFrame) -> DataFrame:
    """Usage per customer and feature; aggregated before the customer join so
    the join sees one row per (customer, feature)."""
    usage = feature_usage(user_activities).withColumnRenamed("customer_id", "cid")
    c = customers.select(F.col("id").alias("cid"), F.col("customer_id").alias("customer_code"))
    return usage.join(c, "cid").select(F.col("customer_code").alias("customer_id"), "feature",
                                       "usage_count", "last_used_at")


def user_activity(customers: DataFrame, transactions: DataFrame, accounts: DataFrame,
                  user_activities: DataFrame) -> DataFrame:
    """Size summary of each customer's activity object: number of
    transactions and of frequently-used features (0, never NULL), latest
    transaction and latest feature use. The per-item lists are
    :func:`user_transactions` and :func:`frequent_features`; they are not
    gathered into one array per customer."""
    owners = accounts.select(F.col("id").alias("account_id"), F.col("customer_id").alias("cid"))
    tx = (transactions.select("account_id", "created_at").join(owners, "account_id")
          .groupBy("cid").agg(F.count(F.lit(1)).alias("transaction_count"),
                              F.max("created_at").alias("latest_transaction_at")))
    fu = (feature_usage(user_activities).groupBy(F.col("customer_id").alias("cid"))
          .agg(F.count(F.lit(1)).alias("feature_count"), F.max("last_used_at").alias("last_feature_used_at")))
    c = customers.select(F.col("id").alias("cid"), "customer_id")
    out = c.join(tx, "cid", "left").join(fu, "cid", "left")
    return out.select("customer_id",
                      F.coalesce("transaction_count", F.lit(0).cast("bigint")).alias("transaction_count"),
                      F.coalesce("feature_count", F.lit(0).cast("bigint")).alias("feature_count"),
                      "latest_transaction_at", "last_feature_used_at")


def user_activity_items(customers: DataFrame, transactions: DataFrame, accounts: DataFrame,
                        user_activities: DataFrame) -> DataFrame:
    """The items of every customer's activity object as long rows: one per
    transaction and one per frequently-used feature (``kind``). Per customer they
    are listed by ``happened_at``, newest first, and features by ``usage_count``."""
    tx = user_transactions(transactions, accounts, customers).select(
        "customer_id", F.lit("transaction").alias("kind"), F.col("trx_id").alias("item"), "type", "amount", "status",
        F.lit(None).cast("bigint").alias("usage_count"), F.col("created_at").alias("happened_at"))
    used = frequent_features(user_activities, customers).select(
        "customer_id", F.lit("feature").alias("kind"), F.col("feature").alias("item"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("amount"),
        F.lit(None).cast("string").alias("status"), "usage_count", F.col("last_used_at").alias("happened_at"))
    return tx.unionByName(used)


# -- L19 / L24 -----------------------------------------------------------------
def user_segmentation(customers: DataFrame, user_segments: DataFrame, segments: DataFrame,
                      recommendations: DataFrame) -> DataFrame:
    """Every segment of every customer with its recommendations, one row per
    (assignment, recommendation); an assignment whose segment has no
    recommendation keeps one row with NULL rec_* columns. Customers without
    a segment do not appear."""
    seg = segments.select(F.col("id").alias("segment_id"), F.col("name").alias("segment_name"),
                          F.coalesce("description", F.lit("")).alias("description"))
    rec = recommendations.select(
        F.col("segment_id"), F.col("id").alias("rec_id"),
        F.coalesce("feature", F.lit("")).alias("rec_feature"),
        F.coalesce("reason", F.lit("")).alias("rec_reason"), F.col("priority").alias("rec_priority"))
    c = customers.select(F.col("id").alias("cid"), F.col("customer_id").alias("customer_code"))
    us = user_segments.select(F.col("customer_id").alias("cid"), "segment_id", "confidence",
                              F.col("created_at").alias("assigned_at"))
    out = us.join(seg, "segment_id").join(rec, "segment_id", "left").join(c, "cid")
    return out.select(F.col("customer_code").alias("customer_id"), "segment_id", "segment_name",
                      "description", "confidence", "assigned_at", "rec_id", "rec_feature",
                      "rec_reason", "rec_priority")


def segment_master(segments: DataFrame) -> DataFrame:
    return segments.select("id", "name", F.coalesce("description", F.lit("")).alias("description"))


# -- B13: one-customer form of a set-based report ---------------------------------
def for_customer(df: DataFrame, customers: DataFrame, key: str, id_col: str = "customer_id",
                 by_public_id: bool = True) -> DataFrame:
    """Rows of a per-customer report for the customer named by ``key``
    (internal id as text or public id): the set-based DataFrame plus an
    equality filter, after resolving the key like the reference does."""
    from tessera.functions.joins import unique_aliases

    hit = unique_aliases(customers).filter(F.col("alias") == F.lit(key))
    col = "resolved_customer_id" if by_public_id else "resolved_id"
    return df.join(hit.select(F.col(col).alias(id_col)), id_col, "left_semi")
