"""Per-customer model features (17 inputs plus dominant feature and total
activity), as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import expr as X

# Fixed values (feature order and defaults the scoring model expects) ---------
FEATURE_ORDER = [
    "transaction_frequency_monthly",
    "avg_balance",
    "transfer_ratio",
    "payment_ratio",
    "qris_ratio",
    "topup_ratio",
    "investment_activity",
    "loan_usage",
    "credit_card_usage",
    "cardless_usage",
    "poin_xtra_active",
    "login_frequency_weekly",
    "avg_session_duration_min",
    "recent_transaction_days",
    "dominant_activity_enc",
    "frequent_product_enc",
    "customer_type_enc",
]
DEFAULT_LOAN_USAGE = 0.40
DEFAULT_CREDIT_CARD_USAGE = 0.40
DEFAULT_CARDLESS_USAGE = 0.25
DEFAULT_POIN_XTRA_ACTIVE = 0.40
DEFAULT_LOGIN_FREQUENCY_WEEKLY = 26.5
DEFAULT_AVG_SESSION_DURATION_MIN = 8.0
DEFAULT_AVG_BALANCE = 50_250_000.0
DEFAULT_RECENT_TRANSACTION_DAYS = 15.0
DOMINANT_ACTIVITY_CODES = {
    "bills_topup": 0,
    "low_activity": 1,
    "qris_payment": 2,
    "transfer": 3,
    "wealth_investment": 4,
}
DEFAULT_FREQUENT_PRODUCT_ENC = 4
DEFAULT_CUSTOMER_TYPE_ENC = 2
TRANSFER_NEEDLES = ("transfer",)
PAYMENT_NEEDLES = ("bill", "payment", "tagihan", "auto_debit")
QRIS_NEEDLES = ("qris",)
TOPUP_NEEDLES = ("topup", "e_wallet", "wallet", "octo_pay")
INVESTMENT_NEEDLES = ("investment", "reksa", "deposito")


def dominant_activity_code(name: Column) -> Column:
    """Ordinal code of the dominant feature; investment beats qris beats
    bills/top-up beats transfer; anything else (or none) is low activity."""
    c = DOMINANT_ACTIVITY_CODES
    return (F.when(name == "", F.lit(c["low_activity"]))
            .when(X.contains_any(name, INVESTMENT_NEEDLES), F.lit(c["wealth_investment"]))
            .when(X.contains_any(name, QRIS_NEEDLES), F.lit(c["qris_payment"]))
            .when(X.contains_any(name, PAYMENT_NEEDLES + TOPUP_NEEDLES), F.lit(c["bills_topup"]))
            .when(X.contains_any(name, TRANSFER_NEEDLES), F.lit(c["transfer"]))
            .otherwise(F.lit(c["low_activity"])))


def activity_counts(transactions: DataFrame, accounts: DataFrame, user_activities: DataFrame) -> DataFrame:
    """(cid, normalised name) -> cnt, tx_cnt, latest_tx.

    One row per feature use (NULL features left out) and one per
    transaction, named by their normalised feature / type, grouped once.
    Summing usage counts per raw feature and then per normalised name gives
    the same totals as counting per normalised name directly. ``tx_cnt`` and
    ``latest_tx`` only count transactions (also those whose type normalises
    to '')."""
    fu = user_activities.filter(F.col("feature").isNotNull()).select(
        F.col("customer_id").alias("cid"), X.normalize_feature("feature").alias("name"),
        F.lit(None).cast("timestamp_ntz").alias("tx_at"))
    owners = accounts.select(F.col("id").alias("account_id"), F.col("customer_id").alias("cid"))
    tx = transactions.select("account_id", X.normalize_feature("type").alias("name"),
                             F.col("created_at").alias("tx_at"), F.lit(True).alias("is_tx")) \
        .join(owners, "account_id").select("cid", "name", "tx_at", "is_tx")
    rows = fu.withColumn("is_tx", F.lit(False)).unionByName(tx)
    return rows.groupBy("cid", "name").agg(
        F.count(F.lit(1)).alias("cnt"), X.count_if(F.col("is_tx")).alias("tx_cnt"),
        F.max("tx_at").alias("latest_tx"))


def model_features(customers: DataFrame, transactions: DataFrame, accounts: DataFrame,
                   user_activities: DataFrame, as_of, use_balances: bool = False) -> DataFrame:
    """One row per customer: ``customer_id`` (public), the 17 model inputs
    (double), ``dominant_feature`` and ``total_activity``.

    Transactions and feature uses are reduced per (customer, name) in one
    aggregation, then per customer; the dominant feature is a
    ``min(struct(-count, name))`` aggregate, so no per-customer list is ever
    built and the transactions are joined to their accounts once.

    ``avg_balance`` is the fixed default, as in the reference, unless
    ``use_balances=True``: then it is the mean balance of the customer's
    accounts (default when the customer has none).
    """
    counts = activity_counts(transactions, accounts, user_activities)
    name = F.col("name")
    named = name != ""
    cnt = F.when(named, F.col("cnt")).otherwise(F.lit(0))

    def matching(needles):
        return F.sum(F.when(named & X.contains_any(name, needles), F.col("cnt")).otherwise(F.lit(0)))

    per_c = counts.groupBy("cid").agg(
        F.sum(cnt).alias("total"),
        matching(TRANSFER_NEEDLES).alias("transfer_n"),
        matching(PAYMENT_NEEDLES).alias("payment_n"),
        matching(QRIS_NEEDLES).alias("qris_n"),
        matching(TOPUP_NEEDLES).alias("topup_n"),
        matching(INVESTMENT_NEEDLES).alias("investment_n"),
        F.min(F.when(named, F.struct((-F.col("cnt")).alias("neg"), name.alias("name")))).alias("_dom"),
        F.sum("tx_cnt").alias("n_tx"),
        F.max("latest_tx").alias("latest"),
    )
    c = customers.select(F.col("id").alias("cid"), "customer_id")
    j = c.join(per_c, "cid", "left")
    balance = F.lit(DEFAULT_AVG_BALANCE)
    if use_balances:
        bal = accounts.groupBy(F.col("customer_id").alias("cid")).agg(
            F.avg(F.col("balance").cast("double")).alias("_bal"))
        j = j.join(bal, "cid", "left")
        balance = F.coalesce(F.col("_bal"), balance)
    total = F.coalesce(F.col("total"), F.lit(0)).cast("bigint")
    dominant = F.coalesce(F.col("_dom.name"), F.lit(""))
    days = F.greatest(X.days_between_floor(X.ntz(as_of), F.col("latest")), F.lit(0))
    recent = (F.when(F.coalesce(F.col("n_tx"), F.lit(0)) == 0, F.lit(DEFAULT_RECENT_TRANSACTION_DAYS))
              .when(F.col("latest").isNull(), F.lit(DEFAULT_RECENT_TRANSACTION_DAYS))
              .otherwise(days.cast("double")))
    feats = {
        "transaction_frequency_monthly": F.coalesce(F.col("n_tx"), F.lit(0)).cast("double"),
        "avg_balance": balance,
        "transfer_ratio": X.ratio4(F.col("transfer_n"), total),
        "payment_ratio": X.ratio4(F.col("payment_n"), total),
        "qris_ratio": X.ratio4(F.col("qris_n"), total),
        "topup_ratio": X.ratio4(F.col("topup_n"), total),
        "investment_activity": F.when(F.coalesce(F.col("investment_n"), F.lit(0)) > 0, 1.0).otherwise(0.0),
        "loan_usage": F.lit(DEFAULT_LOAN_USAGE),
        "credit_card_usage": F.lit(DEFAULT_CREDIT_CARD_USAGE),
        "cardless_usage": F.lit(DEFAULT_CARDLESS_USAGE),
        "poin_xtra_active": F.lit(DEFAULT_POIN_XTRA_ACTIVE),
        "login_frequency_weekly": F.lit(DEFAULT_LOGIN_FREQUENCY_WEEKLY),
        "avg_session_duration_min": F.lit(DEFAULT_AVG_SESSION_DURATION_MIN),
        "recent_transaction_days": recent,
        "dominant_activity_enc": dominant_activity_code(dominant).cast("double"),
        "frequent_product_enc": F.lit(float(DEFAULT_FREQUENT_PRODUCT_ENC)),
        "customer_type_enc": F.lit(float(DEFAULT_CUSTOMER_TYPE_ENC)),
    }
    return j.select(F.col("cid").alias("customer_pk"), "customer_id",
                    *[feats[f].cast("double").alias(f) for f in FEATURE_ORDER],
                    dominant.alias("dominant_feature"), total.alias("total_activity"))
