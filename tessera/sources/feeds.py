"""Batch inputs of the mutation jobs, derived from the input tables.

The reference receives these as HTTP bodies; here each feed is a DataFrame
expression over the parquet inputs, so the jobs run at the inputs' scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schemas as S
from tessera.sources.fixtures import Tables

# Segment proposed for each market segment of the customer table.
MKT_TO_SEGMENT = {"MACHINERY": "investor", "FURNITURE": "low_activity", "AUTOMOBILE": "digital_spender",
                  "BUILDING": "bill_payer"}
NEW_SEGMENT = "household_saver"
VIP_SEGMENT = "vip_saver"


def _segment_for(mkt: Column) -> Column:
    out = F.lit(NEW_SEGMENT)
    for m, name in reversed(list(MKT_TO_SEGMENT.items())):
        out = F.when(mkt == m, F.lit(name)).otherwise(out)
    return out


def _code(k: Column) -> Column:
    return F.format_string(S.CUSTOMER_ID_FORMAT, k)


def segment_batch(t: Tables) -> DataFrame:
    """A valid segment-update batch: one row per customer in key order, and a
    second, later row for every tenth customer (same customer twice)."""
    c = t.raw("customer")
    k = F.col("c_custkey")
    first = c.select(
        (k * 2).alias("pos"),
        F.when(k % 2 == 0, _code(k)).otherwise(k.cast("string")).alias("customer_id"),
        _segment_for(F.col("c_mktsegment")).alias("segment_name"),
        F.when(k % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("assigned from "), F.col("c_mktsegment"), F.lit(" #"), k.cast("string"))).alias("description"),
        ((k % 97).cast("double") / 100).alias("confidence"))
    second = c.filter(k % 10 == 0).select(
        (k * 2 + 1).alias("pos"), _code(k).alias("customer_id"),
        F.when(k % 20 == 0, F.lit(VIP_SEGMENT)).otherwise(F.lit("investor")).alias("segment_name"),
        F.lit("").alias("description"), F.lit(0.99).alias("confidence"))
    return first.unionByName(second)


def segment_batch_with_errors(t: Tables) -> DataFrame:
    """A batch with every kind of bad row: missing key or name, unknown
    customer, confidence outside [0, 1] (and the 0 / 1 edges, which pass)."""
    c = t.raw("customer")
    k = F.col("c_custkey")
    key = (F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.concat(F.lit("CUS-X"), k.cast("string")))
           .when(k % 2 == 0, _code(k)).otherwise(k.cast("string")))
    name = F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(_segment_for(F.col("c_mktsegment")))
    conf = (F.when(k % 19 == 0, F.lit(-0.1)).when(k % 23 == 0, F.lit(1.1)).when(k % 29 == 0, F.lit(0.0))
            .when(k % 31 == 0, F.lit(1.0)).otherwise((k % 97).cast("double") / 100))
    return c.select(k.alias("pos"), key.alias("customer_id"), name.alias("segment_name"),
                    F.lit("").alias("description"), conf.alias("confidence"))


def registrations(t: Tables) -> DataFrame:
    """Sign-ups derived from the supplier table, in supplier-key order; one has no email."""
    s = t.raw("supplier")
    name = F.col("s_name")
    return s.select(F.col("s_suppkey").alias("pos"), name.alias("full_name"),
                    F.lower(F.replace(name, F.lit("#"), F.lit("_"))).alias("username"),
                    F.when(F.col("s_suppkey") != 3, F.concat(F.lower(name), F.lit("@mail.com"))).alias("email"))


def sign_up_requests(t: Tables) -> DataFrame:
    """Sign-up requests derived from the customer table, numbered by customer key. Each has an account of its own, and
    two of three share an email with the request before them, so requests clash in chains of three; every 11th repeats an
    email, every 17th has the email of a customer, every 23rd no account at all."""
    c = t.raw("customer")
    k = F.col("c_custkey")
    mail = lambda n: F.concat(F.lit("new"), n.cast("string"), F.lit("@mail.com"))
    account = lambda pos, name, email: F.struct(
        F.lit(pos).cast("bigint").alias("pos"), name.alias("full_name"), F.lower(name).alias("username"), email.alias("email"))
    nobody = F.struct(F.lit(None).cast("bigint").alias("pos"), *[
        F.lit(None).cast("string").alias(n) for n in ("full_name", "username", "email")])
    accounts = F.array_compact(F.array(
        account(1, F.col("c_name"), mail(k)),
        F.when(k % 3 != 0, account(2, F.col("c_name"), mail(k - 1))),
        F.when(k % 11 == 0, account(3, F.col("c_name"), mail(k))),
        F.when(k % 17 == 0, account(4, F.col("c_name"), F.concat(F.lower("c_name"), F.lit("@mail.com"))))))
    return c.select(k.alias("request"), F.inline(F.when(k % 23 == 0, F.array(nobody)).otherwise(accounts)))


def tracking_updates(t: Tables) -> DataFrame:
    """One tracking update per customer row, naming the customer by id text,
    by public id or by an unknown key; some without the flag."""
    c = t.raw("customer")
    k = F.col("c_custkey")
    key = (F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, _code(k))
           .otherwise(F.concat(F.lit("CUS-X"), k.cast("string"))))
    flag = F.when(k % 10 == 7, F.lit(None).cast("boolean")).otherwise(F.col("c_acctbal") >= 0)
    return c.select(k.alias("seq"), key.alias("key"), flag.alias("is_activity_tracking_enabled"))


def account_refresh(t: Tables, as_of: str) -> DataFrame:
    """Balance refresh per customer with pending orders: the latest pending
    order's amount; every ninth customer gets a new account number."""
    o = t.raw("orders").filter(F.col("o_orderstatus") == "P")
    latest = o.groupBy("o_custkey").agg(
        F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("l"))
    k = F.col("o_custkey")
    acct = F.when(k % 9 == 0, F.concat(F.lit("N"), F.format_string("%09d", k))) \
            .otherwise(F.format_string("%010d", k))
    return latest.select(acct.alias("account_no"), k.alias("customer_id"), F.lit("savings").alias("type"),
                         F.col("l.o_totalprice").cast("decimal(15,2)").alias("balance"),
                         F.lit("IDR").alias("currency"),
                         F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
