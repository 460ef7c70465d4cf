"""Ingest validation, JSON sources, registration, scoring invariants."""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.operators import ingest as I
from tessera.operators import segmentation as SG
from tessera.sources import json_sources as J

AS_OF = "2024-01-31 00:00:00"


def _raw(spark, rows):
    return spark.createDataFrame(
        [(i, c, e, f, m, dt.datetime(2024, 1, 1, 0, 0, i)) for i, c, e, f, m in rows],
        "raw_id long, customer_id string, event_type string, feature string, metadata string, "
        "received_at timestamp_ntz")


def test_event_validation_rules_in_order(spark, t001):
    raw = _raw(spark, [
        (1, "CUS-000001", "", "", "{}"),                      # event_type first
        (2, "CUS-000001", "feature_used", None, "{}"),         # feature
        (3, "CUS-999999", "feature_used", "qris", "{}"),       # unknown customer
        (4, "1", "feature_used", "qris", "{bad"),              # bad JSON
        (5, "1", "feature_used", "qris", "null"),              # literal null is valid
        (6, "", "feature_used", "qris", None),                 # principal, {} metadata
    ])
    out = {r.raw_id: (r.error, r.metadata, r.cid) for r in
           I.validate_events(raw, t001.customers, "admin", "CUS-000049").collect()}
    assert out[1][0] == "event_type is required"
    assert out[2][0] == "feature is required"
    assert out[3][0] == "user not found"
    assert out[4][0] == "metadata must be valid JSON"
    assert out[5][0] is None
    assert out[6] == (None, "{}", 49)


def test_customer_principal_may_only_post_for_itself(spark, t001):
    raw = _raw(spark, [(1, "CUS-000002", "feature_used", "qris", "{}"),
                       (2, "", "feature_used", "qris", "{}")])
    out = {r.raw_id: r.error for r in I.validate_events(raw, t001.customers, "customer", "CUS-000001").collect()}
    assert out == {1: "forbidden", 2: None}


def test_ingest_numbers_after_existing_ids(spark, t001):
    raw = _raw(spark, [(3, "1", "feature_used", "qris", "{}"), (1, "2", "feature_used", "topup", "{}"),
                       (2, "", "", "x", "{}")])
    res = I.ingest_events(raw, t001.customers, t001.analytics_events, "admin", "CUS-000049")
    top = t001.analytics_events.agg(F.max("id")).first()[0]
    ids = [(r.id, r.feature) for r in res["accepted"].orderBy("id").collect()]
    assert ids == [(top + 1, "topup"), (top + 2, "qris")]
    assert res["rejected"].count() == 1


def test_registration_object_or_array(spark, t001):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    with open(f"{d}/one.json", "w") as fh:
        json.dump({"full_name": "A", "username": "a", "email": "a@x.com", "password": "secret"}, fh)
    arr = f"{d}/arr"
    os.makedirs(arr)
    with open(f"{arr}/many.json", "w") as fh:
        json.dump([{"full_name": "B", "username": "b", "email": "b@x.com", "password": "p"},
                   {"full_name": "C", "username": "c", "email": "c@x.com", "password": "p"}], fh, indent=2)
    one = J.read_registrations(spark, f"{d}/one.json")
    many = J.read_registrations(spark, arr)
    assert "password" not in one.columns
    assert [r.email for r in many.orderBy("pos").collect()] == ["b@x.com", "c@x.com"]
    res = I.onboard_customers(many, t001.customers, AS_OF)
    top = t001.customers.agg(F.max("id")).first()[0]
    got = [(r.id, r.customer_id, r.role) for r in res["registered"].orderBy("id").collect()]
    assert got == [(top + 1, f"CUS-{top + 1:06d}", "customer"), (top + 2, f"CUS-{top + 2:06d}", "customer")]
    assert res["profiles"].count() == 2


def test_registration_duplicate_email_rejects_batch(spark, t001):
    regs = spark.createDataFrame([(1, "A", "a", "dup@x.com"), (2, "B", "b", "dup@x.com")],
                                 "pos long, full_name string, username string, email string")
    res = I.onboard_customers(regs, t001.customers, AS_OF)
    assert res["registered"].count() == 0 and res["rejected"].count() == 1


def test_segment_batch_json_keeps_order(spark):
    d = tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))
    with open(f"{d}/b.json", "w") as fh:
        json.dump({"segments": [{"customer_id": "CUS-000002", "segment_name": "x", "description": "",
                                 "confidence": 0.4},
                                {"customer_id": "1", "segment_name": "y", "description": "d", "confidence": 1}]},
                  fh, indent=1)
    rows = J.read_segment_batch(spark, d).orderBy("pos").collect()
    assert [r.customer_id for r in rows] == ["CUS-000002", "1"] and rows[1].confidence == 1.0


def test_feature_rules(spark):
    df = spark.createDataFrame([(" Bill-Payment ",), ("e wallet",), (None,)], "x string")
    assert [r.n for r in df.select(FE.X.normalize_feature("x").alias("n")).collect()] == \
        ["bill_payment", "e_wallet", ""]
    codes = spark.createDataFrame([("reksa_qris",), ("qris_topup",), ("topup",), ("transfer",), ("",), ("x",)],
                                  "d string").select(FE.dominant_activity_code(F.col("d")).alias("c"))
    assert [r.c for r in codes.collect()] == [4, 2, 0, 3, 1, 1]


def test_scoring_matches_kmeans_and_bounds(t001):
    feats = FE.model_features(t001.customers, t001.transactions, t001.accounts, t001.user_activities, AS_OF)
    pm, model, _ = SG.train_segments(feats, 4, 3, 7)
    mine = SG.score_segments(feats, model)
    theirs = pm.transform(feats).select("customer_id", F.col("cluster").alias("k"))
    j = mine.join(theirs, "customer_id")
    assert j.filter(F.col("k") != F.col("cluster")).count() == 0
    # softmax of 4 distances: the nearest centre gets at least 1/4
    assert j.filter((F.col("confidence") < 0.25) | (F.col("confidence") > 1.0)).count() == 0
    assert sorted(model.names) == sorted(SG.SEGMENT_NAMES)
    d = mine.first().description
    assert "Fitur dominan:" in d and d.endswith(".")


def test_description_default_text(spark):
    df = spark.createDataFrame([("unknown", "", 0)], "s string, d string, t long")
    r = df.select(SG.description(F.col("s"), F.col("d"), F.col("t")).alias("x")).first().x
    assert r == ("Segmen nasabah berdasarkan model clustering. Fitur dominan: aktivitas mobile banking. "
                 "Total aktivitas terdeteksi: 0.")


def test_respect_tracking_option(spark, t001):
    raw = _raw(spark, [(1, "3", "feature_used", "qris", "{}"), (2, "1", "feature_used", "qris", "{}")])
    off = {r.raw_id: r.error for r in I.validate_events(raw, t001.customers, "admin", "CUS-000049").collect()}
    on = {r.raw_id: r.error for r in
          I.validate_events(raw, t001.customers, "admin", "CUS-000049", respect_tracking=True).collect()}
    # customer 3 has tracking off (3 % 4 == 3)
    assert off == {1: None, 2: None}
    assert on == {1: "activity tracking disabled", 2: None}


def test_use_balances_option(t001):
    f = FE.model_features(t001.customers, t001.transactions, t001.accounts, t001.user_activities, AS_OF,
                          use_balances=True)
    bal = {r.id: float(r.balance) for r in t001.accounts.collect()}
    got = {r.customer_pk: r.avg_balance for r in f.collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in bal.items())
