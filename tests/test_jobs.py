"""Jobs that apply their result: requests, publication, empty inputs, JSON rules, stored tables."""

from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.operators import ingest as I
from tessera.operators import merge as G
from tessera.operators.segmentation import DEFAULT_MODEL
from tessera.plans import jobs as J
from tessera.sources import json_sources as JS
from tessera.sources import sinks
from tessera.streaming import streams as ST

AS_OF = "2024-01-31 00:00:00"


def folder():
    return tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))


def segment_file(path, *rows):
    with open(path, "w") as fh:
        json.dump({"segments": [dict(zip(("customer_id", "segment_name", "description", "confidence"), r, strict=True))
                                for r in rows]}, fh)


def test_bad_request_costs_no_other_its_rows(spark, t001):
    d = folder()
    segment_file(f"{d}/a.json", ("CUS-000001", "investor", "", 0.5), ("2", "fresh", "new one", 0.25))
    segment_file(f"{d}/b.json", ("CUS-000003", "investor", "", 0.5), ("CUS-000004", "investor", "", 9.5))
    segment_file(f"{d}/c.json")
    batch = JS.read_segment_batch(spark, d)
    res = G.apply_segment_updates(batch, t001.customers, t001.segments, t001.user_segments, AS_OF)
    assert [r.customer_id for r in res["results"].orderBy("pos").collect()] == ["CUS-000001", "CUS-000002"]
    assert sorted(r.error for r in res["rejected"].collect()) == [
        "confidence must be between 0 and 1", "segments is required"]
    us = {r.customer_id: r.confidence for r in res["user_segments"].collect()}
    before = {r.customer_id: r.confidence for r in t001.user_segments.collect()}
    assert us[1] == 0.5 and us[2] == 0.25 and us[3] == before[3]
    assert {r.name for r in res["segments"].collect()} >= {"fresh"}


def test_stream_of_requests_does_not_depend_on_the_trigger(spark, t001):
    src = ST.scratch(spark, "test-requests")
    schema = "pos long, request string, customer_id string, segment_name string, description string, confidence double"
    for k in range(4):
        rows = [(10 * k + i, f"r{k}", str(5 * k + i + 1), f"s{k}", "", 9.5 if (k, i) == (1, 2) else 0.5)
                for i in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    seen = []
    for files in (1, 10):
        out = ST.scratch(spark, "test-requests-out")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(src)
        ST.stream_segment_updates(spark, stream, t001, AS_OF, out).awaitTermination()
        rows = spark.read.parquet(f"{out}/results").drop("batch_id").collect()
        bad = spark.read.parquet(f"{out}/rejected").select("pos", "error").collect()
        seen.append((sorted(map(tuple, rows)), sorted(map(tuple, bad))))
    assert seen[0] == seen[1]
    assert len(seen[0][0]) == 15 and seen[0][1] == [(12, "confidence must be between 0 and 1")]


def test_predictions_are_published(spark, t001):
    root = ST.scratch(spark, "test-predict")
    res = J.predict_and_update(t001, AS_OF, DEFAULT_MODEL, root, ["CUS-000001", "6", "CUS-999999"])
    assert {r.customer_id for r in res["results"].collect()} == {"CUS-000001", "CUS-000006"}
    assert [r.key for r in res["unknown"].collect()] == ["CUS-999999"]
    names = {r.id: r.name for r in sinks.read_current(spark, f"{root}/segments").collect()}
    held = {r.customer_id: r.segment_id for r in sinks.read_current(spark, f"{root}/user_segments").collect()}
    for r in res["results"].collect():
        assert names[held[int(r.customer_id[4:])]] == r.segment_name
    assert len(held) == t001.user_segments.count() + 1  # customer 6 had no assignment
    nobody = J.predict_and_update(t001, AS_OF, DEFAULT_MODEL, ST.scratch(spark, "test-none"), [])
    assert nobody["results"].count() == 0


def test_dry_run_publishes_nothing(spark, t001):
    root = folder()
    assert J.sync_segments(t001, AS_OF, DEFAULT_MODEL, root, "CUS-000001", dry_run=True).count() == 1
    assert os.listdir(root) == []
    done = J.sync_segments(t001, AS_OF, DEFAULT_MODEL, root, "CUS-000001")
    assert [r.customer_id for r in done.collect()] == ["CUS-000001"]
    assert sorted(os.listdir(root)) == ["results", "segments", "user_segments"]
    with pytest.raises(ValueError):
        J.sync_segments(t001, AS_OF, DEFAULT_MODEL)


def test_registrations_without_email_or_rows(spark, t001):
    schema = "pos long, full_name string, username string, email string"
    one = spark.createDataFrame([(1, "A", None, None)], schema)
    res = I.onboard_customers(one, t001.customers, AS_OF)
    assert [(r.email, r.username) for r in res["customers"].collect()] == [("", "")]
    two = spark.createDataFrame([(1, "A", None, None), (2, None, "b", "")], schema)
    res = I.onboard_customers(two, t001.customers, AS_OF)
    assert res["registered"].count() == 0
    assert [(r.pos, r.error) for r in res["rejected"].collect()] == [(2, "email already registered")]
    res = I.onboard_customers(one.limit(0), t001.customers, AS_OF)
    assert res["registered"].count() == 0
    assert [r.error for r in res["rejected"].collect()] == ["at least one account is required"]


def test_valid_json_is_one_value(spark):
    good = ["{}", "null", "1", '"x"', '{"a":1,"a":2}', ' {"a": [1, {"b": null}]} ', "[]", "[1,2]", "-1.5e3"]
    bad = ["{broken", "{} x", "{'a':1}", "1],[2", "1,2", "", "NaN", "01", '{"a":1}}', "[1,]", '"x', "1,2],[3", "tru"]
    df = spark.createDataFrame([(x,) for x in good + bad + [None]], "x string")
    got = {r.x: r.ok for r in df.select("x", X.valid_json("x").alias("ok")).collect()}
    assert {x for x, ok in got.items() if ok} == set(good)


def test_json_metadata_keeps_its_text(spark):
    d = folder()
    with open(f"{d}/e.json", "w") as fh:
        fh.write('{"event_type":"a","feature":"1","metadata":"abc"}\n\n{"event_type":"a","feature":"2","metadata":null}\n'
                 '{"event_type":"a","feature":"3"}\n{"event_type":"a","feature":"4","metadata":{"k": "v"}}\n'
                 '{"event_type":"a","feature":"5","metadata":"say \\"hi\\""}\n')
    got = {r.feature: r.metadata for r in JS.read_events(spark, d).collect()}
    assert got == {"1": '"abc"', "2": "null", "3": None, "4": '{"k":"v"}', "5": '"say \\"hi\\""'}


def test_tracking_updates_from_json(spark, t001):
    d = folder()
    with open(f"{d}/t.json", "w") as fh:
        fh.write('{"key":"CUS-000001","is_activity_tracking_enabled":false}\n{"key":"2"}\n')
    rep = G.set_tracking(JS.read_tracking_updates(spark, d), t001.customers)["report"].orderBy("seq").collect()
    assert [(r.key, r.status) for r in rep] == [("CUS-000001", "updated"), ("2", "invalid")]


def test_ingest_appends_to_the_stored_table(spark, t001):
    table = f"{folder()}/events"
    sinks.append_events(t001.analytics_events, table)
    raw = I.raw_event_feed(t001.analytics_events.filter(F.col("id") < 200))
    rejected = J.ingest_to_table(raw, t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    n, top = t001.analytics_events.count(), t001.analytics_events.agg(F.max("id")).first()[0]
    stored = sinks.read_events_table(spark, table)
    new = stored.filter(F.col("id") > top)
    assert stored.count() == n + new.count() and new.count() + rejected.count() == raw.count()
    day = stored.filter(F.col("event_date") == F.lit("2024-01-05").cast("date"))
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()


def test_rollups_replace_their_days(spark, t001):
    root = folder()
    J.write_rollups(t001, root, AS_OF, 30)
    first = sorted(map(str, spark.read.parquet(f"{root}/personalization").collect()))
    J.write_rollups(t001, root, AS_OF, 10)
    assert sorted(map(str, spark.read.parquet(f"{root}/personalization").collect())) == first


def test_listings_keep_their_order(spark, t001):
    d = folder()
    J.write_listing(t001.segments, f"{d}/p", F.desc("name"))
    J.write_listing(t001.segments, f"{d}/j", "name", json=True)
    names = sorted(r.name for r in t001.segments.collect())
    assert [r.name for r in spark.read.parquet(f"{d}/p").coalesce(1).collect()] == names[::-1]
    assert sorted(r.name for r in spark.read.json(f"{d}/j").collect()) == names
