"""Streaming jobs in several micro-batches equal the batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.ingest import DEFAULT_PRINCIPAL, ingest_events, raw_event_feed
from tessera.streaming import streams as ST

AS_OF = "2024-01-31 00:00:00"


def test_stream_ingest_multi_batch_ids_continue(spark, t001, tmp_path_factory):
    # stage the raw feed as 4 files and read them one file per micro-batch
    src = ST.scratch(spark, "test-raw")
    raw = raw_event_feed(t001.analytics_events)
    raw.repartitionByRange(4, "received_at", "raw_id").write.parquet(src)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = ST.scratch(spark, "test-ingest")
    q = ST.stream_ingest(spark, stream, t001.customers, t001.analytics_events, out)
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/accepted")
    assert got.select("batch_id").distinct().count() > 1
    batch = ingest_events(raw, t001.customers, t001.analytics_events, "admin", DEFAULT_PRINCIPAL)["accepted"]
    # same accepted rows; ids dense and unique after the existing maximum
    cols = ["customer_id", "event_type", "feature", "metadata", "created_at"]
    assert got.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert got.count() == batch.count()
    top = t001.analytics_events.agg(F.max("id")).first()[0]
    ids = sorted(r.id for r in got.select("id").collect())
    assert ids == list(range(top + 1, top + 1 + len(ids)))


def test_stream_windows_equal_batch(spark, t001):
    daily = {r.day: r.clicks for r in ST.stream_daily_clicks(spark, "/root/testdata/sf0.001").collect()}
    ev = t001.analytics_events.filter(F.col("event_type").isin("recommendation_click", "recommendation_clicked"))
    batch = {r.d: r.n for r in ev.groupBy(F.to_date("created_at").alias("d")).agg(F.count("*").alias("n")).collect()}
    assert daily == batch
    weekly = ST.stream_weekly_metrics(spark, "/root/testdata/sf0.001")
    # every event falls into 7 sliding windows
    total = weekly.agg(F.sum("clicks")).first()[0]
    assert total == 7 * sum(batch.values())


def test_append_mode_emits_only_finalized_days(spark, t001):
    out, ck = ST.scratch(spark, "test-append"), ST.scratch(spark, "test-append-ck")
    q = ST.append_finalized(ST.daily_clicks(ST.event_stream(spark, "/root/testdata/sf0.001")), out, ck,
                            available_now=True)
    q.awaitTermination()
    got = {r.day: r.clicks for r in spark.read.parquet(out).collect()}
    full = {r.day: r.clicks for r in ST.stream_daily_clicks(spark, "/root/testdata/sf0.001").collect()}
    # every emitted day is final and equals the batch count; the newest day waits for the watermark
    assert got and all(full[d] == n for d, n in got.items())
    assert max(full) not in got


def test_stream_ingest_with_frozen_customer_index(spark, t001):
    out = ST.scratch(spark, "test-frozen")
    q = ST.stream_ingest(spark, raw_event_feed(ST.event_stream(spark, "/root/testdata/sf0.001")), t001.customers,
                         t001.analytics_events, out, freeze_customers=True)
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/accepted").drop("batch_id", "event_date")
    want = ingest_events(raw_event_feed(t001.analytics_events), t001.customers, t001.analytics_events,
                         "admin", DEFAULT_PRINCIPAL)["accepted"]
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_json_event_submissions_batch_and_stream(spark, t001):
    import json
    import os

    from tessera.sources import json_sources as J
    src = ST.scratch(spark, "test-json-events")
    local = src.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    subs = [{"customer_id": "CUS-000001", "event_type": "feature_used", "feature": "qris", "metadata": {"k": 1}},
            {"customer_id": "2", "event_type": "recommendation_click", "feature": "topup"},
            {"customer_id": "CUS-999999", "event_type": "feature_used", "feature": "qris"},
            {"event_type": "", "feature": "qris"}]
    with open(f"{local}/part-0.json", "w") as fh:
        fh.write("\n".join(json.dumps(s) for s in subs) + "\n")
    raw = J.read_events(spark, src).withColumn("received_at", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    res = ingest_events(raw, t001.customers, t001.analytics_events, "admin", DEFAULT_PRINCIPAL)
    got = {r.feature: (r.customer_id, r.metadata) for r in res["accepted"].collect()}
    # an object value is kept as JSON text; spaces between its tokens are not
    assert got == {"qris": (1, '{"k":1}'), "topup": (2, "{}")}
    assert sorted(r.error for r in res["rejected"].collect()) == ["event_type is required", "user not found"]
    stream = J.read_events_stream(spark, src)
    out = ST.scratch(spark, "test-json-ingest")
    ST.stream_ingest(spark, stream, t001.customers, t001.analytics_events, out).awaitTermination()
    assert spark.read.parquet(f"{out}/accepted").count() == 2
