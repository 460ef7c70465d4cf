"""Stream state: the segment change log, the customer key index, live panes with late events."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import merge as G
from tessera.operators.ingest import DEFAULT_PRINCIPAL
from tessera.sources import feeds as FD
from tessera.sources import sinks
from tessera.sources.fixtures import customers_of
from tessera.streaming import live_panes as LP
from tessera.streaming import streams as ST
from tessera.streaming.key_index import KeyIndex
from tessera.streaming.segment_log import SegmentLog

AS_OF = "2024-01-31 00:00:00"


def rows(df):
    return sorted(map(str, df.collect()))


def size_of(path):
    path = path.replace("file:", "")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-"))


@pytest.fixture(scope="module")
def staged(spark, t001):
    """The segment batch as four files, in order."""
    src = ST.scratch(spark, "test-segment-files")
    batch = FD.segment_batch(t001).withColumn("request", F.col("pos").cast("string")).cache()
    edges = [0, 90, 180, 240, 10 ** 6]
    for lo, hi in zip(edges, edges[1:], strict=False):
        batch.filter((F.col("pos") >= lo) & (F.col("pos") < hi)).coalesce(1).write.mode("append").parquet(src)
    return src, batch


def run(spark, t, src, schema, out, files=1):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(src)
    ST.stream_segment_updates(spark, stream, t, AS_OF, out).awaitTermination()


def test_log_equals_the_batch_job(spark, t001, staged):
    src, batch = staged
    want = G.apply_segment_updates(batch, t001.customers, t001.segments, t001.user_segments, AS_OF)
    for files in (1, 10):
        out = ST.scratch(spark, "test-log")
        run(spark, t001, src, batch.schema, out, files)
        log = SegmentLog(spark, out, t001.segments, t001.user_segments)
        got = spark.read.parquet(f"{out}/results").drop("batch_id")
        assert rows(got.select("pos", "customer_id", "segment_name", "confidence", "action")) == rows(
            want["results"].select("pos", "customer_id", "segment_name", "confidence", "action"))
        last = 3 if files == 1 else 0
        assert rows(log.segments(last)) == rows(want["segments"].select("id", "name", "description"))
        cols = ["id", "customer_id", "segment_id", "confidence", "created_at"]
        assert rows(log.assignments(last).select(*cols)) == rows(want["user_segments"].select(*cols))


def test_retry_and_publication_change_nothing(spark, t001, staged):
    src, batch = staged
    one, two = ST.scratch(spark, "test-log-a"), ST.scratch(spark, "test-log-b")
    run(spark, t001, src, batch.schema, one)
    # by hand: every micro-batch twice, and the log folded after the second one
    log = SegmentLog(spark, two, t001.segments, t001.user_segments, buckets=8)
    index = ST.customer_index(t001, f"{two}/keys")
    edges = [0, 90, 180, 240, 10 ** 6]
    for n, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        part = batch.filter((F.col("pos") >= lo) & (F.col("pos") < hi))
        for _ in range(2):
            index.refresh(n)
            log.apply(part, n, t001.customers, index.table(n), AS_OF)
        if n == 1:
            log.publish(1)
    first = SegmentLog(spark, one, t001.segments, t001.user_segments)
    assert rows(first.segments(3)) == rows(log.segments(3))
    assert rows(first.assignments(3)) == rows(log.assignments(3))
    assert rows(spark.read.parquet(f"{one}/results").drop("batch_id")) == rows(spark.read.parquet(f"{two}/results").drop("batch_id"))
    log.publish(3)
    current = sinks.read_together(spark, f"{two}/published", "user_segments")
    assert rows(current["user_segments"].drop("bucket")) == rows(first.assignments(3))
    assert rows(current["segments"]) == rows(first.segments(3))


def test_written_bytes_follow_the_batch(spark, t001):
    held = spark.range(200_000).select(F.col("id"), (F.col("id") + 1).alias("customer_id"), F.lit(1).alias("segment_id"),
                                       F.rand(1).alias("confidence"), F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"))
    small = FD.segment_batch(t001).limit(20)
    sizes = []
    for n in (200_000, 2_000):
        out = ST.scratch(spark, "test-log-bytes")
        log = SegmentLog(spark, out, t001.segments, held.limit(n))
        index = ST.customer_index(t001, f"{out}/keys")
        index.refresh(0)
        log.apply(small, 0, t001.customers, index.table(0), AS_OF)
        sizes.append(size_of(f"{out}/deltas") + size_of(f"{out}/results") + size_of(f"{out}/marks"))
    assert abs(sizes[0] - sizes[1]) < 0.2 * sizes[1]


def test_index_finds_new_customers_and_reads_new_files(spark, t001):
    raw = t001.raw("customer")
    src, root = ST.scratch(spark, "test-customers"), ST.scratch(spark, "test-keys")
    raw.filter("c_custkey < 100").coalesce(2).write.parquet(src)
    index = KeyIndex.of_table(spark, root, src, customers_of)
    assert index.refresh(0) >= 1 and index.refresh(1) == 0
    before = rows(index.table(1))
    raw.filter("c_custkey >= 100").coalesce(1).write.mode("append").parquet(src)
    raw.filter("c_custkey = 5").coalesce(1).write.mode("append").parquet(src)  # known already
    assert index.refresh(2) == 2 and index.refresh(2) == 2  # a retry does the same again
    keys = [r.alias for r in index.table(2).collect()]
    assert len(keys) == len(set(keys)) == 2 * raw.count()
    assert rows(index.table(1)) == before  # earlier micro-batches see what they saw
    written = [size_of(f"{root}/aliases/part={n}") for n in (0, 2)]
    assert written[1] < written[0]


def test_key_of_two_customers_means_the_smaller_id(spark):
    src, root = ST.scratch(spark, "test-two"), ST.scratch(spark, "test-two-keys")
    schema = "id long, customer_id string"
    spark.createDataFrame([(7, "5"), (8, "x")], schema).write.parquet(src)
    index = KeyIndex.of_table(spark, root, src, lambda c: c)
    index.refresh(0)
    spark.createDataFrame([(5, "y")], schema).write.mode("append").parquet(src)
    index.refresh(1)
    got = {r.alias: r.resolved_id for r in index.table(1).collect()}
    assert got == {"7": 7, "5": 5, "8": 8, "x": 8, "y": 5}
    assert {r.alias: r.resolved_id for r in index.table(0).collect()}["5"] == 7


def test_stream_finds_a_customer_added_on_the_way(spark, t001):
    customers, events = ST.scratch(spark, "test-way"), ST.scratch(spark, "test-way-events")
    raw = t001.raw("customer")
    raw.filter("c_custkey <> 149").write.parquet(customers)
    schema = "raw_id long, customer_id string, event_type string, feature string, metadata string, received_at timestamp_ntz"

    def submit(k):
        spark.createDataFrame([(k, "149", "feature_used", "qris", "{}", None)], "raw_id long, customer_id string, "
                              "event_type string, feature string, metadata string, x string").select(
            "raw_id", "customer_id", "event_type", "feature", "metadata",
            F.lit(AS_OF).cast("timestamp_ntz").alias("received_at")).coalesce(1).write.mode("append").parquet(events)

    out = ST.scratch(spark, "test-way-out")

    def drain():
        index = KeyIndex.of_table(spark, f"{out}/keys", customers, customers_of)
        stream = spark.readStream.schema(schema).parquet(events)
        ST.stream_ingest(spark, stream, index, t001.analytics_events, out, principal_code=DEFAULT_PRINCIPAL).awaitTermination()

    submit(1)
    drain()
    raw.filter("c_custkey = 149").write.mode("append").parquet(customers)
    submit(2)
    drain()
    assert [r.customer_id for r in spark.read.parquet(f"{out}/accepted").collect()] == [149]
    assert [r.error for r in spark.read.parquet(f"{out}/rejected").collect()] == ["user not found"]


def test_accepted_and_late_events_add_up(spark, t001):
    src, out = ST.scratch(spark, "test-shuffled"), ST.scratch(spark, "test-panes")
    events = t001.analytics_events.withColumn("created_at", F.when(F.col("id") % 211 == 0, F.lit(None).cast("timestamp_ntz"))
                                              .otherwise(F.col("created_at"))).cache()
    # files in another order than time: every file has days of its third of the month and some of any day
    part = (F.dayofmonth("created_at") / 11).cast("int")
    part = F.when(F.col("id") % 5 == 0, F.col("id") % 3).otherwise(F.coalesce(part, F.lit(1)))
    for k in (1, 2, 0):
        events.filter(part == k).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    LP.live_panes(stream, out).awaitTermination()
    marks = LP.late_events(spark, out).orderBy("batch_id").collect()
    late = spark.read.parquet(f"{out}/late").drop("batch_id")
    assert [m.batch_id for m in marks] == [0, 1, 2] and marks[0].accepted > 0
    assert sum(m.accepted for m in marks) + sum(m.late for m in marks) == events.count()
    assert sum(m.late for m in marks) == late.count() > 0 and late.filter("created_at IS NULL").count() == events.filter(
        "created_at IS NULL").count()
    # every pane has the events of its day that were not late
    on_time = events.join(late.select("id"), "id", "left_anti")
    want = on_time.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("events"))
    assert rows(LP.panes(spark, out).select("day", "events")) == rows(want)
    # a day is closed once, and the state is what is left
    closed = LP.panes(spark, out, final=True)
    assert closed.count() == closed.select("day").distinct().count() > 10
    assert spark.read.parquet(f"{out}/open/batch_id=2").count() <= 3
    assert "Expand" not in LP.weekly(LP.panes(spark, out))._jdf.queryExecution().executedPlan().toString()
    assert rows(LP.daily(LP.panes(spark, out)).select("day", "clicks")) == rows(
        on_time.filter(F.col("event_type").isin("recommendation_click", "recommendation_clicked"))
        .groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("clicks")).select("day", "clicks"))
