"""Structured Streaming variants of ingestion and the live event metrics.

Event time: the tables keep TIMESTAMP_NTZ (wall clock, UTC), but watermarks
need TIMESTAMP. ``utc_instant`` maps the wall clock to the same instant in
UTC without touching the session time zone, and ``wall_clock`` maps window
bounds back, so streamed windows line up with the batch reports' days.

Sinks are written per micro-batch into ``batch_id=<n>`` folders with
overwrite, so a retried batch replaces its own output (idempotent).
All state and output live under the session's checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.functions.joins import stored_aliases
from tessera.operators.ingest import DEFAULT_PRINCIPAL, raw_event_feed, validate_events
from tessera.operators.merge import max_id, sequence_ids
from tessera.session import ensure_checkpoint_dir
from tessera.sources.driver import DRIVER_SCHEMAS
from tessera.sources.fixtures import Tables, analytics_from_events, customers_of
from tessera.streaming import live_panes
from tessera.streaming.key_index import KeyIndex
from tessera.streaming.segment_log import SegmentLog

EPOCH = "1970-01-01 00:00:00"


def utc_instant(ntz: Column) -> Column:
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", X.ntz(EPOCH), ntz))


def wall_clock(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), X.ntz(EPOCH))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The input ``events`` parquet as a file stream, mapped to
    ``analytics_events`` rows."""
    reader = spark.readStream.schema(DRIVER_SCHEMAS["events"])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return analytics_from_events(reader.parquet(f"{sf_dir.rstrip('/')}/events*.parquet"))


def _run(q) -> None:
    q.awaitTermination()
    if q.exception():
        raise q.exception()


# -- I1 ----------------------------------------------------------------------------
def stream_ingest(spark: SparkSession, raw: DataFrame, customers: DataFrame | KeyIndex, existing_events: DataFrame,
                  out: str, principal_role: str = "admin", principal_code: str | None = DEFAULT_PRINCIPAL,
                  trigger_available_now: bool = True, freeze_customers: bool = False):
    """Validate a stream of raw events against the customer table
    per micro-batch, number accepted rows after every id already given out,
    and write accepted / rejected rows per micro-batch. Accepted rows lie in
    date partitions inside their batch's folder, so reports over ``accepted``
    prune days and a retried batch replaces its own rows.

    Each micro-batch leaves a one-row high-water mark (largest id so far)
    under ``marks/batch_id=<n>``; batch n starts from batch n-1's mark, so
    no batch rescans earlier output, and a retried batch recomputes the
    same ids.

    ``customers`` as a :class:`KeyIndex`: each micro-batch adds the customers that are new since the one before and
    finds them; the cost follows the changes. As a table: the index is built for each micro-batch, or with
    ``freeze_customers`` once per run (customers created later are then seen after a restart)."""
    index = customers if isinstance(customers, KeyIndex) else None
    frozen = stored_aliases(customers) if freeze_customers and not index else None
    accepted_root, rejected_root, marks = f"{out}/accepted", f"{out}/rejected", f"{out}/marks"

    def write_batch(submitted: DataFrame, batch_id: int) -> None:
        s = submitted.sparkSession
        if index:
            index.refresh(batch_id)
            aliases = index.table(batch_id)
        else:
            aliases = frozen or stored_aliases(customers)
        batch = validate_events(submitted, None if index else customers, principal_role, principal_code,
                                aliases=aliases).checkpoint(eager=True)
        if batch_id == 0:
            start = max_id(existing_events)
        else:
            start = s.read.parquet(f"{marks}/batch_id={batch_id - 1}").select(
                F.col("max_id").cast("bigint")).scalar()
        ok = batch.filter(F.col("error").isNull())
        numbered = sequence_ids(ok, ["received_at", "raw_id"], start, "id")
        target = f"{accepted_root}/batch_id={batch_id}"
        (numbered.select("id", F.col("cid").alias("customer_id"), "event_type", "feature", "metadata",
                         F.col("received_at").alias("created_at"), F.to_date("received_at").alias("event_date"))
         .write.mode("overwrite").partitionBy("event_date").parquet(target))
        (batch.filter(F.col("error").isNotNull())
         .select("raw_id", "customer_id", "event_type", "feature", "received_at", "error")
         .write.mode("overwrite").parquet(f"{rejected_root}/batch_id={batch_id}"))
        written = s.read.schema("id long").parquet(target).agg(F.max("id").cast("bigint")).scalar()
        (s.range(1).select(F.coalesce(written, start).alias("max_id"))
         .write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}"))

    w = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{out}/_checkpoint")
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run :func:`stream_ingest` over the input events to completion and
    return the accepted rows (same rows as the batch ingest)."""
    t = Tables(spark, sf_dir)
    out = scratch(spark, "ingest")
    q = stream_ingest(spark, raw_event_feed(event_stream(spark, sf_dir)), customer_index(t, f"{out}/keys"),
                      t.analytics_events, out)
    _run(q)
    return spark.read.parquet(f"{out}/accepted").drop("batch_id", "event_date")


# -- I2 / I3 -----------------------------------------------------------------------
def daily_clicks(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Clicks per UTC day: watermark + tumbling one-day window."""
    ev = events.filter(X.is_click()).withColumn("event_time", utc_instant(F.col("created_at")))
    agg = (ev.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", "1 day").alias("w"))
           .agg(F.count(F.lit(1)).alias("clicks")))
    return agg.select(F.to_date(wall_clock(F.col("w.start"))).alias("day"), "clicks")


def weekly_metrics(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Impressions, clicks, engagements, CTR and conversion over sliding
    7-day windows advancing by one day."""
    ev = events.withColumn("event_time", utc_instant(F.col("created_at")))
    agg = (ev.withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", "7 days", "1 day").alias("w"))
           .agg(X.count_if(X.is_impression()).alias("impressions"),
                X.count_if(X.is_click()).alias("clicks"),
                X.count_if(X.is_engagement()).alias("engagements")))
    return agg.select(wall_clock(F.col("w.start")).alias("window_start"),
                      wall_clock(F.col("w.end")).alias("window_end"),
                      "impressions", "clicks", "engagements",
                      X.pct_rate("clicks", "impressions").alias("ctr"),
                      X.pct_rate("engagements", "clicks").alias("conversion_rate"))


def run_complete(spark: SparkSession, agg: DataFrame, name: str) -> DataFrame:
    """Drive an aggregation stream to completion in complete mode; each
    micro-batch overwrites the result folder with the whole (small) result
    table."""
    out = scratch(spark, name)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    q = (agg.writeStream.outputMode("complete").foreachBatch(write_batch)
         .option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start())
    _run(q)
    return spark.read.parquet(f"{out}/result")


def append_finalized(agg: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Long-running form of the windowed metrics: append mode to a parquet
    sink. A window is written once, after the watermark passes its end, and
    its state is then dropped, so state stays bounded by the watermark
    delay rather than growing with history."""
    w = (agg.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stream_daily_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_complete(spark, daily_clicks(event_stream(spark, sf_dir)), "daily-clicks")


def stream_weekly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-day windows folded from the daily panes of an append-mode stream."""
    out = scratch(spark, "weekly-panes")
    _run(live_panes.live_panes(event_stream(spark, sf_dir), out))
    return live_panes.weekly(live_panes.panes(spark, out))


# -- I4 ----------------------------------------------------------------------------
def stream_segment_updates(spark: SparkSession, batches: DataFrame, t: Tables, as_of, out: str,
                           index: KeyIndex | None = None):
    """Apply each micro-batch of segment updates to the state left by the previous one (the tables for the
    first). What is written follows the batch: changed rows go to the log of :class:`SegmentLog` under ``out``,
    per-row results to ``results/``, failing rows to ``rejected/``; a retried batch reads the same state and
    replaces its own output. With a column ``request`` what is applied does not depend on how requests fall into
    micro-batches, as long as a request's rows arrive in one file. :meth:`SegmentLog.publish` folds the log."""
    log = SegmentLog(spark, out, t.segments, t.user_segments)
    index = index or customer_index(t, f"{out}/keys")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        index.refresh(batch_id)
        log.apply(batch, batch_id, t.customers, index.table(batch_id), as_of)

    return (batches.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{out}/_checkpoint")
            .trigger(availableNow=True).start())


def customer_index(t: Tables, root: str) -> KeyIndex:
    """The key index of the customers of an input folder."""
    return KeyIndex.of_table(t.spark, root, f"{t.sf_dir.rstrip('/')}/customer.parquet", customers_of)


def stream_segment_results(spark: SparkSession, sf_dir: str, as_of) -> DataFrame:
    """Stage the derived segment batch as files, stream it through
    :func:`stream_segment_updates`, return all per-row results."""
    from tessera.sources.feeds import segment_batch

    t = Tables(spark, sf_dir)
    out = scratch(spark, "segment-updates")
    segment_batch(t).write.parquet(f"{out}/input")
    schema = spark.read.parquet(f"{out}/input").schema
    batches = spark.readStream.schema(schema).parquet(f"{out}/input")
    _run(stream_segment_updates(spark, batches, t, as_of, out))
    return spark.read.parquet(f"{out}/results").drop("batch_id")
