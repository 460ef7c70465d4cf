"""Jobs that apply their result: prediction and sync, event ingestion, daily roll-ups, listings.

Snapshots are published under a root folder as one commit (see ``sources.sinks``): a job that fails
leaves the current versions in place, and one that is repeated publishes the same rows again. The event table keeps a
ledger of its batches: a repeated one appends nothing, and the daily roll-ups follow the days that batches touched.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.joins import customer_aliases
from tessera.operators.features import model_features
from tessera.operators.ingest import ingest_events
from tessera.operators.merge import apply_segment_updates
from tessera.operators.performance import engagement_metrics_daily, personalization_daily
from tessera.operators.segmentation import SegmentModel, score_segments
from tessera.sources import sinks
from tessera.sources.fixtures import Tables


def predictions(t: Tables, as_of, model: SegmentModel, customers: DataFrame | None = None) -> DataFrame:
    """Segment, confidence and description for every customer of ``customers``
    (default: all), as a segment-update batch (``pos`` = internal id)."""
    cust = customers if customers is not None else t.customers
    feats = model_features(cust, t.transactions, t.accounts, t.user_activities, as_of)
    return score_segments(feats, model).select(
        F.col("customer_pk").alias("pos"), "customer_id", "segment_name", "description", "confidence")


def publish_updates(updates: dict[str, DataFrame], root: str) -> DataFrame:
    """Publish the next ``segments`` and ``user_segments`` and the per-row ``results``
    under ``root`` as one commit; returns the published results, read back."""
    names = ("segments", "user_segments", "results")
    spark = updates["results"].sparkSession
    sinks.publish_together({name: updates[name] for name in names}, root)
    return sinks.read_together(spark, root, names[-1])["results"]


def predict_and_update(t: Tables, as_of, model: SegmentModel, root: str,
                       customer_ids: DataFrame | list[str] | None = None) -> dict[str, DataFrame]:
    """Score customers (any role), upsert their segments as one request and publish the
    snapshots under ``root``.

    ``customer_ids``: public or internal ids (a list, or a DataFrame whose first column
    holds them); None means all customers, an empty one none. Returns the published ``results``,
    ``rejected`` rows and the ``unknown`` ids that name nobody.
    """
    cust, unknown = t.customers, None
    if customer_ids is not None:
        if not isinstance(customer_ids, DataFrame):
            customer_ids = t.spark.createDataFrame([(k,) for k in customer_ids], "key string")
        keys = customer_ids.select(F.col(customer_ids.columns[0]).cast("string").alias("key")).distinct()
        aliases = customer_aliases(t.customers)
        hit = aliases.join(keys, aliases["alias"] == keys["key"], "left_semi").select(F.col("resolved_id").alias("id"))
        cust = cust.join(hit, "id", "left_semi")
        unknown = keys.join(aliases, keys["key"] == aliases["alias"], "left_anti")
    updates = apply_segment_updates(predictions(t, as_of, model, cust), t.customers, t.segments, t.user_segments, as_of)
    return {"results": publish_updates(updates, root), "rejected": updates["rejected"],
            "unknown": unknown if unknown is not None else t.spark.createDataFrame([], "key string")}


def sync_segments(t: Tables, as_of, model: SegmentModel, root: str | None = None, customer_id: str | None = None,
                  dry_run: bool = False) -> DataFrame:
    """Batch sync: customers with role 'customer' and a non-empty id, optionally one of
    them. ``dry_run`` returns the predictions and publishes nothing; otherwise the snapshots are
    published under ``root`` and the published per-row results returned (no customer: no rows)."""
    cust = t.customers.filter((F.col("role") == "customer") & F.coalesce(F.col("customer_id") != "", F.lit(False)))
    if customer_id:
        cust = cust.filter(F.col("customer_id") == customer_id)
    batch = predictions(t, as_of, model, cust)
    if dry_run:
        return batch
    if not root:
        raise ValueError("a root folder is needed to publish the snapshots")
    return publish_updates(apply_segment_updates(batch, t.customers, t.segments, t.user_segments, as_of), root)


def batch_digest(raw: DataFrame) -> str:
    """A name for the rows of a batch: their number and the sums of two hashes of each, in whatever order they come."""
    hashes = [F.sum(F.xxhash64(F.lit(k), *raw.columns).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    n, *sums = raw.agg(F.count(F.lit(1)), *hashes).first()
    return "-".join([str(n), *(f"{int(s or 0) % (1 << 64):016x}" for s in sums)])


def ingest_to_table(raw: DataFrame, customers: DataFrame, table: str, principal_role: str = "admin",
                    principal_code: str | None = None, batch: str | None = None) -> DataFrame:
    """Ingest into the date-partitioned event table at ``table`` (ids continue it); returns the rejected rows.

    The table keeps a ledger of its batches (``batch``: a name, by default a digest of the rows). A batch that is
    done appends nothing when it comes again; one whose job was lost on the way replaces what that left, with the
    same ids, and until it is done no reader sees its rows. One job writes to a table at a time.
    """
    spark = raw.sparkSession
    batch = batch or batch_digest(raw)
    rejected = f"{table.rstrip('/')}/_rejected/batch={batch}"
    if not sinks.batch_done(spark, table, batch):
        existing = sinks.read_events_table(spark, table, but=batch)
        out = ingest_events(raw, customers, existing, principal_role, principal_code)
        sinks.begin_batch(spark, table, batch)
        sinks.write_batch(out["accepted"], table, batch)
        out["rejected"].write.mode("overwrite").parquet(rejected)
        sinks.finish_batch(spark, table, batch, _days(out["accepted"]))
    return spark.read.parquet(rejected)


def _days(events: DataFrame) -> list:
    """The event dates of a batch: one value a day."""
    return sorted(r.day for r in events.select(F.to_date("created_at").alias("day")).distinct().collect() if r.day)


def write_rollups(t: Tables, root: str, as_of, days: int) -> None:
    """Write the daily roll-ups; only the days computed here are replaced."""
    _write_rollups(t.user_segments, t.analytics_events, root, as_of, days)


def _write_rollups(user_segments: DataFrame, events: DataFrame, root: str, as_of, days: int) -> None:
    sinks.overwrite_partitions(engagement_metrics_daily(user_segments, events, as_of, days),
                               f"{root}/engagement_metrics", "metric_date")
    sinks.overwrite_partitions(personalization_daily(user_segments, events, as_of, days),
                               f"{root}/personalization", "date_period")


def refresh_rollups(spark: SparkSession, user_segments: DataFrame, table: str, root: str) -> list:
    """Bring the daily roll-ups under ``root`` up to date with the event table at ``table``; returns the days written.

    The table's ledger tells which days each batch touched, and a record beside the roll-ups which batches they
    already hold. Only the days of the other batches are read (partition pruning) and replaced, whole, so
    late events of one day cost that day. A job that fails before its record does the same days again.
    """
    seen = sinks.rolled_up(spark, root)
    log = sinks.batches(spark, table).filter("state = 'done'").groupBy("batch").agg(F.first("days").alias("days"))
    fresh = log.join(seen, "batch", "left_anti").collect()  # batches since the last refresh, one row each
    days = sorted({d for r in fresh for d in r.days})
    if days:
        events = sinks.read_events_table(spark, table).filter(F.col("event_date").isin(days)).drop("event_date")
        end = days[-1] + dt.timedelta(days=1)
        _write_rollups(user_segments, events, root, f"{end} 00:00:00", (end - days[0]).days)
    if fresh:
        sinks.note_rolled_up(spark, root, [r.batch for r in fresh])
    return days


def write_listing(df: DataFrame, path: str, *order, json: bool = False) -> None:
    """A listing in its total order, as Parquet or as JSON lines."""
    if json:
        sinks.write_json(df.orderBy(*order), path)
    else:
        sinks.write_sorted(df, path, *order)
