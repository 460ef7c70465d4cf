"""Segment state of a stream as a log of changes, folded when it is published.

Micro-batch n writes the rows that it changes, nothing else:

* ``deltas/segments/batch_id=n``: segments that are new or have another description;
* ``deltas/user_segments/batch_id=n/bucket=b``: one row per customer whose assignment it sets, by customer bucket;
* ``marks/batch_id=n``: the greatest ids given out so far.

The state before a micro-batch is the base overlaid by the changes of the ones before it, the last per key; of
the assignments only the batch's own customers, and so only their buckets, are read. :meth:`SegmentLog.publish`
folds the log into the next base, bucketed likewise, and publishes both tables as one commit; changes up to it
are not read any more. A retried micro-batch reads what it read before and replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.merge import admitted, max_id, segment_changes, user_segment_actions, user_segment_changes
from tessera.operators.merge import validate_segment_batch
from tessera.sources import sinks
from tessera.sources.sinks import read_if_there

SEGMENTS = "id int, name string, description string"
USER_SEGMENTS = "id long, customer_id long, segment_id int, confidence double, created_at timestamp_ntz"
MARKS = "segment_id long, user_segment_id long, batch_id long"
LEAD = "user_segments"
Base = tuple[DataFrame, DataFrame, int]


class SegmentLog:
    """``segments`` and ``user_segments`` are the tables that the stream starts from."""

    def __init__(self, spark: SparkSession, root: str, segments: DataFrame, user_segments: DataFrame, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._start = segments.select("id", "name", "description"), user_segments.select(
            "id", "customer_id", "segment_id", "confidence", "created_at")

    def bucket(self, customer: str = "customer_id") -> Column:
        return F.pmod(F.xxhash64(customer), F.lit(self.buckets)).cast("int")

    # -- reading ------------------------------------------------------------------
    def _base(self) -> Base:
        """Segments, assignments, and the last micro-batch that they hold."""
        mark = sinks.newest_commit(self.spark, f"{self.root}/published", LEAD)
        if not mark:
            return *self._start, -1
        tables = {name: self.spark.read.parquet(path) for name, path in mark["members"].items()}
        return tables["segments"], tables["user_segments"], tables["upto"].first()["batch_id"]

    def _changes(self, name: str, schema: str, after: int, upto: int) -> DataFrame:
        log = read_if_there(self.spark, f"{schema}, batch_id long" + (", bucket int" if name == LEAD else ""),
                         f"{self.root}/deltas/{name}")
        return log.filter((F.col("batch_id") > after) & (F.col("batch_id") <= upto))

    def segments(self, upto: int, base: Base | None = None) -> DataFrame:
        """The segments after micro-batch ``upto``."""
        base, _, after = base or self._base()
        changed = self._changes("segments", SEGMENTS, after, upto)
        last = changed.groupBy("name").agg(F.max(F.struct("batch_id", "id", "description")).alias("c")).select(
            "c.id", "name", "c.description")
        return base.join(last, "name", "left_anti").select("id", "name", "description").unionByName(last)

    def assignments(self, upto: int, customers: DataFrame | None = None, base: Base | None = None) -> DataFrame:
        """The assignments after micro-batch ``upto``, of all customers or of those in ``customers`` (``customer_id``)."""
        _, base, after = base or self._base()
        changed = self._changes("user_segments", USER_SEGMENTS, after, upto)
        if customers is not None:
            # at most as many numbers as there are buckets
            buckets = [r.b for r in customers.select(self.bucket().alias("b")).distinct().collect()]
            changed = changed.filter(F.col("bucket").isin(buckets)).join(customers, "customer_id", "left_semi")
            if "bucket" in base.columns:
                base = base.filter(F.col("bucket").isin(buckets))
            base = base.join(customers, "customer_id", "left_semi")
        cols = ["id", "customer_id", "segment_id", "confidence", "created_at"]
        last = changed.groupBy("customer_id").agg(F.max(F.struct("batch_id", *[c for c in cols if c != "customer_id"]))
                                                  .alias("c")).select("c.*", "customer_id").drop("batch_id")
        return base.select(*cols).join(last, "customer_id", "left_anti").select(*cols).unionByName(last.select(*cols))

    def _last_ids(self, batch: int) -> tuple[Column, Column]:
        mark = read_if_there(self.spark, MARKS, f"{self.root}/marks").filter(F.col("batch_id") == batch - 1).first()
        if mark:
            return F.lit(mark.segment_id), F.lit(mark.user_segment_id)
        segments, assigned = self._start
        return max_id(segments), max_id(assigned)

    # -- writing ------------------------------------------------------------------
    def apply(self, batch: DataFrame, batch_id: int, customers: DataFrame, aliases: DataFrame, as_of) -> None:
        """Validate a micro-batch, write its changes, its ``results`` and its ``rejected`` rows."""
        checked = validate_segment_batch(batch, customers, aliases).checkpoint(eager=True)
        valid = admitted(checked)
        last_segment, last_assignment = self._last_ids(batch_id)
        base = self._base()
        known = self.segments(batch_id - 1, base)
        segments = self._write(segment_changes(known, valid, last_segment), "deltas/segments", batch_id)
        touched = valid.select(F.col("cid").alias("customer_id")).distinct()
        held = self.assignments(batch_id - 1, touched, base).checkpoint(eager=True)
        changes = user_segment_changes(held, valid, segments, as_of, last_assignment).withColumn("bucket", self.bucket())
        assigned = self._write(changes, "deltas/user_segments", batch_id, "bucket")
        self._write(user_segment_actions(held, valid).select(
            "pos", F.col("customer_code").alias("customer_id"), "segment_name", "confidence", "action"), "results", batch_id)
        self._write(checked.filter(F.col("error").isNotNull()).select("pos", "customer_id", "segment_name", "error"),
                    "rejected", batch_id)
        greatest = lambda df, last: F.greatest(max_id(df), last.cast("bigint"))
        self._write(self.spark.range(1).select(greatest(segments, last_segment).alias("segment_id"),
                                               greatest(assigned, last_assignment).alias("user_segment_id")), "marks", batch_id)

    def _write(self, df: DataFrame, name: str, batch_id: int, *by: str) -> DataFrame:
        path = f"{self.root}/{name}/batch_id={batch_id}"
        (df.repartition(*by) if by else df).write.mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def publish(self, upto: int) -> None:
        """Fold the log up to micro-batch ``upto`` into the next version of both tables."""
        base = {"segments": self.segments(upto), "upto": self.spark.range(1).select(F.lit(upto).cast("long").alias("batch_id")),
                LEAD: self.assignments(upto).withColumn("bucket", self.bucket())}
        sinks.publish_together(base, f"{self.root}/published", {LEAD: ["bucket"]})
