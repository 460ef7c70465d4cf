"""Live metrics from daily panes, with a side output for late events.

A micro-batch is reduced to one row per day. The panes of days that can still grow are the state: micro-batch n
writes the sum of the ones before and its own to ``open/batch_id=n``. A day whose end the watermark (the newest
event time so far, less the delay) has passed is closed: its pane goes to ``closed/batch_id=n``, once, and leaves the
state, which so holds some days, however long the stream runs. Events of closed days, and events without a time, are
late: their rows go to ``late/batch_id=n`` and their number to the mark, and no pane changes. Accepted and late events
add up to the input.

Seven-day windows are folded from the panes, seven rows a day, when they are asked for; no event is multiplied. A
retried micro-batch reads the state before it and replaces its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import expr as X
from tessera.sources.sinks import read_if_there

COUNTS = ["impressions", "clicks", "engagements", "events"]
PANES = "day date, " + ", ".join(f"{c} long" for c in COUNTS) + ", batch_id long"
MARKS = "watermark timestamp_ntz, accepted long, late long, batch_id long"


def live_panes(events: DataFrame, out: str, delay_days: int = 1, available_now: bool = True):
    """Start the stream over ``analytics_events`` rows; see the module for what lies under ``out``."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_if_there(spark, MARKS, f"{out}/marks").filter(F.col("batch_id") == batch_id - 1).first()
        passed = F.lit(before.watermark if before else None).cast("timestamp_ntz")
        day = F.to_date("created_at")
        per_day = batch.groupBy(day.alias("day")).agg(
            X.count_if(X.is_impression()).alias("impressions"), X.count_if(X.is_click()).alias("clicks"),
            X.count_if(X.is_engagement()).alias("engagements"), F.count(F.lit(1)).alias("events"),
            F.max("created_at").alias("newest")).checkpoint(eager=True)
        late = per_day.filter(_closed("day", passed))
        if not late.isEmpty():
            batch.filter(_closed(day, passed)).write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
        accepted = per_day.filter(~_closed("day", passed))
        state = read_if_there(spark, PANES, f"{out}/open").filter(F.col("batch_id") == batch_id - 1)
        merged = state.select("day", *COUNTS).unionByName(accepted.select("day", *COUNTS)).groupBy("day").agg(
            *[F.sum(c).alias(c) for c in COUNTS]).checkpoint(eager=True)
        newest = accepted.agg(F.max("newest")).scalar()
        total = lambda df: F.coalesce(df.agg(F.sum("events")).scalar(), F.lit(0).cast("bigint"))
        mark = spark.range(1).select(F.greatest(passed, X.days_before(newest, delay_days)).alias("watermark"),
                                     total(accepted).alias("accepted"), total(late).alias("late"))
        now = F.lit(mark.first().watermark).cast("timestamp_ntz")
        for name, rows in (("closed", merged.filter(_closed("day", now))), ("open", merged.filter(~_closed("day", now)))):
            rows.coalesce(1).write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")  # one row a day
        mark.coalesce(1).write.mode("overwrite").parquet(f"{out}/marks/batch_id={batch_id}")

    w = events.writeStream.outputMode("append").foreachBatch(write_batch).option("checkpointLocation", f"{out}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _closed(day, watermark) -> F.Column:
    """Whether the watermark has passed the end of the day; an unknown day counts as passed."""
    end = F.timestamp_add("DAY", F.lit(1), F.col(day).cast("timestamp_ntz") if isinstance(day, str) else
                          day.cast("timestamp_ntz"))
    return F.coalesce(end <= watermark, end.isNull())


def panes(spark: SparkSession, out: str, final: bool = False) -> DataFrame:
    """One row per day: ``day`` and its counts; with ``final`` the closed days only, else also what is open so far."""
    closed = read_if_there(spark, PANES, f"{out}/closed")
    if final:
        return closed.drop("batch_id")
    last = read_if_there(spark, MARKS, f"{out}/marks").agg(F.max("batch_id")).scalar()
    state = read_if_there(spark, PANES, f"{out}/open").filter(F.col("batch_id") == last)
    return closed.unionByName(state).drop("batch_id")


def late_events(spark: SparkSession, out: str) -> DataFrame:
    """``accepted`` and ``late`` events of every micro-batch."""
    return read_if_there(spark, MARKS, f"{out}/marks")


def daily(panes: DataFrame) -> DataFrame:
    """Clicks per day with any."""
    return panes.filter("clicks > 0").select("day", "clicks")


def weekly(panes: DataFrame) -> DataFrame:
    """Impressions, clicks, engagements, CTR and conversion of every 7-day window that holds a pane, advancing by a day."""
    start = F.explode(F.sequence(F.date_sub("day", 6), F.col("day")))
    agg = panes.select(start.alias("start"), *COUNTS).groupBy("start").agg(
        *[F.sum(c).alias(c) for c in COUNTS if c != "events"])
    begin = F.col("start").cast("timestamp_ntz")
    return agg.select(begin.alias("window_start"), F.timestamp_add("DAY", F.lit(7), begin).alias("window_end"),
                      "impressions", "clicks", "engagements", X.pct_rate("clicks", "impressions").alias("ctr"),
                      X.pct_rate("engagements", "clicks").alias("conversion_rate"))
