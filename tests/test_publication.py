"""One commit for several tables, the ledger of ingested batches, roll-ups of touched days, ids."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest as I
from tessera.operators import merge as G
from tessera.operators.segmentation import DEFAULT_MODEL
from tessera.plans import jobs as J
from tessera.sources import sinks
from tessera.streaming import streams as ST

AS_OF = "2024-01-31 00:00:00"


def folder():
    return tempfile.mkdtemp(dir=os.environ.get("TMPDIR", "/tmp"))


def rows(df):
    return sorted(map(str, df.collect()))


class Lost(Exception):
    pass


@pytest.mark.parametrize("at", ["segments", "user_segments", "results", "commit"])
def test_job_killed_between_writes_leaves_the_old_trio(spark, t001, monkeypatch, at):
    root = ST.scratch(spark, "test-trio")
    J.predict_and_update(t001, AS_OF, DEFAULT_MODEL, root, ["CUS-000001"])
    before = {n: rows(sinks.read_current(spark, f"{root}/{n}")) for n in ("segments", "user_segments", "results")}

    from pyspark.sql import DataFrameWriter
    parquet, json = DataFrameWriter.parquet, DataFrameWriter.json

    def killed(self, path, *args, **kw):
        if f"/{at}/v=" in path:
            raise Lost
        return parquet(self, path, *args, **kw)

    def killed_commit(self, path, *args, **kw):
        if at == "commit" and path.endswith("_versions"):
            raise Lost
        return json(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", killed)
    monkeypatch.setattr(DataFrameWriter, "json", killed_commit)
    with pytest.raises(Lost):
        J.predict_and_update(t001, AS_OF, DEFAULT_MODEL, root, ["CUS-000006"])
    monkeypatch.undo()
    together = sinks.read_together(spark, root, "results")
    for name, old in before.items():
        assert rows(sinks.read_current(spark, f"{root}/{name}")) == rows(together[name]) == old
    J.predict_and_update(t001, AS_OF, DEFAULT_MODEL, root, ["CUS-000006"])
    assert [r.customer_id for r in sinks.read_current(spark, f"{root}/results").collect()] == ["CUS-000006"]


def _raw(t001, lo, hi):
    return I.raw_event_feed(t001.analytics_events.filter((F.col("id") >= lo) & (F.col("id") < hi)))


def test_repeated_ingest_appends_nothing(spark, t001):
    table = f"{folder()}/events"
    sinks.append_events(t001.analytics_events, table)
    raw = _raw(t001, 0, 200)
    rejected = J.ingest_to_table(raw, t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    once = rows(sinks.read_events_table(spark, table))
    # the same rows in another order are the same batch
    again = J.ingest_to_table(raw.repartition(3), t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    assert rows(sinks.read_events_table(spark, table)) == once and rows(again) == rows(rejected)
    J.ingest_to_table(_raw(t001, 200, 260), t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    stored = sinks.read_events_table(spark, table)
    assert stored.count() > len(once) and stored.select("id").distinct().count() == stored.count()
    assert "batch" not in stored.columns


def test_lost_ingest_is_not_seen_and_replaced(spark, t001, monkeypatch):
    table = f"{folder()}/events"
    sinks.append_events(t001.analytics_events, table)
    before = rows(sinks.read_events_table(spark, table))
    raw = _raw(t001, 0, 300)

    def lost(*args):
        raise Lost

    monkeypatch.setattr(sinks, "finish_batch", lost)
    with pytest.raises(Lost):
        J.ingest_to_table(raw, t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    monkeypatch.undo()
    assert spark.read.parquet(table).count() > len(before)  # rows lie there
    assert rows(sinks.read_events_table(spark, table)) == before
    # a batch in between takes the next ids; the lost one then comes after it
    J.ingest_to_table(_raw(t001, 300, 330), t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    J.ingest_to_table(raw, t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    stored = sinks.read_events_table(spark, table)
    top = t001.analytics_events.agg(F.max("id")).first()[0]
    ids = sorted(r.id for r in stored.filter(F.col("id") > top).collect())
    assert ids == list(range(top + 1, top + 1 + len(ids))) and stored.count() == len(before) + len(ids)


def test_rollups_follow_touched_days(spark, t001):
    table, root = f"{folder()}/events", folder()
    sinks.append_events(t001.analytics_events.filter("id = 1"), table)
    J.ingest_to_table(I.raw_event_feed(t001.analytics_events), t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    everything = J.refresh_rollups(spark, t001.user_segments, table, root)
    assert len(everything) > 20 and J.refresh_rollups(spark, t001.user_segments, table, root) == []

    def files():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
                for d, _, names in os.walk(root) for f in names if f.startswith("part-") and "_rolled_up" not in d}

    old = files()
    day = everything[7]
    late = t001.analytics_events.filter(F.to_date("created_at") == F.lit(day)).withColumn("id", F.col("id") + 10 ** 6)
    J.ingest_to_table(I.raw_event_feed(late), t001.customers, table, "admin", I.DEFAULT_PRINCIPAL)
    assert J.refresh_rollups(spark, t001.user_segments, table, root) == [day]
    now = files()
    assert {f.split("=")[1].split("/")[0] for f in set(now) - set(old)} == {str(day)}
    assert all(now[f] == old[f] for f in set(now) & set(old))
    # the same as computing everything from the stored table
    events = sinks.read_events_table(spark, table).drop("event_date")
    end = everything[-1] + dt.timedelta(days=1)
    fresh = folder()
    J._write_rollups(t001.user_segments, events, fresh, f"{end} 00:00:00", 40)
    for name in ("engagement_metrics", "personalization"):
        assert rows(spark.read.parquet(f"{root}/{name}")) == rows(spark.read.parquet(f"{fresh}/{name}"))


def test_ids_copy_the_order_key_only(spark):
    def bytes_checkpointed(width):
        before = _size(spark)
        df = spark.range(2000).select((F.col("id") * 7 % 2000).alias("o"), F.repeat(F.lit("x"), width).alias("metadata"),
                                      F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id")).alias("id"))
        out = G.sequence_ids(df, ["o"], 10)
        assert [(r.o + 11, r.metadata) for r in out.collect()] == [(r.id, "x" * width) for r in out.collect()]
        return _size(spark) - before
    narrow, wide = bytes_checkpointed(1), bytes_checkpointed(5000)
    # the wide rows hold 10 MB; the folder may also lose or gain a little by other checkpoints' end
    assert 0 < narrow and abs(wide - narrow) < 100_000


def _size(spark):
    root = spark.sparkContext.getCheckpointDir().replace("file:", "")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_ids_with_a_missing_part_of_the_key(spark):
    df = spark.createDataFrame([(None, 2, "b"), (1, 1, "c"), (None, 1, "a")], "r long, k long, name string")
    assert {r.name: r.id for r in G.sequence_ids(df, ["r", "k"]).collect()} == {"a": 1, "b": 2, "c": 3}


def test_constraints_share_two_shuffles(spark, t001):
    plan = G.constraint_report(t001)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the fixture tables join small dimensions by broadcast


def test_constraint_violations_are_counted(spark, t001):
    class T:
        pass

    t = T()
    for name, *_ in G.CONSTRAINTS:
        setattr(t, name, getattr(t001, name))
    held = t001.user_segments.limit(3)
    t.user_segments = held.unionByName(held.withColumn("confidence", F.lit(None).cast("double"))).unionByName(
        held.withColumn("customer_id", F.lit(10 ** 9).cast("long")).withColumn("segment_id", F.lit(None).cast("int")))
    got = {(r.table_name, r.constraint_name): (r.checked_rows, r.violations) for r in G.constraint_report(t).collect()}
    assert got["user_segments", "unique(customer_id)"] == (9, 9)
    assert got["user_segments", "fk(customer_id)->customers"] == (9, 3)
    assert got["user_segments", "fk(segment_id)->segments"] == (9, 0)
    assert got["user_segments", "check(0<=confidence<=1)"] == (9, 3)
    t.customers = t001.customers.limit(0)
    got = {(r.table_name, r.constraint_name): (r.checked_rows, r.violations) for r in G.constraint_report(t).collect()}
    assert got["customers", "unique(id)"] == (0, 0)
    assert got["accounts", "fk(customer_id)->customers"] == (150, 150)


def _constrained(spark, n):
    """Tables of the constraints: ``n`` customers in one task; event rows, a third of one customer, and ten orphans."""
    class T:
        pass

    t = T()
    one = spark.range(0, n, 1, 1)
    few = one.limit(7)
    i = F.col("id")
    t.customers = one.select("id", F.concat(F.lit("C"), i).alias("customer_id"),
                             F.when(i % 50 == 0, "twice").when(i % 50 > 1, F.concat(i, F.lit("@mail"))).alias("email"))
    t.customer_profiles = one.select("id", i.alias("customer_id"))
    t.accounts = one.select("id", i.alias("customer_id"), i.cast("string").alias("account_no"))
    t.transactions = one.select("id", F.when(i % 9 > 0, i).alias("account_id"), F.concat(F.lit("T"), i).alias("trx_id"))
    t.analytics_events = one.select("id", F.when(i < 10, i + n).when(i % 3 == 0, 1).otherwise(i).alias("customer_id"))
    t.user_activities = t.analytics_events
    t.segments = few.select("id", i.cast("string").alias("name"))
    t.user_segments = one.select("id", (i % (n - 1)).alias("customer_id"), (i % 8).alias("segment_id"),
                                 (i % 5 / 4 + 0.25).alias("confidence"))
    t.recommendations = few.select("id", i.alias("segment_id"))
    t.ab_tests = few
    t.ab_test_assignments = one.select("id", i.alias("customer_id"), (i % 7).alias("ab_test_id"))
    return t


def test_constraint_entries_of_one_task_are_bounded(spark, monkeypatch):
    # all of a task's keys are held by the first aggregation, and nearly all differ
    monkeypatch.setattr(G, "_report", lambda rows, names: rows)
    rows = G.constraint_report(_constrained(spark, 200_000))
    per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 1_200_000 and sum(per_task) == 200_000 * (9 + 2 + 3 + 2 + 2 + 4 + 3) + 7 * 5


def test_constraints_of_dealt_tables(spark, monkeypatch):
    n = 3000
    t = _constrained(spark, n)
    whole = sorted(map(tuple, G.constraint_report(t).collect()))
    monkeypatch.setattr(G, "ENTRIES_PER_TASK", 500)
    report = G.constraint_report(t)
    assert "RepartitionByExpression" in report._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, report.collect())) == whole
    got = {(r[0], r[1]): r[2:] for r in whole}
    assert got["customers", "unique(id)"] == (n, 0)
    assert got["customers", "unique(email)"] == (n, n // 50)  # missing ones never conflict
    assert got["transactions", "fk(account_id)->accounts"] == (n, 0)
    assert got["analytics_events", "fk(customer_id)->customers"] == (n, 10)
    assert got["user_segments", "unique(customer_id)"] == (n, 2)
    assert got["user_segments", "fk(segment_id)->segments"] == (n, n // 8)
    assert got["user_segments", "check(0<=confidence<=1)"] == (n, n // 5)
