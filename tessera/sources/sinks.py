"""Sinks: the event table with its ledger of batches, daily roll-up partitions, and
snapshot publication for the merged tables, alone or several as one commit."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The batch that rows appended without a name belong to.
UNNAMED = "-"


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table, made without Python."""
    return spark.range(0).select(F.from_json(F.lit(None).cast("string"), schema).alias("r")).select("r.*")


def small_table(spark: SparkSession, name: str, values: list, kind: str = "string") -> DataFrame:
    """One column of a few values, made without Python."""
    if not values:
        return no_rows(spark, f"{name} {kind}")
    return spark.range(1).select(F.explode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(name))


def read_if_there(spark: SparkSession, schema: str, path: str, form: str = "parquet") -> DataFrame:
    """The files under ``path``; no rows if nothing has been written there."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, schema)


def append_events(df: DataFrame, path: str) -> None:
    """Append accepted events to a table partitioned by event date (so the
    look-back reports prune whole days at the scan) and batch."""
    (df.withColumn("event_date", F.to_date("created_at")).withColumn("batch", F.lit(UNNAMED))
       .write.mode("append").partitionBy("event_date", "batch").parquet(path))


# -- the ledger of the event table: a batch is begun, its rows are written, and it is done -------
BATCHES = "batch string, state string, days array<date>"


def begin_batch(spark: SparkSession, path: str, batch: str) -> None:
    """From now on the batch's rows may be in the table; readers leave them out until it is done."""
    _log_batch(spark, path, batch, "begun", [])


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """The rows of a begun batch. Its partitions are replaced, so a repeated attempt leaves one copy."""
    (df.withColumn("event_date", F.to_date("created_at")).withColumn("batch", F.lit(batch))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path))


def finish_batch(spark: SparkSession, path: str, batch: str, days: list) -> None:
    """One record makes all rows of the batch visible and tells which days they touch."""
    _log_batch(spark, path, batch, "done", days)


def _log_batch(spark: SparkSession, path: str, batch: str, state: str, days: list) -> None:
    dates = F.array(*[F.lit(d) for d in days]).cast("array<date>")
    spark.range(1).select(F.lit(batch).alias("batch"), F.lit(state).alias("state"), dates.alias("days")) \
        .coalesce(1).write.mode("append").json(f"{path}/_batches")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: ``batch``, ``state`` (begun, done), ``days``; one or two records a batch."""
    return read_if_there(spark, BATCHES, f"{path}/_batches", "json")


def batch_done(spark: SparkSession, path: str, batch: str) -> bool:
    return not batches(spark, path).filter((F.col("batch") == batch) & (F.col("state") == "done")).isEmpty()


def read_events_table(spark: SparkSession, path: str, but: str | None = None) -> DataFrame:
    """The date-partitioned event table (``event_date`` is the partition column the reports prune on), without the rows
    of batches that are begun and not done, or of batch ``but``. Those are few: attempts that failed or still run."""
    log = batches(spark, path)
    open_ones = log.groupBy("batch").agg(F.bool_or(F.col("state") == "done").alias("done")).filter("NOT done")
    names = sorted({r.batch for r in open_ones.select("batch").collect()} | ({but} if but is not None else set()))
    rows = spark.read.option("mergeSchema", "false").parquet(path)
    rows = rows.withColumn("batch", F.col("batch").cast("string"))
    return (rows.filter(~F.col("batch").isin(names)) if names else rows).drop("batch")


def overwrite_partitions(df: DataFrame, path: str, partition_col: str) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite),
    e.g. re-running one day's roll-up."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_col).parquet(path))


def rolled_up(spark: SparkSession, root: str) -> DataFrame:
    """The batches that the roll-ups under ``root`` hold."""
    return read_if_there(spark, "batch string", f"{root}/_rolled_up", "json").distinct()


def note_rolled_up(spark: SparkSession, root: str, names: list[str]) -> None:
    small_table(spark, "batch", names).coalesce(1).write.mode("append").json(f"{root}/_rolled_up")


def write_sorted(df: DataFrame, path: str, *order) -> None:
    """Listing output in a total order (range-partitioned sort)."""
    df.orderBy(*order).write.mode("overwrite").parquet(path)


def publish_snapshot(df: DataFrame, table_root: str) -> str:
    """Write the next version of a table under ``<root>/v=<version>``, then
    append a marker naming it under ``<root>/_versions``. Nothing is ever
    overwritten or deleted: readers of an older version keep reading it, and
    a job that fails before the marker leaves the current version in place.
    Version names start with a zero-padded clock, so the greatest marker is
    the newest."""
    import time

    spark = df.sparkSession
    root = table_root.rstrip("/")
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    spark.range(1).select(F.lit(version).alias("version"), F.lit(path).alias("path")).coalesce(1) \
        .write.mode("append").json(f"{root}/_versions")
    return path


def read_current(spark: SparkSession, table_root: str) -> DataFrame:
    """The newest published version (one small read of the markers); of a table
    published with others, the version that the newest commit names."""
    root = table_root.rstrip("/")
    mark = _newest(spark, root, "version string, path string")
    if mark:
        return spark.read.parquet(mark["path"])
    folder, _, name = root.rpartition("/")
    lead = spark.read.text(f"{root}/_lead").first()[0]
    return spark.read.parquet(_newest(spark, f"{folder}/{lead}", COMMIT)["members"][name])


COMMIT = "version string, path string, members map<string,string>"


def _newest(spark: SparkSession, root: str, schema: str):
    try:
        marks = spark.read.schema(schema).json(f"{root}/_versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.orderBy(F.desc("version")).first()


def publish_together(tables: dict[str, DataFrame], root: str, partitioned: dict[str, list[str]] | None = None) -> None:
    """Publish the next versions of several tables under ``root`` as one commit.

    Every table's version is written to its folder first. Then one marker, kept by the last table, names
    the versions of all: it is the commit, so a job that fails anywhere before it leaves all tables at their old
    versions, and no reader sees some new and some old ones. The other tables only say who keeps the marker.
    ``partitioned`` names the partition columns of a table.
    """
    import time

    root = root.rstrip("/")
    *_, lead = tables
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    members = {name: f"{root}/{name}/v={version}" for name in tables}
    spark = tables[lead].sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy(*(partitioned or {}).get(name, [])).parquet(members[name])
        if name != lead:
            small_table(spark, "lead", [lead]).coalesce(1).write.mode("overwrite").text(f"{root}/{name}/_lead")
    named = F.create_map(*[F.lit(x) for pair in members.items() for x in pair])
    spark.range(1).select(F.lit(version).alias("version"), F.lit(members[lead]).alias("path"), named.alias("members")) \
        .coalesce(1).write.mode("append").json(f"{root}/{lead}/_versions")


def newest_commit(spark: SparkSession, root: str, lead: str):
    """The record of the newest commit: ``version`` and ``members`` (table to path); None before the first."""
    return _newest(spark, f"{root.rstrip('/')}/{lead}", COMMIT)


def read_together(spark: SparkSession, root: str, lead: str) -> dict[str, DataFrame]:
    """All tables of the newest commit (one read of the markers)."""
    mark = newest_commit(spark, root, lead)
    return {name: spark.read.parquet(path) for name, path in mark["members"].items()}


def write_json(df: DataFrame, path: str) -> None:
    """Nested output as JSON lines (the API payload shape)."""
    df.write.mode("overwrite").json(path)


def save_segment_model(spark, model, path: str) -> None:
    """Store scoring parameters (small) as one JSON document."""
    import dataclasses
    import json

    spark.createDataFrame([(json.dumps(dataclasses.asdict(model)),)], "model string") \
        .coalesce(1).write.mode("overwrite").text(path)


def load_segment_model(spark, path: str):
    import json

    from tessera.operators.segmentation import SegmentModel

    return SegmentModel(**json.loads(spark.read.text(path).first()[0]))
