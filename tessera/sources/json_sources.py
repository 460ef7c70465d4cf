"""JSON inputs with fixed schemas: event submissions, segment batches,
registrations (object or array) and tracking updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schemas as S
from tessera.functions import expr as X


def _ordered(df: DataFrame) -> DataFrame:
    """Input position: file name, then the row's place in the file (a
    multi-line JSON file is never split, so ids rise in document order)."""
    return df.withColumn("_file", F.input_file_name()).withColumn("_row", F.monotonically_increasing_id())


def _submissions(lines: DataFrame) -> list:
    """Input fields of the event submissions in ``value``. ``metadata`` is the JSON text of
    its value: an object (spaces between its tokens go, repeated keys stay), a text
    with its quotes, a literal null as ``null``."""
    row = F.from_json("value", S.EVENT_INPUT)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.metadata", "variant"))
    quoted = F.to_json(F.array(row["metadata"]))
    meta = (F.when(kind == "STRING", F.substr(quoted, F.lit(2), F.length(quoted) - 2))
            .when(kind == "VOID", F.lit("null")).otherwise(row["metadata"]))
    return [*[row[c].alias(c) for c in ("customer_id", "event_type", "feature")], meta.alias("metadata"),
            X.now_wall_clock().alias("received_at")]


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event submissions, one JSON object per line, in the raw shape the
    ingest job takes: ``raw_id`` (unique per row), the four input fields
    (``metadata`` as JSON text) and ``received_at`` (read time, UTC wall
    clock)."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("raw_id"), *_submissions(lines))


def read_events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same raw shape from a file stream: ``received_at`` is the
    micro-batch time; ``raw_id`` hashes the source file and the submitted
    line (row numbering is not available on streams) and only orders
    submissions that arrive in the same micro-batch; equal lines of a file share
    it, and being equal they may be numbered in any order."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(path).filter(F.trim("value") != "")
    return lines.select(F.xxhash64(F.input_file_name(), "value").alias("raw_id"), *_submissions(lines))


def read_segment_batch(spark: SparkSession, path: str) -> DataFrame:
    """``{"segments": [..]}`` documents, each one request (``request``); ``pos`` keeps
    batch order. A document without rows leaves one row whose ``request_error`` says so."""
    df = _ordered(spark.read.schema(S.SEGMENT_BATCH_INPUT).option("multiLine", True).json(path))
    ex = df.select("_file", "_row", F.posexplode_outer("segments").alias("i", "s")).orderBy("_file", "_row", "i")
    return ex.select(F.monotonically_increasing_id().alias("pos"), F.concat_ws("#", "_file", "_row").alias("request"),
                     "s.*", F.when(F.col("i").isNull(), "segments is required").alias("request_error"))


def read_tracking_updates(spark: SparkSession, path: str) -> DataFrame:
    """Tracking updates, one JSON object per line: ``key`` names the customer; ``seq`` keeps order."""
    schema = T.StructType([T.StructField("key", T.StringType()), *S.TRACKING_INPUT.fields])
    df = _ordered(spark.read.schema(schema).json(path)).orderBy("_file", "_row")
    return df.select(F.monotonically_increasing_id().alias("seq"), "key", "is_activity_tracking_enabled")


def read_registrations(spark: SparkSession, path: str) -> DataFrame:
    """A registration object or an array of them (the multi-line reader
    accepts both); ``pos`` keeps document order. The password field is not
    part of the schema and is never loaded."""
    df = _ordered(spark.read.schema(S.REGISTRATION_INPUT).option("multiLine", True).json(path))
    return df.orderBy("_file", "_row").select(F.monotonically_increasing_id().alias("pos"),
                                              "full_name", "username", "email")
