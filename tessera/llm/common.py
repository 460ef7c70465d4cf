"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir

# White space of the word definition: space and the code points 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_table(df: DataFrame, name: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back (as ``schema``, if given;
    ``options`` are those of the writer).

    Cuts the lineage (a lost executor loses nothing), keeps expensive work
    from running again in every consumer, and gives the planner the real
    size of the table.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda function is inlined into it by the
    optimizer and would be evaluated again for every array element; a
    lambda variable is bound to the finished value.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns (nulls told apart from absent
    values), together a key that equal rows, and only those, share."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        atomic = not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))
        parts += [c.isNull(), c if atomic else c.cast("string")]
    return [F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)]


def map_batches(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: T.StructType,
                flush: int = 4096) -> DataFrame:
    """``rows(*columns of one input row)`` yields output tuples; Arrow batches
    of at most ``flush`` rows travel both ways, one input row is worked on at
    a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)

        def batch(out):
            cols = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                out.extend(rows(*(b.column(k)[i].as_py() for k in range(b.num_columns))))
                if len(out) >= flush:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    return df.mapInArrow(run, schema)
