"""The customer key index of a stream, kept up to date from new customers only.

``aliases/part=<n>`` holds the keys that micro-batch n found new, ``files/part=<n>`` the files of the customer table that
it read for that. A refresh lists the table's files, reads those that no earlier part has read, and adds the keys
that the index lacks; without new files it writes nothing. A retried micro-batch replaces its own part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.joins import unique_aliases
from tessera.sources.sinks import read_if_there, small_table

ALIASES = "alias string, resolved_id long, resolved_customer_id string, part long"
FILES = "file string, replaced long, part long"


class KeyIndex:
    """``files()`` lists the files of the customer table, ``customers(files)`` gives the customers of some of them
    (columns ``id`` and ``customer_id``). A key that names two customers means the one of the smaller id."""

    def __init__(self, spark: SparkSession, root: str, files: Callable[[], list[str]],
                 customers: Callable[[list[str]], DataFrame]):
        self.spark, self.root, self._files, self._customers = spark, root.rstrip("/"), files, customers

    @classmethod
    def of_table(cls, spark: SparkSession, root: str, path: str, prepare: Callable[[DataFrame], DataFrame]) -> KeyIndex:
        """Over a Parquet table at ``path`` to which files are added; ``prepare`` makes customers of its rows."""
        schema = spark.read.parquet(path).schema
        return cls(spark, root, lambda: spark.read.schema(schema).parquet(path).inputFiles(),
                   lambda files: prepare(spark.read.schema(schema).parquet(*files)))

    def refresh(self, part: int) -> int:
        """Index what is new as part ``part``; returns the number of files read."""
        log = read_if_there(self.spark, FILES, f"{self.root}/files").filter(F.col("part") < part)
        seen = {r.file for r in log.select("file").collect()}  # file names, as the listing itself has them
        fresh = [f for f in self._files() if f not in seen]
        if not fresh:
            return 0
        own = unique_aliases(self._customers(fresh))
        held = self._parts(part - 1).select("alias", F.col("resolved_id").alias("_held"))
        # a new customer has a greater id than those before; if not, the smaller id wins
        new = own.join(held, "alias", "left").filter("_held IS NULL OR resolved_id < _held")
        target = f"{self.root}/aliases/part={part}"
        new.withColumn("replaces", F.col("_held").isNotNull()).drop("_held").write.mode("overwrite").parquet(target)
        replaced = self.spark.read.parquet(target).filter("replaces").count()
        small_table(self.spark, "file", fresh).withColumn("replaced", F.lit(replaced).cast("long")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.root}/files/part={part}")
        return len(fresh)

    def _parts(self, part: int) -> DataFrame:
        return read_if_there(self.spark, ALIASES, f"{self.root}/aliases").filter(F.col("part") <= part)

    def table(self, part: int) -> DataFrame:
        """``alias``, ``resolved_id``, ``resolved_customer_id`` after part ``part``: a stored table, one row per key."""
        rows = self._parts(part).drop("part")
        log = read_if_there(self.spark, FILES, f"{self.root}/files").filter((F.col("part") <= part) & (F.col("replaced") > 0))
        if log.isEmpty():
            return rows
        return rows.groupBy("alias").agg(F.min(F.struct("resolved_id", "resolved_customer_id")).alias("c")).select(
            "alias", "c.*")
