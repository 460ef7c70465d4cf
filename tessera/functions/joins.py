"""Join helpers: the OR-key -> equi-join rewrite."""


from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def customer_aliases(customers: DataFrame) -> DataFrame:
    """One row per lookup key of a customer: its internal id as text and its
    public id. Joining on ``alias`` replaces the reference's
    ``id::text = $1 OR customer_id = $1`` (a nested-loop join in Spark) by an
    equi-join."""
    return customers.select(
        F.col("id").alias("resolved_id"),
        F.col("customer_id").alias("resolved_customer_id"),
        F.explode(F.array_distinct(F.array(F.col("id").cast("string"), F.col("customer_id")))).alias("alias"),
    )


def unique_aliases(customers: DataFrame) -> DataFrame:
    """``customer_aliases`` reduced to one customer per key (smallest id when
    a key names two customers). The result is hash-partitioned on ``alias``,
    which a following join on ``alias`` reuses."""
    agg = customer_aliases(customers).groupBy("alias").agg(
        F.min(F.struct("resolved_id", "resolved_customer_id")).alias("_c"))
    return agg.select("alias", F.col("_c.resolved_id").alias("resolved_id"),
                      F.col("_c.resolved_customer_id").alias("resolved_customer_id"))


def stored_aliases(customers: DataFrame) -> DataFrame:
    """:func:`unique_aliases`, written once (reliable checkpoint). A join with it
    reads it through a shuffle of its own, which AQE can split on a hot key; an aggregate
    made in the same plan cannot be split."""
    ensure_checkpoint_dir(customers.sparkSession)
    return unique_aliases(customers).checkpoint(eager=True)


def spread_key(key: Column, row: Column) -> Column:
    """``key``; an empty or missing one becomes a text that names nobody (keys hold no NUL)
    and differs per row, so such rows do not meet in one task."""
    return F.when(F.coalesce(key, F.lit("")) == "", F.concat(F.lit("\0"), row.cast("string"))).otherwise(key)
