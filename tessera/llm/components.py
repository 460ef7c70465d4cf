"""Connected components of a link table by alternating stars.

Every round links each node's larger neighbours to the smallest node it sees
(large star), then its smaller neighbours to the smallest of them (small
star). The rounds end when the links no longer change; each component is then
a star around its smallest node. The number of rounds grows with the logarithm
of the component's size. Only a row count and a checksum per round reach the
driver.

Each round's links and minima are written tables, so joins see two plain
shuffles: a node with very many links is split by AQE's skewed-join rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link to another node.

    Links may repeat and come in either direction; self links and links with
    a null end are ignored; no links give no rows.
    """
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = shared_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                         "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared_table(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
        large = shared_table(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                             .distinct(), "large")
        least = shared_table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = shared_table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
