"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws the Efraimidis-Spirakis key ``-ln(u) / w``: ``u`` is a hash of the
document in (0, 1], ``w`` its quality weight. A source's target is met by
complete epochs, and the rest of it by the documents with the smallest keys, as
many as their prefix sum of sizes allows (to the nearest document).

A source with a third of all rows is never sorted in one task: keys fall into ``buckets``
equal steps of their distribution function, sizes are summed per (source, bucket), and the
prefix sums of these settle every bucket but the one in which the target lies; only
that one is sorted. Equal rows draw a key each, by their number among their like, so they
spread over the buckets too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import row_key, shared_table, words
from tessera.llm.text_stats import SYMBOLS, count_of, word_chars
from tessera.operators.merge import dense_ranks

WEIGHTS = (5, 2, 1)
LEAST_WEIGHT = 0.1


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of word characters that are no symbols, times
    how near the mean word length is to that of prose (3 to 12)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars, n = word_chars(words(t)), F.greatest(F.size(words(t)), F.lit(1))
    plain = 1 - F.coalesce(count_of(t, SYMBOLS) / F.nullif(chars, F.lit(0)), F.lit(0.0))
    mean = chars / n
    shape = F.when(mean < 3, mean / 3).when(mean > 12, 12 / mean).otherwise(1.0)
    return F.greatest(F.lit(LEAST_WEIGHT), plain * shape)


def targets(sizes: DataFrame, epochs: float = 1.5, most: float = 2.0,
            weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``size`` and ``target`` from a table ``(source, size)``,
    one row per source.

    ``weights`` repeat over the sources by code point, null last. The targets
    share ``epochs`` times all sizes by weight; what exceeds ``most`` times a
    source's size is shared again by weight among the others until none is above.
    """
    named = shared_table(sizes.select("source", "size", F.col("source").isNull().alias("__none"),
                                      F.col("source").cast("string").alias("__name")), "source_sizes")
    ranks = dense_ranks(named, ["__none", "__name"]).select(F.col("__name").alias("__ranked"), "_rank")
    named = named.join(ranks, F.col("__name").eqNullSafe(F.col("__ranked")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    t = shared_table(named.select("source", "size", weight.alias("w"), (F.col("size") * most).alias("cap")), "sources")
    total = t.agg(F.sum("size")).first()[0] or 0
    share, capped = None, -1
    while True:
        above = F.lit(False) if share is None else F.col("w") * share >= F.col("cap")
        n, held, free = t.agg(F.coalesce(F.sum(above.cast("int")), F.lit(0)),
                              F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
                              F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        share, capped = (total * epochs - held) / free, n
    target = F.col("cap") if share is None else F.least(F.col("cap"), F.col("w") * share)
    return t.select("source", "size", target.cast("double").alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__j``: 0, 1, .. among rows of equal ``__g``, in the order of ``__r`` (a stored
    ``monotonically_increasing_id``). Numbers run within what one task wrote and go on from the tasks before it, so no
    group is gathered."""
    again = shared_table(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__g"), "again")
    zero = F.lit(0).cast("long")
    if again.isEmpty():
        return rows.withColumn("__j", zero)
    part = rows.join(again, "__g").withColumn("__p", F.shiftright("__r", 33))
    upto = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    first = part.groupBy("__g", "__p").agg(F.count(F.lit(1)).alias("n"))
    first = shared_table(first.select("__g", "__p", F.coalesce(F.sum("n").over(upto), zero).alias("__first")), "firsts")
    place = F.row_number().over(Window.partitionBy("__g", "__p").orderBy("__r")) - 1
    part = part.withColumn("__place", place).join(first, ["__g", "__p"])
    part = part.select(*rows.columns, (F.col("__first") + F.col("__place")).alias("__j"))
    alone = rows.join(again, "__g", "left_anti").select(*rows.columns, zero.alias("__j"))
    return shared_table(alone.unionByName(part), "numbered")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        epochs: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, buckets: int = 4096,
        seed: int = 11, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, size, source, source_size, target and copies (how
    often the mix takes the document) for every row.

    A null or empty text has size 0 and takes part without adding words; a null source is a
    source of its own; repeated rows (equal doc_id, text, source and ``carry``) are drawn each by itself, and how many
    of them the mix takes is the same in a rerun; an empty table gives no rows.
    """
    h1, _ = row_key(docs.select(doc_id, text, source))
    t = F.col(text).cast("string")
    slim = docs.select(doc_id, *carry, F.col(source).alias("source"), F.size(words(t)).cast("long").alias("size"),
                       quality_weight(t).alias("__w"), h1.alias("__h"), F.xxhash64(h1, *carry).alias("__g"),
                       F.monotonically_increasing_id().alias("__r"))
    slim = _numbered(shared_table(slim, "sized"))
    own = F.xxhash64("__h", F.lit(seed))
    own = F.when(F.col("__j") == 0, own).otherwise(F.xxhash64("__h", F.lit(seed), "__j"))
    u = (F.shiftrightunsigned(own, 11) + 1) / F.lit(float(1 << 53))
    key = -F.log(u) / F.col("__w")
    # The distribution functions of the keys for the largest weight (1) and the least (0.1),
    # in equal parts: whatever a source's weights, no bucket expects over 2.2 times the mean.
    place = 1 - (F.exp(-key) + F.exp(-F.lit(LEAST_WEIGHT) * key)) / 2
    bucket = F.least(F.lit(buckets - 1), F.floor(place * buckets)).cast("int")
    slim = shared_table(slim.select(doc_id, *carry, "source", "size", key.alias("__key"), bucket.alias("__b")), "keys")
    per_bucket = shared_table(slim.groupBy("source", "__b").agg(F.sum("size").alias("n")), "buckets")
    goals = targets(per_bucket.groupBy("source").agg(F.sum("n").alias("size")), epochs, most, weights)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumnRenamed("size", "source_size").withColumn("__full", full.cast("int"))
    goals = shared_table(goals.withColumn("__rest", F.col("target") - F.col("__full") * F.col("source_size")), "goals")

    same = F.col("source").eqNullSafe(F.col("__s"))
    named = goals.withColumnRenamed("source", "__s")
    upto = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edges = per_bucket.withColumn("__before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    edges = edges.join(named, same).select(
        F.col("source").alias("__s"), F.col("__b").alias("__eb"), "__before", "source_size", "target", "__full", "__rest",
        (F.col("__before") + F.col("n") <= F.col("__rest")).alias("__in"),
        (F.col("__before") >= F.col("__rest")).alias("__out"))
    edges = shared_table(edges, "edges")
    placed = slim.join(edges, same & (F.col("__b") == F.col("__eb")))
    cols = [doc_id, *carry, "source", "size", "source_size", "target", "__full"]
    settled = placed.filter("__in OR __out").select(*cols, F.col("__in").cast("int").alias("__more"))
    within = Window.partitionBy("source").orderBy("__key", doc_id, *carry)
    half = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1))
    # taken while more than half of the document lies below the target: the nearest sum
    near = F.col("__before") + F.coalesce(half, F.lit(0)) + F.col("size") / 2 < F.col("__rest")
    crossing = placed.filter("NOT __in AND NOT __out").select(*cols, near.cast("int").alias("__more"))
    out = settled.unionByName(crossing)
    return out.select(doc_id, *carry, "size", "source", "source_size", "target",
                      (F.col("__full") + F.col("__more")).alias("copies"))


def resample(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, columns unchanged."""
    cols = docs.columns
    h1, h2 = row_key(docs)
    keyed = docs.select("*", h1.alias("__h1"), h2.alias("__h2"))
    mixed = mix(keyed, doc_id, text, source, carry=("__h1", "__h2"), **options)
    # rows that are equal in all columns are one key here: their copies add up
    times = mixed.groupBy("__h1", "__h2").agg(F.sum("copies").alias("__n")).filter("__n > 0")
    times = shared_table(times, "copies")
    # equal rows become one per task before any of them moves; the join finds the rows where they then are
    once = keyed.dropDuplicates(["__h1", "__h2"]).join(times, ["__h1", "__h2"])
    again = F.sequence(F.lit(1), F.col("__n").cast("int"))
    return once.withColumn("__i", F.explode(again)).select(*[F.col(f"`{c}`") for c in cols])
