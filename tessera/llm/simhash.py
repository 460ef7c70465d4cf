"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: a bit is 1 where more than half of the shingles'
XXH64 values (seed 42) have it. Two documents link when their fingerprints
differ in few bits; groups are the connected components of the links.

Search over the distinct fingerprints:

1. The fingerprint is cut into segments. By the pigeonhole rule two
   fingerprints within ``max_bits`` differ in few bits in some segment, so the
   small Hamming ball around each segment value is enumerated.
2. The enumerated keys meet the table of segment values in an equi-join; a
   pair is enumerated from its smaller key only.
3. Matches are verified on all 64 bits.

A segment value shared by more than ``hot`` fingerprints would make all pairs
of them. For these the ball over the remaining bits is enumerated too, and the
full fingerprint is looked up: the work per fingerprint is then bounded by the
ball's size, whatever the size of the bucket, and no link is lost.
"""

from __future__ import annotations

from itertools import accumulate, combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, row_key, shared_table
from tessera.llm.components import components

BITS = 64
SEED = 42
BLOCK = 1 << 16  # shingles per numpy block


def fingerprint(text: str | None, width: int) -> int:
    """The unsigned fingerprint of a text; without words (or null) it is 0."""
    import numpy as np
    from xxhash import xxh64_intdigest

    # bytes.lower() and bytes.split() know ASCII only: A-Z, space, and 9 to 13
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    start = [0, *accumulate(len(p) + 1 for p in parts)]
    spans = list(zip(start, start[width:], strict=False)) or [(0, len(line) + 1)]
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(spans), BLOCK):
        hashes = np.array([xxh64_intdigest(line[i:j - 1], SEED) for i, j in spans[k:k + BLOCK]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", width: int = 3) -> DataFrame:
    """``keys`` and ``fp`` (the fingerprint as a signed long) of every row."""

    def rows(*values):
        fp = fingerprint(values[-1], width)
        yield (*values[:-1], fp - (1 << BITS) if fp >> (BITS - 1) else fp)

    slim = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*slim.select(*keys).schema.fields, T.StructField("fp", T.LongType())])
    return map_batches(slim, rows, schema)


def _ball(bits: int, radius: int) -> list[int]:
    """All masks over ``bits`` bits with at most ``radius`` ones."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _signed(masks: list[int]) -> F.Column:
    return F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("bigint") for m in masks])


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, hot: int = 64) -> DataFrame:
    """Pairs ``(a, b)`` of the distinct fingerprints ``fp`` that differ in 1 to ``max_bits`` bits
    (``segments`` from 2 on; the balls, and so the plan, grow with ``max_bits``)."""
    size = BITS // segments
    radius, rest = divmod(max_bits, segments)
    # if no segment had so few differing bits, the sum would exceed max_bits
    radii = [radius if s <= rest else radius - 1 for s in range(segments)]
    mask = (1 << size) - 1
    found = None
    for s, r in enumerate(radii):
        if r < 0:
            continue
        key = F.shiftrightunsigned("fp", s * size).bitwiseAND(F.lit(mask))
        buckets = fps.select(key.alias("key"), "fp")
        sizes = shared_table(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "buckets")
        probes = buckets.select(F.col("key").alias("own"), F.col("fp").alias("a"),
                                F.explode(_signed(_ball(size, r))).alias("flip"))
        probes = probes.select("a", "flip", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "own")
        probes = probes.filter("key >= own").drop("own").join(sizes, "key")
        probes = shared_table(probes.filter("flip <> 0 OR n > 1"), "probes")
        cold = (probes.filter(F.col("n") <= hot).join(buckets, "key")
                .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= max_bits)
                .filter("flip <> 0 OR a < fp").select("a", F.col("fp").alias("b")))
        outside = [m for m in range(BITS) if not s * size <= m < (s + 1) * size]
        flips = F.lit(None).cast("array<bigint>")
        for d in range(r + 1):
            ball = [sum(1 << outside[i] for i in range(BITS - size) if m >> i & 1)
                    for m in _ball(BITS - size, max_bits - d)]
            flips = F.when(F.bit_count("flip") == d, _signed(ball)).otherwise(flips)
        wide = (probes.filter(F.col("n") > hot)
                .select("a", "flip", F.explode(flips).alias("more"))
                .select("a", "flip", F.col("a").bitwiseXOR(F.shiftleft("flip", s * size))
                        .bitwiseXOR(F.col("more")).alias("fp"))
                .filter("flip <> 0 OR a < fp").join(fps.select("fp"), "fp").select("a", F.col("fp").alias("b")))
        both = cold.unionByName(wide)
        found = both if found is None else found.unionByName(both)
    return found


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3,
                   max_bits: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``carry``, ``fingerprint`` (16 hex digits), ``component_id``
    and ``group`` (the smallest fingerprint of the component) per row.

    ``component_id`` is the smallest non-null doc_id among all rows reachable
    over links, the row itself included. Null and empty texts have fingerprint
    zero and link like any other; rows with a null doc_id are grouped too
    (component_id is null if no row of the group has an id); repeated rows are
    all returned; an empty table gives no rows. Other columns of ``docs`` are
    not read.
    """
    slim = shared_table(fingerprints(docs, [doc_id, *carry], text, width), "fingerprints")
    fps = shared_table(slim.groupBy("fp").agg(F.min(doc_id).alias("first")), "distinct")
    stars = shared_table(components(links(fps, max_bits)), "stars")
    linked = fps.join(stars, fps["fp"] == stars["node"]).select("fp", "root", "first")
    firsts = shared_table(linked.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = linked.select("fp", "root").join(firsts, "root")
    rest = fps.join(stars, fps["fp"] == stars["node"], "left_anti")
    groups = shared_table(named.select("fp", "root", "component_id").unionByName(
        rest.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))), "groups")
    return slim.join(groups, "fp").select(
        doc_id, *carry, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("root").alias("group"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3,
               max_bits: int = 2) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the
    one with the smallest non-null doc_id (ties: smallest row hash). Rows that
    are equal in all columns count once."""
    cols = docs.columns
    h1, h2 = row_key(docs)
    keyed = docs.select("*", h1.alias("__h1"), h2.alias("__h2"))
    groups = simhash_groups(keyed, doc_id, text, width, max_bits, carry=("__h1", "__h2"))
    kept = groups.groupBy("group").agg(
        F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), "__h1", "__h2")).alias("k"))
    kept = shared_table(kept.select("k.__h1", "k.__h2"), "kept")
    # equal rows become one per task before any of them moves; the join finds the rows where they then are
    once = keyed.dropDuplicates(["__h1", "__h2"])
    return once.join(kept, ["__h1", "__h2"], "left_semi").select(*cols)
