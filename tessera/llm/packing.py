"""Best-fit packing of tokenised documents by exact complements.

1. Each document becomes pieces of at most ``capacity`` tokens (one Arrow pass;
   only the last token count of each piece and its digest travel on).
2. The plan needs the histogram of piece lengths only: at most ``capacity``
   rows, whatever the size of the corpus, so it is made on the driver. The
   lengths are taken from the largest down; the gap a length leaves is filled
   exactly by a single length, a pair or a triple found in hash indexes of
   length sums, as often as the counts allow. What has no exact complement is
   packed by best fit, again in whole counts.
3. The plan is a list of patterns (lengths of a sequence, how many sequences).
   Each length's pieces are numbered, and a number range of a length belongs
   to one slot of one pattern, so a broadcast join of at most a few thousand
   plan rows gives every piece its sequence and offset.

A length held by a third of all pieces is numbered in parallel: pieces of a
length are spread over salts, numbered within their salt, and shifted by the
counts of the salts before.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches, shared_table


def byte_bpe(ranks_path: str, pattern: str, special: dict[str, int] | None = None,
             end_id: int | None = 2) -> Callable[[], Callable[[str], bytes]]:
    """A maker of encoders (made once per task): text -> ids as little-endian
    unsigned 32-bit integers, ``end_id`` appended. Strings of ``special`` in a
    text become their own id."""
    special = special or {}

    def make() -> Callable[[str], bytes]:
        import base64

        import numpy as np
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        end = [] if end_id is None else [end_id]

        def encode(text: str) -> bytes:
            ids = (bpe.encode(text, allowed_special="all") if any(s in text for s in special)
                   else bpe.encode_ordinary(text))
            return np.array(ids + end, dtype="<u4").tobytes()

        return encode

    return make


def pieces(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], doc_id: str = "doc_id",
           text: str = "text", capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length, ids_crc32 and, with
    ``keep_ids``, ids (binary, 4 bytes each). Documents of more than
    ``capacity`` tokens are cut into pieces of ``capacity``; the first piece
    holds the remainder. Null text counts as empty."""
    fields = [docs.schema[doc_id], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    made = []

    def rows(key, body) -> Iterator[tuple]:
        if not made:
            made.append(encoder())
        ids = made[0](body or "")
        n = len(ids) // 4
        start = 0
        for k in range(-(-n // capacity)):
            stop = n % capacity or capacity if k == 0 else start + capacity
            own = ids[4 * start:4 * stop]
            yield (key, k, start, stop - start, zlib.crc32(own), *([own] if keep_ids else []))
            start = stop

    return map_batches(docs.select(doc_id, F.col(text).cast("string")), rows, T.StructType(fields))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, number of sequences)`` that use every piece once.

    Small lengths spent on exact fills among themselves can be missed later
    beside large ones, so plans whose exact fills start from all lengths, from
    those over half the capacity, and from none are made, and the one with the
    fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, least) for least in (1, capacity // 2 + 1, capacity)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, least: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose exact fills start from lengths of at least ``least``."""
    left = Counter({n: c for n, c in counts.items() if c > 0})
    sizes = sorted(left, reverse=True)
    out: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        n = min(left[x] // k for x, k in need.items())
        if n > 0:
            out.append((lengths, n))
            for x, k in need.items():
                left[x] -= n * k
        return n > 0

    # sums of two lengths; a triple is a length and the pair that completes it
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, x in enumerate(sizes):
        for y in sizes[i:]:
            if x + y <= capacity:
                pairs[x + y].append((x, y))

    def fillers(gap: int) -> Iterator[tuple[int, ...]]:
        if gap in counts:
            yield (gap,)
        yield from pairs.get(gap, ())
        for z in sizes:
            if z < gap:
                for x, y in pairs.get(gap - z, ()):
                    if y >= z and left[z] and left[x] and left[y]:
                        yield (x, y, z)

    for big in sizes:
        if big < least:
            break
        if left[big] and big == capacity:
            use((big,))
            continue
        for rest in fillers(capacity - big):
            if not left[big]:
                break
            if rest[0] <= big and all(left[x] for x in rest):
                while use((big, *rest)):
                    pass

    # best fit for the rest: open[gap] holds the patterns that leave this gap
    open_: dict[int, list[list]] = defaultdict(list)
    for x in sizes:
        while left[x]:
            gap = min((g for g, held in open_.items() if g >= x and held), default=None)
            if gap is None:
                k = min(capacity // x, left[x])
                n = left[x] // k
                open_[capacity - k * x].append([(x,) * k, n])
                left[x] -= k * n
                continue
            lengths, n = open_[gap].pop()
            m = min(n, left[x])
            open_[gap - x].append([(*lengths, x), m])
            if n > m:
                open_[gap].append([lengths, n - m])
            left[x] -= m
    out += [(tuple(lengths), n) for held in open_.values() for lengths, n in held]
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """Rows (length, first, stop, copies, sequence, offset): the pieces of
    ``length`` numbered from ``first`` to ``stop`` go, ``copies`` to each, to
    the sequences from ``sequence`` on, side by side from ``offset``."""
    rows, taken, base = [], Counter(), 0
    for lengths, n in patterns:
        offset = 0
        for x, k in sorted(Counter(lengths).items(), reverse=True):
            rows.append((x, taken[x], taken[x] + n * k, k, base, offset))
            taken[x] += n * k
            offset += k * x
        base += n
    return rows


def pack(items: DataFrame, capacity: int = 1024, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"),
         salts: int | None = None) -> DataFrame:
    """``items`` (rows with a ``length`` from 1 to ``capacity``) with
    ``sequence_id`` and ``offset``. Pieces of equal length change places
    freely; ``order`` fixes which goes where, and rows equal in it are equal.
    An empty table gives no rows; a length out of range is an error."""
    spark = items.sparkSession
    cols = items.columns
    items = shared_table(items, "pieces")
    salts = salts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    per_salt = shared_table(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_salt.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy("length", "__salt").orderBy(*order)
    ranked = salted.withColumn("__n", F.row_number().over(within) - 1).join(shifts, ["length", "__salt"])
    ranked = ranked.select(*cols, (F.col("__n") + F.col("__shift")).alias("__n"))
    slots = spark.createDataFrame(
        _slots(plan(counts, capacity)),
        "length long, first long, stop long, copies int, seq long, off long")
    ranges = slots.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("first", "stop", "copies", "seq", "off"))).alias("__r"))
    slot = F.element_at(F.filter("__r", lambda r: (r["first"] <= F.col("__n")) & (F.col("__n") < r["stop"])), 1)
    # the plan's size is bounded by the capacity, not by the corpus
    placed = ranked.join(F.broadcast(ranges), "length").withColumn("__s", slot)
    at = F.col("__n") - F.col("__s.first")
    return placed.select(
        *cols, (F.col("__s.seq") + F.floor(at / F.col("__s.copies"))).cast("long").alias("sequence_id"),
        (F.col("__s.off") + F.pmod(at, F.col("__s.copies")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], doc_id: str = "doc_id",
                   text: str = "text", capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset and, with ``keep_ids``, the token ids of every piece.

    Null doc_ids, repeated rows and empty texts (one end token) are packed
    like any other; other columns of ``docs`` are not read.
    """
    cut = pieces(docs, encoder, doc_id, text, capacity, keep_ids)
    return pack(cut, capacity, order=(doc_id, "piece", "length", "ids_crc32"))
