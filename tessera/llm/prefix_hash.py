"""Document fingerprints from prefix polynomial hashes.

A text ``c[0..n)`` of code points has, for two prime moduli and fixed bases, the prefix
array ``H[i] = sum(c[j] * B**j, j < i) mod p``. The hash of any span is a difference of two
entries (brought to a common power of B), so equality of any two spans takes constant time,
and the longest common extension of two positions is found by binary search.

* The fingerprint is the length and the two hashes of the whole text.
* The likeness of two texts is the share of both that lies in their longest common prefix, in the longest common
  suffix of what is left, or in spans of ``SPAN`` code points (of the shorter text, if that is less) which the other text
  has too, wherever they stand. So copies with any number of scattered edits, and shared passages that have moved, count;
  edits less than ``SPAN`` apart hide what is between. Two empty texts are alike (1). Only what prefix and suffix leave
  is looked up span by span, in sorted order.

A text is worked on in memory, at some 80 bytes a code point, with its neighbour.

Neighbours in doc_id order meet by one range partitioning of the texts; each
partition is read as a stream that holds two documents. The last document of a
partition and the first of the next one, a row each per partition, are paired
afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import shared_table

# Mersenne prime 2^31 - 1 and the prime below it; products of a residue and a
# code point or another residue fit 63 bits.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 69069069)
_powers: dict[int, list] = {}
_inverses: dict[int, list] = {}
# Code points of the spans that the likeness looks for.
SPAN = 16


def powers(n: int, inverse: bool = False) -> dict:
    """``B**i mod p`` (``B**-i``) for i < n at least, for both moduli; kept and doubled."""
    import numpy as np

    kept = _inverses if inverse else _powers
    if kept and len(kept[0]) >= n:
        return kept
    for m, (p, base) in enumerate(zip(MODULI, BASES, strict=True)):
        have = kept.get(m, np.ones(1, dtype=np.int64))
        while len(have) < n:
            step = pow(base, -len(have) if inverse else len(have), p)
            have = np.concatenate([have, have * step % p])
        kept[m] = have
    return kept


def _mod(values, p: int):
    """``values % p`` of an array of whole numbers, none negative (division by one number is the faster way)."""
    return values - values // p * p


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        import numpy as np

        self.text, self._sorted = text, {}
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64) + 1
        self.n = len(codes)
        self.sums = []
        pws = powers(self.n + 1)
        for m, p in enumerate(MODULI):
            # residues stay below 2^31, so 2^32 of them can be summed before the remainder
            self.sums.append(np.concatenate([[0], _mod(np.cumsum(_mod(codes * pws[m][:self.n], p)), p)]))

    def span(self, i: int, j: int, at: int) -> tuple[int, int]:
        """The hash of ``[i, j)`` as if it began at position ``at >= i``."""
        pws = powers(at - i + 1)
        return tuple((int(s[j]) - int(s[i])) * int(pws[m][at - i]) % p
                     for m, (s, p) in enumerate(zip(self.sums, MODULI, strict=True)))

    def spans(self, length: int, begin: int, end: int):
        """The hashes of the spans of ``length`` that start in ``[begin, end)``, as if they began at 0."""
        inv = powers(max(end, 1), inverse=True)
        a, b = (_mod((s[begin + length:end + length] - s[begin:end] + p) * inv[m][begin:end], p)
                for m, (s, p) in enumerate(zip(self.sums, MODULI, strict=True)))
        return a << 31 | b

    def sorted_spans(self, length: int):
        """The hashes of all spans of ``length``, sorted; kept."""
        import numpy as np

        if length not in self._sorted:
            self._sorted[length] = np.sort(self.spans(length, 0, self.n - length + 1))
        return self._sorted[length]

    def fingerprint(self) -> str:
        a, b = (int(s[-1]) for s in self.sums)
        return f"{self.n:x}-{a:08x}{b:08x}"


def equal_spans(x: Prefixes, i: int, y: Prefixes, j: int, length: int) -> bool:
    """Whether ``x[i : i + length]`` and ``y[j : j + length]`` are equal."""
    at = max(i, j)
    return x.span(i, i + length, at) == y.span(j, j + length, at)


def common_extension(x: Prefixes, i: int, y: Prefixes, j: int) -> int:
    """The longest length for which the spans from ``i`` and ``j`` on are equal."""
    return _longest(min(x.n - i, y.n - j), lambda k: equal_spans(x, i, y, j, k))


def common_suffix(x: Prefixes, y: Prefixes, limit: int) -> int:
    """The longest common suffix of at most ``limit`` code points."""
    return _longest(limit, lambda k: equal_spans(x, x.n - k, y, y.n - k, k))


def _longest(limit: int, equal: Callable[[int], bool]) -> int:
    """The greatest length up to ``limit`` that is equal: doubled while it is, then searched by halves."""
    if limit <= 0 or not equal(1):
        return 0
    lo, step = 1, 2
    while step <= limit and equal(step):
        lo, step = step, 2 * step
    hi = min(limit, step - 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(mid) else (lo, mid - 1)
    return lo


def _covered(spans, there, length: int, begin: int, first: int, last: int) -> int:
    """The places in ``[first, last)`` that spans of ``length`` cover, if they occur ``there`` (sorted); ``spans`` start at
    ``begin``, ``begin + 1``, .."""
    import numpy as np

    # in sorted order one look-up is next to the one before; common spans are few or make up the text
    own = np.sort(spans)
    common = own[there[np.minimum(np.searchsorted(there, own), len(there) - 1)] == own]
    if not len(common):
        return 0
    at = np.flatnonzero(common[np.minimum(np.searchsorted(common, spans), len(common) - 1)] == spans) + begin
    ends = np.minimum(at + length, last)
    # each span adds what the one before it has not covered
    return int((ends - np.maximum(at, np.concatenate([[first], ends[:-1]]))).sum())


def likeness(x: Prefixes, y: Prefixes) -> float:
    import numpy as np

    if not x.n or not y.n:
        return float(x.n == y.n)
    head = common_extension(x, 0, y, 0)
    tail = common_suffix(x, y, min(x.n, y.n) - head)
    same = 2 * (head + tail)
    length = min(SPAN, x.n, y.n)
    if same < x.n + y.n:
        begin = max(head - length + 1, 0)
        (ends_x, own_x), (ends_y, own_y) = ((e, t.spans(length, begin, e)) for t in (x, y)
                                            for e in [max(begin, min(t.n - length + 1, t.n - tail))])
        # the spans of y are its own ones and those that lie in the common prefix or suffix
        there_y = y.sorted_spans(length) if begin == 0 and ends_y == y.n - length + 1 else np.sort(np.concatenate(
            [x.spans(length, 0, begin), own_y, x.spans(length, ends_x, x.n - length + 1)]))
        if len(own_x):
            same += _covered(own_x, there_y, length, begin, head, x.n - tail)
        if len(own_y):
            same += _covered(own_y, x.sorted_spans(length), length, begin, head, y.n - tail)
    return same / (x.n + y.n)


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of ``following``'s start."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _compare(own: Prefixes, following: Prefixes) -> tuple:
    changed = Prefixes(edited(own.text, following.text))
    return (own.n, hashlib.sha256(changed.text.encode()).hexdigest(), own.fingerprint(), changed.fingerprint(),
            likeness(own, changed), likeness(own, following))


RESULT = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
          T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
          T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]


def fingerprint_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is the one after it by descending doc_id, after the last
    one the first; nulls come last, rows of equal doc_id follow each other by
    text. A null text counts as empty, a single row is its own next one, an
    empty table gives no rows; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    id_field = docs.schema[doc_id]
    # the head and the tail of each partition carry their text, inner rows their result
    schema = T.StructType([id_field, *RESULT, T.StructField("part", T.IntegerType()),
                           T.StructField("kind", T.StringType()), T.StructField("body", T.StringType())])
    order = F.col(doc_id).desc_nulls_last()
    ranged = docs.select(doc_id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    ranged = ranged.repartitionByRange(_partitions(docs), order).sortWithinPartitions(order, "__text")

    def stream(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        arrow = to_arrow_schema(schema)
        part = TaskContext.get().partitionId()
        empty = (None,) * len(RESULT)

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        last = None
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                key, own = b.column(0)[i].as_py(), Prefixes(b.column(1)[i].as_py())
                if last is None:
                    rows.append((None, *empty, part, "head", own.text))
                else:
                    rows.append((last[0], *_compare(last[1], own), None, "inner", None))
                last = key, own
            if rows:
                yield batch(rows)
        if last:
            yield batch([(last[0], *empty, part, "tail", last[1].text)])

    parts = shared_table(ranged.mapInArrow(stream, schema), "neighbours")
    inner = parts.filter("kind = 'inner'").select(doc_id, *[f.name for f in RESULT])
    heads = parts.filter("kind = 'head'").select("part", F.col("body").alias("following"))
    # one row per partition: the next partition that has rows, after the last one the first
    by_part = Window.orderBy("part")
    after = heads.select("part").select(
        "part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(by_part)).alias("next_part"))
    tails = parts.filter("kind = 'tail'").select(doc_id, "part", "body").join(after, "part")
    tails = tails.join(heads.withColumnRenamed("part", "next_part"), "next_part")

    def pair(batches) -> Iterator:
        import pyarrow as pa

        arrow = to_arrow_schema(T.StructType([id_field, *RESULT]))
        for b in batches:
            for i in range(b.num_rows):
                key, own, following = (b.column(k)[i].as_py() for k in range(3))
                row = (key, *_compare(Prefixes(own), Prefixes(following)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

    return inner.unionByName(tails.select(doc_id, "body", "following").mapInArrow(
        pair, T.StructType([id_field, *RESULT])))


def _partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
