"""Periodic runs in the words of a text, found from multi-scale minimizers.

A run is a maximal stretch of words with smallest period ``q`` (words ``q`` apart are
identical) and a length of at least ``max(24, 3 q)``.

* Words become numbers; ranks of all spans of 2, 4, 8, .. words come from doubling, so equality of any two spans is
  exact and takes constant time. Without a repeated span of 16 words there is no run. A run of period q keeps at least
  2 q - 15 neighbouring starts of repeated spans, which bounds the periods that a text can have.
* Periods up to 15: the words are compared with themselves at every such lag.
* Longer periods fall into scales ``[P, 1.5 P)``. In a scale the spans have at least q words, so inside a run equal spans
  are a multiple of q apart, and a window of minimizers fits into the run's first period: the minimum of that window
  and of the one q further are equal spans, and no equal one lies between them. Neighbouring equal minimizers at a
  distance of the scale are therefore seeds of every run; their number is linear. Each seed is extended to both sides
  word by word, which verifies it.
* A stretch whose period is a multiple of a shorter one is dropped; the shorter period finds it.

A text is worked on in one task, from its numbers; its words are kept once each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import map_batches

SPAN = 16  # a run has a repeated span of so many words: max(24 - q, 2 q) >= 16
LEAST, TIMES = 24, 3
PIECE = 1 << 20  # bytes split into words at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_MIX = 0x9E3779B97F4A7C15  # odd, so that the product is one-to-one


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time."""
    data = text.encode()
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        # bytes.split() knows ASCII white space only: space and 9 to 13
        yield data[at:end].split()
        at = end


def numbered(text: str) -> tuple:
    """The words of a text as numbers, and the different words."""
    import numpy as np

    seen: dict[bytes, int] = {}
    number = seen.setdefault
    parts = [np.array([number(w, len(seen)) for w in piece], dtype=np.int64) for piece in pieces(text)]
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)), list(seen)


class Ranks:
    """Equal spans of 1, 2, 4, .. words have equal ranks."""

    def __init__(self, words):
        self.levels = [words]

    def level(self, k: int):
        import numpy as np

        while len(self.levels) <= k:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = below[:-half] << 32 | below[half:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
        return self.levels[k]

    def spans(self, length: int):
        """A number for every span of ``length`` words, the same for equal ones only."""
        k = length.bit_length() - 1
        ranks, last = self.level(k), length - (1 << k)
        return ranks[:len(ranks) - last] << 32 | ranks[last:]


def _slide(values, width: int, take):
    """``take`` (minimum or maximum) of every window of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = take(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return take(values[:-rest], values[rest:]) if rest else values


def minimizers(spans, width: int):
    """Positions of the spans that are the least of some window of ``width`` spans, by mixed numbers."""
    import numpy as np

    mixed = spans.astype(np.uint64) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    least = _slide(mixed, width, np.minimum)
    # the greatest minimum of the windows that hold a span is the span itself, or the span is no minimum
    pad = np.zeros(width - 1, dtype=np.uint64)
    return np.flatnonzero(_slide(np.concatenate([pad, least, pad]), width, np.maximum) == mixed)


def _extent(words, at: int, lag: int) -> tuple[int, int]:
    """The widest ``[i, j)`` around ``at`` in which words equal those ``lag`` further; empty if none."""
    import numpy as np

    end = step = at
    width = 64
    while step < len(words) - lag:
        stop = min(step + width, len(words) - lag)
        other = np.flatnonzero(words[step:stop] != words[step + lag:stop + lag])
        if len(other):
            end = step + int(other[0])
            break
        end = step = stop
        width *= 2
    begin, step, width = at, at, 64
    while step > 0:
        stop = max(step - width, 0)
        other = np.flatnonzero(words[stop:step] != words[stop + lag:step + lag])
        if len(other):
            begin = stop + int(other[-1]) + 1
            break
        begin = step = stop
        width *= 2
    return begin, end


def _primitive(words, start: int, period: int) -> bool:
    """Whether the period's words are not a shorter stretch several times."""
    import numpy as np

    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            while rest % p == 0:
                rest //= p
            part = period // p
            if np.array_equal(words[start:start + period - part], words[start + part:start + period]):
                return False
        p += 1
    return True


def _longest_stretch(flags) -> int:
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def find_runs(words) -> list[tuple[int, int, int]]:
    """Every run of the numbers ``words`` as (start, length, period), by start, then period."""
    import numpy as np

    n = len(words)
    if n < LEAST:
        return []
    ranks = Ranks(words)
    for k in range(1, SPAN.bit_length()):
        level = ranks.level(k)
        if int(level.max()) + 1 == len(level):
            return []
    again = np.bincount(level)[level] > 1
    # a run of period q starts more than 2 q - SPAN spans that occur again, and its last third ends as many
    most = min((_longest_stretch(again) + SPAN - 1) // 2, n // TIMES)
    found: set[tuple[int, int, int]] = set()
    for q in range(1, min(SPAN - 1, most) + 1):
        same = np.concatenate([[0], (words[:-q] == words[q:]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if j - i + q >= max(LEAST, TIMES * q) and _primitive(words, i, q):
                found.add((i, j - i + q, q))
    low = SPAN
    while low <= most:
        high = low + low // 2  # periods low .. high - 1, spans of high - 1 words, windows of 2 low - high + 2 spans
        spans = ranks.spans(high - 1)
        at = minimizers(spans, 2 * low - high + 2)
        at = at[np.lexsort((at, spans[at]))]
        lags = np.diff(at)
        seed = (spans[at[:-1]] == spans[at[1:]]) & (lags >= low) & (lags < high)
        starts, lags = at[:-1][seed], lags[seed]
        order = np.lexsort((starts, lags))
        done = (0, 0)  # lag, and the end of its last extent
        for m, q in zip(starts[order].tolist(), lags[order].tolist(), strict=True):
            if q == done[0] and m < done[1]:
                continue
            i, j = _extent(words, m, q)
            done = q, j
            if j - i >= (TIMES - 1) * q and _primitive(words, i, q):
                found.add((i, j - i + q, q))
        low = high
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]):
    """Which of ``n`` words stay: all but those that a run holds after its first period."""
    import numpy as np

    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) == 0


def repeated_tail(doc_id, words):
    """The planted repetition: in a tenth of the documents, told by the checksum of doc_id, the words from some place on
    are a stretch of them again and again. A null doc_id has none."""
    import numpy as np

    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def joined_sha256(words, names: list[bytes], block: int = 1 << 16) -> str:
    """SHA-256 of the words of these numbers, joined by one space."""
    out = hashlib.sha256()
    for k in range(0, len(words), block):
        out.update((b" " if k else b"") + b" ".join([names[i] for i in words[k:k + block].tolist()]))
    return out.hexdigest()


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_runs", T.LongType()),
          T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
          T.StructField("period", T.LongType()), T.StructField("exponent_milli", T.LongType()),
          T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", planted: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_runs, the strongest run (start, length, period, exponent_milli; nulls if there is
    none), the SHA-256 of the list of all runs and of the words that collapsing leaves.

    ``planted`` first repeats a stretch in a tenth of the documents (:func:`repeated_tail`). A null or empty text has no
    words; a null doc_id stays null; repeated rows are all returned; an empty table gives no rows; other columns are not
    read.
    """
    def rows(key, body):
        words, names = numbered(body or "")
        if planted:
            words = repeated_tail(key, words)
        runs = find_runs(words)
        best = strongest(runs)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        yield (key, len(words), len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(),
               joined_sha256(words[kept_words(len(words), runs)] if runs else words, names))

    schema = T.StructType([docs.schema[doc_id], *RESULT])
    return map_batches(docs.select(doc_id, F.col(text).cast("string").alias("__text")), rows, schema)


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every run cut to its first period: the words that stay, joined by one space, in texts that have a
    run; all other texts are unchanged (null too)."""
    docs = docs.withColumn(text, F.col(text).cast("string"))
    place = docs.columns.index(text)

    def rows(*values):
        words, names = numbered(values[place] or "")
        runs = find_runs(words)
        if runs:
            stay = words[kept_words(len(words), runs)].tolist()
            body = b" ".join([names[i] for i in stay]).decode()
            values = (*values[:place], body, *values[place + 1:])
        yield values

    return map_batches(docs, rows, docs.schema)
