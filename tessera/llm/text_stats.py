"""Statistics of a text as JVM-side expressions over the text and its words."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.llm.common import let, words

SYMBOLS = "#*$%&|<>"


def count_of(text: Column, chars: str) -> Column:
    """How many code points of a non-null text are among ``chars`` (ASCII)."""
    among = "[" + "".join(c if c.isalnum() else "\\" + c for c in chars) + "]+"
    return F.length(text) - F.length(F.regexp_replace(text, among, ""))


def word_chars(w: Column) -> Column:
    """Code points in the words ``w``."""
    return F.length(F.array_join(w, ""))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(full, lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeated_words(w: Column, width: int = 8) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the
    text, the first occurrence included.

    Hashes that are all different prove that no window repeats, which settles
    most texts; otherwise the windows themselves are sorted and compared.
    """
    def exact() -> Column:
        keyed = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)),
                            lambda i: F.struct(F.array_join(F.slice(w, i, width), " ").alias("x"), i.alias("i")))

        def covered(s: Column) -> Column:
            again = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False))
                             | F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False)))
            starts = F.sort_array(F.transform(again, lambda e: e["i"]))
            # a window adds the words that the one before it does not reach
            zero = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(starts, zero, lambda a, i: F.struct(
                i.alias("last"), (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n")), lambda a: a["n"])

        return let(F.sort_array(keyed), covered)

    def screened(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - width),
                              lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(exact()))

    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < width, 0).otherwise(let(hashed, screened))


def base_stats(text: Column) -> Column:
    """One struct of the base statistics; null counts as empty."""
    def stats(t: Column) -> Column:
        return let(words(t), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars(w).cast("long").alias("word_chars"),
            count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            repeated_lines(t).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words")))

    return let(F.coalesce(text.cast("string"), F.lit("")), stats)


def more_stats(text: Column) -> Column:
    """One struct of further statistics; null counts as empty."""
    def stats(t: Column) -> Column:
        return F.struct(
            count_of(t, string.ascii_uppercase).cast("long").alias("n_upper"),
            count_of(t, string.digits).cast("long").alias("n_digits"),
            count_of(t, "!").cast("long").alias("n_shouts"),
            count_of(t, ".,;:?").cast("long").alias("n_points"),
            (count_of(t, "\n") + 1).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words(t))).cast("long").alias("n_distinct"))

    return let(F.coalesce(text.cast("string"), F.lit("")), stats)
