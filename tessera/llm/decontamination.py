"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its stretches of ``size`` consecutive words; an item of fewer words is one window. A document
word inside any occurrence of a window is hit. Windows and documents are sets of word shingles (of three words; of all
words of a shorter window), and a window occurs where a document has all its shingles at their places.

1. Every shingle of a document that some window has is a match, with its position.
2. Shingles are ordered by rarity, counted over all documents. All of a window's shingles are needed, so a prefix of one
   is necessary: its rarest shingle. A window with a shingle that no document has is out.
3. Matches meet the prefixes; the shingle's place in the window and the document's length bound where it can start.
4. A candidate is verified by all its other shingles, which have to be matches at their places.

Shingles are joined as words, not as hashes, so the verification is exact. Documents of equal text are worked on once
from the first step on (their key is two 64-bit hashes of the text). The benchmark's shingles are broadcast if they
are small, which is measured; else Spark joins them by a shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_table

SIZE = 10
WIDTH = 3
# What separates words: all of ASCII but digits and letters; capitals are lowered before.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The benchmark's shingles are broadcast up to so many bytes.
BROADCAST = 32 << 20
KEY = ["k1", "k2"]
ALL = 1 << 30


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BREAKS), "")


def text_key(text: Column) -> list[Column]:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), whole).alias("k1"), F.xxhash64(F.lit(2), whole).alias("k2")]


def shingles(w: str, width: int = WIDTH) -> Column:
    """The shingles of the words in column ``w`` as structs; the last ones are filled up with nulls."""
    return F.arrays_zip(*[(F.slice(w, i + 1, ALL) if i else F.col(w)).alias(f"w{i}") for i in range(width)])


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``item``, ``window`` (an array of words) of every item that has words; equal windows of an item once."""
    w = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("window")) \
            .distinct()


def _numbered(df: DataFrame, name: str, id_name: str) -> DataFrame:
    """``df`` with a number per row, written once, so that the numbers stay."""
    return shared_table(df.withColumn(id_name, F.monotonically_increasing_id()), name)


class Benchmark:
    """The windows of the items, their shingles, and which items hold them."""

    def __init__(self, items: DataFrame, item_id: str, text: str, size: int, width: int):
        self.width = width
        held = shared_table(item_windows(items, item_id, text, size), "item_windows")
        windows = _numbered(held.select("window").distinct(), "windows", "wid")
        self.items = held.join(windows, "window").select("wid", F.col("item").cast("string").alias("item")) \
                         .filter("item IS NOT NULL")
        parts = windows.select("wid", F.size("window").alias("length"), "window",
                               F.least(F.size("window"), F.lit(width)).alias("width"))
        parts = parts.select("wid", "length", "width", F.posexplode(shingles("window", width)).alias("offset", "s"))
        parts = parts.filter(F.col("offset") <= F.col("length") - F.col("width"))
        names = [f"w{i}" for i in range(width)]
        # words beyond the width of a short window's shingle are null already
        parts = parts.select("wid", "length", "width", "offset", *[F.col(f"s.{c}").alias(c) for c in names])
        self.shingles = _numbered(parts.select("width", *names).distinct(), "shingles", "sid")
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in ("width", *names)]
        joined = parts.alias("p")
        on = same[0]
        for c in same[1:]:
            on = on & c
        self.parts = shared_table(joined.join(self.shingles.alias("q"), on).select(
            "p.wid", "p.length", "p.offset", "q.sid"), "window_shingles")
        size_of = F.sum(F.lit(64) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in names), F.lit(0)))
        row = self.shingles.agg(F.array_sort(F.collect_set("width")), size_of).first()
        self.widths, self.bytes = row[0], row[1] or 0


def matches(docs: DataFrame, bench: Benchmark, text: str = "text") -> DataFrame:
    """``k1, k2, n, pos, sid``: every shingle of the distinct texts that some window has; ``n`` is the text's length."""
    names = [f"w{i}" for i in range(bench.width)]
    rows = docs.select(*text_key(F.col(text)), words(F.col(text)).alias("w"))
    rows = rows.select(*KEY, F.size("w").alias("n"), F.posexplode(shingles("w", bench.width)).alias("pos", "s"))
    rows = rows.select(*KEY, "n", "pos", *[F.col(f"s.{c}").alias(c) for c in names])
    found = None
    for v in bench.widths:
        own = bench.shingles.filter(F.col("width") == v).select("sid", *names[:v])
        own = F.broadcast(own) if bench.bytes <= BROADCAST else own
        hit = rows.filter(F.col(names[v - 1]).isNotNull()).join(own, names[:v]).select(*KEY, "n", "pos", "sid")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return rows.select(*KEY, "n", "pos", F.lit(0).cast("bigint").alias("sid")).limit(0)
    return found.distinct()


def occurrences(docs: DataFrame, bench: Benchmark, text: str = "text") -> DataFrame:
    """``k1, k2, wid, start, length``: every place at which a window occurs in the distinct texts."""
    found = shared_table(matches(docs, bench, text), "matches")
    rarity = found.groupBy("sid").agg(F.count(F.lit(1)).alias("count"))
    counted = bench.parts.join(rarity, "sid", "left")
    # a window's prefix: its rarest shingle; a shingle without matches leaves no place for the window
    prefix = counted.groupBy("wid", "length").agg(
        F.count(F.lit(1)).alias("shingles"), F.count("count").alias("seen"),
        F.min(F.struct("count", "offset", "sid")).alias("p")).filter("shingles = seen")
    prefix = shared_table(prefix.select("wid", "length", "shingles", F.col("p.offset").alias("at"),
                                        F.col("p.sid").alias("sid")), "prefixes")
    places = found.join(prefix, "sid").withColumn("start", F.col("pos") - F.col("at"))
    places = shared_table(places.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
                          .select(*KEY, "wid", "start", "length", "shingles", "at"), "candidates")
    one = places.filter("shingles = 1").select(*KEY, "wid", "start", "length")
    needed = places.filter("shingles > 1").join(bench.parts.drop("length"), "wid").filter("offset <> at") \
                   .withColumn("pos", F.col("start") + F.col("offset"))
    whole = needed.join(found.drop("n"), [*KEY, "pos", "sid"]).groupBy(
        *KEY, "wid", "start", "length", "shingles").agg(F.count(F.lit(1)).alias("there"))
    return one.unionByName(whole.filter("there = shingles - 1").select(*KEY, "wid", "start", "length"))


def _per_text(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, text: str, size: int,
              width: int) -> tuple[Benchmark, DataFrame]:
    bench = Benchmark(items, item_id, item_text, size, width)
    return bench, shared_table(occurrences(docs, bench, text), "occurrences")


def judge(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (hit words), n_items (items with a window that occurs), items_sha256
    (of their ids, sorted as texts, comma-joined), contaminated.

    A null or empty text has no words and no hit; an item without words has no window; rows of one item_id are one
    item, rows without one mark words and are not counted among the items; repeated rows are all returned; without
    items nothing is hit; an empty table gives no rows. Other columns are not read.
    """
    bench, found = _per_text(docs, items, item_id, item_text, text, size, width)
    hit = found.select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")) \
               .distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    held = found.select(*KEY, "wid").distinct().join(bench.items, "wid").select(*KEY, "item").distinct()
    held = held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list("item")).alias("ids"))
    result = shared_table(hit.join(held.select(*KEY, "n_items", F.sha2(F.array_join("ids", ","), 256).alias("sha")),
                                   KEY, "left"), "contamination")
    rows = docs.select(F.col(doc_id), F.size(words(F.col(text))).cast("long").alias("n_words"), *text_key(F.col(text)))
    zero = F.lit(0).cast("long")
    return rows.join(result, KEY, "left").select(
        doc_id, "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def hit_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """The widest stretches of hit words: doc_id, start, end (word numbers, end exclusive), for every row that has any."""
    _, found = _per_text(docs, items, item_id, item_text, text, size, width)
    ends = found.select(*KEY, "start", (F.col("start") + F.col("length")).alias("end")).groupBy(*KEY, "start").agg(
        F.max("end").alias("end"))
    by_start = Window.partitionBy(*KEY).orderBy("start")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(before < F.col("start"), F.lit(True)).cast("int")
    spans = ends.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(by_start))
    spans = shared_table(spans.groupBy(*KEY, "span").agg(F.min("start").alias("start"), F.max("end").alias("end")),
                         "hit_spans")
    return docs.select(F.col(doc_id), *text_key(F.col(text))).join(spans, KEY).select(doc_id, "start", "end")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without a hit word, columns unchanged."""
    _, found = _per_text(docs, items, item_id, item_text, text, size, width)
    k1, k2 = text_key(F.col(text))
    keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2"))
    hit = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    return keyed.join(hit, ["__k1", "__k2"], "left_anti").select(*docs.columns)
