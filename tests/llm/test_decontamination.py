"""Benchmark decontamination against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tessera.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LONG = " ".join(f"w{i}" for i in range(40))
ITEMS = [(1, "One two THREE four, five six seven eight nine ten eleven"), (2, "short Item"), (3, "x"), (4, ""), (5, None),
         (6, "  ...  "), (1, "another text of the same item that has more than ten words in all"), (None, LONG),
         (10, "a a a a a a a a a a a a a"), (7, "Ä ß, 日本語 ſ K"), (8, "one two three four five six seven eight nine ten x")]
TEXTS = ["", None, "one TWO three-four_five six seven eight nine ten eleven twelve", "x", "X y", "a short item here, short  item",
         "a " * 9, "a " * 10, "b " + "a " * 25 + "b", "ä ß 日本語 ſ k", "Ä ß 日本語 ſ k", "two three four five six seven eight nine ten",
         "0 " + LONG.upper() + " 1 " + LONG[:20], "short item " * 3000, "1 2 3 one two three four five six seven eight nine ten x"]


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(rows, items, size=10):
    windows = {}
    for i, text in items:
        w = split(text)
        for k in range(max(len(w) - size + 1, 1) if w else 0):
            windows.setdefault(tuple(w[k:k + size]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, hit, held = split(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    held |= windows[tuple(w[k:k + n])]
        ids = sorted(str(x) for x in held if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS * 2, "item_id long, text string").withColumn("wid", F.lit("clash"))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [*enumerate(TEXTS), *enumerate(TEXTS), (None, TEXTS[2]), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("k1", F.lit("clash")) \
                .withColumn("pos", F.lit(1)).withColumn("w", F.lit(None).cast("string"))


@pytest.mark.parametrize("width", [1, 2, 3])
def test_edge_rows(texts, items, width):
    want = slow([(r.doc_id, r.text) for r in texts.collect()], ITEMS)
    got = D.judge(texts, items, width=width).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_without_broadcast(texts, items, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert Counter(map(tuple, D.judge(texts, items).collect())) == Counter(
        slow([(r.doc_id, r.text) for r in texts.collect()], ITEMS))


def test_tables(spark, small, docs):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = [(r.item_id, r.text) for r in bench.collect()]
    for d in (small, docs):
        got = D.judge(d, bench).collect()
        assert Counter(map(tuple, got)) == Counter(slow([(r.doc_id, r.text) for r in d.collect()], want))
    assert any(r.contaminated for r in D.judge(small, bench).collect())


def test_empty_tables(texts, items, no_docs):
    none = D.judge(texts, items.limit(0)).collect()
    assert len(none) == texts.count() and not any(r.contaminated or r.n_hit or r.n_items for r in none)
    assert D.judge(no_docs, items).count() == 0


def test_spans_and_clean_rows(spark, texts, items):
    marked = {r.doc_id: (r.start, r.end) for r in D.hit_spans(texts, items).collect()}
    assert marked[2] == (0, 11) and marked[8] == (1, 26) and marked[13] == (0, 6000) and 6 not in marked
    kept = D.clean(texts, items)
    assert kept.columns == texts.columns
    bad = {r[0] for r in slow(enumerate(TEXTS), ITEMS) if r[5]}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        [i for i in range(len(TEXTS)) if i not in bad] * 2 + [None])
