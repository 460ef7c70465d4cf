"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import periodic_runs as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow_runs(w):
    """Every lag is compared word by word; a stretch that a smaller lag covers has that period."""
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = (g % n), 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in
           ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, n, len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), *sha)


def test_small_table(spark, small):
    rows = [(r.doc_id, r.text) for r in small.collect() if r.text is None or len(r.text) < 4000]
    d = small.filter("text IS NULL OR length(text) < 4000").repartition(3)
    got = R.digest(d).collect()
    assert Counter(map(tuple, got)) == Counter(slow_row(*r) for r in rows)
    assert any(r.n_runs for r in got)


def test_edge_rows(docs, no_docs):
    short = docs.filter("text IS NULL OR length(text) < 4000")
    assert Counter(map(tuple, R.digest(short).collect())) == Counter(slow_row(r.doc_id, r.text) for r in short.collect())
    # the two long rows repeat 701 words, one of them with a further word
    long = {r.doc_id: r for r in R.digest(docs, planted=False).collect() if r.doc_id in (5, 6)}
    assert [(r.start, r.length, r.period, r.n_runs) for r in long.values()] == [(0, 30_000, 701, 1)] * 2
    assert R.digest(no_docs).count() == 0


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 2 ** 32), st.integers(1, 3))
def test_runs_of_any_words(seed, kinds):
    rng = random.Random(seed)
    w: list[int] = []
    while len(w) < rng.randrange(20, 260):
        part = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 17, 25, 33, 40]))]
        if rng.random() < 0.4:  # periods that hold repetitions themselves
            part = part[:3] * rng.randrange(1, 9) + part
        w += part * rng.randrange(1, 5) + part[:rng.randrange(len(part))]
    assert R.find_runs(np.array(w, dtype=np.int64)) == slow_runs(w)


@pytest.mark.parametrize("period", [15, 16, 23, 24, 35, 36, 100, 333])
def test_long_runs_at_the_scales_edges(period):
    rng = random.Random(period)
    unit = [rng.randrange(4) for _ in range(period - 1)] + [9]
    w = [5] + unit * 3 + [7] + (unit * 4)[:4 * period - 1]
    want = [(1, 3 * period, period), (3 * period + 2, 4 * period - 1, period)]
    assert [r for r in R.find_runs(np.array(w)) if r[2] == period] == [r for r in want if r[1] >= 24]


def test_million_words():
    rng = random.Random(1)
    unit = [rng.randrange(500) for _ in range(70_001)]
    w = np.array([501] + unit * 4 + list(range(502, 400_000)) + [1, 2] * 200_000)
    assert R.find_runs(w) == [(0 + 1, 280_004, 70_001), (len(w) - 400_000, 400_000, 2)]


def test_pieces_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(R, "PIECE", 7)
    text = "  añb\tlonger-than-a-piece x \x1f\n\n y zz" * 3
    words, names = R.numbered(text)
    assert [names[i].decode() for i in words] == WORD.findall(text)


def test_collapse(spark):
    unit = [f"w{i}" for i in range(20)]
    d = spark.createDataFrame([(1, "a  b\n" + " ".join(unit * 5) + " end"), (2, "keeps  its\nspaces"), (3, None)],
                              "doc_id long, text string")
    got = {r.doc_id: r.text for r in R.collapse(d).collect()}
    assert got == {1: "a b " + " ".join(unit) + " end", 2: "keeps  its\nspaces", 3: None}
