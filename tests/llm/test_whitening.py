"""Whitening against numpy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import whitening as W


def slow(vectors, most=8):
    """n, exact deviations, whitened values, shares."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    z = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    dev = [sum(c * c for c in v) for v in z]
    y = np.array(z, dtype=float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, dev, y @ u / np.sqrt(e), e / np.trace(v)


def check(rows, vectors, ids, most=8):
    n, dev, want, share = slow(vectors, most)
    k = want.shape[1]
    assert len(rows) == n * k
    assert {r.n for r in rows} == {n}
    errors = {r.identity_error for r in rows}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert Counter((r.vec_id, r.deviation) for r in rows if r.component == 1) == Counter(zip(ids, dev, strict=True))
    for c in range(k):
        own = [(str(r.vec_id), r.deviation, r.whitened) for r in rows if r.component == c + 1]
        other = [(str(i), d, v) for i, d, v in zip(ids, dev, want[:, c].tolist(), strict=True)]
        a, b = (np.array([v for *_, v in sorted(x, key=lambda t: t[:2])]) for x in (own, other))
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8
        assert all(math.isclose(r.explained, share[c], rel_tol=1e-9) for r in rows if r.component == c + 1)


def test_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    raw = d.collect()
    check(W.whiten(d.repartition(3)).collect(), [r.embedding for r in raw], [r.vec_id for r in raw])


def test_many_blocks_slabs_and_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_BYTES", 7 * 8 * 64)
    monkeypatch.setattr(W, "SLAB", 30)
    monkeypatch.setattr(W, "COLUMNS", 24)
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    raw = d.collect()
    check(W.whiten(d.repartition(3)).collect(), [r.embedding for r in raw], [r.vec_id for r in raw])


GOOD = [(1, [0.5, -1.25, 3.0]), (1, [0.5, -1.25, 3.0]), (2, [1e3, 0.1, 0.2]), (None, [0.0, 0.0, -0.0]), (4, [7.5, 2.0, 1e-9]),
        (5, [-0.0001, 4.0, 4.0])]
BAD = [(6, None), (7, [1.0, None, 2.0]), (8, [float("nan"), 0.0, 0.0]), (9, [float("inf"), 0.0, 0.0]),
       (10, [0.0, 0.0, float("-inf")]), (11, [])]


def test_edge_rows(spark):
    d = spark.createDataFrame(GOOD + BAD, "vec_id long, embedding array<double>").repartition(4)
    for c in ("n", "p", "x", "block", "deviation", "ids"):
        d = d.withColumn(c, F.lit("clash"))
    check(W.whiten(d).collect(), [v for _, v in GOOD], [i for i, _ in GOOD])
    assert W.whiten(d.limit(0)).count() == 0
    assert W.whiten(d.filter("vec_id > 5")).count() == 0


def test_components_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    rows = W.whiten(spark.createDataFrame([(k, [float(k), 2.0, -1.0]) for k in range(4)], schema)).collect()
    assert [r.whitened is None for r in sorted(rows, key=lambda r: r.component)] == [False] * 4 + [True] * 8
    assert all(r.identity_error < 1e-9 for r in rows) and {r.explained for r in rows if r.component == 1} == {1.0}
    one = W.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [
        (1, 0, None, None, None), (2, 0, None, None, None)]


def test_most_frequent_dimension(spark):
    d = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [2.0, 5.0]), (4, [3.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id for r in W.whiten(d).collect()} == {2, 3}


def test_deviations_stay_exact():
    whole = np.array([[1 << 40, 3], [5, 1 << 52]])
    y, own = W.centred(whole, 10, np.array([7, 1 << 53], dtype=object))
    z = [[10 * int(c) - s for c, s in zip(v, (7, 1 << 53), strict=True)] for v in whole]
    assert own == [v if v < 1 << 63 else None for v in (sum(c * c for c in r) for r in z)]
    assert np.allclose(y, np.array(z, dtype=float) / 10)


@pytest.mark.parametrize(("n", "d"), [(10, 64), (10 ** 12, 64), (100, 100_000)])
def test_blocks_stay_bounded(n, d):
    rows = W._rows_per_block(n, d)
    assert rows == 1 or W.BLOCK_BYTES // 2 <= rows * d * 8 <= W.MOST_BYTES
