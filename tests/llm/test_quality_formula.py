from __future__ import annotations

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import quality_model

NAMES = quality_model.FEATURES


def slow_scores(x, y, z, to_pooled=0.5, to_diagonal=0.2):
    """The discriminant from the rows themselves, by inverse and determinant: learnt from x and y, for the rows of z."""
    d = x.shape[1]
    center, scale = x.mean(0), x.std(0)
    scale = np.where(scale == 0, 1.0, scale)
    x, z = (x - center) / scale, (z - center) / scale
    own = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum((y == k).sum() * own[k] for k in (0, 1)) / len(y)
    density = []
    for k in (0, 1):
        n = (y == k).sum()
        share = max(to_pooled, d / (n + d))
        c = (1 - share) * own[k] + share * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 0.01 * np.eye(d)
        away = z - x[y == k].mean(0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away)
        density.append(np.log(n) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * distance)
    return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / d, -30, 30)))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_scores_are_those_of_the_formula(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.statistics(docs).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    out = {r.doc_id: r.o for r in docs.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("o")).collect()}
    z = np.array([[r[f] for f in NAMES] for r in rows], dtype=float)
    use = [k for k, r in enumerate(rows) if quality.get(r.doc_id) in (0, 1) and not out[r.doc_id]]
    y = np.array([quality[rows[k].doc_id] for k in use])
    assert len(set(y)) == 2 and 0 < len(use) < len(rows)
    want = slow_scores(z[use], y, z)
    got = {r.doc_id: r for r in quality_model.judge(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(abs(got[r.doc_id].score - s) < 1e-9 for r, s in zip(rows, want, strict=True))
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == out[r.doc_id] for r in got.values())
