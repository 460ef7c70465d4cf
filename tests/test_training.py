"""What training learns: scaler, components, centres; homepage sections as rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import features as FE
from tessera.operators import recommend as R
from tessera.operators import segmentation as SG

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def trained(t01):
    feats = FE.model_features(t01.customers, t01.transactions, t01.accounts, t01.user_activities, AS_OF)
    feats = feats.checkpoint(eager=True)
    pm, model, silhouette = SG.train_segments(feats, 4, 3, 7)
    x = np.array([[float(r[f]) for f in FE.FEATURE_ORDER] for r in feats.orderBy("customer_id").collect()])
    clusters = [r.cluster for r in pm.transform(feats).orderBy("customer_id").select("cluster").collect()]
    return x, np.array(clusters), pm, model, silhouette


def test_components_are_orthonormal_with_falling_variance(trained):
    x, _, pm, model, _ = trained
    std = np.where(np.array(model.std) > 0, np.array(model.std), np.inf)
    z = (x - np.array(model.mean)) / std
    w = np.array(model.components)
    assert np.allclose(w.T @ w, np.eye(3), atol=1e-9)
    var = (z @ w).var(axis=0, ddof=1)
    assert var[0] >= var[1] >= var[2] > 0
    # no other direction has more variance: they are the first ones of the covariance of the scaled features
    e, u = np.linalg.eigh(np.cov(z.T))
    assert np.allclose(var, e[::-1][:3], rtol=1e-8)
    assert np.allclose(np.abs(np.sum(w * u[:, ::-1][:, :3], axis=0)), 1, atol=1e-6)
    assert np.allclose(pm.stages[2].explainedVariance.toArray(), e[::-1][:3] / e.sum(), rtol=1e-8)


def test_centres_are_the_means_of_their_members(trained):
    x, clusters, _, model, silhouette = trained
    std = np.where(np.array(model.std) > 0, np.array(model.std), np.inf)
    p = (x - np.array(model.mean)) / std @ np.array(model.components)
    centres = np.array(model.centers)
    assert set(clusters) == {0, 1, 2, 3}
    # the fit ends when no centre moves by more than its tolerance, or at its last round
    means = np.array([p[clusters == c].mean(axis=0) for c in range(4)])
    assert np.abs(means - centres).max() < 0.05
    nearest = ((p[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == clusters).all()
    # any two centres swapped, or all moved, fit worse
    cost = ((p - centres[clusters]) ** 2).sum()
    assert cost <= ((p - p.mean(axis=0)) ** 2).sum() and -1 <= silhouette <= 1
    assert cost <= ((p - (means + 0.2)[clusters]) ** 2).sum()


def test_clusters_are_named_by_their_members(trained):
    x, clusters, _, model, _ = trained
    col = {f: i for i, f in enumerate(FE.FEATURE_ORDER)}
    mean = lambda f, c: x[clusters == c][:, col[f]].mean()
    free = set(range(4))
    for name, score in (("investor", lambda c: mean("investment_activity", c)), ("bill_payer", lambda c: mean("payment_ratio", c)),
                        ("digital_spender", lambda c: mean("topup_ratio", c) + mean("qris_ratio", c))):
        held = model.names.index(name)
        assert score(held) >= max(map(score, free)) - 1e-12
        free.discard(held)
    assert [model.names[c] for c in free] == ["low_activity"]


def test_sections_and_listed_features(spark, t001):
    recs = t001.recommendations
    more = recs.select((F.col("id") + 100).alias("id"), "segment_id", "feature", "reason", F.lit(1).alias("priority"))
    many = recs.unionByName(more.select(*recs.columns))
    args = (t001.customers, t001.user_segment_history, t001.segments, many)
    rows = R.personalization_sections(*args).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.position):
        by.setdefault(r.customer_id, []).append(r)
    assert all([r.position for r in v] == list(range(1, len(v) + 1)) for v in by.values())
    assert all([(r.priority, r.rec_id) for r in v] == sorted((r.priority, r.rec_id) for r in v) for v in by.values())
    whole = {r.customer_id: r for r in R.personalization(*args, t001.user_activities).collect()}
    for c, v in by.items():
        assert whole[c].recommended_features == ",".join(r.feature for r in v) and whole[c].recommended_count == len(v)
    for listed in (0, 1, 2):
        part = {r.customer_id: r for r in R.personalization(*args, t001.user_activities, listed=listed).collect()}
        assert part.keys() == whole.keys()
        for c, r in part.items():
            assert (r.primary_feature, r.recommended_count) == (whole[c].primary_feature, whole[c].recommended_count)
            assert r.recommended_features == ",".join(x.feature for x in by.get(c, [])[:listed])
