"""Pair engine, kNN and Wishart against brute force on small points."""

import math

import numpy as np
import pytest

from lexiclust.operators import pairs as pr
from lexiclust.operators import wishart as wi


def frame(spark, pts, labels=None):
    rows = [(i, [float(x) for x in p], int(labels[i]) if labels is not None else 0) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")


@pytest.fixture(scope="module")
def pts():
    rng = np.random.default_rng(3)
    a = np.vstack([rng.normal(c, 0.4, size=(25, 3)) for c in [(0, 0, 0), (4, 4, 0), (0, 5, 5)]])
    return np.vstack([a, a[:2]])  # exact duplicates


def brute(pts):
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    return d


def test_knn_matches_brute_force(spark, pts):
    k = 4
    got = pr.knn(frame(spark, pts), k, block_rows=16).toPandas()
    d = brute(pts)
    np.fill_diagonal(d, np.inf)
    ids = np.arange(len(pts))
    for i in range(len(pts)):
        order = np.lexsort((ids, d[i]))[:k]
        g = got[got.vec_id == i].sort_values("rank")
        assert list(g.nbr_id) == list(order)
        assert np.allclose(g.dist, d[i, order])


def test_label_pair_stats(spark, pts):
    labels = np.repeat([0, 1, 2], 26)[: len(pts)]
    got = pr.label_pair_stats(frame(spark, pts, labels), block_rows=10).toPandas()
    d = brute(pts)
    for _, r in got.iterrows():
        m = (labels[:, None] == r.label_i) & (labels[None, :] == r.label_j) & ~np.eye(len(pts), dtype=bool)
        assert r.n_pairs == m.sum()
        assert math.isclose(r.sum_dist, d[m].sum(), rel_tol=1e-9)
        assert math.isclose(r.max_dist, d[m].max(), rel_tol=1e-12)


def test_label_scan_rows(spark, pts):
    labels = np.repeat([0, 1, 2], 26)[: len(pts)]
    got = pr.scanned_rows(pr.label_scan(frame(spark, pts, labels), block_rows=12, step=7)).toPandas()
    d = brute(pts)
    assert sorted(got.vec_id) == list(range(len(pts)))
    for r in got.itertuples():
        i = int(r.vec_id)
        own = (labels == labels[i]) & (np.arange(len(pts)) != i)
        assert math.isclose(r.own_mean, d[i, own].mean(), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(r.near_mean, min(d[i, labels == x].mean() for x in set(labels) - {labels[i]}), rel_tol=1e-9)


def test_a_row_alone_and_a_single_label(spark):
    pts = np.array([[0.0, 0], [1, 0], [5, 0]])
    lone = pr.scanned_rows(pr.label_scan(frame(spark, pts, np.array([0, 0, 1])))).toPandas().set_index("vec_id")
    assert np.isnan(lone.own_mean[2]) and lone.near_mean[2] == 4.5
    one = pr.scanned_rows(pr.label_scan(frame(spark, pts, np.array([0, 0, 0])))).toPandas()
    assert one.near_mean.isna().all()


def test_own_label_sums(spark, pts):
    labels = np.repeat([0, 1, 2], 26)[: len(pts)]
    d = brute(pts)
    got = pr.own_label_sums(frame(spark, pts, labels), block_rows=6).toPandas()
    assert len(got) == len(pts)
    for r in got.itertuples():
        own = (labels == r.label) & (np.arange(len(pts)) != r.vec_id)
        assert r.n_own == own.sum() and math.isclose(r.sum_dist, d[int(r.vec_id), own].sum(), rel_tol=1e-9)
        assert math.isclose(r.max_dist, d[int(r.vec_id), own].max(), rel_tol=1e-9)


# Labels derived by hand from the rule: points are visited by the distance to
# their k-th neighbour (ties by id); a point without labelled neighbours founds a
# cluster, one with a single open cluster among them joins it.
LINE = np.array([[x, 0.0] for x in (0, 1, 2, 4, 6, 7, 8)])


def labels_of(spark, points, k, h, fit=wi.wishart):
    got = fit(frame(spark, points), k, h, block_rows=16).toPandas().sort_values("vec_id")
    return got["label"].tolist()


def test_two_groups_far_apart(spark):
    pts = np.array([[0, 0], [1, 0], [2, 0], [10, 0], [11, 0], [12, 0]])
    for h in (0.01, 100.0):  # no point sees two clusters: the height plays no part
        assert labels_of(spark, pts, 2, h) == [1, 1, 1, 2, 2, 2]


def test_bridge_merges_when_one_cluster_is_significant(spark):
    # 1 and 7 found clusters; 0, 2 and the bridge 4 join the first; 6 sees both: the first has
    # (1 - 1/4) * 2 / 7 / pi = 0.068, the second 0, so at 0.05 the second joins the first
    assert labels_of(spark, LINE, 2, 0.05) == [1] * 7


def test_bridge_becomes_noise_when_both_are_significant(spark):
    # below zero both count as significant: 6 is noise and closes them, and 8, which sees the noise
    # and the closed second cluster, is noise too
    assert labels_of(spark, LINE, 2, -1.0) == [1, 1, 1, 1, 0, 2, 0]


def test_far_point_keeps_to_its_neighbours(spark):
    # the outlier is visited last and joins the only cluster it sees
    pts = np.array([[0, 0], [1, 0], [2, 0], [50, 0]])
    assert labels_of(spark, pts, 2, 1.0) == [1, 1, 1, 1]


def test_connected_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (5, 5), (7, 3)], "src long, dst long")
    comp = {r["id"]: r["comp"] for r in wi.connected_components(edges).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 7: 1, 10: 10, 11: 10, 5: 5}


def test_scanned_pairs_equal_the_cells(spark, pts):
    labels = np.repeat([0, 1, 2], 26)[: len(pts)]
    f = frame(spark, pts, labels)
    a = pr.label_pair_stats(f, block_rows=10).toPandas().sort_values(["label_i", "label_j"]).reset_index(drop=True)
    b = pr.scanned_pairs(pr.label_scan(f, block_rows=12, step=5)).toPandas() \
        .sort_values(["label_i", "label_j"]).reset_index(drop=True)
    assert (a.n_pairs.to_numpy() == b.n_pairs.to_numpy()).all()
    for c in ("sum_dist", "max_dist", "min_nz_dist"):
        assert np.allclose(a[c].to_numpy(), b[c].to_numpy(), rtol=1e-12, atol=0)
