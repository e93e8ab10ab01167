"""Pruned extremes and centroid scans against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import extremes, metric
from lexiclust.operators import similarity as sm
from lexiclust.operators import validity as va
from lexiclust.operators import vectors as vv


def frame(spark, pts, labels):
    return spark.createDataFrame([(i, [float(x) for x in p], int(a)) for i, (p, a) in enumerate(zip(pts, labels))],
                                 "vec_id long, embedding array<double>, label long")


def distances(pts):
    return np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(c, 0.5, size=(60, 2)) for c in [(0, 0), (5, 5), (0, 9)]] + [np.zeros((40, 2)), [[3.0, 3.0]]])
    labels = np.array([0] * 60 + [1] * 60 + [2] * 60 + [0] * 40 + [7])
    return pts, labels


def test_diameters(spark, data):
    pts, labels = data
    got = {r.label: r.diameter for r in extremes.diameters(frame(spark, pts, labels), block_rows=16).collect()}
    d = distances(pts)
    assert got == pytest.approx({a: d[np.ix_(labels == a, labels == a)].max() for a in set(labels.tolist())})
    outer, _ = extremes.outer_rows(frame(spark, pts, labels))
    assert outer.count() < len(pts) / 2  # most rows cannot belong to a farthest pair


def test_label_gap(spark, data):
    pts, labels = data
    d = distances(pts)
    cross = d[labels[:, None] != labels[None, :]]
    for probes in (4, 512):
        assert extremes.label_gap(frame(spark, pts, labels), probes=probes).first().gap == pytest.approx(cross[cross > 0].min())
    assert extremes.label_gap(frame(spark, pts, np.zeros(len(pts)))).first().gap is None
    one_place = frame(spark, np.array([[1.0], [1.0], [1.0], [4.0]]), [0, 1, 1, 2])
    assert extremes.label_gap(one_place).first().gap is None  # labels 0 and 1 have no distance above 0
    assert extremes.label_gap(one_place.where("label <> 0")).first().gap == 3.0


def test_dunn_with_and_without_the_pair_pass(spark, data):
    df = frame(spark, *data)
    pruned = va.ClusterValidity(df).dunn().first().value
    full = va.ClusterValidity(df)
    assert full.scan is not None and full.dunn().first().value == pytest.approx(pruned, rel=1e-12)


def test_centroid_extremes(spark):
    rng = np.random.default_rng(9)
    c, s = rng.normal(size=(50, 4)), rng.uniform(1, 2, 50)
    c[7] = c[8]
    rows = spark.createDataFrame([(i, x.tolist(), float(y)) for i, (x, y) in enumerate(zip(c, s))], "label long, centroid array<double>, s double")
    d = distances(c)
    away = ~np.eye(50, dtype=bool)
    for r in vv.centroid_extremes(rows, spread_col="s", block_rows=11).collect():
        own = d[r.label][away[r.label]]
        ratio = [(s[r.label] + s[j]) / d[r.label, j] if d[r.label, j] else 0.0 for j in range(50) if j != r.label]
        assert (r.sum_d, r.max_d, r.min_d, r.score) == pytest.approx((own.sum(), own.max(), own.min(), max(ratio)))
    alone = vv.centroid_extremes(rows.limit(1)).first()
    assert alone.max_d is None and alone.score is None


def test_square_silhouette(spark, data):
    pts, labels = data
    d = distances(pts) ** 2
    got = {r.vec_id: r.s for r in vv.square_silhouette(frame(spark, pts, labels), block_rows=32).collect()}
    for i in range(len(pts)):
        own = (labels == labels[i]) & (np.arange(len(pts)) != i)
        a = d[i][own].mean() if own.any() else None
        b = min(d[i][labels == x].mean() for x in set(labels.tolist()) if x != labels[i])
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-9)
    assert all(r.s is None or r.s == 0 for r in vv.square_silhouette(frame(spark, pts, np.zeros(len(pts)))).collect())


def test_density_of_midpoints(spark):
    """S_Dbw by the radius search over centroids, worked through with numpy."""
    rng = np.random.default_rng(10)
    pts = np.vstack([rng.normal(c, 0.6, size=(30, 3)) for c in [(0, 0, 0), (1, 1, 0), (0, 1.5, 1)]])
    labels = np.repeat([0, 1, 2], 30)
    c = np.array([pts[labels == a].mean(axis=0) for a in range(3)])
    std = np.array([np.linalg.norm(np.sqrt(pts[labels == a].var(axis=0))) for a in range(3)])
    radius = np.sqrt(np.linalg.norm(std[:, None], axis=1).sum()) / 3
    std2 = np.array([np.sqrt(pts[labels == a].var(axis=0).sum()) for a in range(3)])
    assert np.allclose(std, std2)
    dens = [(np.linalg.norm(pts[labels == a] - c[a], axis=1) <= radius).sum() for a in range(3)]
    total = 0.0
    for a in range(3):
        for b in range(3):
            if a != b:
                mid = (c[a] + c[b]) / 2
                count = (np.linalg.norm(pts[(labels == a) | (labels == b)] - mid, axis=1) <= radius).sum()
                total += count / max(dens[a], dens[b])
    scat = std.sum() / (np.sqrt(pts.var(axis=0).sum()) * 3)
    got = va.ClusterValidity(frame(spark, pts, labels)).s_dbw().first().value
    assert got == pytest.approx(total / 6 + scat)
    far = frame(spark, np.vstack([pts[:30], pts[:30] + 100]), np.repeat([0, 1], 30))
    assert va.ClusterValidity(far).s_dbw().first().value > 0  # no row near any midpoint: only the scatter counts


def test_medoids(spark, data):
    pts, labels = data
    pts = pts + 20.0
    unit = pts / np.linalg.norm(pts, axis=1)[:, None]
    cos = 1 - unit @ unit.T
    got = {r.label: (r.medoid_id, r.mean_cos_dist) for r in sm.medoids(frame(spark, pts, labels)).collect()}
    assert set(got) == {0, 1, 2}  # a label of one row has no other member
    for a, (medoid, value) in got.items():
        ids = np.flatnonzero(labels == a)
        means = cos[np.ix_(ids, ids)].sum(axis=1) / (len(ids) - 1)
        assert value == pytest.approx(means.min(), abs=1e-12)
        assert means[list(ids).index(medoid)] == pytest.approx(means.min(), abs=1e-12)


def test_radius_search_of_two_tables(spark):
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(80, 3)), rng.normal(size=(40, 3))
    a = frame(spark, x, np.arange(80) % 4).withColumn("r", F.lit(0.9))
    b = frame(spark, y, np.arange(40) % 4).withColumnsRenamed({"vec_id": "p", "embedding": "w"})
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    for apart in (None, ("label", "label")):
        got = {(r.vec_id, r.nbr_id) for r in metric.radius_search(a, b, "r", point_id="p", point_vec="w", apart=apart, block_rows=8).collect()}
        assert got == {(i, j) for i in range(80) for j in range(40) if d[i, j] <= 0.9 and (apart is None or i % 4 != j % 4)}
