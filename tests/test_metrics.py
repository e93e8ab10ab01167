"""Metric identities, two-sample tests and ordering helpers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import clusterstats as cs
from lexiclust.operators import ordering as od
from lexiclust.operators import twosample as ts
from lexiclust.operators import validity as va
from tests.test_pairs_wishart import frame


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(c, 0.7, size=(60, 2)) for c in [(1, 1), (-1, -1), (1, -1)]])
    labels = np.repeat([0, 1, 2], 60)
    return pts, labels


def report(spark, pts, labels):
    cv = va.ClusterValidity(frame(spark, pts, labels), block_rows=40)
    return {r["metric"]: r["value"] for r in cv.run_all().collect()}, cv


def test_sst_decomposes(spark, blobs):
    pts, labels = blobs
    _, cv = report(spark, pts, labels)
    ssw = cv.lab.agg(F.sum("ss")).first()[0]
    sst = cv.glob.first()["sst"]
    ssb = sum((labels == c).sum() * ((pts[labels == c].mean(0) - pts.mean(0)) ** 2).sum() for c in range(3))
    assert math.isclose(sst, ssw + ssb, rel_tol=1e-9)


def test_indices_against_numpy(spark, blobs):
    pts, labels = blobs
    rep, _ = report(spark, pts, labels)
    n, d = pts.shape
    cen = np.array([pts[labels == c].mean(0) for c in range(3)])
    ssw = sum(((pts[labels == c] - cen[c]) ** 2).sum() for c in range(3))
    assert math.isclose(rep["rmsstd"], math.sqrt(ssw / ((n - 3) * d)), rel_tol=1e-9)
    dm = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    sil = []
    for i in range(n):
        same = labels == labels[i]
        a = dm[i, same].sum() / (same.sum() - 1)
        b = min(dm[i, labels == c].mean() for c in range(3) if c != labels[i])
        sil.append((b - a) / max(a, b))
    assert math.isclose(rep["silhouette"], float(np.mean(sil)), rel_tol=1e-9)
    cd = np.sqrt(((cen[:, None] - cen[None]) ** 2).sum(-1))
    s = np.array([np.sqrt(((pts[labels == c] - cen[c]) ** 2).sum(1)).mean() for c in range(3)])
    db = np.mean([max((s[i] + s[j]) / cd[i, j] for j in range(3) if j != i) for i in range(3)])
    assert math.isclose(rep["davies_bouldin"], db, rel_tol=1e-9)


def test_label_permutation_invariance(spark, blobs):
    pts, labels = blobs
    perm = np.array([2, 0, 1])[labels]
    a, _ = report(spark, pts, labels)
    b, _ = report(spark, pts, perm)
    for m in ["rmsstd", "r_squared", "ch_index", "silhouette", "davies_bouldin", "dunn", "xie_beni", "cvnn"]:
        assert math.isclose(a[m], b[m], rel_tol=1e-9), m


def test_mean_intracluster_is_twice_the_mean(spark, blobs):
    pts, labels = blobs
    cv = va.ClusterValidity(frame(spark, pts, labels), block_rows=40)
    got = {r["label"]: r["value"] for r in cs.cluster_stats(cv, ["mean_dist"]).collect()}
    dm = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for c in range(3):
        sub = dm[np.ix_(labels == c, labels == c)]
        n = sub.shape[0]
        assert math.isclose(got[c], 2 * sub[np.triu_indices(n, 1)].mean(), rel_tol=1e-9)


def test_ranksum_and_ks(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, 40).round(1), rng.normal(0.5, 1, 30).round(1)
    rows = [("s", "real", float(v)) for v in x] + [("s", "generated", float(v)) for v in y]
    df = spark.createDataFrame(rows, "stat string, sample string, value double")
    res = {r["test"]: r for r in ts.two_sample_tests(df).collect()}
    allv = np.concatenate([x, y])
    ranks = np.array([(allv < v).sum() + ((allv == v).sum() + 1) / 2 for v in allv])
    n1, n2 = len(x), len(y)
    z = (ranks[:n1].sum() - n1 * (n1 + n2 + 1) / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    assert math.isclose(res["ranksum"]["statistic"], z, rel_tol=1e-9)
    assert math.isclose(res["ranksum"]["pvalue"], math.erfc(abs(z) / math.sqrt(2)), rel_tol=1e-6)
    grid = np.sort(allv)
    dstat = max(abs((x <= v).mean() - (y <= v).mean()) for v in grid)
    assert math.isclose(res["ks"]["statistic"], dstat, rel_tol=1e-12)
    assert 0.0 <= res["ks"]["pvalue"] <= 1.0


def test_global_index_dense_and_ordered(spark):
    df = spark.range(0, 5000, 3).select((F.col("id") * 7 % 1000).alias("k"), F.col("id").alias("id"))
    got = od.global_index(df, ["k", "id"], "idx").toPandas().sort_values("idx")
    assert list(got.idx) == list(range(len(got)))
    assert list(zip(got.k, got.id)) == sorted(zip(got.k, got.id))


def test_prefix_offsets(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(200)], "doc long, n long")
    got = od.prefix_offsets(df, ["doc"], "n", "off").toPandas().sort_values("doc")
    exp = np.concatenate([[0], np.cumsum(got.n.to_numpy())[:-1]])
    assert (got.off.to_numpy() == exp).all()
