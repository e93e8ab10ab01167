"""The pair engine's tiles: digits, ties, repeated ids, one block a partition, speed."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import pairs as pr


def direct(x, y):
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("offset", [0.0, 1e3, 1e6])
def test_distances_keep_their_digits_near_and_far(offset):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8)) + offset
    y = np.vstack([x[:300], x[:300] + 1e-6, rng.normal(size=(200, 8)) + offset])
    assert np.allclose(pr.distances(x, y), direct(x, y), rtol=1e-10, atol=0)
    assert (pr.distances(x, x).diagonal() == 0).all()


def test_distances_of_endless_rows():
    x = np.array([[np.inf, 0.0], [np.nan, 1.0], [3.0, 4.0]])
    d = pr.distances(x, np.zeros((1, 2)))[:, 0]
    assert d[0] == np.inf and np.isnan(d[1]) and d[2] == 5.0


def test_distances_run_at_the_speed_of_a_product():
    x = np.random.default_rng(2).normal(size=(1500, 64))
    t = time.perf_counter()
    step = [np.sqrt(np.einsum("ijk,ijk->ij", d, d)) for d in (x[i:i + 50, None] - x[None] for i in range(0, 1500, 50))]
    plain = time.perf_counter() - t
    t = time.perf_counter()
    got = pr.distances(x, x)
    assert time.perf_counter() - t < plain / 2
    assert np.allclose(got, np.vstack(step), rtol=1e-11)


def test_knn_over_many_tiles_with_copies(spark, monkeypatch):
    monkeypatch.setattr(pr, "TILE", 16)
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(size=(60, 4))] * 3 + [rng.normal(size=(20, 4))])
    f = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, embedding array<double>")
    got = pr.knn(f, 5, block_rows=40).toPandas().sort_values(["vec_id", "rank"])
    d = direct(pts, pts)
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(pts)), d.shape), d), axis=1)[:, :5]
    assert (got["nbr_id"].to_numpy().reshape(-1, 5) == want).all()


def test_each_block_has_a_partition_of_its_own(spark):
    f = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    got = pr.knn(f, 1, block_rows=25)
    parts = got.groupBy(F.spark_partition_id().alias("p")).count().toPandas()
    assert len(parts) == got.rdd.getNumPartitions() >= 16


def test_pairs_of_one_id_are_left_out(spark):
    rows = [(1, [0.0, 0.0], 0), (1, [0.0, 0.0], 0), (1, [0.0, 9.0], 1), (2, [3.0, 4.0], 0)]
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = {(r.label_i, r.label_j): (r.n_pairs, r.sum_dist, r.max_dist) for r in pr.label_pair_stats(f).collect()}
    far = 34 ** 0.5  # (0, 9) to (3, 4)
    assert got == {(0, 0): (4, 20.0, 5.0), (0, 1): (1, pytest.approx(far), pytest.approx(far)),
                   (1, 0): (1, pytest.approx(far), pytest.approx(far))}


def test_copies_are_equally_similar_wherever_they_stand(spark, monkeypatch):
    monkeypatch.setattr(pr, "TILE", 13)
    rng = np.random.default_rng(6)
    pts = np.repeat(rng.normal(size=(12, 31)), 7, axis=0)
    f = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, p.tolist(), []) for i, p in enumerate(rng.normal(size=(20, 31)))],
                              "qid long, qvec array<double>, exclude array<long>")
    got = pr.cross_topk(q, f, 14).toPandas().sort_values(["qid", "rank"])["vec_id"].to_numpy().reshape(20, 2, 7)
    assert (np.diff(got, axis=2) == 1).all() and (got[:, :, 0] % 7 == 0).all()


def test_label_scan_prepares_its_factors_once(monkeypatch):
    """The fold's sums are those of the plain distances, for copies, rows far off and rows
    that are not finite as well; a block's factor of the products is made once."""
    rng = np.random.default_rng(3)
    made = []
    hstack = np.hstack
    monkeypatch.setattr(np, "hstack", lambda *a, **b: made.append(1) or hstack(*a, **b))
    for odd in (0.0, 1e9, np.inf):
        x, y = rng.normal(size=(1100, 5)), rng.normal(size=(700, 5))
        y[:20] = x[:20]
        y[300] += odd
        labels = np.sort(rng.integers(0, 4, len(y)))
        table = lambda m, lab, first: pa.table({"_id": pa.array(np.arange(len(m)) + first), "_lab": pa.array(lab), "_v": pa.array(list(m))})
        block = pr._label_sums(256, "euclidean", False)(table(x, np.zeros(len(x), np.int64), 10_000))
        made.clear()
        with np.errstate(invalid="ignore"):
            block.add(table(y, labels, 0).combine_chunks().to_batches()[0])
            rows = block.result().to_pylist()
            want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
        if np.isfinite(odd):
            assert len(made) == 3  # one for each batch of 256 rows
        pairs = {r["other"]: r for r in rows if r["pair"]}
        for label in range(4):
            mine = want[:, labels == label]
            count = mine.size - (len(x) if label == 0 else 0)
            assert pairs[label]["c"] == count
            np.testing.assert_allclose(pairs[label]["s"], mine.sum(), rtol=1e-11)
            np.testing.assert_allclose(pairs[label]["mx"], mine.max(), rtol=1e-11)
            np.testing.assert_allclose(pairs[label]["mn"], mine[mine > 0].min(), rtol=1e-9)
