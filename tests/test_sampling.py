"""Exact splits by hash cuts, one-scan histograms, k-means of many starts, training in batches."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import autoencoder as ae
from lexiclust.operators import kmeans as km
from lexiclust.operators import sampling as sp
from lexiclust.operators import stats as st


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 3000).select(F.col("id").alias("k"), F.lit("text").alias("text")).repartition(5)


@pytest.mark.parametrize("prefix,border", [(4, 10_000), (1, 7), (2, 1)])
def test_border_hashes(spark, rows, prefix, border):
    hashes = rows.select(sp.hash_key(5, "k").alias("_h"))
    want = sorted(hashlib.md5(f"5:{i}".encode()).hexdigest() for i in range(3000))
    ranks = [0, 1, 17, 1500, 2999, 3000, 9000]
    assert sp._border_hashes(hashes, ranks, prefix, border) == [want[r] if r < 3000 else None for r in ranks]


def test_split_by_sizes(spark, rows):
    order = by_hash(range(3000), 9)
    got = {r.k: r.split for r in sp.split_exact(rows, {"a": 100, "none": 0, "b": 1, "c": 900}, ["k"], seed=9).collect()}
    assert got == {**{i: "a" for i in order[:100]}, order[100]: "b", **{i: "c" for i in order[101:1001]}}
    more = sp.split_exact(rows, {"a": 2000, "b": 5000}, ["k"], seed=9).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in more} == {"a": 2000, "b": 1000}


def test_split_by_fractions_keeps_the_remainder(spark, rows):
    some = rows.where("k < 1007")
    order = by_hash(range(1007), 3)
    got = sp.split_fractions(some, {"a": 0.5, "b": 0.3, "c": 0.2}, ["k"], seed=3)
    assert got.columns == ["k", "text", "split"]
    want = {**{i: "a" for i in order[:503]}, **{i: "b" for i in order[503:805]}, **{i: "c" for i in order[805:]}}
    assert {r.k: r.split for r in got.collect()} == want
    assert sp.split_fractions(some.limit(0), {"a": 0.5, "b": 0.5}, ["k"]).count() == 0
    assert sp.split_fractions(some, {"a": 1.0, "b": 0.0}, ["k"]).where("split = 'a'").count() == 1007


def test_split_neither_sorts_nor_joins(spark, rows):
    plan = sp.split_exact(rows, {"a": 10, "b": 20}, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Join" not in plan


def test_histogram(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 500, 4000)
    df = spark.createDataFrame([(int(v),) for v in x] + [(None,)], "n long")
    count, edges = np.histogram(x, bins=20)
    got = sorted(st.histogram(df, "n", 20).collect())
    assert [r.cnt for r in got] == count.tolist()
    assert [r.lo for r in got] == pytest.approx(edges[:-1].tolist())
    same = st.histogram(spark.createDataFrame([(3,), (3,)], "n long"), "n", 4).collect()
    assert sorted((r.bin, r.cnt) for r in same) == [(0, 2), (1, 0), (2, 0), (3, 0)]


def test_kmeans_finds_the_blobs_in_one_scan_a_step(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]], float)
    x = np.vstack([rng.normal(c, 0.5, size=(100, 2)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    fit = km.kmeans(df, 4, starts=6)
    assert sorted(fit.sizes.tolist()) == [100] * 4 and len(fit.costs) == 6 and fit.cost == min(fit.costs)
    assert fit.steps <= 51
    d = ((x[:, None] - fit.centres[None]) ** 2).sum(-1)
    assert fit.cost == pytest.approx(d.min(axis=1).sum(), rel=1e-9)
    again = km.kmeans(df.repartition(2), 4, starts=6)
    assert again.cost == pytest.approx(fit.cost, rel=1e-9)
    assert len(km.kmeans(df.limit(0), 4).centres) == 0
    assert len(km.kmeans(df.where("vec_id < 2"), 4).centres) == 2


def test_training_in_batches(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 8)) + 0.05 * rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, w double")
    one = ae.fit_batches(ae.single_autoencoder(8, 3, None, seed=0), df, 30, 0.01, 32, val=df)
    full = ae.fit(ae.single_autoencoder(8, 3, None, seed=0), df, 30, 0.01)
    assert ae.mse(one, df) < ae.mse(full, df)  # 13 steps an epoch instead of one
    assert one.history[-1]["val_loss"] == pytest.approx(ae.mse(one, df))
    spread = ae.fit_batches(ae.single_autoencoder(8, 3, None, seed=0), df.repartition(7), 30, 0.01, 32, task_rows=100)
    assert ae.mse(spread, df) < ae.mse(full, df)  # averaged over four tasks
    weighted = ae.fit_batches(ae.single_autoencoder(8, 3, None, seed=0), df, 30, 0.01, 32, weight_col="w")
    assert np.allclose(weighted.flat(), one.flat())  # equal weights change nothing
    again = ae.fit_batches(ae.single_autoencoder(8, 3, None, seed=0), df.repartition(3), 30, 0.01, 32)
    assert np.allclose(again.flat(), one.flat())  # whatever the partitions of the input
