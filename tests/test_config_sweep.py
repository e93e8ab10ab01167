"""The configs of a sweep train in the same jobs, each as if alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import autoencoder as ae


def rows(spark, n=90, d=6):
    x = np.random.default_rng(5).normal(size=(n, d))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


CONFIGS = [([6, 3], "tanh", 4), ([6, 4, 2], None, 4), ([6, 2], "sigmoid", 3)]


def test_swept_configs_equal_single_fits(spark):
    train = rows(spark)
    got = {(r["dims"], r["split"]): r["mse"] for r in ae.config_sweep(train, train, train.where("vec_id < 9"), CONFIGS, lr=0.01, batch_size=16)}
    for dims, act, epochs in CONFIGS:
        net = ae.stacked_fit(train, dims, act, epochs, 0.01, None, batch_size=16).chain()
        name = "-".join(map(str, dims))
        assert got[name, "train"] == pytest.approx(ae.mse(net, train), rel=1e-9)
        assert got[name, "test"] == pytest.approx(ae.mse(net, train.where("vec_id < 9")), rel=1e-9)


def test_several_tasks_average_as_one_network_would(spark):
    train, nets = rows(spark), [ae.single_autoencoder(6, k, "tanh", k) for k in (2, 3)]
    ae.fit_many(nets, [train, train.where("vec_id % 2 = 0")], 3, 0.01, 8, task_rows=30)
    alone = [ae.single_autoencoder(6, k, "tanh", k) for k in (2, 3)]
    ae.fit_batches(alone[0], train, 3, 0.01, 8, task_rows=30)
    ae.fit_batches(alone[1], train.where("vec_id % 2 = 0"), 3, 0.01, 8, task_rows=30)
    for a, b in zip(nets, alone):
        assert np.allclose(a.flat(), b.flat(), rtol=1e-9)


def test_a_sweep_takes_one_job_an_epoch_and_stage(spark, monkeypatch):
    epochs = []
    real = ae._local_epoch
    monkeypatch.setattr(ae, "_local_epoch", lambda *a: epochs.append(1) or real(*a))
    ae.config_sweep(*[rows(spark)] * 3, [([6, k], "tanh", 2) for k in (2, 3, 4)], batch_size=32)
    assert len(epochs) == 4  # two epochs of the layer and of the chain, whatever the number of configs
