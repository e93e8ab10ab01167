"""Dense autoencoders trained by distributed gradient sums.

Each optimisation step ships the current weights (a few MB at most) to the
tasks as a closure; every partition runs numpy forward/backward passes over
its own rows and returns one row of summed gradients plus its loss sum.
Spark adds the partition rows element-wise (posexplode + groupBy, so the
reduction is a normal shuffle of ``partitions x parameters`` values) and the
driver applies an Adam update.  Training rows never leave the executors.

Networks are sequences of dense layers ``(W, b, activation)``; a single
autoencoder is ``in -> out (activation)`` followed by ``out -> in (linear)``,
loss = mean squared error over all cells (optionally row-weighted).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blockscan import matrix
from .ordering import hash_int

ACTIVATIONS = (None, "sigmoid", "tanh", "relu", "leakyrelu", "softplus")
LEAKY_SLOPE = 0.3  # Keras' default LeakyReLU slope


def _act(name, z):
    if name is None or name == "linear":
        return z
    if name == "sigmoid":
        return 1.0 / (1.0 + np.exp(-z))
    if name == "tanh":
        return np.tanh(z)
    if name == "relu":
        return np.maximum(z, 0.0)
    if name == "leakyrelu":
        return np.where(z > 0, z, LEAKY_SLOPE * z)
    if name == "softplus":
        return np.logaddexp(0.0, z)
    raise ValueError(name)


def _act_grad(name, z, h):
    if name is None or name == "linear":
        return np.ones_like(z)
    if name == "sigmoid":
        return h * (1.0 - h)
    if name == "tanh":
        return 1.0 - h * h
    if name == "relu":
        return (z > 0).astype(z.dtype)
    if name == "leakyrelu":
        return np.where(z > 0, 1.0, LEAKY_SLOPE)
    if name == "softplus":
        return 1.0 / (1.0 + np.exp(-z))
    raise ValueError(name)


@dataclass
class Layer:
    w: np.ndarray
    b: np.ndarray
    activation: str | None = None


@dataclass
class Network:
    layers: list[Layer]
    history: list[dict] = field(default_factory=list)

    def forward(self, x: np.ndarray) -> np.ndarray:
        for lay in self.layers:
            x = _act(lay.activation, x @ lay.w + lay.b)
        return x

    def flat(self) -> np.ndarray:
        return np.concatenate([np.concatenate([l.w.ravel(), l.b]) for l in self.layers])

    def set_flat(self, v: np.ndarray) -> None:
        o = 0
        for lay in self.layers:
            n = lay.w.size
            lay.w = v[o:o + n].reshape(lay.w.shape)
            o += n
            lay.b = v[o:o + lay.b.size].copy()
            o += lay.b.size


def glorot(fan_in: int, fan_out: int, rng) -> np.ndarray:
    lim = np.sqrt(6.0 / (fan_in + fan_out))
    return rng.uniform(-lim, lim, size=(fan_in, fan_out))


def dense_chain(dims: list[int], activations: list[str | None], seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    return Network([Layer(glorot(dims[i], dims[i + 1], rng), np.zeros(dims[i + 1]), activations[i])
                    for i in range(len(dims) - 1)])


def single_autoencoder(in_dim: int, out_dim: int, activation: str | None, seed: int = 0) -> Network:
    return dense_chain([in_dim, out_dim, in_dim], [activation, None], seed)


def _grad_sums(layers: list[Layer], x: np.ndarray, y: np.ndarray, w: np.ndarray):
    hs, zs = [x], []
    h = x
    for lay in layers:
        z = h @ lay.w + lay.b
        h = _act(lay.activation, z)
        zs.append(z)
        hs.append(h)
    err = h - y
    loss = float((w[:, None] * err * err).sum())
    delta = 2.0 * w[:, None] * err * _act_grad(layers[-1].activation, zs[-1], hs[-1])
    grads = [None] * len(layers)
    for i in range(len(layers) - 1, -1, -1):
        grads[i] = (hs[i].T @ delta, delta.sum(axis=0))
        if i > 0:
            delta = (delta @ layers[i].w.T) * _act_grad(layers[i - 1].activation, zs[i - 1], hs[i])
    flat = np.concatenate([np.concatenate([gw.ravel(), gb]) for gw, gb in grads])
    return flat, loss


def _partition_step(layers, vec_col, target_col, weight_col):
    """One row per partition: the gradient's sums, then loss and row count."""
    def run(batches):
        g_tot, l_tot, n_tot = None, 0.0, 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            y = x if target_col is None else np.stack(pdf[target_col].to_numpy()).astype(np.float64)
            w = np.ones(len(pdf)) if weight_col is None else pdf[weight_col].to_numpy(dtype=np.float64)
            g, loss = _grad_sums(layers, x, y, w)
            g_tot = g if g_tot is None else g_tot + g
            l_tot += loss
            n_tot += len(pdf)
        if g_tot is not None:
            yield pd.DataFrame({"g": [np.concatenate([g_tot, [l_tot, n_tot]])]})
    return run


def _reduce(df: DataFrame, layers, vec_col, target_col, weight_col):
    parts = df.mapInPandas(_partition_step(layers, vec_col, target_col, weight_col), "g array<double>")
    summed = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    rows = summed.collect()  # one value per parameter, and two: one pass over the data a step
    if not rows:
        return np.zeros(0), 0.0, 0
    total = np.zeros(len(rows))
    for r in rows:
        total[r["i"]] = r["v"]
    return total[:-2], float(total[-2]), int(total[-1])


def mse(net: Network, df: DataFrame, vec_col: str = "embedding", target_col: str | None = None) -> float:
    """Mean squared error over all cells (forward pass only)."""
    layers = net.layers

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            y = x if target_col is None else np.stack(pdf[target_col].to_numpy()).astype(np.float64)
            h = x
            for lay in layers:
                h = _act(lay.activation, h @ lay.w + lay.b)
            yield pd.DataFrame({"s": [float(((h - y) ** 2).sum())], "c": [h.size]})

    r = df.mapInPandas(run, "s double, c long").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).first()
    return float(r["s"]) / float(r["c"]) if r["c"] else float("nan")


def _local_epoch(nets, states, cols, batch_size, lr, betas, eps, epoch):
    """A task's epoch: Adam steps over batches of its own rows, in an order that
    changes with the epoch, of every network in turn.  One row a network: the task's
    weights and moments times its number of rows, then loss and rows."""
    def trained(layers, state, x, y, w):
        net = Network([Layer(l.w, l.b, l.activation) for l in layers])
        theta, m, v, t = state
        order, loss = np.random.default_rng(epoch).permutation(len(x)), 0.0
        for a in range(0, len(x), batch_size):
            rows = order[a:a + batch_size]
            net.set_flat(theta)
            g, batch_loss = _grad_sums(net.layers, x[rows], y[rows], w[rows])
            g = g / (len(rows) * y.shape[1])
            loss, t = loss + batch_loss, t + 1
            m, v = betas[0] * m + (1 - betas[0]) * g, betas[1] * v + (1 - betas[1]) * g * g
            theta = theta - lr * (m / (1 - betas[0] ** t)) / (np.sqrt(v / (1 - betas[1] ** t)) + eps)
        return np.concatenate([np.concatenate([theta, m, v]) * len(x), [loss, len(x), t * len(x)]])

    def run(batches):
        parts: dict[int, list] = {}
        for batch in batches:
            which = batch.column(0).to_numpy()
            for net in np.unique(which).tolist():
                some = batch.filter(pa.array(which == net))
                x = matrix(some.column(1))
                y = matrix(some.column(cols["target"])) if "target" in cols else x
                w = some.column(cols["weight"]).to_numpy().astype(np.float64) if "weight" in cols else np.ones(len(x))
                parts.setdefault(net, []).append((x, y, w))
        for net, pieces in parts.items():
            sums = trained(nets[net], states[net], *(np.concatenate(p) for p in zip(*pieces)))
            yield pa.RecordBatch.from_arrays([pa.array([net], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))],
                                             names=["net", "g"])
    return run


def fit_many(nets: list[Network], trains: list[DataFrame], epochs: int = 10, lr: float = 1e-3, batch_size: int = 64,
             vals: list[DataFrame | None] | None = None, vec_col: str = "embedding", target_col: str | None = None,
             weight_col: str | None = None, id_col: str = "vec_id", beta1: float = 0.9, beta2: float = 0.999,
             eps: float = 1e-7, task_rows: int = 8192) -> list[Network]:
    """``fit_batches`` of several networks, each on its own rows, with one job an
    epoch for all of them: every network comes out as if trained alone."""
    from ..session import cut_lineage
    named = [c for c in (vec_col, target_col, weight_col) if c]
    data, first = None, 0
    for i, train in enumerate(trains):
        parts = max(1, -(-train.count() // task_rows))
        vectors = [F.transform(c, lambda x: x.cast("double")).alias(c) for c in (vec_col, target_col) if c]
        rows = train.select(F.lit(i).cast("long").alias("_net"), F.xxhash64(id_col).alias("_h"),
                            *vectors, *([F.col(weight_col).cast("double")] if weight_col else []))
        rows = rows.withColumn("_part", (F.lit(first) + F.pmod("_h", F.lit(parts))).cast("int"))
        data, first = rows if data is None else data.unionByName(rows), first + parts
    # one partition holds one part of one network's rows
    data = data.repartitionById(first, F.col("_part")).sortWithinPartitions("_net", "_h").select("_net", *named)
    data = cut_lineage(data)
    cols = {"target": 2} if target_col else {}
    if weight_col:
        cols["weight"] = len(named)
    states = [(net.flat(), np.zeros_like(net.flat()), np.zeros_like(net.flat()), 0) for net in nets]
    for epoch in range(epochs):
        step = _local_epoch([net.layers for net in nets], states, cols, batch_size, lr, (beta1, beta2), eps, epoch)
        totals = [np.zeros(3 * len(state[0]) + 3) for state in states]
        for r in data.mapInArrow(step, "net long, g array<double>").select("net", F.posexplode("g").alias("i", "v")) \
                .groupBy("net", "i").agg(F.sum("v").alias("v")).collect():  # three values a parameter
            totals[r["net"]][r["i"]] = r["v"]
        for i, (net, total) in enumerate(zip(nets, totals)):
            n = total[-2]
            if not n:
                continue
            theta, m, v = np.split(total[:-3] / n, 3)
            states[i] = (theta, m, v, int(round(total[-1] / n)))
            net.set_flat(theta.copy())
            rec = {"epoch": epoch + 1, "train_loss": total[-3] / (n * net.layers[-1].w.shape[1])}
            if vals is not None and vals[i] is not None:
                rec["val_loss"] = mse(net, vals[i], vec_col, target_col)
            net.history.append(rec)
    return nets


def fit_batches(net: Network, train: DataFrame, epochs: int = 10, lr: float = 1e-3, batch_size: int = 64,
                val: DataFrame | None = None, vec_col: str = "embedding", target_col: str | None = None,
                weight_col: str | None = None, id_col: str = "vec_id", beta1: float = 0.9, beta2: float = 0.999,
                eps: float = 1e-7, task_rows: int = 8192) -> Network:
    """Adam in batches of ``batch_size`` rows at the price of one job an epoch:
    every task steps through the batches of its own rows, and the tasks' weights
    and moments are averaged by their number of rows after each epoch.  A task
    holds about ``task_rows`` rows, dealt by a hash of the id, written once to the
    shared folder, so that a lost executor costs a task and changes nothing."""
    return fit_many([net], [train], epochs, lr, batch_size, [val], vec_col, target_col, weight_col, id_col,
                    beta1, beta2, eps, task_rows)[0]


def _trained(net, train, epochs, lr, steps_per_epoch, batch_size, val, vec_col, weight_col, id_col, seed):
    if batch_size:
        return fit_batches(net, train, epochs, lr, batch_size, val, vec_col, None, weight_col, id_col)
    return fit(net, train, epochs, lr, steps_per_epoch, val, vec_col, None, weight_col, id_col, seed)


def fit(net: Network, train: DataFrame, epochs: int = 10, lr: float = 1e-3, steps_per_epoch: int = 1,
        val: DataFrame | None = None, vec_col: str = "embedding", target_col: str | None = None,
        weight_col: str | None = None, id_col: str = "vec_id", seed: int = 0,
        beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-7) -> Network:
    """Adam on distributed gradient sums; ``steps_per_epoch`` hash-chosen
    mini-batches per epoch (1 = full batch).  Appends per-epoch losses to
    ``net.history``."""
    cols = [vec_col] + ([target_col] if target_col else []) + ([weight_col] if weight_col else [])
    data = train.select(id_col, *cols).persist()
    theta = net.flat()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    t = 0
    d_out = net.layers[-1].w.shape[1]
    for epoch in range(epochs):
        batch_no = F.pmod(hash_int(f"{seed}:{epoch}", id_col), steps_per_epoch)
        losses, count = 0.0, 0
        for step in range(steps_per_epoch):
            frame = data if steps_per_epoch == 1 else data.where(batch_no == step)
            g, loss, n = _reduce(frame, net.layers, vec_col, target_col, weight_col)
            if n == 0:
                continue
            g = g / (n * d_out)
            t += 1
            m = beta1 * m + (1 - beta1) * g
            v = beta2 * v + (1 - beta2) * g * g
            mh, vh = m / (1 - beta1 ** t), v / (1 - beta2 ** t)
            theta = theta - lr * mh / (np.sqrt(vh) + eps)
            net.set_flat(theta)
            losses += loss
            count += n
        rec = {"epoch": epoch + 1, "train_loss": losses / max(1, count * d_out)}
        if val is not None:
            rec["val_loss"] = mse(net, val, vec_col, target_col)
        net.history.append(rec)
    data.unpersist()
    return net


def apply_udf(layers: list[Layer]):
    """pandas UDF running the given layers (encode, decode or both)."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(col: pd.Series) -> pd.Series:
        if len(col) == 0:
            return pd.Series([], dtype=object)
        h = np.stack(col.to_numpy()).astype(np.float64)
        for lay in layers:
            h = _act(lay.activation, h @ lay.w + lay.b)
        return pd.Series(list(h))
    return run


@dataclass
class Stacked:
    encoders: list[Layer]
    decoders: list[Layer]          # in decoding order (innermost first)
    history: list[dict] = field(default_factory=list)

    def chain(self) -> Network:
        return Network(self.encoders + self.decoders)


def stacked_fit(train: DataFrame, dims: list[int], activation: str | None = "tanh", epochs: int = 10,
                lr: float = 1e-3, val: DataFrame | None = None, vec_col: str = "embedding",
                weight_col: str | None = None, id_col: str = "vec_id", seed: int = 0,
                steps_per_epoch: int = 1, fine_tune: bool = True, batch_size: int | None = None) -> Stacked:
    """Greedy layer-wise training: autoencoder i learns the codes of i-1;
    then the chain (encoders, reversed decoders) is fine-tuned end to end.
    ``batch_size`` trains in batches within the tasks (``fit_batches``)."""
    encs, decs, hist = [], [], []
    cur_train, cur_val = train, val
    held = []
    for i in range(1, len(dims)):
        ae = single_autoencoder(dims[i - 1], dims[i], activation, seed + i)
        _trained(ae, cur_train, epochs, lr, steps_per_epoch, batch_size, cur_val, vec_col, weight_col, id_col, seed + i)
        hist += [{"stage": f"layer{i}", **h} for h in ae.history]
        enc, dec = ae.layers
        encs.append(enc)
        decs.insert(0, dec)
        udf = apply_udf([enc])
        cur_train = cur_train.withColumn(vec_col, udf(F.col(vec_col))).persist()
        held.append(cur_train)
        cur_val = cur_val.withColumn(vec_col, udf(F.col(vec_col))) if cur_val is not None else None
    for frame in held:
        frame.unpersist()
    model = Stacked(encs, decs, hist)
    if fine_tune:
        net = model.chain()
        _trained(net, train, epochs, lr, steps_per_epoch, batch_size, val, vec_col, weight_col, id_col, seed)
        model.history += [{"stage": "fine_tune", **h} for h in net.history]
        n_enc = len(encs)
        model.encoders, model.decoders = net.layers[:n_enc], net.layers[n_enc:]
    return model


def encode(df: DataFrame, model: Stacked, vec_col: str = "embedding", out_col: str = "code") -> DataFrame:
    return df.withColumn(out_col, apply_udf(model.encoders)(F.col(vec_col)))


def decode(df: DataFrame, model: Stacked, code_col: str = "code", out_col: str = "restored") -> DataFrame:
    return df.withColumn(out_col, apply_udf(model.decoders)(F.col(code_col)))


def _stacked_many(train: DataFrame, configs: list[tuple], vec_col: str, lr: float, batch_size: int) -> list[Stacked]:
    """``stacked_fit`` of every config, those of one stage and number of epochs in the same jobs."""
    frames, models, layers = [train] * len(configs), [Stacked([], []) for _ in configs], [1] * len(configs)
    open_ = list(range(len(configs)))
    while open_:
        epochs = configs[open_[0]][2]
        # a stage: the next layer where one is left, else the chain
        now = [c for c in open_ if configs[c][2] == epochs]
        left = {c: layers[c] < len(configs[c][0]) for c in now}
        nets = [single_autoencoder(configs[c][0][layers[c] - 1], configs[c][0][layers[c]], configs[c][1], layers[c])
                if left[c] else models[c].chain() for c in now]
        fit_many(nets, [frames[c] if left[c] else train for c in now], epochs, lr, batch_size, vec_col=vec_col)
        for c, net in zip(now, nets):
            model, n_enc = models[c], len(configs[c][0]) - 1
            if left[c]:
                enc, dec = net.layers
                model.encoders.append(enc)
                model.decoders.insert(0, dec)
                model.history += [{"stage": f"layer{layers[c]}", **h} for h in net.history]
                frames[c] = frames[c].withColumn(vec_col, apply_udf([enc])(F.col(vec_col)))
                layers[c] += 1
            else:
                model.history += [{"stage": "fine_tune", **h} for h in net.history]
                model.encoders, model.decoders = net.layers[:n_enc], net.layers[n_enc:]
                open_.remove(c)
    return models


def _mse_many(nets: list[Network], df: DataFrame, vec_col: str) -> list[float]:
    """``mse`` of several networks in one pass."""
    chains = [net.layers for net in nets]

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            sums = [float(((Network(layers).forward(x) - x) ** 2).sum()) for layers in chains]
            yield pd.DataFrame({"net": range(len(chains)), "s": sums, "c": x.size})

    got = df.select(vec_col).mapInPandas(run, "net long, s double, c long").groupBy("net").agg(
        F.sum("s").alias("s"), F.sum("c").alias("c")).collect()  # one row a network
    found = {r["net"]: r["s"] / r["c"] if r["c"] else float("nan") for r in got}
    return [found.get(i, float("nan")) for i in range(len(nets))]


def config_sweep(train: DataFrame, val: DataFrame, test: DataFrame, configs: list[tuple], vec_col: str = "embedding",
                 lr: float = 1e-3, steps_per_epoch: int = 1, batch_size: int | None = None) -> list[dict]:
    """Grid of ``(dims, activation, epochs)``: train/val/test MSE per config.  With
    ``batch_size`` the configs of a stage train in the same jobs."""
    if batch_size:
        models = _stacked_many(train, configs, vec_col, lr, batch_size)
    else:
        models = [stacked_fit(train, list(dims), activation, epochs, lr, None, vec_col, steps_per_epoch=steps_per_epoch)
                  for dims, activation, epochs in configs]
    nets = [model.chain() for model in models]
    losses = {name: _mse_many(nets, frame, vec_col) for name, frame in (("train", train), ("val", val), ("test", test))}
    return [{"dims": "-".join(map(str, dims)), "activation": str(activation), "epochs": epochs, "split": name,
             "mse": losses[name][i]}
            for i, (dims, activation, epochs) in enumerate(configs) for name in ("train", "val", "test")]
