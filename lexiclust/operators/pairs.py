"""Blocked all-pairs engine: exact kNN and pair aggregates.

Exact Euclidean pair work is O(n^2 d) whatever the engine; what matters is
that it spreads evenly, never ships n^2 rows and runs at the speed of a matrix
product.  Rows are dealt over blocks by a hash of the id (independent of the
label, so a label holding a third of the rows does not make a hot task); a task
holds one block while all rows stream by, and takes distances tile by tile.
Blocks return only aggregates or top-k candidates; Spark then combines the
partial results with ordinary ``groupBy``.

Distances come from dot products where these keep 12 digits, and from the
differences ``sqrt(sum((x - y)^2))`` elsewhere; those that are returned or
ranked always come from the differences, so ties agree with a plain SQL oracle.
A search rules pairs out by a product in single precision, whose error is bounded
(``Near``); the pairs that it cannot rule out are looked at in double precision.
A table is copied ``n / block_rows`` times: for inputs past ~10^7 vectors use
``neighbours.knn_graph``, ``metric`` or ``ivf`` instead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blockscan import block_scan, matrix

#: rows of a block: a table is copied once for each block, a task holds one of them
DEFAULT_BLOCK_ROWS = 16384
#: rows and columns of a tile of distances, which fits the processor's cache
TILE = 512
#: columns that a search looks through at once where all its rows have k neighbours and few pairs are left
WIDE = 2048
#: below this share of the squared lengths a squared distance is taken from the differences
NEAR = 1e-3


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    if len(pdf) == 0:
        return np.zeros((0, 0))
    return np.stack(pdf["_v"].to_numpy()).astype(np.float64)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def exact_squares(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Squared distances of the pairs ``(x[i], y[j])`` from the differences."""
    out = np.empty(len(i))
    for s in range(0, len(i), chunk):
        diff = x[i[s:s + chunk]] - y[j[s:s + chunk]]
        out[s:s + chunk] = _lengths(diff)
    return out


def _squares(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one product; ``a`` and ``b`` are the squared lengths.
    Their error stays below ``_error(a, b)``."""
    return _left(x, a) @ _right(y, b)


def _left(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.hstack([-2.0 * x, a[:, None], np.ones((len(x), 1))])


def _right(y: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.hstack([y, np.ones((len(y), 1)), b[:, None]]).T


def _error(a: np.ndarray, b: np.ndarray, dims: int) -> np.ndarray:
    return 4e-16 * (dims + 8) * (a + b.max())


def near_tile(y: np.ndarray):
    """Rows that ``Near.within`` looks through: with their squared lengths, the right
    side of the products in single precision and the largest squared length."""
    b = _lengths(y)
    if not (len(y) and np.isfinite(b).all()):
        return y, b, None, np.inf
    top = float(b.max())
    if top >= 1e30:
        return y, b, None, top
    return y, b, np.vstack([y.T, np.ones((1, len(y))), b[None, :]]).astype(np.float32), top


class Near:
    """Rows ``x`` that look for rows within a squared distance of each.

    A tile of squared distances is one product in single precision, widened by more
    than its rounding error.  Where that rules out too little (rows far from the
    origin and close to each other), double precision is used."""

    def __init__(self, x: np.ndarray):
        self.x, self.a = x, _lengths(x)
        self.usable = len(x) > 0 and bool(np.isfinite(self.a).all())
        self.most = float(self.a.max()) if self.usable else 0.0
        self.left = None
        if self.usable and self.most < 1e30:
            self.left = np.hstack([-2.0 * x, self.a[:, None], np.ones((len(x), 1))]).astype(np.float32)

    def within(self, rows: slice, tile, limit: np.ndarray):
        """Positions ``(i, j)`` of all pairs of ``x[rows]`` and the tile whose squared
        distance is at most ``limit`` (one a row), and of few others."""
        y, b, right, top = tile
        mine = self.a[rows]
        if not (self.usable and np.isfinite(top)):
            square = np.vstack([_lengths(v - y) for v in self.x[rows]]) if len(mine) else np.zeros((0, len(y)))
            return np.divmod(np.flatnonzero(square <= limit[:, None]), max(1, len(y)))
        if right is not None and self.left is not None and top + self.most > 1e-24:
            slack = 1.3e-7 * (y.shape[1] + 16) * (mine + top) + 1e-36
            bound = np.minimum((limit + slack) * (1 + 1e-6), 3e38).astype(np.float32)  # a squared distance is below
            left, found = self.left[rows], []
            for c in range(0, len(y), TILE):
                low = left @ right[:, c:c + TILE]
                some = np.flatnonzero(low.min(axis=1) <= bound)  # mostly a few rows
                i, j = np.divmod(np.flatnonzero(low[some] <= bound[some, None]), low.shape[1])
                found.append((some[i], j + c))
            i, j = (np.concatenate(x) for x in zip(*found))
            if len(i) * 32 <= len(mine) * len(y):
                return i, j
        square = _squares(self.x[rows], y, mine, b)
        return np.divmod(np.flatnonzero(square <= (limit + _error(mine, b, y.shape[1]))[:, None]), len(y))


def distances(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distance matrix.  ``euclidean``: by a matrix product, and from the differences
    where the product would cancel digits; ``cosine`` = 1 - cos."""
    out = np.empty((x.shape[0], y.shape[0]))
    if x.size == 0 or y.size == 0:
        return out
    a, b = _lengths(x), _lengths(y)
    if metric == "cosine":
        return 1.0 - (x @ y.T) / (np.sqrt(a)[:, None] * np.sqrt(b)[None, :])
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        j = np.arange(len(y))
        for i in range(len(x)):
            out[i] = np.sqrt(exact_squares(x, y, np.full(len(y), i), j))
        return out
    left, right = _left(x, a), _right(y, b)
    for s in range(0, len(x), TILE):
        t = slice(s, s + TILE)
        _tile(x[t], a[t], left[t], y, b, right, out[t])
    return out


def _tile(x: np.ndarray, a: np.ndarray, left: np.ndarray, y: np.ndarray, b: np.ndarray, right: np.ndarray, out: np.ndarray):
    """Euclidean distances of finite rows into ``out``: one product, and differences where it cancels digits."""
    np.matmul(left, right, out=out)
    close = np.flatnonzero(out.min(axis=1) < NEAR * (a + b.max()))
    if len(close):
        i, j = np.nonzero(out[close] < NEAR * (a[close, None] + b[None, :]))
        i = close[i]
        out[i, j] = exact_squares(x, y, i, j)
    np.sqrt(out, out=out)


def _equal(ids: np.ndarray, place: np.ndarray, others: np.ndarray):
    """Pairs of places (``place`` of the sorted ``ids``, position in ``others``) of equal ids."""
    lo, hi = np.searchsorted(ids, others, "left"), np.searchsorted(ids, others, "right")
    n = hi - lo
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return place[at], np.repeat(np.arange(len(others)), n)


def _numbers(df: DataFrame, vec_col: str):
    """The vectors as they are where they hold single or double numbers (tasks widen
    them), else as doubles: half the traffic for single ones."""
    kind = df.schema[vec_col].dataType.simpleString()
    return F.col(vec_col) if kind in ("array<float>", "array<double>") else F.transform(vec_col, lambda v: v.cast("double"))


def _parallel(df: DataFrame) -> int:
    return 2 * df.sparkSession.sparkContext.defaultParallelism


# --------------------------------------------------------------------------
# exact kNN

def _nearest(k: int, metric: str):
    """The fold of ``stream_topk``: a block of queries and their ``k`` nearest so far."""
    class Nearest:
        def __init__(self, rows):
            self.ids, self.m = rows["_id"].to_numpy(), matrix(rows["_v"])
            self.near = Near(self.m)
            ex = [(i, e) for i, es in enumerate(rows["_ex"].to_pylist()) for e in es or () if e is not None]
            mine, skip = (np.array([x[c] for x in ex], np.int64) for c in (0, 1))
            order = np.argsort(skip, kind="stable")
            self.skip, self.skips = skip[order], mine[order]
            self.dist = np.full((len(self.ids), k), np.inf)
            self.found = np.full((len(self.ids), k), np.iinfo(np.int64).max, np.int64)

        def add(self, rows):
            ids, m = rows.column("_id").to_numpy(), matrix(rows.column("_v"))
            skips, at = _equal(self.skip, self.skips, ids)  # ascending in ``at``
            c = 0
            while c < len(ids):
                width = WIDE if metric == "euclidean" and np.isfinite(self.dist[:, -1]).all() else TILE
                lo, hi = np.searchsorted(at, [c, c + width])
                part = m[c:c + width]
                tile = near_tile(part) if metric == "euclidean" else None
                for r in range(0, len(self.ids), TILE):
                    here = (skips[lo:hi] >= r) & (skips[lo:hi] < r + TILE)
                    self.tile(slice(r, r + TILE), ids[c:c + width], part, tile, skips[lo:hi][here] - r, at[lo:hi][here] - c)
                c += width

        def bounds(self, mine, m, b, i_out, j_out):
            """Squared distances (cosine: distances) of a tile, and the most that can be among the k nearest."""
            x, a, worst = self.m[mine], self.near.a[mine], self.dist[mine][:, -1]
            if metric == "cosine":
                rough, slack = distances(x, m, metric), np.full(len(x), 4e-16 * (m.shape[1] + 8))
                limit = worst + slack
            elif self.near.usable and np.isfinite(b).all():
                rough, slack = _squares(x, m, a, b), _error(a, b, m.shape[1])
                limit = worst * worst * (1 + 1e-14) + slack
            else:
                rough = distances(x, m) ** 2
                limit, slack = worst * worst * (1 + 1e-14), np.zeros(len(x))
            rough[i_out, j_out] = np.inf
            new = np.flatnonzero(np.isinf(worst))  # no k rows so far: the k-th of the tile bounds
            if len(new) and m.shape[0] > k:
                part = rough if len(new) == len(x) else rough[new]
                # a zero vector has no direction: it is nobody's neighbour, and NaN sorts last
                kth = np.partition(part, k - 1, axis=1)[:, k - 1]
                limit[new] = np.where(np.isnan(kth), np.inf, kth + 2 * slack[new] + 1e-14 * np.abs(kth))
            return rough, limit

        def tile(self, mine, ids, m, tile, i_out, j_out):
            x, dist, found = self.m[mine], self.dist[mine], self.found[mine]
            worst = dist[:, -1]
            if metric == "euclidean" and np.isfinite(worst).all():
                i, j = self.near.within(mine, tile, worst * worst * (1 + 1e-14))
                if len(i) and len(i_out):
                    other = ~np.isin(i * len(m) + j, i_out * len(m) + j_out)
                    i, j = i[other], j[other]
                finite = True
            else:
                rough, limit = self.bounds(mine, m, tile[1] if tile else None, i_out, j_out)
                i, j = np.divmod(np.flatnonzero(rough <= limit[:, None]), len(m))
                finite = np.isfinite(rough[i, j])
            if not len(i):
                return
            if metric == "cosine":  # pair by pair: in a product, copies may differ in the last digit
                a, b = self.near.a[mine], _lengths(m)
                d = 1.0 - np.einsum("ij,ij->i", x[i], m[j]) / (np.sqrt(a)[i] * np.sqrt(b)[j])
            else:
                d = np.sqrt(exact_squares(x, m, i, j))
            keep = np.isfinite(d) & finite & (d <= worst[i])
            i, j, d = i[keep], j[keep], d[keep]
            if not len(i):
                return
            rows = np.unique(i)
            whose = np.concatenate([np.repeat(rows, k), i])
            dists, names = np.concatenate([dist[rows].ravel(), d]), np.concatenate([found[rows].ravel(), ids[j]])
            order = np.lexsort((names, dists, whose))
            first = order[np.searchsorted(whose[order], rows)[:, None] + np.arange(k)]
            dist[rows], found[rows] = dists[first], names[first]  # views of the block's arrays

        def result(self):
            keep = np.isfinite(self.dist).ravel()
            n = len(self.ids)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(self.ids, k)[keep]), pa.array(np.tile(np.arange(1, k + 1), n)[keep]),
                 pa.array(self.found.ravel()[keep]), pa.array(self.dist.ravel()[keep])], names=["qid", "rank", "id", "dist"])

    return Nearest


def stream_topk(queries: DataFrame, refs: DataFrame, k: int, metric: str = "euclidean",
                block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(qid, rank, id, dist)``: for every query row ``(_id, _v, _ex)`` the k
    reference rows ``(_id, _v)`` of smallest distance, ids in ``_ex``
    excluded, ties by id.

    Queries are dealt over blocks and every reference row passes every block
    (``block_scan``), so a task holds one block and its running top-k.  A tile of
    squared distances comes from one matrix product; only the entries that can be
    among the k best, by more than its rounding error, are taken from the
    differences, ranked and kept.  Exactly k rows per query leave the task."""
    q = queries.select("_id", "_v", F.col("_ex").cast("array<long>").alias("_ex"))
    r = refs.select("_id", "_v", F.lit(None).cast("array<long>").alias("_ex"))
    return block_scan(q, r, "_id", _nearest(k, metric), "qid long, rank long, id long, dist double", block_rows,
                      least=_parallel(queries))


def knn(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
        block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(id, rank, nbr_id, dist)``: the k nearest other rows (self excluded
    by id), ranked by ``(dist, nbr_id)``; rank starts at 1 (``stream_topk``)."""
    base = df.select(F.col(id_col).alias("_id"), _numbers(df, vec_col).alias("_v"))
    out = stream_topk(base.withColumn("_ex", F.array(F.col("_id"))), base, k, "euclidean", block_rows)
    return out.select(F.col("qid").alias(id_col), "rank", F.col("id").alias("nbr_id"), "dist")


def kth_distance(neigh: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """``(id, dk)``: distance to the k-th nearest other row."""
    return neigh.where(F.col("rank") == k).select(id_col, F.col("dist").alias("dk"))


def own_label_sums(df: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
                   block_rows: int = DEFAULT_BLOCK_ROWS, metric: str = "euclidean") -> DataFrame:
    """``(label, id, sum_dist, n_own, max_dist)`` of every row to the other rows
    of its label; pairs of unlike labels are never formed.  A label is cut into
    blocks of about ``block_rows`` rows, and a task holds two of them."""
    rows = df.select(F.col(label_col).cast("long").alias("_lab"), F.col(id_col).alias("_id"),
                     _numbers(df, vec_col).alias("_v"))
    blocks = rows.groupBy("_lab").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_b"))
    x = rows.join(blocks, "_lab").withColumn("_blk", F.pmod(F.xxhash64("_id"), F.col("_b")).cast("int"))
    x = x.withColumn("_oth", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    x = x.withColumn("_lo", F.least("_blk", "_oth")).withColumn("_hi", F.greatest("_blk", "_oth")).drop("_oth", "_b")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["_blk"] == pdf["_lo"]], pdf[pdf["_blk"] == pdf["_hi"]]
        same = pdf["_lo"].iloc[0] == pdf["_hi"].iloc[0]
        parts = []
        if len(left) and len(right):
            x, y = _matrix(left), _matrix(right)
            sums, tops = (np.zeros(len(x)), np.zeros(len(y))), (np.full(len(x), -np.inf), np.full(len(y), -np.inf))
            for i in range(0, len(x), TILE):
                for j in range(0, len(y), TILE):
                    d = distances(x[i:i + TILE], y[j:j + TILE], metric=metric)
                    if same and i == j:
                        np.fill_diagonal(d, 0.0)
                    for side, (at, axis) in enumerate(((i, 1), (j, 0))):
                        mine = slice(at, at + TILE)
                        sums[side][mine] += d.sum(axis=axis)
                        tops[side][mine] = np.maximum(tops[side][mine], d.max(axis=axis))
            sides = ((left["_id"], 0, len(y) - same),) + (() if same else ((right["_id"], 1, len(x)),))
            for ids, side, n in sides:
                parts.append(pd.DataFrame({"_lab": pdf["_lab"].iloc[0], "_id": ids.to_numpy(), "s": sums[side],
                                           "n": n, "m": tops[side]}))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["_lab", "_id", "s", "n", "m"])

    part = x.groupBy("_lab", "_lo", "_hi").applyInPandas(cell, "_lab long, _id long, s double, n long, m double")
    out = part.groupBy("_lab", "_id").agg(F.sum("s").alias("sum_dist"), F.sum("n").alias("n_own"), F.max("m").alias("max_dist"))
    return out.select(F.col("_lab").alias(label_col), F.col("_id").alias(id_col), "sum_dist", "n_own", "max_dist")


# --------------------------------------------------------------------------
# label-pair aggregates over ordered pairs i != j

def label_pair_stats(df: DataFrame, label_col: str = "label", id_col: str = "vec_id",
                     vec_col: str = "embedding", block_rows: int = DEFAULT_BLOCK_ROWS,
                     metric: str = "euclidean") -> DataFrame:
    """``(label_i, label_j, sum_dist, n_pairs, max_dist, min_nz_dist)`` over
    ordered pairs of rows of unlike ids (both orders counted)."""
    return scanned_pairs(label_scan(df, label_col, id_col, vec_col, block_rows, metric=metric, unlike_ids=True))


SCANNED = ("pair boolean, id long, label long, own_sum double, own_n long, near double, other long, "
           "s double, c long, mx double, mn double")


def _label_sums(step: int, metric: str, unlike_ids: bool):
    """The fold of ``label_scan``: running sums of one block's rows, which are sorted by label."""
    def batch(n, pair, **known):
        columns = []
        for name, kind in (x.split() for x in SCANNED.split(", ")):
            kind = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}[kind]
            value = known.get(name)
            if name == "pair":
                column = pa.array(np.full(n, pair))
            elif value is None:
                column = pa.nulls(n, kind) if kind == pa.float64() else pa.array(np.zeros(n, np.int64))
            else:
                column = pa.array(value, from_pandas=kind == pa.int64()).cast(kind)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCANNED.split(", ")])

    class Block:
        def __init__(self, rows):
            self.ids, self.labels, self.m = rows["_id"].to_numpy(), rows["_lab"].to_numpy(), matrix(rows["_v"])
            self.groups, self.starts = np.unique(self.labels, return_index=True)
            self.sizes = np.diff(np.append(self.starts, len(self.labels)))
            self.own_sum, self.own_n = np.zeros(len(self.ids)), np.zeros(len(self.ids), np.int64)
            self.near = np.full(len(self.ids), np.inf)
            self.open = None  # label, sums, count, largest, least above zero, rows of the same id
            self.pairs, self.held = [], 0
            self.order = np.argsort(self.ids, kind="stable")
            self.a = _lengths(self.m)
            # the left factor of all tiles of the block, and the place of a tile
            self.left = _left(self.m, self.a) if metric == "euclidean" and np.isfinite(self.a).all() else None
            self.place = np.empty((TILE, step))

        def tile(self, mine, m, b, right):
            if right is None:
                return distances(self.m[mine], m, metric)
            left = self.left[mine]
            d = self.place[:len(left), :len(m)]
            _tile(self.m[mine], self.a[mine], left, m, b, right, d)
            return d

        def add(self, rows):
            labels, m = rows.column("_lab").to_numpy(zero_copy_only=False), matrix(rows.column("_v"))
            ids = rows.column("_id").to_numpy(zero_copy_only=False)
            for s in range(0, len(labels), step):
                self.part(labels[s:s + step], m[s:s + step], ids[s:s + step])
            if self.held > 1 << 17:
                return self.drained()

        def part(self, labels, m, ids):
            cut = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
            ends = np.append(cut[1:], len(labels))
            sums, top, low, same = (np.empty((len(self.ids), len(cut))) for _ in range(4))
            same[:] = 0
            i_same, j_same = _equal(self.ids[self.order], self.order, ids) if unlike_ids else (np.zeros(0, np.int64),) * 2
            squares = _lengths(m)
            right = _right(m, squares) if self.left is not None and np.isfinite(squares).all() else None
            for r in range(0, len(self.ids), TILE):
                mine = slice(r, r + TILE)
                d = self.tile(mine, m, squares, right)
                if unlike_ids:
                    here = (i_same >= r) & (i_same < r + TILE)
                    d[i_same[here] - r, j_same[here]] = 0.0
                    np.add.at(same, (i_same[here], np.searchsorted(cut, j_same[here], "right") - 1), 1)
                if len(cut) <= 16:  # long stretches: sums of slices are faster
                    for c, (a, b) in enumerate(zip(cut, ends)):
                        piece = d[:, a:b]
                        piece.sum(axis=1, out=sums[mine, c])
                        piece.max(axis=1, out=top[mine, c])
                        piece.min(axis=1, out=low[mine, c])
                else:
                    np.add.reduceat(d, cut, axis=1, out=sums[mine])
                    np.maximum.reduceat(d, cut, axis=1, out=top[mine])
                    np.minimum.reduceat(d, cut, axis=1, out=low[mine])
                zero = np.flatnonzero(~(low[mine] > 0).all(axis=1))
                if len(zero):
                    part = d[zero]
                    low[r + zero] = np.minimum.reduceat(np.where(part > 0, part, np.inf), cut, axis=1)
            for c, (label, size) in enumerate(zip(labels[cut].tolist(), (ends - cut).tolist())):
                if self.open is not None and self.open[0] == label:
                    _, s, n, mx, mn, eq = self.open
                    self.open = (label, s + sums[:, c], n + size, np.maximum(mx, top[:, c]), np.minimum(mn, low[:, c]),
                                 eq + same[:, c])
                else:
                    self.close()
                    self.open = (label, *(sums[:, c], size, top[:, c], low[:, c], same[:, c]))

        def close(self):
            if self.open is None:
                return
            label, s, c, mx, mn, eq = self.open
            own = self.labels == label
            self.own_sum[own], self.own_n[own] = s[own], c - 1
            mean = s / c
            mean[own] = np.inf
            self.near = np.minimum(self.near, mean)
            alike = np.add.reduceat(eq, self.starts).astype(np.int64) if unlike_ids else self.sizes * (self.groups == label)
            count = self.sizes * c - alike
            kept = count > 0
            self.pairs.append((self.groups[kept], np.full(kept.sum(), label), np.add.reduceat(s, self.starts)[kept], count[kept],
                               np.maximum.reduceat(mx, self.starts)[kept], np.minimum.reduceat(mn, self.starts)[kept]))
            self.held += int(kept.sum())
            self.open = None

        def drained(self):
            label, other, s, c, mx, mn = (np.concatenate(x) for x in zip(*self.pairs))
            self.pairs, self.held = [], 0
            return batch(len(s), True, label=label, other=other, s=s, c=c, mx=mx, mn=mn)

        def result(self):
            self.close()
            mine = batch(len(self.ids), False, id=self.ids, label=self.labels, own_sum=self.own_sum, own_n=self.own_n, near=self.near)
            both = pa.Table.from_batches([mine, self.drained()] if self.pairs else [mine])
            return both.combine_chunks().to_batches()[0]

    return Block


def label_scan(df: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
               block_rows: int = DEFAULT_BLOCK_ROWS, step: int = 256, metric: str = "euclidean",
               unlike_ids: bool = False) -> DataFrame:
    """What the validity indices need of all pairs, in one streaming pass.

    A task holds one block of rows while all rows stream by in label order; it
    keeps running sums of the current label only.  Rows of two kinds come out:
    ``pair`` = false: one per row, ``id, label, own_sum, own_n`` (other rows of
    its label) and ``near`` (the least mean distance to another label);
    ``pair`` = true: one per block and pair of labels, ``label, other, s, c, mx,
    mn`` (ordered pairs of distinct rows, with ``unlike_ids`` of rows of unlike
    ids; ``mn`` over distances above zero)."""
    base = df.select(F.col(id_col).alias("_id"), F.col(label_col).cast("long").alias("_lab"),
                     _numbers(df, vec_col).alias("_v"))
    return block_scan(base, base, "_id", _label_sums(step, metric, unlike_ids), SCANNED, block_rows, ("_lab",), _parallel(df))


def scanned_rows(scan: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``(id, label, own_mean, near_mean)`` of a ``label_scan``: null where a row
    is alone in its label, or no other label exists."""
    rows = scan.where(~F.col("pair"))
    near = F.when(F.col("near") < float("inf"), F.col("near"))
    return rows.select(F.col("id").alias(id_col), "label", F.try_divide("own_sum", "own_n").alias("own_mean"),
                       near.alias("near_mean"))


def scanned_pairs(scan: DataFrame) -> DataFrame:
    """``label_pair_stats`` from a ``label_scan``."""
    g = scan.where("pair").groupBy(F.col("label").alias("label_i"), F.col("other").alias("label_j")).agg(
        F.sum("s").alias("sum_dist"), F.sum("c").alias("n_pairs"), F.max("mx").alias("max_dist"), F.min("mn").alias("mn"))
    return g.select("label_i", "label_j", "sum_dist", "n_pairs", "max_dist",
                    F.when(F.col("mn") < float("inf"), F.col("mn")).alias("min_nz_dist"))


# --------------------------------------------------------------------------
# query set x vector set: top-k by cosine similarity

def cross_topk(queries: DataFrame, vectors: DataFrame, k: int, qid_col: str = "qid",
               qvec_col: str = "qvec", exclude_col: str | None = "exclude", id_col: str = "vec_id",
               vec_col: str = "embedding", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(qid, rank, id, sim)``: the k vectors most cosine-similar to each
    query vector, ids listed in ``exclude`` skipped; ties by id
    (``stream_topk`` with cosine distance)."""
    ex = F.col(exclude_col) if exclude_col else F.lit(None).cast("array<long>")
    q = queries.select(F.col(qid_col).alias("_id"), F.transform(qvec_col, lambda v: v.cast("double")).alias("_v"),
                       ex.cast("array<long>").alias("_ex"))
    r = vectors.select(F.col(id_col).alias("_id"), F.transform(vec_col, lambda v: v.cast("double")).alias("_v"))
    out = stream_topk(q, r, k, "cosine", block_rows)
    return out.select(F.col("qid").alias(qid_col), "rank", F.col("id").alias(id_col), (1.0 - F.col("dist")).alias("sim"))
