"""Approximate nearest-neighbour graph by descent over neighbours of neighbours.

Whoever is near to a common neighbour is likely near to each other.  Each row
keeps ``width`` nearest rows found so far; in a round the rows that list a node
and the rows that it lists meet at that node, their distances are taken, and
those that beat a row's worst neighbour are sent to it.  Rounds end when few
neighbours change.  Work and traffic grow with ``n * width``, never with the
number of row blocks: no row is copied to all blocks.

* The first graph comes from several cuts of the rows into chunks of bounded size:
  rows sorted by their nearest of some pivots and a projection, so that near rows
  share a chunk often and copies or dense regions make no hot key.
* A node that many rows list is split: its listers are dealt over salts of about
  ``width`` rows, each of which also gets the rows that the node lists.
* Only candidates that improve a row leave a task, at most ``width`` for each row
  and output batch.  Equally distant rows are preferred by a hash of the pair,
  so copies list unlike copies and none is listed by all.
* Distances are exact (float64, as in the exact join), so the result is the
  exact ranking of the candidates found; recall is what ``recall`` measures.

Defined results: fewer than ``k`` other rows give shorter lists; equal vectors are
neighbours at distance 0; ids must be unique; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: rows that are compared with each other in the first graph
CHUNK = 4096
#: cuts of the rows into such chunks
TABLES = 8
#: pivots of a cut, at most
MOST_PIVOTS = 1024
#: neighbours kept for each row beyond those asked for, at least
SPARE = 22
EDGES = "array<struct<dist: double, tie: long, id: long>>"
_LIST = pa.list_(pa.struct([("dist", pa.float64()), ("tie", pa.int64()), ("id", pa.int64())]))


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each ordered pair, spread evenly."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(2)).astype(np.int64)


def _candidates(ids: np.ndarray, m: np.ndarray, worst: np.ndarray, fresh: np.ndarray):
    """``(row, other, dist)`` of the pairs of which one is fresh and which beat
    the row's worst distance."""
    norms = np.einsum("ij,ij->i", m, m)
    rough = norms[:, None] + norms[None, :] - 2.0 * (m @ m.T)
    slack = 1e-9 * (norms[:, None] + norms[None, :])  # of the dot-product form
    near = (rough - slack <= np.square(worst)[:, None]) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
    i, j = np.nonzero(near)
    diff = m[i] - m[j]
    d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    better = d < worst[i]
    return ids[i[better]], ids[j[better]], d[better]


class _Best:
    """Candidate edges of a task, cut to the best ``width`` of each row on the way."""

    def __init__(self, width: int, size: int = 1_000_000):
        self.width, self.size, self.parts, self.held = width, size, [], 0

    def add(self, part):
        self.parts.append(part)
        self.held += len(part[0])
        if self.held >= self.size:
            yield self.batch()

    def batch(self):
        a, b, d = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        tie = _tie(a, b)
        order = np.lexsort((b, tie, d, a))
        a, b, d, tie = a[order], b[order], d[order], tie[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))  # equal pairs are neighbours in this order
        a, b, d, tie = a[new], b[new], d[new], tie[new]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rank = np.arange(len(a)) - np.repeat(heads, np.diff(np.append(heads, len(a))))
        keep = rank < self.width
        a, b, d, tie = a[keep], b[keep], d[keep], tie[keep]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(heads, len(a)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(d), pa.array(tie), pa.array(b)], names=["dist", "tie", "id"]))
        return pa.RecordBatch.from_arrays([pa.array(a[heads]), lists], names=["node", "found"])

    def rest(self):
        if self.held:
            yield self.batch()


def _edges(column) -> tuple[np.ndarray, ...]:
    """The edges of an Arrow list column: number of the row, distance, tie, id."""
    sizes = np.diff(column.offsets.to_numpy())  # no list is null
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *(flat.field(i).to_numpy() for i in range(3))


def _merged(state: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """``id, near, fresh``: the best ``width`` of the old and the found edges of
    each row, and which of them are new."""
    lists = found.groupBy("node").agg(F.flatten(F.collect_list("found")).alias("_found"))  # width for each task at most
    none = F.array().cast(EDGES)
    joined = state.join(lists, state["id"] == lists["node"], "left")

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                old, new = _edges(part.column(1)), _edges(part.column(2))
                row, d, tie, ids = (np.concatenate(x) for x in zip(old, new))
                fresh = np.arange(len(row)) >= len(old[0])
                order = np.lexsort((fresh, ids, tie, d, row))  # of equal edges the old one comes first
                row, d, tie, ids, fresh = row[order], d[order], tie[order], ids[order], fresh[order]
                first = np.ones(len(row), bool)
                first[1:] = (row[1:] != row[:-1]) | (d[1:] != d[:-1]) | (tie[1:] != tie[:-1]) | (ids[1:] != ids[:-1])
                row, d, tie, ids, fresh = row[first], d[first], tie[first], ids[first], fresh[first]
                sizes = np.bincount(row, minlength=part.num_rows)
                keep = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < width
                ends = pa.array(np.append(0, np.cumsum(np.minimum(sizes, width))), pa.int32())
                edges = pa.StructArray.from_arrays([pa.array(x[keep]) for x in (d, tie, ids)], names=["dist", "tie", "id"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, edges), pa.ListArray.from_arrays(ends, pa.array(fresh[keep]))],
                    names=["id", "near", "fresh"])

    return joined.select("id", "near", F.coalesce("_found", none).alias("_found")).mapInArrow(
        run, f"id long, near {EDGES}, fresh array<boolean>")


def _cells(rows: DataFrame, pivots: np.ndarray, w: np.ndarray) -> DataFrame:
    """``id, v, cell, along``: the nearest pivot and the projection on ``w``."""
    half = np.einsum("ij,ij->i", pivots, pivots) / 2

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            cell = np.concatenate([(m[s:s + 2048] @ pivots.T - half).argmax(axis=1) for s in range(0, len(m), 2048)] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(m @ w if len(m) else np.zeros(0))],
                                             names=["id", "v", "cell", "along"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.select("id", "v").mapInArrow(run, f"id long, v {kind}, cell int, along double")


def _first_graph(rows: DataFrame, width: int, tables: int, chunk: int, seed: int) -> DataFrame:
    """Each table cuts the rows anew, into chunks of rows with the same nearest of
    some pivots (drawn by a hash, a chunk's number of rows to each); rows of a cell
    are ordered by a projection, so that large cells are cut along it."""
    state = rows.select("id", F.array().cast(EDGES).alias("near"), F.array().cast("array<boolean>").alias("fresh"))
    n, dim = rows.count(), rows.select(F.size("v").alias("d")).first()["d"]
    most = min(MOST_PIVOTS, max(1, n // chunk))
    rng, found = np.random.default_rng(seed), None
    for t in range(tables if n > chunk else 1):  # one chunk holds all pairs
        picked = rows.select("v").orderBy(F.xxhash64("id", F.lit(seed), F.lit(t)), "id").limit(most).collect()
        ordered = _cells(rows, np.array([r["v"] for r in picked], np.float64), rng.normal(size=dim))
        ordered = ordered.repartitionByRange("cell", "along", F.xxhash64("id")).sortWithinPartitions("cell", "along", F.xxhash64("id"))

        def run(batches):
            best, ids, vectors = _Best(width), [], []
            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                vectors.append(_matrix(batch.column(1)))
                while sum(map(len, ids)) >= 2 * chunk:  # the last chunk holds up to two
                    i, m = np.concatenate(ids), np.concatenate(vectors)
                    for part in _nearest(i[:chunk], m[:chunk], width):
                        yield from best.add(part)
                    ids, vectors = [i[chunk:]], [m[chunk:]]
            if ids:
                for part in _nearest(np.concatenate(ids), np.concatenate(vectors), width):
                    yield from best.add(part)
            yield from best.rest()

        part = ordered.select("id", "v").mapInArrow(run, f"node long, found {EDGES}")
        found = part if found is None else found.unionByName(part)
    return _merged(state, found, width)


def _nearest(ids, m, width, strip: int = 512):
    """All of the ``width`` nearest within a chunk, by strips of rows."""
    norms = np.einsum("ij,ij->i", m, m)
    k = min(width, len(ids) - 1)
    for s in range(0, len(ids) if k > 0 else 0, strip):
        x = m[s:s + strip]
        rough = norms[s:s + strip, None] + norms[None, :] - 2.0 * (x @ m.T)
        own = np.arange(len(x))
        rough[own, own + s] = np.inf
        j = np.argpartition(rough, k - 1, axis=1)[:, :k].ravel()
        i = np.repeat(own + s, k)
        diff = m[i] - m[j]
        yield ids[i], ids[j], np.sqrt(np.einsum("ij,ij->i", diff, diff))


def _meetings(rows: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """``node, salt, id, v, worst, fresh``: at each node the rows it lists (in
    every salt) and the rows that list it (each in one)."""
    worst = F.when(F.size("near") >= width, F.col("near")[width - 1]["dist"]).otherwise(F.lit(float("inf")))
    edges = state.select(F.col("id").alias("a"), F.explode(F.arrays_zip("near", "fresh")).alias("e")).select(
        "a", F.col("e.near.id").alias("b"), F.col("e.fresh").alias("fresh"))
    listed = edges.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / (2 * width)).cast("int").alias("salts"))
    salted = edges.join(listed, "b")
    listers = salted.select(F.col("b").alias("node"), F.pmod(F.xxhash64("a", "b"), F.col("salts")).cast("int").alias("salt"),
                            F.col("a").alias("id"), "fresh")
    own = edges.join(listed.select(F.col("b").alias("a"), "salts"), "a", "left").select(
        F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"),
        F.col("b").alias("id"), "fresh")
    members = listers.unionByName(own).groupBy("node", "salt", "id").agg(F.max("fresh").alias("fresh"))
    carried = rows.join(state.select("id", worst.alias("worst")), "id")
    return members.join(carried, "id").select("node", "salt", "id", "v", "worst", "fresh")


def _compared(met: DataFrame, width: int) -> DataFrame:
    ordered = met.repartition("node", "salt").sortWithinPartitions("node", "salt")

    def run(batches):
        best, held = _Best(width), []  # the rows of the last meeting of a batch wait for the next batch
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            node, salt = table.column(0).to_numpy(), table.column(1).to_numpy()
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (salt[1:] != salt[:-1])) + 1
            done = cuts[-1] if len(cuts) else 0
            yield from _groups(table.slice(0, done), cuts[:-1], best)
            held = [table.slice(done)]
        if held:
            yield from _groups(held[0], [], best)
        yield from best.rest()

    def _groups(batch, cuts, best):
        if not batch.num_rows:
            return
        ids, m = batch.column(2).to_numpy(), _matrix(batch.column(3))
        worst, fresh = batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if fresh[a:b].any():
                yield from best.add(_candidates(ids[a:b], m[a:b], worst[a:b], fresh[a:b]))

    return ordered.mapInArrow(run, f"node long, found {EDGES}")


def knn_graph(df: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", spare: int | None = None,
              tables: int = TABLES, chunk: int = CHUNK, rounds: int = 12, settled: float = 0.02, seed: int = 7) -> DataFrame:
    """``(id, rank, nbr_id, dist)``: nearly the ``k`` nearest other rows of each row,
    ranked by ``(dist, nbr_id)``; ``spare`` more are kept on the way, where not
    given more of them the more rows there are (5 for each doubling).  Rounds end
    when less than a share ``settled`` of the lists is new."""
    # single numbers travel as such and the tasks widen them
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast(kind)).alias("v"))
    rows = cut_lineage(rows)
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], f"{id_col} long, rank long, nbr_id long, dist double")
    if spare is None:
        spare = max(SPARE, math.ceil(5 * math.log2(rows.count())) - 33)
    width = k + spare
    state = cut_lineage(_first_graph(rows, width, tables, chunk, seed))
    for _ in range(rounds):
        state = cut_lineage(_merged(state, _compared(_meetings(rows, state, width), width), width))
        new, held = state.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("near"))).first()
        if new <= settled * held:
            break
    best = F.slice(F.array_sort(F.transform("near", lambda e: F.struct(e["dist"].alias("dist"), e["id"].alias("nbr_id")))), 1, k)
    out = state.select("id", F.posexplode(best).alias("rank", "e"))
    return out.select(F.col("id").alias(id_col), (F.col("rank") + 1).cast("long").alias("rank"), "e.nbr_id", "e.dist")


def recall(found: DataFrame, exact: DataFrame, on: list[str]) -> Column:
    """Share of the rows of ``exact`` that ``found`` holds too, as a scalar."""
    hits = exact.select(*on).join(found.select(*on).withColumn("_hit", F.lit(1)), on, "left")
    return hits.agg(F.try_divide(F.count("_hit"), F.count(F.lit(1)))).scalar()
