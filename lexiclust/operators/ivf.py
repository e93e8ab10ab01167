"""Inverted-file index for cosine search: lists of unit vectors by nearest centre.

Centres are fitted by a few rounds of spherical k-means on a bounded sample (the
rows of least hash); every row is indexed.  A query searches the ``probes`` lists
whose centres are most similar to it, and what it finds there is ranked by the
exact similarity, so the only loss is a neighbour in a list that is not probed.
``probes`` is either given or measured: for a bounded sample of queries the exact
neighbours are found by a full scan, and the least number of probes that reaches
the target share of them is taken.

A long list is cut into parts of bounded size, and the queries of a list that many
probe are dealt over several tasks, so neither side of a popular list meets in one
task.  Traffic is ``queries * probes`` rows instead of every vector to every block.

Defined results: a zero or null vector is nobody's neighbour and a zero query finds
nothing; ties go by id; ids in a query's ``exclude`` are skipped; an empty index or
no queries give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import pairs as pr

#: rows that the centres are fitted on at most
SAMPLE_ROWS = 50_000
#: lists at most
MOST_LISTS = 4096
#: queries that the number of probes is measured with at most
SAMPLE_QUERIES = 512
#: vectors of a part of a list, and queries that meet it in one task
PART_ROWS = 8192


@dataclass
class Index:
    """``members`` has the rows ``id, v`` (not scaled) with ``list``; ``centres`` are unit rows."""
    members: DataFrame
    centres: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(norm > 0, norm, 1.0)[:, None]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _centres(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample; a centre that loses
    all its rows moves to the row that is least like its own centre."""
    unit = _unit(sample)
    centres = unit[np.linspace(0, len(unit) - 1, lists).astype(int)]
    for _ in range(rounds):
        sims = unit @ centres.T
        best = sims.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, unit)
        empty = np.flatnonzero(np.bincount(best, minlength=lists) == 0)
        sums[empty] = unit[np.argsort(sims.max(axis=1), kind="stable")[:len(empty)]]
        centres = _unit(sums)
    return centres


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None,
          rounds: int = 6, sample_rows: int = SAMPLE_ROWS) -> Index:
    """The index of all rows with a vector that is not zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()  # bounded
    if not n:
        return Index(rows.withColumn("list", F.lit(0)).limit(0), np.zeros((0, 0)))
    sample = np.array([r["v"] for r in sample], np.float64)
    lists = min(lists or max(1, math.isqrt(n)), MOST_LISTS, len(sample))
    centres = _centres(sample, lists, rounds)

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            of = np.concatenate([(m[s:s + 4096] @ centres.T).argmax(axis=1) for s in range(0, len(m), 4096)] or [np.zeros(0, int)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32))], names=["id", "v", "list"])

    return Index(cut_lineage(rows.mapInArrow(run, "id long, v array<double>, list int")), centres)


def _probed(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``list, qid, place`` of the ``probes`` best lists of every query, from 0."""
    probes = min(probes, len(centres))

    def run(batches):
        for batch in batches:
            sims = _unit(_matrix(batch.column(1))) @ centres.T
            order = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(order.ravel().astype(np.int32)), batch.column(0).take(pa.array(np.repeat(np.arange(len(sims)), probes))),
                 pa.array(np.tile(np.arange(probes, dtype=np.int32), len(sims)))], names=["list", "qid", "place"])

    return queries.select("qid", "qvec").mapInArrow(run, "list int, qid long, place int")


def measured_probes(index: Index, queries: DataFrame, k: int, target: float = 0.95, sample: int = SAMPLE_QUERIES) -> int:
    """The least number of probes that finds a share ``target`` of the exact ``k``
    nearest of a sample of ``queries(qid, qvec, exclude)``."""
    some = cut_lineage(queries.orderBy(F.xxhash64("qid"), "qid").limit(sample))
    exact = pr.cross_topk(some, index.members.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), k)
    true = exact.select("qid", "vec_id").join(index.members.select(F.col("id").alias("vec_id"), "list"), "vec_id")
    places = true.join(_probed(some, index.centres, len(index.centres)), ["list", "qid"]).groupBy("place").count()
    counts = np.zeros(max(1, len(index.centres)))
    for r in places.collect():  # one row a list
        counts[r["place"]] = r["count"]
    if not counts.sum():
        return len(counts)
    return int(np.searchsorted(np.cumsum(counts) / counts.sum(), target)) + 1


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, target: float = 0.95,
           part_rows: int = PART_ROWS) -> DataFrame:
    """``(qid, rank, vec_id, sim)``: the k most similar rows among the probed lists
    for ``queries(qid, qvec, exclude)``."""
    spark = queries.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], "qid long, rank long, vec_id long, sim double")
    queries = cut_lineage(queries.select(F.col("qid").cast("long").alias("qid"),
                                         F.transform("qvec", lambda x: x.cast("double")).alias("qvec"),
                                         F.col("exclude").cast("array<long>").alias("exclude"))
                          .where(F.exists("qvec", lambda x: x != 0)))
    probes = probes or measured_probes(index, queries, k, target)
    asked = cut_lineage(_probed(queries, index.centres, probes).select("list", "qid"))
    parts = index.members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    deals = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("deals"))
    sizes = parts.join(deals, "list")
    place = ["list", "part", "deal"]
    held = index.members.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(0).alias("role"), "id", "v",
        F.lit(None).cast("array<long>").alias("exclude"))
    coming = asked.join(sizes, "list").join(queries, "qid").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("qid"), F.col("deals")).cast("int").alias("deal"), F.lit(1).alias("role"),
        F.col("qid").alias("id"), F.col("qvec").alias("v"), "exclude")
    met = held.unionByName(coming).repartition(*place).sortWithinPartitions(*place, "role")

    def run(batches):
        at, mine = None, []
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if a == b:
                    continue
                key, role, part = tuple(keys[a, :3].tolist()), keys[a, 3], batch.slice(a, b - a)
                if key != at:
                    at, mine = key, []
                ids, m = part.column(4).to_numpy(), _matrix(part.column(5))
                if role == 0:
                    mine.append((ids, m))
                    continue
                if not mine:
                    continue
                own_ids, own = (np.concatenate(x) for x in zip(*mine))
                mine = [(own_ids, own)]
                skip = part.column(6).to_pylist()
                for s in range(0, len(ids), 256):
                    d = pr.distances(m[s:s + 256], own, metric="cosine")
                    for i, e in enumerate(skip[s:s + 256]):
                        if e:
                            d[i, np.isin(own_ids, e)] = np.inf
                    n = min(k, d.shape[1])
                    worst = np.partition(d, n - 1, axis=1)[:, n - 1]
                    i, j = np.nonzero((d <= worst[:, None]) & np.isfinite(d))
                    order = np.lexsort((own_ids[j], d[i, j], i))
                    i, j = i[order], j[order]
                    heads = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
                    keep = np.arange(len(i)) - np.repeat(heads, np.diff(np.append(heads, len(i)))) < k
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:s + 256][i]), pa.array(own_ids[j]), pa.array(d[i, j])],
                                                     names=["qid", "vec_id", "dist"])

    found = met.mapInArrow(run, "qid long, vec_id long, dist double")  # k rows a query and probed part
    best = Window.partitionBy("qid").orderBy("dist", "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", (1.0 - F.col("dist")).alias("sim"))
