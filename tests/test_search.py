"""Neighbour graph, metric radius join and inverted-file index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import ivf
from lexiclust.operators import metric as me
from lexiclust.operators import neighbours as nb
from lexiclust.operators import pairs as pr


def frame(spark, pts, **columns):
    names = list(columns)
    rows = [(i, [float(x) for x in p], *(columns[c][i] for c in names)) for i, p in enumerate(pts)]
    kinds = {"r": "double", "o": "long"}
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>" + "".join(f", {c} {kinds[c]}" for c in names))


def distances(pts):
    return np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    parts = [rng.normal(c, 0.3, size=(90, 3)) for c in [(0, 0, 0), (8, 8, 0), (0, 9, 9)]]
    return np.vstack([*parts, np.zeros((150, 3))])  # more than a third are copies of one row


# -------------------------------------------------------------- neighbour graph

def test_graph_recall_on_spread_points(spark):
    pts = np.random.default_rng(4).normal(size=(1500, 24))
    k = 8
    got = nb.knn_graph(frame(spark, pts).repartition(5), k, chunk=64).toPandas()
    d = distances(pts)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, axis=1)[:, :k]
    assert (got.groupby("vec_id").size() == k).all()
    hits = sum(len(set(g.nbr_id) & set(true[i])) for i, g in got.groupby("vec_id"))
    assert hits / true.size >= 0.95
    assert np.allclose(got.dist, d[got.vec_id, got.nbr_id])  # exact distances, ranked by (dist, id)
    for _, g in got.sort_values(["vec_id", "rank"]).head(400).groupby("vec_id"):
        assert list(zip(g.dist, g.nbr_id)) == sorted(zip(g.dist, g.nbr_id)) and list(g["rank"]) == list(range(1, k + 1))


def test_graph_of_copies_makes_no_hub(spark, blobs):
    got = nb.knn_graph(frame(spark, blobs), 5, spare=6, chunk=40).toPandas()
    assert (got.groupby("vec_id").size() == 5).all() and (got.vec_id != got.nbr_id).all()
    assert (got[got.vec_id >= 270].dist == 0).all()
    listed = nb.knn_graph(frame(spark, np.zeros((400, 2))), 4, spare=4, chunk=40).groupBy("nbr_id").count()
    assert listed.agg(F.max("count")).first()[0] < 100  # by id alone four rows would be listed 400 times


def test_graph_of_few_rows(spark):
    assert nb.knn_graph(frame(spark, np.zeros((1, 2))).limit(0), 3).count() == 0
    assert nb.knn_graph(frame(spark, np.zeros((1, 2))), 3).count() == 0
    got = {(r.vec_id, r["rank"], r.nbr_id) for r in nb.knn_graph(frame(spark, np.array([[0.0], [1.0], [3.0]])), 5).collect()}
    assert got == {(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0)}


def test_exact_neighbours_by_graph(spark, blobs):
    df = frame(spark, blobs)
    poor = nb.knn_graph(df, 4, spare=0, tables=1, chunk=16, rounds=0)  # a bad graph: the bound is loose, the result exact
    assert sorted(me.knn_by_graph(df, poor, 4, block_rows=32).collect()) == sorted(pr.knn(df, 4).collect())
    some = poor.where("vec_id % 3 = 0")  # rows that the graph does not know search everywhere
    assert sorted(me.knn_by_graph(df, some, 4, block_rows=32).collect()) == sorted(pr.knn(df, 4).collect())


# ------------------------------------------------------------------ radius join

@pytest.mark.parametrize("order", [None, "o"])
def test_radius_join_against_brute_force(spark, blobs, order):
    rng = np.random.default_rng(2)
    r, o = rng.uniform(0, 0.6, len(blobs)).tolist(), rng.permutation(len(blobs)).tolist()
    r[3], r[4], r[5], r[6] = float("inf"), 0.0, None, float("nan")
    df = frame(spark, blobs, r=r, o=o).repartition(4)
    d = distances(blobs)
    want = {(i, j) for i in range(len(blobs)) for j in range(len(blobs)) if i != j and r[i] is not None and d[i, j] <= r[i]
            and (order is None or o[j] < o[i])}
    for block_rows in (16, 2048):
        got = me.radius_join(df, "r", order, block_rows=block_rows).collect()
        assert len(got) == len(want) and {(x.vec_id, x.nbr_id) for x in got} == want
        assert np.allclose([x.dist for x in got], [d[x.vec_id, x.nbr_id] for x in got])


def test_radius_join_visits_few_blocks_of_clustered_rows(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack([rng.normal(c, 0.05, size=(100, 2)) for c in rng.uniform(0, 50, size=(12, 2))])
    df = frame(spark, pts).withColumn("r", F.lit(0.1))
    assert me.visited_share(df, "r", block_rows=25) < 0.2
    assert me.radius_join(df.limit(0), "r").count() == 0


# ------------------------------------------------------------ inverted-file index

def queries_of(df):
    return df.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.array("vec_id").alias("exclude"))


def test_index_of_all_lists_equals_full_scan(spark):
    pts = np.random.default_rng(5).normal(size=(300, 6))
    pts[10:60] = pts[10]  # copies
    df = frame(spark, pts)
    index = ivf.build(df, lists=9)
    exact = pr.cross_topk(queries_of(df), df, 7)
    got = ivf.search(index, queries_of(df), 7, probes=9, part_rows=20)
    rounded = [F.col("qid"), F.col("rank"), F.col("vec_id"), F.round("sim", 9).alias("sim")]
    assert sorted(got.select(*rounded).collect()) == sorted(exact.select(*rounded).collect())


def test_index_measures_its_probes(spark):
    rng = np.random.default_rng(6)
    pts = np.vstack([c + 0.15 * rng.normal(size=(60, 8)) for c in 3 * rng.normal(size=(15, 8))])
    df = frame(spark, pts).repartition(3)
    index = ivf.build(df, lists=15)
    probes = ivf.measured_probes(index, queries_of(df), 5, target=0.95)
    assert 1 <= probes <= 6  # clustered rows: few lists hold nearly all neighbours
    share = nb.recall(ivf.search(index, queries_of(df), 5), pr.cross_topk(queries_of(df), df, 5), ["qid", "vec_id"])
    assert df.limit(1).select(share).first()[0] >= 0.9


def test_index_edges(spark):
    df = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 2.0]]))
    index = ivf.build(df)
    got = sorted((r.qid, r["rank"], r.vec_id) for r in ivf.search(index, queries_of(df), 5, probes=9).collect())
    assert got == [(1, 1, 2), (2, 1, 1)]  # the zero row neither asks nor answers
    assert ivf.search(ivf.build(df.limit(0)), queries_of(df), 5).count() == 0
    assert ivf.search(index, queries_of(df).limit(0), 5).count() == 0
