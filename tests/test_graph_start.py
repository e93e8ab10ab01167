"""The neighbour graph starts from cells of near rows, and its lists merge in numpy."""

import numpy as np
from pyspark.sql import functions as F

from lexiclust.operators import neighbours as nb


def test_the_first_graph_holds_most_neighbours(spark):
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(30, 24))[rng.integers(0, 30, 1500)] + 0.2 * rng.normal(size=(1500, 24))
    d = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1)[:, :5]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, embedding array<double>")
    got = nb.knn_graph(df, 5, spare=3, chunk=64, rounds=0).toPandas()
    assert len(got) == 7500
    hits = sum(r.nbr_id in best[r.vec_id] for r in got.itertuples())
    assert hits > 0.8 * 7500


def test_merged_lists(spark):
    """The best of old and found edges; equal edges count once, and as old."""
    edge = "struct<dist: double, tie: long, id: long>"
    state = spark.createDataFrame([(1, [(1.0, 5, 2), (3.0, 1, 3)]), (2, []), (3, [(0.5, 1, 1)])], f"id long, near array<{edge}>")
    found = spark.createDataFrame([(1, [(1.0, 5, 2), (2.0, 1, 4)]), (1, [(2.0, 0, 5), (9.0, 0, 6)]), (2, [(7.0, 0, 1)])],
                                  f"node long, found array<{edge}>")
    merged = nb._merged(state.withColumn("fresh", F.array().cast("array<boolean>")), found, 3)
    assert "array_distinct" not in merged._jdf.queryExecution().optimizedPlan().toString()  # compares each edge with each
    got = {r["id"]: ([(e["dist"], e["tie"], e["id"]) for e in r["near"]], r["fresh"]) for r in merged.collect()}
    assert got == {1: ([(1.0, 5, 2), (2.0, 0, 5), (2.0, 1, 4)], [False, True, True]), 2: ([(7.0, 0, 1)], [True]),
                   3: ([(0.5, 1, 1)], [False])}
