"""Searches whose cost must not outgrow the rows: single precision rules pairs out,
rows travel to a bounded number of bins, shared passes run once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import extremes, metric, pairs as pr
from lexiclust.operators import validity as va
from lexiclust.operators import wishart as wi


def frame(spark, pts, kind="double"):
    rows = [(i, int(i) % 3, [float(x) for x in p]) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, f"vec_id long, label long, embedding array<{kind}>")


@pytest.mark.parametrize("offset, scale", [(0.0, 1.0), (1e4, 1.0), (1e8, 1.0), (0.0, 1e-20), (0.0, 1e20)])
def test_single_precision_loses_no_pair(offset, scale):
    rng = np.random.default_rng(3)
    x, y = (rng.normal(size=(n, 12)) * scale + offset for n in (150, 170))
    square = ((x[:, None] - y[None]) ** 2).sum(-1)
    limit = np.quantile(square, 0.02, axis=1)
    i, j = pr.Near(x).within(slice(0, 150), pr.near_tile(y), limit)
    found = np.zeros(square.shape, bool)
    found[i, j] = True
    assert found[square <= limit[:, None]].all()
    if offset == 0:
        assert found.sum() < 0.2 * found.size


def test_single_numbers_travel_as_single_numbers(spark):
    pts = np.random.default_rng(5).normal(size=(40, 3))
    single = pr.knn(frame(spark, pts, "float"), 2)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "as array<double>" not in plan
    own = pts.astype(np.float32).astype(np.float64)
    d = np.sqrt(((own[:, None] - own[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = single.toPandas().sort_values(["vec_id", "rank"])["nbr_id"].to_numpy().reshape(-1, 2)
    assert (got == np.argsort(d, axis=1)[:, :2]).all()


@pytest.mark.parametrize("bins", [3, 48])
def test_rows_travel_to_a_bounded_number_of_bins(spark, monkeypatch, bins):
    """All distances alike: every row meets every block, and is sent once a bin."""
    monkeypatch.setattr(metric, "MOST_BINS", bins)
    monkeypatch.setattr(metric, "BIN_ROWS", 20)
    pts = np.random.default_rng(6).normal(size=(300, 24))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    radius = np.quantile(d, 0.05)
    asked = frame(spark, pts).withColumn("r", F.lit(float(radius)))
    near = metric.radius_join(asked, "r", block_rows=4)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius)) if i != j}
    assert {(r["vec_id"], r["nbr_id"]) for r in near.collect()} == want
    assert near.rdd.getNumPartitions() <= min(bins, 15)


def test_repeated_ids_ask_with_each_radius_for_each_vector(spark):
    rows = [(1, [0.0, 0.0], 1.5), (1, [5.0, 0.0], 0.5), (2, [1.0, 0.0], 0.1), (3, [5.2, 0.0], 0.1), (None, [5.2, 0.0], 9.0)]
    f = spark.createDataFrame(rows, "vec_id long, embedding array<double>, r double")
    near = metric.radius_search(f, f.where("vec_id > 1"), "r", apart=None)
    got = sorted((r["vec_id"], r["nbr_id"]) for r in near.collect())
    assert got == [(1, 2), (1, 3), (1, 3), (2, 2), (3, 3)]


def test_few_points_are_searched_by_several_tasks(spark):
    pts = np.random.default_rng(7).normal(size=(3000, 2))
    near = metric.radius_search(frame(spark, pts).withColumn("r", F.lit(0.5)), frame(spark, pts[:5]), "r")
    d = np.sqrt(((pts[:, None] - pts[None, :5]) ** 2).sum(-1))
    assert near.count() == (d <= 0.5).sum()
    assert near.rdd.getNumPartitions() > 3


def test_report_takes_dunn_from_the_pair_pass(spark, monkeypatch):
    pts = np.random.default_rng(8).normal(size=(60, 3))
    alone = va.ClusterValidity(frame(spark, pts)).dunn().first()["value"]

    def refuse(*a, **k):
        raise AssertionError("the pairs are known")

    monkeypatch.setattr(extremes, "diameters", refuse)
    monkeypatch.setattr(extremes, "label_gap", refuse)
    report = {r["metric"]: r["value"] for r in va.ClusterValidity(frame(spark, pts)).run_all(calc_hubert=False).collect()}
    assert len(report) == 11 and np.isclose(report["dunn"], alone, rtol=1e-12)


def test_components_of_a_long_path(spark):
    n = 70
    order = np.random.default_rng(9).permutation(n) - 20
    edges = [(int(a), int(b)) for a, b in zip(order[:-1], order[1:])] + [(100, 101), (101, 102), (7_000, 7_000)]
    got = {r["id"]: r["comp"] for r in wi.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{int(i): -20 for i in order}, 100: 100, 101: 100, 102: 100, 7_000: 7_000}


def test_cvnn_alone_forms_pairs_of_equal_labels_only(spark, monkeypatch):
    """Same value as from the pair pass; a label of one row and repeated ids included."""
    pts = np.random.default_rng(11).normal(size=(70, 5))
    rows = [(i % 66, 9 if i == 5 else i % 3, [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    full = va.ClusterValidity(df, n_neighbors=4, block_rows=16)
    assert full.scan is not None
    want = full.cvnn().first().value

    def no_scan(*args, **kwargs):
        raise AssertionError("pairs of unlike labels")

    monkeypatch.setattr(pr, "label_scan", no_scan)
    assert va.ClusterValidity(df, n_neighbors=4, block_rows=16).cvnn().first().value == pytest.approx(want, rel=1e-12)


def test_cvnn_leaves_rows_without_a_label_out_of_the_pairs(spark):
    pts = np.random.default_rng(14).normal(size=(60, 5))
    label = np.arange(60) % 3
    rows = [(i, None if i % 20 == 7 else int(label[i]), [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    known = np.arange(60) % 20 != 7
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    want = 0
    for c in range(3):
        mine = np.flatnonzero(known & (label == c))
        want += d[np.ix_(mine, mine)].sum() / (len(mine) * (len(mine) - 1))
    got = va.ClusterValidity(df, block_rows=16).within().toPandas()
    assert (got["sum_dist"] / got["n_pairs"]).sum() == pytest.approx(want, rel=1e-12)


def test_a_strip_of_several_tiles_loses_no_pair(monkeypatch):
    monkeypatch.setattr(pr, "TILE", 32)
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(40, 12)), rng.normal(size=(300, 12))
    square = ((x[:, None] - y[None]) ** 2).sum(-1)
    limit = np.partition(square, 3, axis=1)[:, 3]
    i, j = pr.Near(x).within(slice(0, 40), pr.near_tile(y), limit)
    found = np.zeros(square.shape, int)
    np.add.at(found, (i, j), 1)
    assert found.max() == 1 and found[square <= limit[:, None]].all() and found.sum() < 0.05 * found.size


def test_wide_strips_rank_as_before(spark, monkeypatch):
    monkeypatch.setattr(pr, "TILE", 16)
    monkeypatch.setattr(pr, "WIDE", 64)
    pts = np.random.default_rng(13).normal(size=(400, 6))
    pts[350:] = pts[:50]  # copies tie by id
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = pr.knn(frame(spark, pts), 3, block_rows=100).toPandas().sort_values(["vec_id", "rank"])
    assert (got["nbr_id"].to_numpy().reshape(-1, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()
