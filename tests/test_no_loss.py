"""Rows, lines and characters that must survive: splits, files, blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiclust.operators import pairs, reduce, sampling, vectors
from lexiclust.session import ensure_checkpoint_dir
from lexiclust.sources import files as fs


@pytest.mark.parametrize("n", [0, 1, 2, 19, 100])
@pytest.mark.parametrize("parts", [{"train": 0.8, "val": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.5}])
def test_fraction_splits_keep_every_row(spark, n, parts):
    got = sampling.split_fractions(spark.range(n), parts, ["id"]).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in got}
    assert sum(sizes.values()) == n
    names = list(parts)
    for name in names[:-1]:
        assert sizes.get(name, 0) == int(parts[name] * n)


def test_counted_splits_may_leave_rows(spark):
    got = sampling.split_exact(spark.range(20), {"a": 5, "b": 7}, ["id"]).count()
    assert got == 12


def test_more_components_than_dimensions_raise(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        reduce.pca_fit(df, 3)


def test_centres_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)]
    centres = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cen = spark.createDataFrame(centres, "label long, centroid array<double>")
    one = vectors.nearest_centroid(df, cen).orderBy("vec_id").collect()
    assert vectors.nearest_centroid(df, cen, max_values=9).orderBy("vec_id").collect() == one


def test_a_zero_vector_costs_no_answers(spark):
    rows = [(0, [0.0, 0.0])] + [(i, [float(i), 1.0]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id = 3").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v"))
    got = pairs.stream_topk(q.select("_id", "_v", F.lit(None).cast("array<long>").alias("_ex")),
                            df.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_v")), 5, metric="cosine").collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5] and 0 not in {r["id"] for r in got}


def test_vocabulary_and_matrix_stay_aligned_over_uneven_files(spark, tmp_path):
    words = [f"w{i:05d}" for i in range(500)]
    folder = tmp_path / "vocab"
    folder.mkdir()
    cuts = [0, 10, 400, 405, 500]  # the second file is the largest: file size must not decide the order
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        (folder / f"part-{k:05d}.txt").write_text("\n".join(words[a:b]) + "\n")
    vecs = spark.createDataFrame([(i, [float(i)]) for i in range(500)], "vec_id long, embedding array<float>")
    fs.sink_vectors(vecs.repartition(7), str(tmp_path / "matrix"))
    got = fs.scan_vector_matrix(spark, str(tmp_path / "matrix"), str(folder)).collect()
    assert len(got) == 500 and all(r["word"] == words[r["vec_id"]] == words[r["idx"]] for r in got)


def test_keyed_vectors_order_and_one_dimension(spark, tmp_path):
    rows = [(f"w{i}", [float(i)], i) for i in range(120)]
    df = spark.createDataFrame(rows, "word string, embedding array<float>, idx long").repartition(5)
    path = str(tmp_path / "w2v")
    fs.sink_keyed_vectors(df, path, order_col="idx")
    lines = [x for f in sorted((tmp_path / "w2v").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["120 1"] + [f"w{i} {float(i)}" for i in range(120)]
    back = fs.scan_keyed_vectors(spark, path)
    assert fs.roundtrip_equal(df.select("word", "embedding"), back).first()[:] == (0, 0)
    bad = tmp_path / "bad.txt"
    bad.write_text("2 3\na 1 2 3\nb 1 2\n")
    with pytest.raises(Exception, match="not a word and 3 numbers"):
        fs.scan_keyed_vectors(spark, str(bad)).collect()
    bad.write_text("a 1 2 3\n")
    with pytest.raises(ValueError):
        fs.scan_keyed_vectors(spark, str(bad))
    same = tmp_path / "same.txt"
    same.write_text("2 1\n2 1\nb 5\n")
    assert sorted(r["word"] for r in fs.scan_keyed_vectors(spark, str(same)).collect()) == ["2", "b"]


def test_corpus_files_come_back_equal(spark, tmp_path):
    rows = [("a b", "t (x)", "one\ntwo"), ("a b", "u (y)", "ends with a line\n"), ("c", "v (x)", "")]
    df = spark.createDataFrame(rows, "author string, title string, text string")
    fs.sink_corpus_files(df, str(tmp_path / "c"))
    got = fs.scan_named_corpus(spark, str(tmp_path / "c"))
    assert sorted((r["author"], r["name"], r["text"]) for r in got.collect()) == sorted((a, t + ".txt", x) for a, t, x in rows)


def test_a_cluster_without_checkpoint_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
