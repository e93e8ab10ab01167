"""File sources and sinks."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lexiclust.sources import named_files as nf
from lexiclust.sources import files as fs


def test_scan_corpus_files_reference_layout(spark):
    root = tempfile.mkdtemp(prefix="lexiclust-corpus-", dir="/tmp")
    docs = {("Jane Doe", "First Book (Novel).txt"): "Line one.\n\nLine two!",
            ("Jane Doe", "Verses (Poetry).txt"): "A\nB",
            ("Ann Roe", "Notes (Essay).txt"): "x"}
    for (author, title), text in docs.items():
        os.makedirs(f"{root}/{author}", exist_ok=True)
        with open(f"{root}/{author}/{title}", "w") as f:
            f.write(text)
    got = {(r["author"], r["name"]): (r["style"], r["text"])
           for r in fs.scan_corpus_files(spark, f"{root}/*/*.txt").collect()}
    assert got == {(a, t): (t[t.index("(") + 1:t.index(")")], x) for (a, t), x in docs.items()}


def test_keyed_vectors_text_roundtrip(spark):
    out = tempfile.mkdtemp(prefix="lexiclust-w2v-", dir="/tmp")
    rows = [(f"w{i}", [float(i), i / 3.0, -1.5]) for i in range(40)]
    df = spark.createDataFrame(rows, "word string, embedding array<float>")
    fs.sink_keyed_vectors(df, f"{out}/v")
    parts = sorted(glob.glob(f"{out}/v/part-*"))
    with open(parts[0]) as f:
        assert f.readline().strip() == "40 3"
    back = fs.scan_keyed_vectors(spark, f"{out}/v")
    r = fs.roundtrip_equal(df, back).first()
    assert (r["only_left"], r["only_right"]) == (0, 0)


def test_vector_matrix_zip(spark):
    out = tempfile.mkdtemp(prefix="lexiclust-mat-", dir="/tmp")
    spark.createDataFrame([(10 + i, [float(i)]) for i in range(5)], "vec_id long, embedding array<float>") \
        .write.parquet(f"{out}/m")
    with open(f"{out}/vocab.txt", "w") as f:
        f.write("\n".join(["zeta", "alpha", "mid", "beta"]))
    got = {r["idx"]: (r["word"], r["vec_id"]) for r in fs.scan_vector_matrix(spark, f"{out}/m", f"{out}/vocab.txt")
           .collect()}
    assert got == {0: ("zeta", 10), 1: ("alpha", 11), 2: ("mid", 12), 3: ("beta", 13)}


def test_size_map_and_mirrored_paths(spark):
    out = tempfile.mkdtemp(prefix="lexiclust-size-", dir="/tmp")
    df = spark.createDataFrame([("EnLit/a/x_raw.txt", 5)], "path string, n_words long")
    fs.sink_size_map(df, f"{out}/s")
    assert fs.load_size_map(spark, f"{out}/s").collect()[0]["n_words"] == 5
    m = df.select(fs.mirrored_path(F.col("path")).alias("p")).first()["p"]
    assert m == "EnLitPreprocessed/a/x_preprocessed.txt"


def test_named_files(spark, tmp_path):
    rows = [("a/b/one.txt", "text\n"), ("a/two (x).txt", "é\r\n"), ("three", None), ("a/empty.txt", "")]
    target = tmp_path / "out"
    df = spark.createDataFrame(rows, "path string, text string").repartition(3)
    nf.write_named_files(df, str(target))
    found = {str(p.relative_to(target)): p.read_bytes().decode() for p in target.rglob("*") if p.is_file()}
    assert found == {"_SUCCESS": "", **{p: t or "" for p, t in rows}}  # and no drafts
    assert sorted(nf.read_named_files(spark, str(target)).collect()) == sorted((p, t or "") for p, t in rows)
    nf.write_named_files(df.withColumn("text", F.lit("new")), f"file://{target}")  # a second run replaces
    assert (target / "three").read_text() == "new"
    nf.write_named_files(df.limit(0), str(tmp_path / "none"))
    assert [p.name for p in (tmp_path / "none").iterdir()] == ["_SUCCESS"]
    assert nf.read_named_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("bad", ["../up.txt", "/etc/x", "a//b", None, ""])
def test_named_files_stay_below_their_target(spark, tmp_path, bad):
    with pytest.raises(Exception, match="not a path below the target"):
        nf.write_named_files(spark.createDataFrame([(bad, "x")], "path string, text string"), str(tmp_path / "out"))


def test_mirrored_layout(spark, tmp_path):
    df = spark.createDataFrame([("EnLit/Ann/a_raw.txt", "one"), ("EnLit/Bob/b_raw.txt", "two")], "path string, text string")
    fs.sink_mirrored_layout(df, str(tmp_path))
    assert (tmp_path / "EnLitPreprocessed/Ann/a_preprocessed.txt").read_text() == "one"
    assert (tmp_path / "EnLitPreprocessed/Bob/b_preprocessed.txt").read_text() == "two"
