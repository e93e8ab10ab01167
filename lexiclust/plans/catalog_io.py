"""P10: sources and sinks, each exercised as write -> read back under the
shared checkpoint folder; the oracles state what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load, scratch_path
from ..functions import text as tx
from ..functions import vectors as vx
from ..sources import files as fs
from . import sqlgen as q
from .catalog import register
from .catalog_prep import BENCH_VOCAB_SQL, KEYED_SQL, SPLIT_SQL, keyed_vectors, sentence_splits
from .catalog_text import AUTHORS_SQL, WC_RE_SQL


def docs(spark, d):
    return load(spark, d, "documents")


@register("scan_corpus_files", """
SELECT source AS author, lang AS style, 'doc' || doc_id || ' (' || lang || ')' AS name,
       CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM documents
""")
def _scan_corpus_files(spark, d):
    out = scratch_path(spark, "corpus")
    src = docs(spark, d).select(F.col("source").alias("author"),
                                F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(" ("), F.col("lang"),
                                         F.lit(")")).alias("title"), "text")
    fs.sink_corpus_files(src, out)
    return fs.scan_named_corpus(spark, out).select(
        "author", "style", F.regexp_replace("name", r"\.txt$", "").alias("name"), F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@register("sink_sentences", f"""
SELECT split, count(*) AS n_lines FROM ({SPLIT_SQL}) GROUP BY split
""")
def _sink_sentences(spark, d):
    out = scratch_path(spark, "sentences")
    fs.sink_sentences(sentence_splits(spark, d), out)
    back = spark.read.text(out)  # split=<name> folders become a column
    return back.groupBy("split").agg(F.count("*").alias("n_lines"))


@register("sink_vectors", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, label FROM embeddings
""")
def _sink_vectors(spark, d):
    out = scratch_path(spark, "vectors")
    fs.sink_vectors(load(spark, d, "embeddings"), out)
    return spark.read.parquet(out).select("vec_id", F.size("embedding").alias("dim"), "label")


NO_DIFFERENCE = "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right"


@register("roundtrip_equal", NO_DIFFERENCE)
def _roundtrip_equal(spark, d):
    out = scratch_path(spark, "roundtrip")
    e = load(spark, d, "embeddings")
    fs.sink_vectors(e, out)
    return fs.roundtrip_equal(e, spark.read.parquet(out))


@register("sink_keyed_vectors", NO_DIFFERENCE)
def _sink_keyed_vectors(spark, d):
    out = scratch_path(spark, "w2v-text")
    kv = keyed_vectors(spark, d).select("word", "embedding", "idx")
    fs.sink_keyed_vectors(kv, out, order_col="idx")
    back = fs.scan_keyed_vectors(spark, out)
    return fs.roundtrip_equal(kv.select("word", "embedding"), back)


@register("scan_keyed_vectors", f"""
SELECT word, CAST(len(embedding) AS INTEGER) AS dim, CAST(round(embedding[1] * 1000) AS BIGINT) AS first FROM ({KEYED_SQL})
""")
def _scan_keyed_vectors(spark, d):
    out = scratch_path(spark, "w2v-text")
    fs.sink_keyed_vectors(keyed_vectors(spark, d).select("word", "embedding", "idx"), out, order_col="idx")
    back = fs.scan_keyed_vectors(spark, out)
    return back.select("word", F.size("embedding").alias("dim"),
                       F.round(F.col("embedding")[0].cast("double") * 1000).cast("long").alias("first"))


@register("scan_analogies", f"""
WITH voc AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM ({BENCH_VOCAB_SQL})),
ana AS (SELECT CAST(floor(floor(i / 4) / 25) AS BIGINT) AS section, list(word ORDER BY i) AS w FROM voc
        GROUP BY floor(i / 4) HAVING count(*) = 4)
SELECT CAST(section AS VARCHAR) AS section, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS d FROM ana
""")
def _scan_analogies(spark, d):
    from .catalog_sim import analogies
    out = scratch_path(spark, "analogies")
    fs.sink_analogies(analogies(spark, d), out)
    return fs.scan_analogies(spark, out)


@register("scan_word_pairs", f"""
WITH voc AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM ({BENCH_VOCAB_SQL}))
SELECT a.word AS a, b.word AS b, CAST(10 - abs(length(a.word) - length(b.word)) AS DOUBLE) AS score
FROM voc a JOIN voc b ON b.i = a.i + 1 WHERE a.i % 2 = 0
""")
def _scan_word_pairs(spark, d):
    from ..operators.ordering import global_index
    from .catalog_prep import bench_vocab
    out = scratch_path(spark, "word-pairs")
    v = global_index(bench_vocab(spark, d), ["word"], "i")
    b = v.select((F.col("i") - 1).alias("i"), F.col("word").alias("other"))
    pairs = v.where(F.col("i") % 2 == 0).join(b, "i")
    score = 10 - F.abs(F.length("word") - F.length("other"))
    pairs.select(F.concat_ws("\t", "word", "other", score.cast("string")).alias("value")).write.text(out)
    return fs.scan_word_pairs(spark, out)


@register("scan_vector_matrix", f"""
SELECT CAST(v.idx AS BIGINT) AS idx, word, vec_id FROM
  (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM ({BENCH_VOCAB_SQL})) v
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings) e ON v.idx = e.idx
""")
def _scan_vector_matrix(spark, d):
    mat, voc = scratch_path(spark, "matrix"), scratch_path(spark, "vocab")
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    fs.sink_vectors(e, mat)
    words = tx.explode_rows(load(spark, d, "benchmark"), tx.normalize_filters("text"), "word").distinct()
    # vocabulary file in word order: range-partitioned part files, sorted inside
    words.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").text(voc)
    return fs.scan_vector_matrix(spark, mat, voc).select("idx", "word", "vec_id")


@register("sink_size_map", f"""
SELECT source || '/doc' || doc_id AS path, {WC_RE_SQL} AS n_words FROM documents
""")
def _sink_size_map(spark, d):
    out = scratch_path(spark, "sizes")
    sizes = docs(spark, d).select(F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"))
                                  .alias("path"), tx.wc_regex_split("text").cast("long").alias("n_words"))
    fs.sink_size_map(sizes, out)
    return fs.load_size_map(spark, out)


@register("sink_csv", """
SELECT vec_id AS word_index, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings
""")
def _sink_csv(spark, d):
    out = scratch_path(spark, "points")
    v = vx.as_double("embedding")
    fs.sink_csv(load(spark, d, "embeddings").select(F.col("vec_id").alias("word_index"), v[0].alias("x"), v[1].alias("y")), out)
    return spark.read.option("header", True).schema("word_index long, x double, y double").csv(out)


@register("sink_mirrored_layout", f"""
SELECT source AS author, 'doc' || doc_id || '_preprocessed.txt' AS mirrored, CAST(length(t) AS INTEGER) AS n_chars
FROM (SELECT source, doc_id, {q.decontract('text')} AS t FROM documents)
""")
def _sink_mirrored_layout(spark, d):
    out = scratch_path(spark, "mirrored")
    src = docs(spark, d).select(F.col("source").alias("author"),
                                F.concat(F.lit("EnLit/"), F.col("source"), F.lit("/doc"),
                                         F.col("doc_id").cast("string"), F.lit("_raw.txt")).alias("path"),
                                tx.decontract("text").alias("text"))
    fs.sink_mirrored_layout(src, out)
    back = fs.scan_named_corpus(spark, f"{out}/EnLitPreprocessed")
    return back.select("author", F.col("name").alias("mirrored"), F.length("text").alias("n_chars"))


@register("scan_library_tables", f"""
SELECT 'authors' AS "table", count(*) AS n_rows FROM ({AUTHORS_SQL}) UNION ALL
SELECT 'books', count(*) FROM orders UNION ALL
SELECT 'text_files', count(*) FROM part UNION ALL
SELECT 'book_file', count(*) FROM lineitem
""")
def _scan_library_tables(spark, d):
    root = scratch_path(spark, "library")
    from .catalog_text import authors
    tables = {
        "authors": authors(spark, d),
        "books": load(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"),
                                                 F.col("o_custkey").alias("author_id"),
                                                 F.col("o_orderpriority").alias("cate1")),
        "text_files": load(spark, d, "part").select(F.col("p_partkey").alias("file_id"),
                                                    F.col("p_type").alias("fmt"), F.col("p_name").alias("text")),
        "book_file": load(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"),
                                                       F.col("l_partkey").alias("file_id"),
                                                       F.col("l_linenumber").alias("chapter")),
    }
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{root}/{name}")
    loaded = fs.scan_library_tables(spark, root)
    rows = None
    for name, t in loaded.items():
        r = t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        rows = r if rows is None else rows.unionByName(r)
    return rows
