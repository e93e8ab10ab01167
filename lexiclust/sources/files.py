"""File sources and sinks.

Readers return DataFrames with explicit schemas; writers are plain
DataFrameWriter calls.  Ordered text formats (word2vec text, one sentence per
line) are written as part files whose name order is the row order: rows are
range-partitioned by their order key and sorted inside each part, so no
writer funnels the data through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import global_index
from .named_files import read_named_files, write_named_files


def scan_corpus_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole texts with their path: ``(path, author, style, name, text)``.

    Layouts: ``<author>/<title> (<style>).txt`` as in the reference, or the
    partitioned layout Spark writes (``author=<a>/title=<t>/part-*.txt``).
    author = the ``author=`` folder if present, else the parent folder;
    style = first ``(...)`` in the title."""
    df = spark.read.text(pattern, wholetext=True)
    path = F.url_decode(F.col("_metadata.file_path"))
    segs = F.split(path, "/")
    parent, base = F.element_at(segs, -2), F.element_at(segs, -1)
    part_author = F.regexp_extract(path, "/author=([^/]+)/", 1)
    part_title = F.regexp_extract(path, "/title=([^/]+)/", 1)
    title = F.when(part_title != "", part_title).otherwise(base)
    # the text sink ends its one row with a line end that is not the text's
    own = F.when((part_title != "") & F.col("value").endswith("\n"),
                 F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return df.select(path.alias("path"),
                     F.when(part_author != "", part_author).otherwise(parent).alias("author"),
                     F.regexp_extract(title, r"\((.*?)\)", 1).alias("style"),
                     title.alias("name"), own.alias("text"))


def scan_named_corpus(spark: SparkSession, root: str) -> DataFrame:
    """As ``scan_corpus_files`` for all files below ``root``, empty ones too:
    ``(path, author, style, name, text)`` with paths below ``root``."""
    segs = F.split("path", "/")
    name = F.element_at(segs, -1)
    return read_named_files(spark, root).select(
        "path", F.coalesce(F.get(segs, F.size(segs) - 2), F.lit("")).alias("author"),
        F.regexp_extract(name, r"\((.*?)\)", 1).alias("style"), name.alias("name"), "text")


def scan_text_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per line ``(path, value)`` (line order is not a column; use
    ``scan_corpus_files`` + ``corpus.scan_lines`` when positions matter)."""
    return spark.read.text(pattern).select(F.col("_metadata.file_path").alias("path"), "value")


def scan_keyed_vectors(spark: SparkSession, pattern: str) -> DataFrame:
    """word2vec text format -> ``(word, embedding array<float>)``.  The first
    line of the first file is the ``count dim`` header; a header or line of
    another form raises."""
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("_file"))
    first = lines.agg(F.min("_file")).first()[0]
    if first is None:
        return spark.createDataFrame([], "word string, embedding array<float>")
    head = spark.read.text(first).first()["value"]
    pieces = head.split(" ")
    if len(pieces) != 2 or not all(p.isdigit() for p in pieces):
        raise ValueError(f"no 'count dim' header: {head[:40]!r}")
    dim = int(pieces[1])
    like_head = (F.col("_file") == first) & (F.col("value") == head)
    body = lines.where(~like_head).select("value")
    again = lines.where(like_head).count() - 1  # a 1-dimension line may equal the header
    if again:
        body = body.unionByName(spark.range(again).select(F.lit(head).alias("value")))
    parts = F.split(F.trim("value"), " ")
    checked = F.when(F.size(parts) == dim + 1, parts).otherwise(
        F.raise_error(F.concat(F.lit(f"not a word and {dim} numbers: "), F.substring("value", 1, 40))))
    return (body.select(checked.alias("_p"))
            .select(F.element_at("_p", 1).alias("word"), F.slice("_p", 2, max(dim, 1)).cast("array<float>").alias("embedding")))


def sink_keyed_vectors(df: DataFrame, path: str, word_col: str = "word", vec_col: str = "embedding",
                       order_col: str | None = None) -> None:
    """word2vec text format: a ``count dim`` header, then ``word f1 ... fd`` in
    the order of ``order_col`` (by its own type; default: the word)."""
    order = F.col(order_col) if order_col else F.col(word_col)
    n, d = df.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    body = df.select(F.lit(1).alias("_h"), order.alias("_k"),
                     F.concat_ws(" ", F.col(word_col), F.concat_ws(" ", F.col(vec_col).cast("array<string>")))
                     .alias("value"))
    kind = body.schema["_k"].dataType
    head = df.sparkSession.range(1).select(F.lit(0).alias("_h"), F.lit(None).cast(kind).alias("_k"),
                                           F.lit(f"{n} {d or 0}").alias("value"))
    out = head.unionByName(body).repartitionByRange("_h", "_k").sortWithinPartitions("_h", "_k")
    out.select("value").write.mode("overwrite").text(path)


def sink_analogies(df: DataFrame, path: str, section_col: str = "section", order_col: str = "qid",
                   word_cols: tuple[str, ...] = ("w0", "w1", "w2", "w3")) -> None:
    """Analogy text format: a ``: section`` line, then four words a line; a
    section is never split over files."""
    body = df.select(F.col(section_col).cast("string").alias("_s"), F.col(order_col).alias("_o"),
                     F.concat_ws(" ", *word_cols).alias("value"))
    head = df.select(F.col(section_col).cast("string").alias("_s")).distinct().select(
        "_s", F.lit(None).cast(body.schema["_o"].dataType).alias("_o"), F.concat(F.lit(": "), F.col("_s")).alias("value"))
    out = head.unionByName(body).repartitionByRange("_s").sortWithinPartitions("_s", "_o")
    out.select("value").write.mode("overwrite").text(path)


def scan_analogies(spark: SparkSession, pattern: str) -> DataFrame:
    """``(section, a, b, c, d)`` of analogy files; a line that is neither a
    section nor four words raises.  Words before any section have section null."""
    lines = spark.read.text(pattern, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("no", "line"),
                                                            F.col("_metadata.file_path").alias("file"))
    lines = lines.select("file", "no", F.trim(F.regexp_replace("line", "\t|\r", " ")).alias("line")).where("line <> ''")
    lines = lines.withColumn("head", F.when(F.col("line").startswith(":"), F.trim(F.substring("line", 2, 1 << 30))))
    inside = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last("head", ignorenulls=True).over(inside)).where("head IS NULL")
    w = F.split("line", " +")
    w = F.when(F.size(w) == 4, w).otherwise(F.raise_error(F.concat(F.lit("not four words: "), F.col("line"))))
    return lines.select("section", w.alias("w")).select("section", *[F.col("w")[i].alias(n) for i, n in enumerate("abcd")])


def scan_word_pairs(spark: SparkSession, pattern: str) -> DataFrame:
    """``(a, b, score)`` of word-pair files: two words and a number, parted by
    tabs, commas or blanks; ``#`` lines are comments."""
    line = F.trim("value")
    rows = spark.read.text(pattern).where((line != "") & ~line.startswith("#")).select(F.split(line, "[\t, ]+").alias("w"))
    w = F.when(F.size("w") == 3, F.col("w")).otherwise(F.raise_error(F.lit("not two words and a number")))
    return rows.select(w.alias("w")).select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b"), F.col("w")[2].cast("double").alias("score"))


def scan_vector_matrix(spark: SparkSession, matrix_path: str, vocab_path: str) -> DataFrame:
    """Matrix rows (Parquet ``vec_id, embedding``) zipped with a vocabulary
    (one word per line, in the order of file names and lines):
    ``(idx, word, vec_id, embedding)``."""
    m = spark.read.parquet(matrix_path)
    # a split is read in line order; files and splits are ordered by path and offset
    v = spark.read.text(vocab_path).select("value", F.col("_metadata.file_path").alias("_file"),
                                           F.col("_metadata.file_block_start").alias("_at"),
                                           F.monotonically_increasing_id().alias("_line"))
    vi = global_index(v, ["_file", "_at", "_line"], "idx").select("idx", F.col("value").alias("word"))
    mi = global_index(m, ["vec_id"], "idx")
    return vi.join(mi, "idx")


def sink_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sink_sentences(df: DataFrame, path: str, split_col: str = "split", text_col: str = "sentence",
                   order_cols: tuple[str, ...] = ("doc_id", "sent_no")) -> None:
    """One sentence per line under ``split=<name>/`` folders, in order."""
    out = df.repartitionByRange(split_col, *order_cols).sortWithinPartitions(split_col, *order_cols)
    out.select(split_col, F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(split_col).text(path)


def sink_size_map(df: DataFrame, path: str, key_col: str = "path", size_col: str = "n_words") -> None:
    df.select(key_col, size_col).write.mode("overwrite").json(path)


def load_size_map(spark: SparkSession, path: str, key_col: str = "path", size_col: str = "n_words") -> DataFrame:
    return spark.read.schema(f"{key_col} string, {size_col} long").json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def mirrored_path(col, src: str = "EnLit", dst: str = "EnLitPreprocessed"):
    """Mirror a corpus path: ``src`` folder -> ``dst``, ``_raw`` -> ``_preprocessed``."""
    return F.regexp_replace(F.regexp_replace(col, src, dst), "_raw", "_preprocessed")


def sink_corpus_files(df: DataFrame, path: str, author_col: str = "author", title_col: str = "title",
                      text_col: str = "text") -> None:
    """One file ``<author>/<title>.txt`` per row (read back by ``scan_named_corpus``)."""
    write_named_files(df.select(F.concat(F.col(author_col), F.lit("/"), F.col(title_col), F.lit(".txt")).alias("path"),
                                F.col(text_col).alias("text")), path)


def sink_mirrored_layout(df: DataFrame, root: str, path_col: str = "path", text_col: str = "text",
                         src: str = "EnLit", dst: str = "EnLitPreprocessed") -> None:
    """Cleaned texts as files under the mirrored path of their source, below ``root``."""
    write_named_files(df.select(mirrored_path(F.col(path_col), src, dst).alias("path"), F.col(text_col).alias("text")), root)


def roundtrip_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(only_left, only_right)`` row counts (multiset difference both ways)."""
    return a.exceptAll(b).agg(F.count("*").alias("only_left")).withColumn(
        "only_right", b.exceptAll(a).agg(F.count("*")).scalar())


def scan_library_tables(spark: SparkSession, source: str, tables=("authors", "books", "text_files", "book_file"),
                        jdbc_properties: dict | None = None) -> dict[str, DataFrame]:
    """Four library tables from a JDBC database (driver jar supplied by the
    user) or from Parquet folders ``<source>/<table>``."""
    if source.startswith("jdbc:"):
        return {t: spark.read.jdbc(source, t, properties=jdbc_properties or {}) for t in tables}
    return {t: spark.read.parquet(f"{source.rstrip('/')}/{t}") for t in tables}
