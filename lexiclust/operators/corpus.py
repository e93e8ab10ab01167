"""Corpus operators: lines, sentences, tokens, filters, slices.

Documents are rows; per-document numbering is done with array functions
inside the row (``posexplode`` of a filtered array), so no window has to
gather one document's pieces into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordering import prefix_offsets


def scan_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               drop_blank: bool = True) -> DataFrame:
    """One row per line: ``(id, line_no, line)``; ``line_no`` is the 0-based
    position in the file, blank lines dropped when asked."""
    out = tx.posexplode_rows(df, F.split(text_col, "\n"), "line_no", "line", id_col)
    if drop_blank:
        out = out.where(F.trim("line") != "")
    return out


def filter_nonblank(df: DataFrame, col: str) -> DataFrame:
    """Strip and drop empty strings."""
    return df.withColumn(col, tx.pystrip(col)).where(F.col(col) != "")


def clean_text(df: DataFrame, text_col: str = "text", out_col: str = "clean") -> DataFrame:
    return df.withColumn(out_col, tx.decontract(text_col))


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    clean: bool = True) -> DataFrame:
    """``(id, sent_no, sentence)``: contractions expanded and symbols stripped
    (when ``clean``), split on . ; ! ?, trimmed, blanks dropped, renumbered."""
    src = tx.decontract(text_col) if clean else F.col(text_col)
    return tx.posexplode_rows(df, tx.sentence_array(src), "sent_no", "sentence", id_col)


def cap_sentences(sentences: DataFrame, max_per_doc: int = 2000) -> DataFrame:
    return sentences.where(F.col("sent_no") < max_per_doc)


def doc_token_array(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    tokenizer: str = "clean") -> DataFrame:
    """``(id, tokens array)`` for a tokenizer: ``clean`` = cleaned sentences
    split on spaces; ``filters`` = lower/tag/punct/digit filter chain;
    ``split`` = whitespace split."""
    if tokenizer == "clean":
        sents = tx.sentence_array(tx.decontract(text_col))
        toks = F.flatten(F.transform(sents, lambda s: F.split(s, " ")))
    elif tokenizer == "filters":
        toks = tx.normalize_filters(text_col)
    elif tokenizer == "split":
        toks = tx.words(text_col)
    else:
        raise ValueError(tokenizer)
    return df.select(id_col, toks.alias("tokens"))


def tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str = "clean") -> DataFrame:
    """``(id, tok_no, token)`` per document."""
    arr = doc_token_array(df, id_col, text_col, tokenizer)
    return tx.posexplode_rows(arr, F.col("tokens"), "tok_no", "token", id_col)


def token_stream(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = "clean") -> DataFrame:
    """``(pos, id, tok_no, token)`` with ``pos`` a dense global position over
    the corpus in ``(id, tok_no)`` order.  Offsets are computed on the
    per-document counts (one small row per document), not on tokens."""
    arr = doc_token_array(df, id_col, text_col, tokenizer)
    counts = arr.select(id_col, F.size("tokens").alias("_n"))
    offs = prefix_offsets(counts, [id_col], "_n", "_off").select(id_col, "_off")
    exploded = tx.posexplode_rows(arr, F.col("tokens"), "tok_no", "token", id_col)
    out = exploded.join(offs, id_col)
    return out.select((F.col("_off") + F.col("tok_no")).alias("pos"), id_col,
                      F.col("tok_no").cast("long").alias("tok_no"), "token")


def slice_rows(stream: DataFrame, start: int, stop: int, pos_col: str = "pos") -> DataFrame:
    """Python ``[start:stop]`` on a dense position column."""
    return stream.where((F.col(pos_col) >= start) & (F.col(pos_col) < stop))


def filter_genre(df: DataFrame, path_col: str = "path", genre: str = "poetry") -> DataFrame:
    """Drop paths that contain the genre word (case-insensitive)."""
    return df.where(~F.lower(F.col(path_col)).contains(genre.lower()))


def filter_size_range(df: DataFrame, size_col: str, lo: float, hi: float) -> DataFrame:
    """Strict range ``lo < size < hi``."""
    return df.where((F.col(size_col) > lo) & (F.col(size_col) < hi))


CYRILLIC = "[а-яА-Я]"


def filter_script(df: DataFrame, text_col: str = "text", char_class: str = CYRILLIC) -> DataFrame:
    """Keep rows holding at least one character of the class."""
    return df.where(F.col(text_col).rlike(char_class))


def filter_keyword(df: DataFrame, col: str, keyword: str) -> DataFrame:
    return df.where(F.col(col).contains(keyword))


def filter_format(df: DataFrame, col: str, fmt: str = "txt") -> DataFrame:
    return df.where(F.col(col) == fmt)


def filter_special_words(words_df: DataFrame, col: str = "token") -> DataFrame:
    """Words that are not all lower-case (``not w.islower()``)."""
    return words_df.where(tx.is_not_lower(col))


def vocab_membership(tokens_df: DataFrame, vocab: DataFrame, col: str = "token",
                     vocab_col: str = "word") -> DataFrame:
    """Flag every token by vocabulary membership (left join on distinct vocab)."""
    v = vocab.select(F.col(vocab_col).alias(col)).distinct().withColumn("in_vocab", F.lit(True))
    return tokens_df.join(v, col, "left").withColumn("in_vocab", F.coalesce("in_vocab", F.lit(False)))


def preview_text(df: DataFrame, text_col: str = "text", head: int = 500, tail: int = 100) -> DataFrame:
    return df.withColumn("head", F.expr(f"left({text_col}, {head})")) \
             .withColumn("tail", F.expr(f"right({text_col}, {tail})"))


def prefix_by_words(lines: DataFrame, limit: int = 1000, id_col: str = "doc_id",
                    order_col: str = "line_no", text_col: str = "line") -> DataFrame:
    """Lines of each document until the running word count passes ``limit``;
    the line that passes is kept (keep where the words *before* it <= limit)."""
    w = Window.partitionBy(id_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    n = tx.wc_split(text_col)
    out = lines.withColumn("words_before", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))
    return out.where(F.col("words_before") <= limit)


def chunk_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 32) -> DataFrame:
    """Whitespace words cut into windows of ``size``: ``(id, chunk_no, chunk)``."""
    ws = df.select(id_col, tx.words(text_col).alias("_ws"))  # materialised once
    w = F.col("_ws")
    starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(size))
    chunks = F.transform(starts, lambda i: F.slice(w, i + 1, size))
    arr = ws.select(id_col, F.when(F.size(w) > 0, chunks).otherwise(F.array()).alias("chunks"))
    out = tx.posexplode_rows(arr, F.col("chunks"), "chunk_no", "words", id_col)
    return out.select(id_col, "chunk_no",
                      F.size("words").cast("long").alias("n_words"),
                      F.array_join("words", " ").alias("chunk"))


def char_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Character vocabulary ``(ch, char_id, cnt)``: ids by count descending,
    ties by first appearance in ``(id, position)`` order (characters are
    code points).  Each document is first reduced to one row per distinct
    character in its task (map-side combine); only those rows are shuffled."""
    import pandas as pd

    def per_doc(batches):
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf[id_col], pdf[text_col]):
                if text is None:
                    continue
                rows.extend((doc, c, n, text.find(c)) for c, n in Counter(text).items())
            yield pd.DataFrame(rows, columns=[id_col, "ch", "n", "p"])

    from collections import Counter
    pre = df.select(id_col, text_col).mapInPandas(per_doc, f"{id_col} long, ch string, n long, p long")
    stats = pre.groupBy("ch").agg(F.sum("n").alias("cnt"), F.min(F.struct(id_col, "p")).alias("first"))
    # one row per distinct character: bounded by the character set
    w = Window.orderBy(F.desc("cnt"), F.col(f"first.{id_col}"), F.col("first.p"))
    return stats.select("ch", (F.row_number().over(w) - 1).cast("long").alias("char_id"),
                        F.col("cnt").cast("long").alias("cnt"))


def char_sequence(df: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, char_ids)``: every text as the sequence of its characters' ids in
    ``index(ch, char_id)`` (one row per character: bounded by the character
    set); characters that the index lacks become null."""
    known = index.agg(F.map_from_entries(F.collect_list(F.struct("ch", F.col("char_id").cast("long")))).alias("_map"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(F.col("_map"), c))
    return df.select(id_col, text_col).withColumn("_map", known.scalar()).select(id_col, ids.alias("char_ids"))


def char_text(sequences: DataFrame, index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, text)``: the inverse of ``char_sequence``."""
    known = index.agg(F.map_from_entries(F.collect_list(F.struct(F.col("char_id").cast("long"), "ch"))).alias("_map"))
    chars = F.transform("char_ids", lambda i: F.try_element_at(F.col("_map"), i))
    return sequences.withColumn("_map", known.scalar()).select(id_col, F.array_join(chars, "").alias("text"))


def extract_path_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Folder / name parts of a path or URL: host, path, base name."""
    u = F.col(url_col)
    return df.withColumn("host", F.regexp_extract(u, r"^[a-z]+://([^/?#]+)", 1)) \
             .withColumn("path", F.regexp_extract(u, r"^[a-z]+://[^/?#]+(/[^?#]*)", 1)) \
             .withColumn("base", F.regexp_extract(u, r"([^/?#]+)(?:[?#].*)?$", 1))
