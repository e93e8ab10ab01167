"""Line deduplication by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of consecutive lines closes a chunk wherever it
is divisible by ``divisor``, so boundaries follow content and inserted lines
shift them only nearby.  Chunks of several lines whose hash occurs again
anywhere are compared byte by byte; of equal chunks the first (by document id,
then position) stays and the others are removed.

With ``passage_words`` also repeats that the chunk boundaries cut or miss go:
every pair of consecutive lines is a window, windows that occurred before join
to runs, and runs of more words than that are removed, as are single lines of
more words that occurred before (both by SHA-256, wherever chunks end).

Defined results: null text stays null and empty text stays empty, both without
removed lines; rows that repeat id and text share one fate; a null id comes
before all others; a document whose chunks are all removed is kept with empty
text; an empty table gives no rows; other columns pass through ``deduplicate``
unchanged, whatever their names (columns named like the three counts are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused, written

#: a chunk has about so many lines
DIVISOR = 3
MIN_LINES = 2
#: a repeated passage of more words (between white space) goes wherever chunks end
PASSAGE_WORDS = 50
MULTIPLIER = 1_000_003
MODULUS = 2_147_483_647


def line_hash(line: Column) -> Column:
    """First 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_bounds(lines: Column, divisor: int = DIVISOR) -> Column:
    """Array of ``(first, last)`` line numbers of the chunks of an array of lines."""
    def ends(hashes):
        last = F.size(hashes) - 1

        def closes(i):
            rolled = F.coalesce(F.get(hashes, i - 1), F.lit(0)) * MULTIPLIER + F.get(hashes, i)
            return (i == last) | (rolled % MODULUS % divisor == 0)

        return F.filter(F.sequence(F.lit(0), last), closes)

    return let(let(F.transform(lines, line_hash), ends), lambda e: F.transform(e, lambda x, k: F.struct(
        (F.coalesce(F.get(e, k - 1), F.lit(-1)) + 1).alias("first"), x.alias("last"))))


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of ``(no, n_lines, text)`` of the chunks of a text."""
    return let(F.split(text, "\n", -1), lambda lines: F.transform(
        chunk_bounds(lines, divisor), lambda b, k: F.struct(
            k.alias("no"), (b["last"] - b["first"] + 1).alias("n_lines"),
            F.array_join(F.slice(lines, b["first"] + 1, b["last"] - b["first"] + 1), "\n").alias("text"))))


def repeated(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Chunks to remove: ``_chunk_doc, _chunk_digest`` (of the text) and
    ``_chunk_no``."""
    text = F.col(text_col).cast("string")
    many = F.filter(chunks(text, divisor), lambda c: c["n_lines"] >= min_lines)
    where = F.struct(F.col(id_col).alias("doc"), F.unhex(F.md5(text)).alias("digest"))
    # the generator sees an outer explode, so that no inferred filter computes the chunks twice
    rows = docs.select(where.alias("at"), F.explode_outer(F.transform(many, lambda c: F.struct(
        c["no"].alias("no"), F.unhex(F.md5(c["text"])).alias("hash")))).alias("c"))
    rows = rows.where("c IS NOT NULL")
    again = written(rows.groupBy("c.hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "hashes")
    texts = docs.select(where.alias("at"), F.explode_outer(F.transform(many, lambda c: F.struct(
        c["no"].alias("no"), F.unhex(F.md5(c["text"])).alias("hash"), c["text"].alias("text")))).alias("c"))
    found = written(texts.where("c IS NOT NULL").select(
        F.struct("at.doc", "at.digest", "c.no").alias("place"), "c.hash", "c.text")
        .join(again.hint("merge"), "hash", "left_semi"), "chunks")  # one plan at every size: hashes are not bounded
    # the byte comparison: equal means equal text, not only equal hash
    first = found.groupBy("hash", "text").agg(F.min("place").alias("first"))
    same = found.join(first, ["hash", "text"])
    return (same.where(~F.col("place").eqNullSafe(F.col("first")))
            .select(F.col("place.doc").alias("_chunk_doc"), F.col("place.digest").alias("_chunk_digest"),
                    F.col("place.no").alias("_chunk_no")))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def passages(docs: DataFrame, words: int = PASSAGE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of two lines and lines of over ``words`` words that occurred
    before: ``_chunk_doc, _chunk_digest, _chunk_no`` (the first line's number) and
    ``_chunk_pair``."""
    text = F.col(text_col).cast("string")

    def windows(lines):
        pairs = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, k: F.struct(
            k.alias("no"), F.lit(True).alias("pair"), F.unhex(F.sha2(F.concat(F.get(lines, k), F.lit("\n"), x), 256)).alias("hash")))
        single = F.filter(F.transform(lines, lambda x, k: F.when(n_words(x) > words, F.struct(
            k.alias("no"), F.lit(False).alias("pair"), F.unhex(F.sha2(x, 256)).alias("hash")))), lambda c: c.isNotNull())
        return F.concat(pairs, single)

    where = F.struct(F.col(id_col).alias("doc"), F.unhex(F.md5(text)).alias("digest"))
    rows = docs.select(where.alias("at"), F.explode_outer(let(F.split(text, "\n", -1), windows)).alias("c"))
    rows = written(rows.where("c IS NOT NULL").select(
        F.struct("at.doc", "at.digest", "c.no").alias("place"), "c.pair", "c.hash"), "windows")
    first = rows.groupBy("hash").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = rows.join(first.hint("merge"), "hash").where(~F.col("place").eqNullSafe(F.col("first")))
    return again.select(F.col("place.doc").alias("_chunk_doc"), F.col("place.digest").alias("_chunk_digest"),
                        F.col("place.no").alias("_chunk_no"), F.col("pair").alias("_chunk_pair"))


def runs(lines: Column, pairs: Column, words: int) -> Column:
    """Array of ``(first, last)`` line numbers of the runs of over ``words`` words
    that an array of the first lines of pairs covers."""
    def joined(p):
        starts = F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1) != x - 1, F.lit(True)))
        ends = F.filter(p, lambda x, k: F.coalesce(F.get(p, k + 1) != x + 1, F.lit(True)))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("last")))

    return F.filter(let(F.array_sort(pairs), joined), lambda r: n_words(
        F.array_join(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), "\n")) > words)


def deduplicate(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, id_col: str = "doc_id",
                text_col: str = "text", passage_words: int | None = None) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and the columns
    ``_chunk_lines, _chunk_removed_lines, _chunk_removed`` (counts).  With
    ``passage_words`` repeated passages of more words go too and are counted."""
    doc, digest, own, gone, pairs, single, result = unused(
        docs, "_chunk_doc", "_chunk_digest", "_chunk_own", "_chunk_gone", "_chunk_pairs", "_chunk_single", "_chunk_result")
    found = repeated(docs, divisor, min_lines, id_col, text_col).withColumn("_chunk_pair", F.lit(None).cast("boolean"))
    if passage_words is not None:
        found = found.unionByName(passages(docs, passage_words, id_col, text_col))
    no, kind = F.col("_chunk_no"), F.col("_chunk_pair")
    cut = (found.groupBy(F.col("_chunk_doc").alias(doc), F.col("_chunk_digest").alias(digest))
           .agg(F.collect_set(F.when(kind.isNull(), no)).alias(gone), F.collect_set(F.when(kind, no)).alias(pairs),
                F.collect_set(F.when(~kind, no)).alias(single)))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn(own, F.unhex(F.md5(text)))
    joined = keyed.join(cut, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(digest)), "left")

    def outcome(lines):
        # the chunks are only computed where one goes
        chunk = F.when(F.size(gone) > 0, let(chunk_bounds(lines, divisor), lambda b: F.transform(F.col(gone), lambda k: F.get(b, k))))
        chunk = F.coalesce(chunk, F.array().cast("array<struct<first:int,last:int>>"))
        alone = F.transform(F.col(single), lambda k: F.struct(k.alias("first"), k.alias("last")))
        passage = F.concat(runs(lines, F.col(pairs), passage_words), alone) if passage_words is not None else None
        taken = chunk if passage is None else F.concat(chunk, passage)
        return let(taken, lambda spans: let(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.flatten(F.transform(
                spans, lambda r: F.sequence(r["first"], r["last"])))),
            lambda kept: F.struct(
                F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
                (F.size(lines) - F.size(kept)).cast("long").alias("lines"), F.size(spans).cast("long").alias("spans"))))

    lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return (joined.withColumn(result, F.when(F.col(gone).isNotNull(), let(F.split(text, "\n", -1), outcome)))
            .withColumn("_chunk_lines", lines.cast("long"))
            .withColumn("_chunk_removed_lines", F.coalesce(F.col(result)["lines"], F.lit(0)).cast("long"))
            .withColumn("_chunk_removed", F.coalesce(F.col(result)["spans"], F.lit(0)).cast("long"))
            .withColumn(text_col, F.when(F.col(result).isNull(), text).otherwise(F.col(result)["text"]))
            .drop(own, doc, digest, gone, pairs, single, result))


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines),
marked AS (
  SELECT *, ((coalesce(lag(h) OVER w, 0) * {MULTIPLIER} + h) % {MODULUS}) % {DIVISOR} = 0 AS closes
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(CAST(closes AS INTEGER)) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM marked),
chunks AS (
  SELECT doc_id, no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM numbered GROUP BY doc_id, no),
judged AS (
  SELECT *, n_lines >= {MIN_LINES}
    AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, no) > 1 AS gone FROM chunks),
kept AS (
  SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS text,
    CAST(sum(n_lines) AS BIGINT) AS n_lines,
    CAST(coalesce(sum(n_lines) FILTER (gone), 0) AS BIGINT) AS n_removed_lines,
    count(*) FILTER (gone) AS n_removed_chunks
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed_lines, 0) AS n_removed_lines,
  coalesce(k.n_removed_chunks, 0) AS n_removed_chunks
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
