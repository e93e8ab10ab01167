"""P2: sampling, splits, keyed-vector lookups and library-style joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from ..functions import text as tx
from ..operators import corpus as co
from ..operators import lookup as lk
from ..operators import sampling as sp
from ..operators import stats as st
from ..operators.ordering import global_index
from . import sqlgen as q
from .catalog import register
from .catalog_text import BENCH_VOCAB_SQL, CLEAN_TOKENS_SQL, FILTER_TOKENS_SQL, LINES_SQL


def docs(spark, d):
    return load(spark, d, "documents")


def bench_vocab(spark, d):
    b = load(spark, d, "benchmark")
    return tx.explode_rows(b, tx.normalize_filters("text"), "word").distinct()


def keyed_vectors(spark, d):
    """Keyed vectors from the given tables, one for every word of the benchmark
    vocabulary: word number ``idx`` (sorted) gets embedding row ``idx mod n``
    (by ``vec_id``), its elements rotated by ``idx div n`` places so that no two
    words share a vector -> ``(idx, word, vec_id, embedding)``."""
    words = global_index(bench_vocab(spark, d), ["word"], "idx")
    rows = global_index(load(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], "_row")
    n = max(rows.count(), 1)
    size = F.size("embedding")
    by = F.pmod(F.floor(F.col("idx") / n), size).cast("int")
    turned = F.concat(F.slice("embedding", by + 1, size), F.slice("embedding", F.lit(1), by))
    return words.join(rows, F.col("idx") % n == F.col("_row")).select("idx", "word", "vec_id", turned.alias("embedding"))


KEYED_SQL = f"""
SELECT CAST(v.idx AS BIGINT) AS idx, word, vec_id, list_concat(e.embedding[turn + 1:], e.embedding[1:turn]) AS embedding FROM
  (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx, (SELECT count(*) FROM embeddings) AS n
   FROM ({BENCH_VOCAB_SQL})) v
  JOIN (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS row FROM embeddings) e0 ON v.idx % n = e0.row
  JOIN LATERAL (SELECT e0.embedding, CAST((v.idx // v.n) % len(e0.embedding) AS BIGINT) AS turn) e ON true
"""
DEFAULT_WORD = "a"  # in the vocabulary at every scale (sorted first)


@register("zip_by_position", f"""
SELECT CAST(v.idx AS BIGINT) AS idx, word, vec_id FROM
  (SELECT word, row_number() OVER (ORDER BY word) - 1 AS idx FROM ({BENCH_VOCAB_SQL})) v
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings) e ON v.idx = e.idx
""")
def _zip_by_position(spark, d):
    e = load(spark, d, "embeddings").select("vec_id")
    return lk.zip_by_position(bench_vocab(spark, d), ["word"], e, ["vec_id"]).select("idx", "word", "vec_id")


@register("embed_tokens_default", f"""
SELECT t.doc_id, t.tok_no, t.token, coalesce(k.vec_id, (SELECT vec_id FROM ({KEYED_SQL}) WHERE word = '{DEFAULT_WORD}'))
       AS vec_id, CAST(k.vec_id IS NULL AS INTEGER) AS is_oov
FROM ({FILTER_TOKENS_SQL}) t LEFT JOIN ({KEYED_SQL}) k ON lower(t.token) = k.word
""")
def _embed_tokens_default(spark, d):
    toks = co.tokens(docs(spark, d), tokenizer="filters")
    return lk.embed_tokens_default(toks, keyed_vectors(spark, d), DEFAULT_WORD) \
        .select("doc_id", "tok_no", "token", "vec_id", "is_oov")


@register("embed_tokens_skip", f"""
SELECT t.doc_id, t.tok_no, t.token, k.vec_id
FROM ({FILTER_TOKENS_SQL}) t JOIN ({KEYED_SQL}) k ON lower(t.token) = k.word
""")
def _embed_tokens_skip(spark, d):
    toks = co.tokens(docs(spark, d), tokenizer="filters")
    return lk.embed_tokens_skip(toks, keyed_vectors(spark, d)).select("doc_id", "tok_no", "token", "vec_id")


@register("oov_report", f"""
WITH j AS (SELECT lower(t.token) AS w, k.word IS NULL AS bad
           FROM ({FILTER_TOKENS_SQL}) t LEFT JOIN ({KEYED_SQL}) k ON lower(t.token) = k.word)
SELECT count(*) AS n_tokens, CAST(sum(CAST(bad AS BIGINT)) AS BIGINT) AS n_oov,
       CAST(count(DISTINCT CASE WHEN bad THEN w END) AS BIGINT) AS n_oov_distinct,
       round(sum(CAST(bad AS BIGINT)) / count(*), 6) AS ratio_all,
       round(sum(CAST(bad AS BIGINT)) / (count(*) - sum(CAST(bad AS BIGINT))), 6) AS ratio_kept
FROM j
""")
def _oov_report(spark, d):
    toks = co.tokens(docs(spark, d), tokenizer="filters")
    return lk.oov_report(toks, keyed_vectors(spark, d))


@register("token_weights", f"""
WITH f AS (SELECT token, count(*) AS cnt FROM ({FILTER_TOKENS_SQL}) GROUP BY token),
j AS (SELECT k.word, coalesce(f.cnt, 0) AS cnt FROM ({KEYED_SQL}) k LEFT JOIN f ON k.word = f.token)
SELECT word, CAST(cnt AS BIGINT) AS cnt, round(cnt / (SELECT sum(cnt) FROM j), 6) AS weight FROM j
""")
def _token_weights(spark, d):
    freq = st.token_freq(co.tokens(docs(spark, d), tokenizer="filters"))
    return lk.token_weights(keyed_vectors(spark, d), freq)


@register("sample_exact", f"""
SELECT doc_id FROM documents ORDER BY {q.hash_key(1984, 'doc_id')}, doc_id LIMIT 300
""")
def _sample_exact(spark, d):
    return sp.sample_exact(docs(spark, d), 300, ["doc_id"], seed=1984).select("doc_id")


SENT_SQL = f"""
SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, sentence FROM (
  SELECT doc_id, {q.posexplode(q.sentence_array(q.decontract('text')), 'sentence', 'sent_no')} FROM documents)
"""
SPLIT_SQL = f"""
SELECT doc_id, sent_no, sentence, CASE
    WHEN r < floor(0.8 * n) THEN 'train'
    WHEN r < floor(0.8 * n) + floor(0.1 * n) THEN 'val'
    ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {q.hash_key(1984, 'doc_id', 'sent_no')}, doc_id, sent_no) - 1 AS r,
             count(*) OVER () AS n FROM ({SENT_SQL}))
"""
SPLIT_FRACTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


def sentence_splits(spark, d):
    s = co.split_sentences(docs(spark, d))
    return sp.split_fractions(s, SPLIT_FRACTIONS, ["doc_id", "sent_no"], seed=1984)


@register("split_train_val_test", f"""
SELECT doc_id, sent_no, split FROM ({SPLIT_SQL}) WHERE split IS NOT NULL
""")
def _split_train_val_test(spark, d):
    return sentence_splits(spark, d).select("doc_id", "sent_no", "split")


@register("split_stats", f"""
SELECT split, CAST(sum(len(string_split(sentence, ' '))) AS BIGINT) AS total_words,
       CAST(max(len(string_split(sentence, ' '))) AS BIGINT) AS max_words,
       CAST(max(length(sentence)) AS BIGINT) AS max_chars, count(*) AS n_sentences
FROM ({SPLIT_SQL}) WHERE split IS NOT NULL GROUP BY split
""")
def _split_stats(spark, d):
    return st.split_stats(sentence_splits(spark, d))


@register("split_80_20", f"""
SELECT vec_id, CASE WHEN r < floor(0.8 * n) THEN 'train' ELSE 'test' END AS split
FROM (SELECT vec_id, row_number() OVER (ORDER BY {q.hash_key(7, 'vec_id')}, vec_id) - 1 AS r, count(*) OVER () AS n
      FROM embeddings)
""")
def _split_80_20(spark, d):
    e = load(spark, d, "embeddings").select("vec_id")
    return sp.split_fractions(e, {"train": 0.8, "test": 0.2}, ["vec_id"], seed=7)


@register("replicate_by_freq", f"""
SELECT token, CAST(copy_no AS BIGINT) AS copy_no FROM (
  SELECT token, unnest(range(1, CAST(greatest(1, floor(cnt / 20)) AS BIGINT) + 1)) AS copy_no
  FROM (SELECT token, count(*) AS cnt FROM ({CLEAN_TOKENS_SQL}) GROUP BY token))
""")
def _replicate_by_freq(spark, d):
    freq = st.token_freq(co.tokens(docs(spark, d)))
    return sp.replicate_by_freq(freq, 20).select("token", "copy_no")


@register("random_crops", f"""
SELECT doc_id, CAST(b AS BIGINT) AS b, start, substr(text, CAST(start + 1 AS BIGINT), 255) AS x,
       substr(text, CAST(start + 2 AS BIGINT), 255) AS y FROM (
  SELECT doc_id, text, b, CAST({q.hash_int(0, 'doc_id', 'b')} % (length(text) - 256) AS BIGINT) AS start
  FROM (SELECT doc_id, text, unnest(range(16)) AS b FROM documents WHERE length(text) > 256))
""")
def _random_crops(spark, d):
    return sp.random_crops(docs(spark, d), batch=16, window=256, seed=0)


@register("mask_tokens", f"""
SELECT doc_id, line_no, CAST(tok_no AS BIGINT) AS tok_no, token,
       CAST({q.hash_int(0, 'doc_id', 'line_no', 'tok_no')} % 100 < 15 AS INTEGER) AS is_target FROM (
  SELECT doc_id, line_no, {q.posexplode(q.words('line') + '[1:16]', 'token', 'tok_no')} FROM ({LINES_SQL}))
""")
def _mask_tokens(spark, d):
    return sp.mask_tokens(co.scan_lines(docs(spark, d)), block=16, rate_pct=15, seed=0)


@register("w2v_vocab", f"""
SELECT lower(token) AS token, count(*) AS cnt FROM ({CLEAN_TOKENS_SQL}) GROUP BY lower(token) HAVING count(*) >= 5
""")
def _w2v_vocab(spark, d):
    t = co.tokens(docs(spark, d)).select(F.lower("token").alias("token"))
    return st.token_freq(t).where(F.col("cnt") >= 5)


MANIFEST_SQL = """
SELECT row_number() OVER (ORDER BY quality DESC, doc_id) - 1 AS ord, 'doc' || CAST(doc_id AS VARCHAR) || '.txt' AS name
FROM labels
"""


@register("join_manifest", f"""
SELECT CAST(m.ord AS BIGINT) AS ord, d.doc_id, d.text FROM ({MANIFEST_SQL}) m
JOIN documents d ON m.name = 'doc' || CAST(d.doc_id AS VARCHAR) || '.txt'
""")
def _join_manifest(spark, d):
    from ..operators.ordering import global_index
    lab = load(spark, d, "labels").select("doc_id", "quality")
    man = global_index(lab.withColumn("_q", -F.col("quality")), ["_q", "doc_id"], "ord").select(
        "ord", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    dd = docs(spark, d).withColumn("name", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return man.join(dd, "name").select("ord", "doc_id", "text")


@register("books_by_author", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE contains(c_name, '0000001'))
""")
def _books_by_author(spark, d):
    cust = load(spark, d, "customer").where(F.col("c_name").contains("0000001")).select(
        F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").join(cust, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@register("book_texts", """
SELECT o.o_orderkey, l.l_linenumber, p.p_partkey FROM orders o
JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
WHERE p.p_brand = 'Brand#13'
""")
def _book_texts(spark, d):
    o = load(spark, d, "orders").select("o_orderkey")
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber",
                                           F.col("l_partkey").alias("p_partkey"))
    p = load(spark, d, "part").where(F.col("p_brand") == "Brand#13").select("p_partkey")
    return o.join(li, "o_orderkey").join(p, "p_partkey").select("o_orderkey", "l_linenumber", "p_partkey")


@register("library_star", """
SELECT c.c_custkey, count(DISTINCT o.o_orderkey) AS n_books, count(DISTINCT l.l_partkey) AS n_files
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
JOIN part p ON p.p_partkey = l.l_partkey
GROUP BY c.c_custkey
""")
def _library_star(spark, d):
    c = load(spark, d, "customer").select("c_custkey")
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    p = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    j = c.join(o, "c_custkey").join(li, "o_orderkey").join(p, "l_partkey")
    return j.groupBy("c_custkey").agg(F.countDistinct("o_orderkey").alias("n_books"),
                                      F.countDistinct("l_partkey").alias("n_files"))
