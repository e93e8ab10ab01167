"""P1: text functions, filters, slices and corpus statistics (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from ..functions import text as tx
from ..operators import corpus as co
from ..operators import stats as st
from . import sqlgen as q
from .catalog import register

def doc_path():
    return F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"),
                    F.lit(" ("), F.col("lang"), F.lit(").txt"))
DOC_PATH_SQL = "(source || '/doc' || CAST(doc_id AS VARCHAR) || ' (' || lang || ').txt')"
WC_RE_SQL = f"CAST(len(regexp_split_to_array(text, '{tx.SPACE}+')) AS BIGINT)"
CLEAN_TOKENS_SQL = f"SELECT doc_id, unnest({q.clean_tokens('text')}) AS token FROM documents"
FILTER_TOKENS_SQL = (f"SELECT doc_id, CAST(tok_no AS BIGINT) AS tok_no, token FROM ("
                     f"SELECT doc_id, {q.posexplode(q.normalize_filters('text'), 'token', 'tok_no')} FROM documents)")


def docs(spark, d):
    return load(spark, d, "documents")


@register("filter_genre", f"""
SELECT doc_id, {DOC_PATH_SQL} AS path FROM documents
WHERE NOT contains(lower({DOC_PATH_SQL}), '(fr)')
""")
def _filter_genre(spark, d):
    return co.filter_genre(docs(spark, d).select("doc_id", doc_path().alias("path")), "path", "(fr)")


@register("filter_size_range", f"""
SELECT doc_id, n_words FROM (SELECT doc_id, {WC_RE_SQL} AS n_words FROM documents)
WHERE n_words > 50 AND n_words < 20000
""")
def _filter_size_range(spark, d):
    sized = docs(spark, d).select("doc_id", tx.wc_regex_split("text").cast("long").alias("n_words"))
    return co.filter_size_range(sized, "n_words", 50, 20000)


@register("filter_script", """
SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '[äöüß]')
""")
def _filter_script(spark, d):
    return co.filter_script(docs(spark, d), "text", "[äöüß]").select("doc_id", "lang")


@register("filter_keyword", """
SELECT doc_id, source FROM documents WHERE contains(source, 'src1')
""")
def _filter_keyword(spark, d):
    return co.filter_keyword(docs(spark, d), "source", "src1").select("doc_id", "source")


@register("filter_format", """
SELECT doc_id, lang FROM documents WHERE lang = 'en'
""")
def _filter_format(spark, d):
    return co.filter_format(docs(spark, d), "lang", "en").select("doc_id", "lang")


AUTHORS_SQL = """
SELECT c_custkey AS author_id, c_name AS author,
       CAST(coalesce(f.born, 9999) AS BIGINT) AS born
FROM customer LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS born FROM orders GROUP BY o_custkey) f
  ON c_custkey = f.o_custkey
"""


def authors(spark, d):
    """Library ``authors`` stand-in: customers, born = year of first order,
    unknown (no order) = the 9999 sentinel."""
    first = load(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("born"))
    cust = load(spark, d, "customer")
    return cust.join(first, cust.c_custkey == first.o_custkey, "left").select(
        F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author"),
        F.coalesce("born", F.lit(9999)).cast("long").alias("born"))


@register("filter_sentinel", f"""
SELECT author_id, author, born,
       CASE WHEN born < 9999 THEN CAST(born AS VARCHAR) ELSE 'No Record' END AS born_label
FROM ({AUTHORS_SQL}) WHERE born < 10000
""")
def _filter_sentinel(spark, d):
    a = authors(spark, d).where(F.col("born") < 10000)
    return a.withColumn("born_label", F.when(F.col("born") < 9999, F.col("born").cast("string"))
                        .otherwise(F.lit("No Record")))


@register("top_n_sorted", f"""
SELECT author_id, author, born FROM ({AUTHORS_SQL}) WHERE born < 10000
ORDER BY born DESC, author_id LIMIT 30
""")
def _top_n_sorted(spark, d):
    return st.top_n_sorted(authors(spark, d).where(F.col("born") < 10000), "born", "author_id", 30)


@register("filter_nonblank", f"""
SELECT conv_id, turn, CAST(line_no AS BIGINT) AS line_no, {q.pystrip('line')} AS line FROM (
  SELECT conv_id, turn, {q.posexplode("string_split(text, chr(10))", "line", "line_no")} FROM conversations)
WHERE {q.pystrip('line')} <> ''
""")
def _filter_nonblank(spark, d):
    conv = load(spark, d, "conversations")
    lines = tx.posexplode_rows(conv, F.split("text", "\n"), "line_no", "line", "conv_id", "turn")
    return co.filter_nonblank(lines, "line")


@register("filter_special_words", f"""
SELECT DISTINCT token FROM ({CLEAN_TOKENS_SQL})
WHERE NOT (token = lower(token) AND token <> upper(token))
""")
def _filter_special_words(spark, d):
    return co.filter_special_words(co.tokens(docs(spark, d)).select("token").distinct())


BENCH_VOCAB_SQL = f"SELECT DISTINCT unnest({q.normalize_filters('text')}) AS word FROM benchmark"


@register("vocab_membership", f"""
SELECT t.doc_id, count(*) AS n_tokens, CAST(count(v.word) AS BIGINT) AS n_in_vocab
FROM ({FILTER_TOKENS_SQL}) t LEFT JOIN ({BENCH_VOCAB_SQL}) v ON t.token = v.word
GROUP BY t.doc_id
""")
def _vocab_membership(spark, d):
    toks = co.tokens(docs(spark, d), tokenizer="filters")
    vocab = tx.explode_rows(load(spark, d, "benchmark"), tx.normalize_filters("text"), "word")
    flagged = co.vocab_membership(toks, vocab)
    return flagged.groupBy("doc_id").agg(F.count("*").alias("n_tokens"),
                                         F.sum(F.col("in_vocab").cast("long")).alias("n_in_vocab"))


STREAM_SQL = f"""
SELECT row_number() OVER (ORDER BY doc_id, tok_no) - 1 AS pos, doc_id, tok_no, token
FROM ({FILTER_TOKENS_SQL})
"""


@register("slice_rows", f"""
SELECT CAST(pos AS BIGINT) AS pos, doc_id, tok_no, token FROM ({STREAM_SQL}) WHERE pos >= 1000 AND pos < 2000
""")
def _slice_rows(spark, d):
    from ..operators.ngrams import prefix_stream
    # positions [1000, 2000): only documents starting before 2000 are tokenised
    return co.slice_rows(prefix_stream(docs(spark, d), tx.normalize_filters, 2000), 1000, 2000)


@register("slice_dims", """
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(CAST(value AS DOUBLE), 6) AS value FROM (
  SELECT vec_id, unnest(embedding[1:16]) AS value, unnest(range(16)) AS dim FROM embeddings)
""")
def _slice_dims(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 16).alias("v"))
    x = e.select("vec_id", F.posexplode("v").alias("dim", "value"))
    return x.select("vec_id", F.col("dim").cast("long"), F.round(F.col("value").cast("double"), 6).alias("value"))


@register("cap_sentences", f"""
SELECT doc_id, count(*) AS n_sentences FROM (
  SELECT doc_id, {q.posexplode(q.sentence_array(q.decontract('text')), 'sentence', 'sent_no')} FROM documents)
WHERE sent_no < 2000 GROUP BY doc_id
""")
def _cap_sentences(spark, d):
    s = co.cap_sentences(co.split_sentences(docs(spark, d)), 2000)
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"))


@register("lookup_positions", """
SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def _lookup_positions(spark, d):
    ids = load(spark, d, "labels").where(F.col("quality") == 1).select("doc_id")
    return docs(spark, d).join(ids, "doc_id", "left_semi").select("doc_id", "n_chars")


@register("preview_text", """
SELECT doc_id, left(text, 500) AS head, right(text, 100) AS tail FROM documents
""")
def _preview_text(spark, d):
    return co.preview_text(docs(spark, d)).select("doc_id", "head", "tail")


@register("matrix_shape", """
SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS BIGINT) AS min_dim,
       CAST(max(len(embedding)) AS BIGINT) AS max_dim FROM embeddings
""")
def _matrix_shape(spark, d):
    e = load(spark, d, "embeddings")
    return e.agg(F.count("*").alias("n_rows"), F.min(F.size("embedding")).cast("long").alias("min_dim"),
                 F.max(F.size("embedding")).cast("long").alias("max_dim"))


LINES_SQL = f"""
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM (
  SELECT doc_id, {q.posexplode("string_split(text, chr(10))", "line", "line_no")} FROM documents)
WHERE trim(line) <> ''
"""


@register("prefix_by_words", f"""
SELECT doc_id, line_no, words_before FROM (
  SELECT doc_id, line_no, CAST(coalesce(sum(len({q.words('line')})) OVER (PARTITION BY doc_id ORDER BY line_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before
  FROM ({LINES_SQL}))
WHERE words_before <= 1000
""")
def _prefix_by_words(spark, d):
    return co.prefix_by_words(co.scan_lines(docs(spark, d)), 1000).select("doc_id", "line_no", "words_before")


@register("expand_contractions", f"""
SELECT conv_id, turn, {q.contractions('text')} AS text FROM conversations
""")
def _expand_contractions(spark, d):
    c = load(spark, d, "conversations")
    return c.select("conv_id", "turn", tx.expand_contractions("text").alias("text"))


KEEP_SQL = f"string_split(regexp_replace(text, {q.lit(tx.KEPT_DELIMS)}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"


@register("split_keep_delims", f"""
SELECT doc_id, CAST(piece_no AS BIGINT) AS piece_no, piece FROM (
  SELECT doc_id, {q.posexplode(KEEP_SQL, 'piece', 'piece_no')} FROM documents)
""")
def _split_keep_delims(spark, d):
    return tx.posexplode_rows(docs(spark, d), tx.split_keep_delims("text"), "piece_no", "piece", "doc_id")


@register("capitalize_pieces", f"""
SELECT doc_id, array_to_string(list_transform({KEEP_SQL},
  lambda s: upper(substr(s, 1, 1)) || lower(substr(s, 2))), ' ') AS text FROM documents
""")
def _capitalize_pieces(spark, d):
    return docs(spark, d).select("doc_id", tx.capitalized_pieces("text").alias("text"))


@register("rule_sentence_split", f"""
SELECT doc_id, CAST(sent_no AS BIGINT) AS sent_no, sentence FROM (
  SELECT doc_id, {q.posexplode(q.rule_sentence_split('text'), 'sentence', 'sent_no')} FROM documents)
""")
def _rule_sentence_split(spark, d):
    return tx.posexplode_rows(docs(spark, d), tx.rule_sentence_split("text"), "sent_no", "sentence", "doc_id")


CHUNKS_SQL = (f"list_transform(range(0, len({q.words('text')}), 32), "
              f"lambda i: {q.words('text')}[i + 1:i + 32])")


@register("chunk_words", f"""
SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(len(w) AS BIGINT) AS n_words,
       array_to_string(w, ' ') AS chunk FROM (
  SELECT doc_id, {q.posexplode(CHUNKS_SQL, 'w', 'chunk_no')} FROM documents)
""")
def _chunk_words(spark, d):
    return co.chunk_words(docs(spark, d), size=32)


@register("normalize_filters", f"""
SELECT page_id, CAST(len({q.normalize_filters('html')}) AS BIGINT) AS n_tokens,
       array_to_string({q.normalize_filters('html')}, ' ') AS tokens FROM pages
""")
def _normalize_filters(spark, d):
    p = load(spark, d, "pages").select("page_id", tx.normalize_filters("html").alias("t"))
    return p.select("page_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("clean_book_text", """
SELECT source AS author, doc_id,
       ' ' || replace(regexp_replace(regexp_replace(text, '\\n{tx.SPACE}*\\n', chr(10), 'g'), ' +', ' ', 'g'),
                      chr(10), chr(10) || ' ') AS text
FROM documents
""")
def _clean_book_text(spark, d):
    return docs(spark, d).select(F.col("source").alias("author"), "doc_id",
                                 tx.clean_book_text("text").alias("text"))


@register("extract_path_parts", """
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path,
       regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1) AS base
FROM pages
""")
def _extract_path_parts(spark, d):
    return co.extract_path_parts(load(spark, d, "pages")).select("page_id", "host", "path", "base")


@register("word_count_variants", f"""
SELECT doc_id, {WC_RE_SQL} AS wc_regex, CAST(len({q.words('text')}) AS BIGINT) AS wc_split,
       CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS wc_spaces FROM documents
""")
def _word_count_variants(spark, d):
    return docs(spark, d).select("doc_id", tx.wc_regex_split("text").cast("long").alias("wc_regex"),
                                 tx.wc_split("text").cast("long").alias("wc_split"),
                                 tx.wc_spaces("text").cast("long").alias("wc_spaces"))


CHAR_INDEX_SQL = """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS p
           FROM documents),
a AS (SELECT ch, count(*) AS cnt, min(doc_id) AS fd FROM c WHERE ch <> '' GROUP BY ch),
f AS (SELECT a.ch, a.cnt, a.fd, min(c.p) AS fp FROM a JOIN c ON c.ch = a.ch AND c.doc_id = a.fd
      GROUP BY a.ch, a.cnt, a.fd)
SELECT ch, CAST(row_number() OVER (ORDER BY cnt DESC, fd, fp) - 1 AS BIGINT) AS char_id, cnt FROM f
"""


@register("char_index", CHAR_INDEX_SQL)
def _char_index(spark, d):
    return co.char_index(docs(spark, d))


@register("char_sequence", f"""
WITH idx AS ({CHAR_INDEX_SQL}),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, unnest(range(len(string_split(text, '')))) AS p FROM documents),
t AS (SELECT doc_id, count(*) AS n_chars, md5(string_agg(CAST(char_id AS VARCHAR), ' ' ORDER BY p)) AS ids_md5
      FROM c JOIN idx ON c.ch = idx.ch WHERE c.ch <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(t.n_chars, 0) AS n_chars, coalesce(ids_md5, md5('')) AS ids_md5, md5(text) AS text_md5
FROM documents LEFT JOIN t USING (doc_id)
""")
def _char_sequence(spark, d):
    index = co.char_index(docs(spark, d))
    seq = co.char_sequence(docs(spark, d), index)
    back = co.char_text(seq, index).select("doc_id", F.md5("text").alias("text_md5"))
    ids = F.md5(F.array_join(F.transform("char_ids", lambda i: i.cast("string")), " "))
    return seq.select("doc_id", F.size("char_ids").cast("long").alias("n_chars"), ids.alias("ids_md5")).join(back, "doc_id")



@register("distinct_words", f"""
SELECT count(DISTINCT token) AS n_distinct FROM ({CLEAN_TOKENS_SQL})
""")
def _distinct_words(spark, d):
    return st.distinct_count(co.tokens(docs(spark, d)), "token")


@register("distinct_bigrams", f"""
SELECT count(DISTINCT bigram) AS n_bigrams FROM (
  SELECT unnest(list_transform(range(0, greatest(len(w) - 2, 0)), lambda i: w[i + 1] || ' ' || w[i + 2])) AS bigram
  FROM (SELECT {q.words('text')} AS w FROM documents))
""")
def _distinct_bigrams(spark, d):
    return st.distinct_bigrams(docs(spark, d))


def _stats_sql():
    g10 = st.QUANTILE_GRID_10
    g5 = st.QUANTILE_GRID_5
    parts = ["SELECT 'total' AS stat, round(total, 6) AS value FROM a",
             "SELECT 'n_docs', round(n_docs, 6) FROM a", "SELECT 'mean', round(mean, 6) FROM a"]
    parts += [f"SELECT 'q10_{x:.1f}', CAST(floor(q10[{i + 1}]) AS DOUBLE) FROM a" for i, x in enumerate(g10)]
    parts += [f"SELECT 'q5_{x:.1f}', CAST(floor(q5[{i + 1}]) AS DOUBLE) FROM a" for i, x in enumerate(g5)]
    return f"""
WITH s AS (SELECT {WC_RE_SQL} AS n FROM documents),
a AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS n_docs, avg(n) AS mean,
             quantile_cont(n, {g10}) AS q10, quantile_cont(n, {g5}) AS q5 FROM s)
""" + "\nUNION ALL ".join(parts)


@register("corpus_size_stats", _stats_sql())
def _corpus_size_stats(spark, d):
    return st.corpus_size_stats(docs(spark, d).select(tx.wc_regex_split("text").alias("n_words")))


def _hist_sql(values_sql: str, bins: int) -> str:
    return f"""
WITH s AS ({values_sql}),
m AS (SELECT CAST(min(n) AS DOUBLE) AS mn, CAST(max(n) AS DOUBLE) AS mx FROM s),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((n - mn) / (mx - mn) * {bins}), {bins - 1}) END AS BIGINT) AS bin
      FROM s, m),
c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
g AS (SELECT CAST(range AS BIGINT) AS bin, round(mn + range * ((mx - mn) / {bins}), 6) AS lo,
             round(mn + (range + 1) * ((mx - mn) / {bins}), 6) AS hi FROM m, range(0, {bins}))
SELECT g.bin, lo, hi, CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM g LEFT JOIN c ON g.bin = c.bin
"""


@register("size_histogram", _hist_sql(f"SELECT {WC_RE_SQL} AS n FROM documents", 100))
def _size_histogram(spark, d):
    return st.histogram(docs(spark, d).select(tx.wc_regex_split("text").alias("n")), "n", 100)


@register("sentence_length_dist", _hist_sql(
    f"SELECT len(string_split(s, ' ')) AS n FROM (SELECT unnest({q.sentence_array(q.decontract('text'))}) AS s "
    f"FROM documents)", 100))
def _sentence_length_dist(spark, d):
    s = co.split_sentences(docs(spark, d))
    return st.histogram(s.select(F.size(F.split("sentence", " ")).alias("n")), "n", 100)


@register("docs_per_author", "SELECT source AS author, count(*) AS n_docs FROM documents GROUP BY source")
def _docs_per_author(spark, d):
    return st.group_counts(docs(spark, d).withColumnRenamed("source", "author"), "author")


@register("docs_per_style", "SELECT lang AS style, count(*) AS n_docs FROM documents GROUP BY lang")
def _docs_per_style(spark, d):
    return st.group_counts(docs(spark, d).withColumnRenamed("lang", "style"), "style")


@register("words_per_author", f"""
SELECT source AS author, CAST(sum({WC_RE_SQL}) AS BIGINT) AS n_words FROM documents GROUP BY source
ORDER BY n_words DESC, author
""")
def _words_per_author(spark, d):
    x = docs(spark, d).select(F.col("source").alias("author"), tx.wc_regex_split("text").alias("n"))
    return st.group_sums(x, "author", "n", "n_words").orderBy(F.desc("n_words"), "author")


@register("head_mass", f"""
WITH f AS (SELECT token, count(*) AS cnt FROM ({CLEAN_TOKENS_SQL}) GROUP BY token),
r AS (SELECT cnt, row_number() OVER (ORDER BY cnt DESC, token) AS rk FROM f),
t AS (SELECT count(*) AS vocab, sum(cnt) AS total FROM f)
SELECT CAST(vocab AS BIGINT) AS vocab, CAST(total AS BIGINT) AS total,
       CAST(floor(vocab * 0.01) AS BIGINT) AS top_n,
       CAST((SELECT coalesce(sum(cnt), 0) FROM r WHERE rk <= floor(vocab * 0.01)) AS BIGINT) AS top_mass,
       round((SELECT coalesce(sum(cnt), 0) FROM r WHERE rk <= floor(vocab * 0.01)) / total, 6) AS share
FROM t
""")
def _head_mass(spark, d):
    return st.head_mass(st.token_freq(co.tokens(docs(spark, d))), 0.01)


@register("set_union_words", f"""
SELECT DISTINCT token AS word FROM ({CLEAN_TOKENS_SQL}) WHERE NOT (token = lower(token) AND token <> upper(token))
UNION
SELECT word FROM ({BENCH_VOCAB_SQL})
""")
def _set_union_words(spark, d):
    special = co.filter_special_words(co.tokens(docs(spark, d))).select(F.col("token").alias("word"))
    bench = tx.explode_rows(load(spark, d, "benchmark"), tx.normalize_filters("text"), "word")
    return special.union(bench).distinct()


@register("lowercase_lookup", f"""
SELECT lower(token) AS token, count(*) AS cnt FROM ({FILTER_TOKENS_SQL}) GROUP BY lower(token)
""")
def _lowercase_lookup(spark, d):
    t = co.tokens(docs(spark, d), tokenizer="filters")
    return st.token_freq(t.select(F.lower("token").alias("token")))
