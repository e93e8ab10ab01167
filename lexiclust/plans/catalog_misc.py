"""Layer pooling, array scaling, context drift, analogy distance and
annotation-driven normalisation.  Layer tables are derived from
``embeddings``: sentence = label, position = rank of vec_id in the label,
layer l = dims 8l..8l+7 (8 layers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import annotate as an
from ..operators import autoencoder as ae
from ..operators import corpus as co
from ..operators import layers as ly
from ..operators import reduce as rd
from .catalog import register
from .catalog_cluster import sig_sql
from .catalog_models import BATCH, EPOCHS, RATE
from .catalog_prep import SENT_SQL
from .catalog_sim import SIM_SQL, analogies, kv


def layer_table(spark, d):
    return ly.layer_table_from_vectors(load(spark, d, "embeddings"), 8)


LT_SQL = """
lt0 AS (SELECT CAST(label AS BIGINT) AS sent_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos,
               CAST(embedding AS DOUBLE[]) AS ev FROM embeddings),
lt AS (SELECT sent_id, pos, layer, ev[layer * 8 + 1:layer * 8 + 8] AS v FROM lt0, range(8) t(layer)),
ltl AS (SELECT sent_id, pos, layer, unnest(v) AS x, unnest(range(8)) AS dim FROM lt),
edges AS (SELECT sent_id, min(pos) AS lo, max(pos) AS hi FROM lt GROUP BY sent_id)
"""


def pool_sql(min_layer: int) -> str:
    return f"""
WITH {LT_SQL},
p AS (SELECT sent_id, pos, dim, sum(x) AS value FROM ltl WHERE layer >= {min_layer} GROUP BY sent_id, pos, dim)
SELECT p.sent_id, CAST(p.pos AS BIGINT) AS pos, CAST(dim AS BIGINT) AS dim, {sig_sql('value')} AS value
FROM p JOIN edges e ON e.sent_id = p.sent_id WHERE p.pos > e.lo AND p.pos < e.hi
"""


def _pooled(spark, d, last):
    p = ly.pool_layers(layer_table(spark, d), last)
    return p.select("sent_id", F.col("pos").cast("long"), "dim", vx.sig("value").alias("value"))


@register("pool_last4", pool_sql(4))
def _pool_last4(spark, d):
    return _pooled(spark, d, 4)


@register("pool_last", pool_sql(7))
def _pool_last(spark, d):
    return _pooled(spark, d, 1)


@register("vocab_embeddings", f"""
WITH {LT_SQL},
p AS (SELECT sent_id, pos, dim, sum(x) AS value FROM ltl WHERE layer >= 4 GROUP BY sent_id, pos, dim),
q AS (SELECT p.* FROM p JOIN edges e ON e.sent_id = p.sent_id WHERE p.pos > e.lo AND p.pos < e.hi),
f AS (SELECT sent_id, min(pos) AS fp FROM q GROUP BY sent_id)
SELECT q.sent_id, CAST(dim AS BIGINT) AS dim, {sig_sql('value')} AS value FROM q JOIN f ON f.sent_id = q.sent_id
WHERE q.pos = f.fp
""")
def _vocab_embeddings(spark, d):
    v = ly.vocab_embeddings(ly.pool_layers(layer_table(spark, d), 4))
    return v.select("sent_id", "dim", vx.sig("value").alias("value"))


@register("normalize_minmax", """
SELECT vec_id, CAST(i AS BIGINT) AS i, x / 255.0 AS value FROM (
  SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
""")
def _normalize_minmax(spark, d):
    e = load(spark, d, "embeddings")
    img = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)),
                                         lambda r: F.slice("embedding", r * 8 + 1, 8)).alias("image"))
    flat = ly.normalize_minmax(img, ["vec_id"], "image")
    x = flat.select("vec_id", F.posexplode("image").alias("i", "value"))
    return x.select("vec_id", F.col("i").cast("long"), "value")


@register("context_drift", f"""
WITH {LT_SQL},
p AS (SELECT sent_id, pos, list(value ORDER BY dim) AS v FROM (
        SELECT sent_id, pos, dim, sum(x) AS value FROM ltl WHERE layer >= 4 GROUP BY sent_id, pos, dim) GROUP BY sent_id, pos),
q AS (SELECT p.* FROM p JOIN edges e ON e.sent_id = p.sent_id WHERE p.pos > e.lo AND p.pos < e.hi),
pr AS (SELECT a.sent_id AS sa, b.sent_id AS sb, a.pos AS pa, b.pos AS pb, list_distance(a.v, b.v) AS dist
       FROM q a JOIN q b ON (a.sent_id <> b.sent_id OR a.pos <> b.pos) AND (a.pos = b.pos OR a.sent_id = b.sent_id))
SELECT 'same_word' AS kind, pa AS key, {sig_sql('avg(dist)')} AS mean_dist, {sig_sql('max(dist)')} AS max_dist,
       count(*) AS n_pairs FROM pr WHERE pa = pb GROUP BY pa
UNION ALL
SELECT 'same_context', sa, {sig_sql('avg(dist)')}, {sig_sql('max(dist)')}, count(*) FROM pr WHERE sa = sb GROUP BY sa
""")
def _context_drift(spark, d):
    p = ly.pool_layers(layer_table(spark, d), 4)
    arr = p.groupBy("sent_id", "pos").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_s"))
    toks = arr.select("sent_id", "pos", (F.col("sent_id") * 1_000_000 + F.col("pos")).alias("tok_id"),
                      F.transform("_s", lambda s: s["value"]).alias("embedding"))
    r = ly.context_drift(toks, "pos", "sent_id", "tok_id")
    return r.select("kind", F.col("key").cast("long"), vx.sig("mean_dist").alias("mean_dist"),
                    vx.sig("max_dist").alias("max_dist"), "n_pairs")


@register("analogy_distance", f"""
WITH {SIM_SQL},
j AS (SELECT ana.qid, a.v AS va, b.v AS vb, c.v AS vc, d.v AS vd FROM ana JOIN kv a ON a.word = ana.w[1]
      JOIN kv b ON b.word = ana.w[2] JOIN kv c ON c.word = ana.w[3] JOIN kv d ON d.word = ana.w[4]),
g AS (SELECT qid, list_transform(range(len(va)), lambda i: va[i + 1] - vb[i + 1] + vc[i + 1]) AS guess, vd FROM j)
SELECT qid, {sig_sql('list_distance(guess, vd)')} AS l2, {sig_sql('1 - list_cosine_similarity(guess, vd)')} AS cos_dist
FROM g
""")
def _analogy_distance(spark, d):
    r = ly.analogy_distance(kv(spark, d), analogies(spark, d), "w0", "w1", "w2", "w3")
    return r.select("qid", vx.sig("l2").alias("l2"), vx.sig("cos_dist").alias("cos_dist"))


@register("analogy_distance_pca", f"""
WITH {SIM_SQL},
j AS (SELECT ana.qid, a.v AS va, b.v AS vb, c.v AS vc, d.v AS vd FROM ana JOIN kv a ON a.word = ana.w[1]
      JOIN kv b ON b.word = ana.w[2] JOIN kv c ON c.word = ana.w[3] JOIN kv d ON d.word = ana.w[4]),
g AS (SELECT qid, list_transform(range(len(va)), lambda i: va[i + 1] - vb[i + 1] + vc[i + 1]) AS guess, vd FROM j)
SELECT qid, {sig_sql('list_distance(guess, vd)')} AS l2, true AS shorter FROM g
""")
def _analogy_distance_pca(spark, d):
    """On PCA vectors: with all components distances are those of the raw vectors
    (the means cancel), and the first sixteen can only shorten them."""
    v, a = kv(spark, d), analogies(spark, d)
    fit = rd.pca_fit(v, 64)
    whole = rd.pca_transform(v, fit)
    part = whole.withColumn("reduced", F.slice("reduced", 1, 16))
    l2 = ly.analogy_distance(whole, a, "w0", "w1", "w2", "w3", vec_col="reduced").select("qid", "l2")
    less = ly.analogy_distance(part, a, "w0", "w1", "w2", "w3", vec_col="reduced").select("qid", F.col("l2").alias("less"))
    return l2.join(less, "qid").select("qid", vx.sig("l2").alias("l2"), (F.col("less") <= F.col("l2") * (1 + 1e-9)).alias("shorter"))


@register("analogy_distance_encoded")
def _analogy_distance_encoded(spark, d):
    """On the codes of an autoencoder trained on the word vectors."""
    v = kv(spark, d)
    model = ae.stacked_fit(v, [64, 32], "tanh", epochs=EPOCHS, lr=RATE, batch_size=BATCH)
    coded = ae.encode(v, model)
    r = ly.analogy_distance(coded, analogies(spark, d), "w0", "w1", "w2", "w3", vec_col="code")
    return r.select("qid", vx.sig("l2").alias("l2"), vx.sig("cos_dist").alias("cos_dist"))


PRON_SQL = ", ".join(f"'{p}'" for p in an.PRONOUNS)


def ann_sql(sentences: str) -> str:
    """CTEs ``ann2`` (annotated tokens) over ``sentences(doc_id, sent_no, sentence)``."""
    return f"""
s AS ({sentences}),
tk AS (SELECT doc_id, sent_no, unnest(string_split(sentence, ' ')) AS text,
              unnest(range(len(string_split(sentence, ' ')))) AS tok_no FROM s),
ann AS (SELECT *, CASE WHEN lower(text) IN ({PRON_SQL}) THEN 'PRON' WHEN regexp_full_match(text, '[0-9]+') THEN 'NUM'
                  WHEN tok_no > 0 AND upper(substr(text, 1, 1)) = substr(text, 1, 1)
                       AND lower(substr(text, 1, 1)) <> substr(text, 1, 1) THEN 'PROPN' ELSE 'X' END AS pos FROM tk),
ann2 AS (SELECT *, CASE WHEN pos = 'PRON' THEN '-PRON-' ELSE lower(text) END AS lemma,
                CASE pos WHEN 'NUM' THEN 'CARDINAL' WHEN 'PROPN' THEN 'PERSON' ELSE '' END AS ent_type FROM ann)
"""


ANN_SQL = ann_sql(SENT_SQL)
NORM_SQL = """
w AS (SELECT doc_id, sent_no, tok_no, CASE WHEN ent_type <> '' THEN text WHEN pos = 'PUNCT' THEN NULL
             WHEN pos = 'PRON' THEN 'HE' WHEN pos = 'NUM' THEN 'NUMBER'
             WHEN substr(lemma, 2, length(lemma) - 2) = 'PRON' THEN 'HE'
             WHEN substr(lemma, 2, length(lemma) - 2) = 'NUM' THEN 'NUMBER' ELSE lower(lemma) END AS w FROM ann2),
norm AS (SELECT doc_id, sent_no, coalesce(string_agg(w, ' ' ORDER BY tok_no), '') AS sentence FROM w
         GROUP BY doc_id, sent_no)
"""


def folded_sql(sentences: str, step: str) -> str:
    """``sentences`` with ``step(acc, class, text)`` applied for each entity in order."""
    return f"""
SELECT n.doc_id, n.sent_no, coalesce(list_reduce(ents, lambda acc, x: {step}, sentence), sentence) AS sentence
FROM {sentences} n LEFT JOIN (
  SELECT doc_id, sent_no, list(ent_type || chr(1) || text ORDER BY tok_no) AS ents FROM ann2 WHERE ent_type <> ''
  GROUP BY doc_id, sent_no) e ON n.doc_id = e.doc_id AND n.sent_no = e.sent_no
"""


ENT, ENT_CLASS = "split_part(x, chr(1), 2)", "split_part(x, chr(1), 1)"
SUBSTITUTED_SQL = folded_sql("norm", f"""replace(acc, ' ' || {ENT} || ' ', CASE {ENT_CLASS}
  WHEN 'CARDINAL' THEN ' {tx.ENTITY_WORDS['CARDINAL']} ' ELSE ' {tx.ENTITY_WORDS['PERSON']} ' END)""")
SUFFIX1_SQL = folded_sql("s", f"""CASE WHEN lower({ENT}) = {ENT} AND upper({ENT}) <> {ENT}
  THEN replace(acc, ' ' || {ENT} || ' ', ' ' || {ENT_CLASS} || '1 ')
  ELSE replace(replace(acc, ' ' || {ENT} || ' ', ' ' || {ENT_CLASS} || '1 '),
               ' ' || lower({ENT}) || ' ', ' ' || {ENT_CLASS} || '1 ') END""")


@register("normalize_tokens", f"""
WITH {ANN_SQL}, {NORM_SQL}
SELECT doc_id, sent_no, sentence FROM norm
""")
def _normalize_tokens(spark, d):
    ann, _ = an.lexicon_annotations(co.split_sentences(load(spark, d, "documents")))
    return an.normalize_tokens(ann)


@register("substitute_entities", f"""
WITH {ANN_SQL}, {NORM_SQL}
SELECT doc_id, sent_no, trim(regexp_replace(sentence, '{tx.SPACE}{tx.SPACE}+', ' ', 'g')) AS sentence FROM ({SUBSTITUTED_SQL})
""")
def _substitute_entities(spark, d):
    ann, ents = an.lexicon_annotations(co.split_sentences(load(spark, d, "documents")))
    return an.substitute_entities(an.normalize_tokens(ann), ents)


@register("tag_tokens_suffix1", f"""
WITH sub AS (WITH {ANN_SQL} {SUFFIX1_SQL}),
{ann_sql("SELECT * FROM sub")},
t AS (SELECT doc_id, sent_no, CAST(tok_no AS BIGINT) AS tok_no, CASE WHEN right(text, 1) = '1' THEN text
        WHEN pos = 'PROPN' THEN '{tx.POS_WORDS_SUFFIX1['PROPN']}' WHEN pos = 'PRON' THEN '{tx.POS_WORDS_SUFFIX1['PRON']}'
        WHEN pos = 'NUM' THEN '{tx.POS_WORDS_SUFFIX1['NUM']}' WHEN pos <> 'PUNCT' THEN lower(lemma) END AS token FROM ann2)
SELECT * FROM t WHERE token IS NOT NULL
""")
def _tag_tokens_suffix1(spark, d):
    sents = co.split_sentences(load(spark, d, "documents"))
    ann, ents = an.lexicon_annotations(sents)
    sub = an.substitute_entities_suffix1(sents, ents)
    ann2, _ = an.lexicon_annotations(sub)  # re-annotate the substituted text
    return an.tag_tokens_suffix1(ann2)
