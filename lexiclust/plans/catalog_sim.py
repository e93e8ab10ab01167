"""P3: word-vector similarity queries over the keyed vectors (benchmark
vocabulary zipped with embedding rows).  Analogy quadruples and word pairs
are derived from the sorted vocabulary: quadruple m = words 4m..4m+3
(section = m div 25); pair m = words 2m, 2m+1 with score 10 - |length gap|."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from ..functions import vectors as vx
from ..operators import lookup as lk
from ..operators import similarity as sm
from ..operators import stats as st
from ..operators import corpus as co
from ..operators.ordering import global_index
from . import sqlgen as q
from .catalog import register
from .catalog_cluster import sig_sql
from .catalog_prep import BENCH_VOCAB_SQL, FILTER_TOKENS_SQL, KEYED_SQL, bench_vocab, keyed_vectors


def kv(spark, d):
    """Keyed vectors under the word's own number as ``vec_id``."""
    return keyed_vectors(spark, d).select("idx", "word", F.col("idx").alias("vec_id"), "embedding")


def analogies(spark, d):
    v = global_index(bench_vocab(spark, d), ["word"], "i")
    q = v.groupBy(F.floor(F.col("i") / 4).alias("qid")).agg(
        F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))  # four words per group
    q = q.where(F.size("w") == 4)
    return q.select(F.col("qid").cast("long"), F.floor(F.col("qid") / 25).cast("long").alias("section"),
                    *[F.col("w")[j]["word"].alias(f"w{j}") for j in range(4)])


SIM_SQL = f"""
kv AS MATERIALIZED (SELECT word, idx AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM ({KEYED_SQL})),
kvl AS (SELECT word, vec_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM kv),
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS nr FROM kvl GROUP BY vec_id),
ul AS (SELECT kvl.word, kvl.vec_id, dim, x / nr AS u FROM kvl JOIN nrm ON kvl.vec_id = nrm.vec_id),
voc AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM ({BENCH_VOCAB_SQL})),
ana AS (SELECT CAST(floor(i / 4) AS BIGINT) AS qid, CAST(floor(floor(i / 4) / 25) AS BIGINT) AS section,
               list(word ORDER BY i) AS w FROM voc GROUP BY floor(i / 4) HAVING count(*) = 4)
"""


def sims_sql(qw: str, topn: int) -> str:
    """Top-n cosine neighbours for query words ``qw(qid, word, weight)``."""
    return f"""
qm AS (SELECT qid, dim, avg(weight * u) AS m FROM {qw} q JOIN ul ON q.word = ul.word GROUP BY qid, dim),
qn AS (SELECT qid, sqrt(sum(m * m)) AS qn FROM qm GROUP BY qid),
ex AS (SELECT DISTINCT qid, vec_id FROM {qw} q JOIN kv ON q.word = kv.word),
sims AS (SELECT qm.qid, ul.vec_id, ul.word, sum(qm.m * ul.u) / qn.qn / sqrt(sum(ul.u * ul.u)) AS sim
         FROM qm JOIN ul ON qm.dim = ul.dim JOIN qn ON qn.qid = qm.qid GROUP BY qm.qid, ul.vec_id, ul.word, qn.qn),
top AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY sim DESC, s.vec_id) AS rank
        FROM sims s WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.qid = s.qid AND ex.vec_id = s.vec_id))
        WHERE rank <= {topn})
"""


@register("most_similar", f"""
WITH {SIM_SQL},
qw AS (SELECT vec_id AS qid, word, 1.0 AS weight FROM kv),
{sims_sql('qw', 10)}
SELECT qid, CAST(rank AS BIGINT) AS rank, vec_id, word, {sig_sql('sim')} AS sim FROM top
""")
def _most_similar(spark, d):
    v = kv(spark, d)
    qw = v.select(F.col("vec_id").alias("qid"), "word", F.lit(1.0).alias("weight"))
    r = sm.most_similar(v, qw, 10)
    return r.select("qid", "rank", "vec_id", "word", vx.sig("sim").alias("sim"))


ANA_Q_SQL = """
aq AS (SELECT a.* FROM ana a WHERE w[1] IN (SELECT word FROM kv) AND w[2] IN (SELECT word FROM kv)
       AND w[3] IN (SELECT word FROM kv) AND w[4] IN (SELECT word FROM kv))
"""


@register("analogy_accuracy", f"""
WITH {SIM_SQL},{ANA_Q_SQL},
qw AS (SELECT qid, w[2] AS word, 1.0 AS weight FROM aq UNION ALL SELECT qid, w[3], 1.0 FROM aq
       UNION ALL SELECT qid, w[1], -1.0 FROM aq),
{sims_sql('qw', 1)},
hits AS (SELECT aq.qid, aq.section, CAST(coalesce(max(CASE WHEN top.word = aq.w[4] THEN 1 ELSE 0 END), 0) AS DOUBLE) AS hit
         FROM aq LEFT JOIN top ON top.qid = aq.qid GROUP BY aq.qid, aq.section)
SELECT CAST(section AS VARCHAR) AS section, {sig_sql('avg(hit)')} AS accuracy, count(*) AS n FROM hits GROUP BY section
UNION ALL SELECT 'total', {sig_sql('avg(hit)')}, count(*) FROM hits
""")
def _analogy_accuracy(spark, d):
    a = analogies(spark, d)
    h = sm.analogy_hits(kv(spark, d), a, "w0", "w1", "w2", "w3", 1).join(a.select("qid", "section"), "qid")
    h = h.withColumn("hit", F.col("hit").cast("double"))
    per = h.groupBy(F.col("section").cast("string").alias("section")).agg(
        vx.sig(F.avg("hit")).alias("accuracy"), F.count("*").alias("n"))
    tot = h.agg(F.lit("total").alias("section"), vx.sig(F.avg("hit")).alias("accuracy"), F.count("*").alias("n"))
    return per.unionByName(tot)


@register("analogy_hit_at_k", f"""
WITH {SIM_SQL},{ANA_Q_SQL},
qw AS (SELECT qid, w[1] AS word, 1.0 AS weight FROM aq UNION ALL SELECT qid, w[4], 1.0 FROM aq
       UNION ALL SELECT qid, w[2], -1.0 FROM aq),
{sims_sql('qw', 10)},
hits AS (SELECT aq.qid, aq.section, CAST(coalesce(max(CASE WHEN top.word = aq.w[3] THEN 1 ELSE 0 END), 0) AS DOUBLE) AS hit
         FROM aq LEFT JOIN top ON top.qid = aq.qid GROUP BY aq.qid, aq.section)
SELECT section, {sig_sql('avg(hit)')} AS hit_rate, count(*) AS n FROM hits GROUP BY section
""")
def _analogy_hit_at_k(spark, d):
    a = analogies(spark, d)
    # query = +w0 +w3 -w1, expected w2 within the top 10
    h = sm.analogy_hits(kv(spark, d), a, "w1", "w0", "w3", "w2", 10).join(a.select("qid", "section"), "qid")
    return h.groupBy("section").agg(vx.sig(F.avg(F.col("hit").cast("double"))).alias("hit_rate"),
                                    F.count("*").alias("n"))


PAIRS_SQL = f"""
pv AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM ({BENCH_VOCAB_SQL})),
pp AS (SELECT a.word AS w1, b.word AS w2, 10.0 - abs(length(a.word) - length(b.word)) AS score
       FROM pv a JOIN pv b ON b.i = a.i + 1 WHERE a.i = 2 * floor(a.i / 2))
"""


def word_pairs(spark, d):
    v = global_index(bench_vocab(spark, d), ["word"], "i")
    g = v.groupBy(F.floor(F.col("i") / 2).alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    g = g.where(F.size("w") == 2)
    return g.select(F.col("w")[0]["word"].alias("w1"), F.col("w")[1]["word"].alias("w2"),
                    (10.0 - F.abs(F.length(F.col("w")[0]["word"]) - F.length(F.col("w")[1]["word"]))).alias("score"))


@register("word_pair_eval", f"""
WITH {SIM_SQL},{PAIRS_SQL},
j AS (SELECT pp.w1, pp.w2, pp.score, round(list_cosine_similarity(a.v, b.v), 12) AS sim FROM pp JOIN kv a ON a.word = pp.w1
      JOIN kv b ON b.word = pp.w2),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs,
             rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 AS rc FROM j)
SELECT {sig_sql('corr(sim, score)')} AS pearson, {sig_sql('corr(rc, rs)')} AS spearman,
       {sig_sql('100.0 * (1 - count(*) / (SELECT count(*) FROM pp))')} AS oov_pct FROM r
""")
def _word_pair_eval(spark, d):
    r = sm.word_pair_eval(kv(spark, d), word_pairs(spark, d))
    return r.select(vx.sig("pearson").alias("pearson"), vx.sig("spearman").alias("spearman"),
                    vx.sig("oov_pct").alias("oov_pct"))


@register("medoid_word", f"""
WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, a.label, avg(1 - list_cosine_similarity(a.v, b.v)) AS m FROM e a JOIN e b
      ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label)
SELECT label, arg_min(vec_id, struct_pack(m := m, i := vec_id)) AS medoid_id, {sig_sql('min(m)')} AS mean_cos_dist
FROM p GROUP BY label
""")
def _medoid_word(spark, d):
    e = load(spark, d, "embeddings").withColumn("label", F.col("label").cast("long"))
    r = sm.medoids(e)
    return r.select("label", "medoid_id", vx.sig("mean_cos_dist").alias("mean_cos_dist"))


@register("word_neighbourhood", f"""
WITH {SIM_SQL},
f AS (SELECT lower(token) AS word, count(*) AS cnt FROM ({FILTER_TOKENS_SQL}) GROUP BY lower(token)),
qword AS (SELECT kv.word FROM kv JOIN f ON f.word = kv.word ORDER BY f.cnt DESC, kv.word LIMIT 1),
qw AS (SELECT 0 AS qid, word, 1.0 AS weight FROM qword),
{sims_sql('qw', 10)},
given AS (SELECT DISTINCT kv.word FROM kv JOIN (SELECT unnest({q.normalize_filters('text')}) AS word
          FROM conversations) b ON b.word = kv.word)
SELECT 'query' AS role, kv.word, kv.vec_id FROM kv JOIN qword ON qword.word = kv.word
UNION ALL SELECT 'similar', word, vec_id FROM top
UNION ALL SELECT 'given', kv.word, kv.vec_id FROM kv JOIN given ON given.word = kv.word
""")
def _word_neighbourhood(spark, d):
    from ..functions import text as tx
    v = kv(spark, d)
    freq = st.token_freq(co.tokens(load(spark, d, "documents"), tokenizer="filters")
                         .select(F.lower("token").alias("token")))
    best = v.join(freq.withColumnRenamed("token", "word"), "word") \
        .orderBy(F.desc("cnt"), "word").limit(1).select("word")
    query = v.join(best, "word").select(F.lit("query").alias("role"), "word", "vec_id")
    similar = sm.most_similar(v, best.select(F.lit(0).cast("long").alias("qid"), "word", F.lit(1.0).alias("weight")),
                              10).select(F.lit("similar").alias("role"), "word", "vec_id")
    words = tx.explode_rows(load(spark, d, "conversations"), tx.normalize_filters("text"), "word").distinct()
    given = v.join(words, "word", "left_semi").select(F.lit("given").alias("role"), "word", "vec_id")
    return query.unionByName(similar).unionByName(given)
