"""P7: vector n-grams and token n-grams (SQL-checked)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from ..operators import corpus as co
from ..operators import ngrams as ng
from .catalog import register
from .catalog_prep import KEYED_SQL, keyed_vectors
from .catalog_text import STREAM_SQL


@register("vector_ngrams", """
WITH p AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT a.pos AS ngram_id, flatten([a.v, b.v, c.v]) AS w FROM p a JOIN p b ON b.pos = a.pos + 1
      JOIN p c ON c.pos = a.pos + 2)
SELECT CAST(ngram_id AS BIGINT) AS ngram_id, CAST(dim AS BIGINT) AS dim, value FROM (
  SELECT ngram_id, unnest(w) AS value, unnest(range(len(w))) AS dim FROM g)
""")
def _vector_ngrams(spark, d):
    e = load(spark, d, "embeddings")
    g = ng.vector_ngrams(e, 3, transform=lambda v: F.slice(v, 1, 16))
    x = g.select("ngram_id", F.posexplode("embedding").alias("dim", "value"))
    return x.select(F.col("ngram_id").cast("long"), F.col("dim").cast("long"), "value")


@register("vector_ngrams_pca")
def _vector_ngrams_pca(spark, d):
    """n-grams of the vectors reduced to their first 16 principal components."""
    from ..operators import reduce as rd
    e = load(spark, d, "embeddings")
    reduced = rd.pca_transform(e, rd.pca_fit(e, 16)).select("vec_id", F.col("reduced").alias("embedding"))
    x = ng.vector_ngrams(reduced, 3).select("ngram_id", F.posexplode("embedding").alias("dim", "value"))
    return x.select(F.col("ngram_id").cast("long"), F.col("dim").cast("long"), "value")


TOKEN_NGRAMS_SQL = f"""
s AS ({STREAM_SQL}),
w AS (SELECT a.pos AS window_id, a.token || ' ' || b.token || ' ' || c.token AS ngram, a.token AS t0, b.token AS t1,
             c.token AS t2 FROM s a JOIN s b ON b.pos = a.pos + 1 JOIN s c ON c.pos = a.pos + 2)
"""


@register("unique_ngrams", f"""
WITH {TOKEN_NGRAMS_SQL},
f AS (SELECT ngram, min(window_id) AS first_pos FROM w GROUP BY ngram ORDER BY first_pos LIMIT 10000)
SELECT ngram, CAST(first_pos AS BIGINT) AS first_pos, CAST((SELECT max(first_pos) + 1 FROM f) AS BIGINT) AS scanned FROM f
""")
def _unique_ngrams(spark, d):
    from ..functions.text import normalize_filters
    return ng.unique_ngrams(load(spark, d, "documents"), 3, 10000, normalize_filters)


@register("ngrams_known_words", f"""
WITH {TOKEN_NGRAMS_SQL},
k AS ({KEYED_SQL}),
j AS (SELECT w.window_id, lower(t0) || ' ' || lower(t1) || ' ' || lower(t2) AS ngram, k0.vec_id AS v0, k1.vec_id AS v1,
             k2.vec_id AS v2
      FROM w JOIN k k0 ON k0.word = lower(t0) JOIN k k1 ON k1.word = lower(t1) JOIN k k2 ON k2.word = lower(t2)
      WHERE w.window_id < 40000)
SELECT CAST(window_id AS BIGINT) AS ngram_id, ngram, v0, v1, v2 FROM j ORDER BY window_id LIMIT 10000
""")
def _ngrams_known_words(spark, d):
    from ..functions.text import normalize_filters
    # only the first 4 * 10000 windows are scanned: tokenise just that prefix
    s = ng.prefix_stream(load(spark, d, "documents"), normalize_filters, 4 * 10000 + 3 - 1)
    r = ng.ngrams_known_words(s, keyed_vectors(spark, d), 3, 10000)
    return r.select("ngram_id", "ngram", F.col("ids")[0].alias("v0"), F.col("ids")[1].alias("v1"),
                    F.col("ids")[2].alias("v2"))
