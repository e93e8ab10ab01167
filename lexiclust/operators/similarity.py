"""Word-vector similarity: most-similar search, analogies, word-pair
evaluation, medoids.

Query vectors follow the usual keyed-vector convention: the mean of
``weight * unit(v)`` over the query words (weight +1 positive, -1
negative); candidates are ranked by cosine similarity, input words
excluded.  Scoring runs in the blocked query x vector engine
(``pairs.cross_topk``), so no query x vocabulary table is materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import ivf
from . import pairs as pr
from .vectors import centroid_arrays


def unit_long(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
              word_col: str = "word") -> DataFrame:
    """``(word, vec_id, dim, u)`` with u the unit-normalised component."""
    v = vectors.select(word_col, id_col, vx.unit(vx.as_double(vec_col)).alias("_u"))
    return v.select(word_col, id_col, F.posexplode("_u").alias("dim", "u"))


def query_vectors(vectors: DataFrame, query_words: DataFrame, word_col: str = "word",
                  id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_words(qid, word, weight)`` -> ``(qid, qvec, exclude)``; words
    without a vector are skipped (a query with none produces no row)."""
    ul = unit_long(vectors, id_col, vec_col, word_col)
    j = query_words.join(ul, word_col)
    per_dim = j.groupBy("qid", "dim").agg(F.avg(F.col("weight") * F.col("u")).alias("m"))
    qv = per_dim.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("_s"))
    ex = query_words.join(vectors.select(word_col, id_col), word_col) \
        .groupBy("qid").agg(F.collect_set(id_col).alias("exclude"))  # a query's own words: bounded
    return qv.select("qid", F.transform("_s", lambda s: s["m"]).alias("qvec")).join(ex, "qid")


def most_similar(vectors: DataFrame, query_words: DataFrame, topn: int = 10, word_col: str = "word",
                 id_col: str = "vec_id", vec_col: str = "embedding", index: ivf.Index | None = None,
                 probes: int | None = None) -> DataFrame:
    """``(qid, rank, vec_id, word, sim)``; exact, or by the lists of an ``index``
    of the same vectors (``probes`` of them, measured where not given)."""
    q = query_vectors(vectors, query_words, word_col, id_col, vec_col)
    if index is not None:
        top = ivf.search(index, q, topn, probes).withColumnRenamed("vec_id", id_col)
    else:
        top = pr.cross_topk(q, vectors.select(id_col, vec_col), topn, "qid", "qvec", "exclude", id_col, vec_col)
    return top.join(vectors.select(id_col, word_col), id_col)


def analogy_queries(analogies: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """``(qid, word, weight)``: +b +c -a (the answer is expected next)."""
    return analogies.select("qid", F.explode(F.array(
        F.struct(F.lower(F.col(b)).alias("word"), F.lit(1.0).alias("weight")),
        F.struct(F.lower(F.col(c)).alias("word"), F.lit(1.0).alias("weight")),
        F.struct(F.lower(F.col(a)).alias("word"), F.lit(-1.0).alias("weight")))).alias("q")) \
        .select("qid", "q.word", "q.weight")


def analogy_hits(vectors: DataFrame, analogies: DataFrame, a: str, b: str, c: str, expected: str,
                 topn: int, word_col: str = "word", index: ivf.Index | None = None, probes: int | None = None) -> DataFrame:
    """Per analogy ``(qid, hit)``: expected word within the top ``topn``.
    Analogies with an unknown word are skipped (inner joins); ``index`` and
    ``probes`` as for ``most_similar``."""
    known = vectors.select(F.col(word_col).alias("_w"))
    ok = analogies
    for col in (a, b, c, expected):
        ok = ok.join(known, F.lower(F.col(col)) == F.col("_w"), "left_semi")
    res = most_similar(vectors, analogy_queries(ok, a, b, c), topn, word_col, index=index, probes=probes)
    hits = res.join(ok.select("qid", F.lower(F.col(expected)).alias("_exp")), "qid") \
        .groupBy("qid").agg(F.max((F.col(word_col) == F.col("_exp")).cast("int")).alias("hit"))
    return ok.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("hit", F.lit(0)).alias("hit"))


def word_pair_eval(vectors: DataFrame, pairs: DataFrame, word_col: str = "word",
                   vec_col: str = "embedding") -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks) of cosine similarity
    vs the human score over pairs with both words known; OOV share in %."""
    v1 = vectors.select(F.col(word_col).alias("w1"), F.col(vec_col).alias("v1"))
    v2 = vectors.select(F.col(word_col).alias("w2"), F.col(vec_col).alias("v2"))
    j = pairs.join(v1, "w1").join(v2, "w2").withColumn(
        "sim", F.round(1 - vx.cosine_distance(vx.as_double("v1"), vx.as_double("v2")), 12))  # noise makes no ranks
    j = j.select("w1", "w2", "score", "sim")
    r = avg_rank(avg_rank(j, "score", "rs", ["w1", "w2"]), "sim", "rc", ["w1", "w2"])
    total = pairs.agg(F.count("*")).scalar()
    return r.agg(F.corr("sim", "score").alias("pearson"), F.corr("rc", "rs").alias("spearman"),
                 (100.0 * (1 - F.try_divide(F.count("*"), total))).alias("oov_pct"))


def avg_rank(df: DataFrame, col: str, out: str, key: list[str]) -> DataFrame:
    """1-based average rank of ``col`` (ties share the mean rank), from a
    distributed dense index - no one-partition window."""
    from .ordering import global_index
    idx = global_index(df, [col, *key], "_i")
    ties = idx.groupBy(col).agg(((F.min("_i") + F.max("_i")) / 2.0 + 1).alias(out))
    return idx.join(ties, col).drop("_i")


def medoids(df: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per label the member with the smallest mean cosine distance to the
    other members (ties: smaller id): ``(label, medoid_id, mean_cos_dist)``.
    Cosines are linear in the unit vectors: those of a row to all others of its
    label sum to ``u . (sum of the label) - u . u``, so no pair of rows is formed."""
    unit = df.select(F.col(label_col).cast("long").alias("label"), F.col(id_col).alias("id"),
                     vx.unit(vx.as_double(vec_col)).alias("u"))
    centre = centroid_arrays(unit, "label", "id", "u")
    rows = unit.join(centre, "label").where(F.col("n") > 1)
    others = vx.dot("u", "centroid") * F.col("n") - vx.dot("u", "u")
    own = rows.select("label", "id", (1.0 - F.try_divide(others, F.col("n") - 1)).alias("m"))
    best = own.groupBy("label").agg(F.min(F.struct("m", "id")).alias("b"))
    return best.select(F.col("label").alias(label_col), F.col("b.id").alias("medoid_id"), F.col("b.m").alias("mean_cos_dist"))
