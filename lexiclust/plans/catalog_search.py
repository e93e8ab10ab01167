"""Neighbour search that does not meet every block: the neighbour graph, exact
results on top of it by the metric radius join, and the inverted-file index.

Queries of an approximate search either state their measured recall (checked by
SQL that it is enough: rows whose id is divisible by 20 against all rows) or, where
the exact stage follows, have the same SQL as the plain operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import clusterstats as cs
from ..operators import ivf
from ..operators import metric as me
from ..operators import neighbours as nb
from ..operators import pairs as pr
from ..operators import similarity as sm
from ..operators import validity as va
from . import catalog_compare  # noqa: F401 - registers the SQL used below
from .catalog import ORACLE, register
from .catalog_cluster import emb
from .catalog_sim import SIM_SQL, analogies, kv

K = 10
#: share of the exact neighbours that an approximate search must find
ENOUGH = 0.9


def _asked(e):
    """The rows whose id is divisible by 20, as queries."""
    return e.where(F.col("vec_id") % 20 == 0)


def _exact(e, k):
    """The k nearest rows of each asked row, by a full scan."""
    rows = e.select(F.col("vec_id").alias("_id"), vx.as_double("embedding").alias("_v"))
    found = pr.stream_topk(_asked(rows.withColumn("vec_id", F.col("_id"))).select("_id", "_v", F.array("_id").alias("_ex")), rows, k)
    return found.select(F.col("qid").alias("vec_id"), "rank", F.col("id").alias("nbr_id"), "dist")


@register("knn_graph")
def _knn_graph(spark, d):
    g = nb.knn_graph(emb(spark, d), K)
    return g.select("vec_id", "rank", "nbr_id", vx.sig("dist").alias("dist"))


@register("knn_graph_recall", f"""
SELECT count(*) AS queries, CAST({K} AS BIGINT) AS k, true AS enough FROM embeddings WHERE vec_id % 20 = 0
""")
def _knn_graph_recall(spark, d):
    e = emb(spark, d)
    share = nb.recall(nb.knn_graph(e, K), _exact(e, K), ["vec_id", "nbr_id"])
    return _asked(e).agg(F.count(F.lit(1)).alias("queries")).select(
        "queries", F.lit(K).cast("long").alias("k"), (share >= ENOUGH).alias("enough"))


def _by_graph(e, k):
    return me.knn_by_graph(e, nb.knn_graph(e, k), k)


@register("knn_join_by_graph", ORACLE["knn_join"])
def _knn_join_by_graph(spark, d):
    return _by_graph(emb(spark, d), K).select("vec_id", "rank", "nbr_id", vx.sig("dist").alias("dist"))


@register("knn_density_by_graph", ORACLE["knn_density"])
def _knn_density_by_graph(spark, d):
    e = emb(spark, d)
    dk = pr.kth_distance(_by_graph(e, 2), 2)
    value = F.log(F.lit(3.0)) - vx.log_ball_volume("dk", 64) - F.log(e.agg(F.count("*").cast("double")).scalar())
    return dk.select("vec_id", vx.sig(value).alias("log_density"))


@register("cv_cvnn_by_graph", ORACLE["cv_cvnn"])
def _cv_cvnn_by_graph(spark, d):
    e = emb(spark, d)
    cv = va.ClusterValidity(e, neighbors=_by_graph(e, K))
    return cv.cvnn().select("metric", vx.sig("value").alias("value"))


@register("cs_cvnn_sep_by_graph", ORACLE["cs_cvnn_sep"])
def _cs_cvnn_sep_by_graph(spark, d):
    e = emb(spark, d)
    found = cs.cluster_stats(va.ClusterValidity(e, neighbors=_by_graph(e, K)), ["cvnn_sep"])
    return found.select("label", vx.sig("value").alias("value"))


# --------------------------------------------------------------------------
# inverted-file index


def _word_queries(v):
    return sm.query_vectors(v, v.select(F.col("vec_id").alias("qid"), "word", F.lit(1.0).alias("weight")))


@register("most_similar_index")
def _most_similar_index(spark, d):
    v = kv(spark, d)
    qw = v.select(F.col("vec_id").alias("qid"), "word", F.lit(1.0).alias("weight"))
    r = sm.most_similar(v, qw, K, index=ivf.build(v))
    return r.select("qid", "rank", "vec_id", "word", vx.sig("sim").alias("sim"))


@register("most_similar_index_recall", f"""
WITH {SIM_SQL}
SELECT count(*) AS queries, CAST({K} AS BIGINT) AS k, true AS enough FROM kv WHERE vec_id % 20 = 0
""")
def _most_similar_index_recall(spark, d):
    v = kv(spark, d)
    asked = _word_queries(v).where(F.col("qid") % 20 == 0)
    found = ivf.search(ivf.build(v), _word_queries(v), K)
    exact = pr.cross_topk(asked, v.select("vec_id", "embedding"), K)
    share = nb.recall(found, exact, ["qid", "vec_id"])
    return _asked(v).agg(F.count(F.lit(1)).alias("queries")).select(
        "queries", F.lit(K).cast("long").alias("k"), (share >= ENOUGH).alias("enough"))


def _hit_rates(spark, d, words, topn, probes=None):
    a, v = analogies(spark, d), kv(spark, d)
    h = sm.analogy_hits(v, a, *words, topn, index=ivf.build(v), probes=probes).join(a.select("qid", "section"), "qid")
    return h.withColumn("hit", F.col("hit").cast("double"))


#: more probes than there can be lists: the index then finds what the full scan finds
ALL_LISTS = ivf.MOST_LISTS


@register("analogy_accuracy_index", ORACLE["analogy_accuracy"])
def _analogy_accuracy_index(spark, d):
    h = _hit_rates(spark, d, ("w0", "w1", "w2", "w3"), 1, probes=ALL_LISTS)
    per = h.groupBy(F.col("section").cast("string").alias("section")).agg(
        vx.sig(F.avg("hit")).alias("accuracy"), F.count("*").alias("n"))
    return per.unionByName(h.agg(F.lit("total").alias("section"), vx.sig(F.avg("hit")).alias("accuracy"), F.count("*").alias("n")))


@register("analogy_hit_at_k_index")
def _analogy_hit_at_k_index(spark, d):
    h = _hit_rates(spark, d, ("w1", "w0", "w3", "w2"), K)
    return h.groupBy("section").agg(vx.sig(F.avg("hit")).alias("hit_rate"), F.count("*").alias("n"))
