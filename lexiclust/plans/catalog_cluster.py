"""P3-P6: vector statistics, pairs/kNN, validity indices, per-cluster
statistics and two-sample tests (SQL-checked on ``embeddings``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import load
from ..functions import vectors as vx
from ..operators import metric as me
from ..operators import pairs as pr
from ..operators import vectors as vv
from ..operators import validity as va
from .catalog import register


def sig_sql(e: str) -> str:
    return f"CAST(printf('%.9e', CAST({e} AS DOUBLE)) AS DOUBLE)"


def emb(spark, d):
    return load(spark, d, "embeddings")


BASE = """
e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM e),
cen AS (SELECT label, dim, avg(x) AS c, count(*) AS n FROM x GROUP BY label, dim),
gm AS (SELECT dim, avg(x) AS g FROM x GROUP BY dim),
dev AS (SELECT x.vec_id, x.label, x.dim, x.x, cen.c, gm.g FROM x JOIN cen ON x.label = cen.label AND x.dim = cen.dim
        JOIN gm ON x.dim = gm.dim),
pdim AS (SELECT label, dim, count(*) AS n, sum((x - c) * (x - c)) AS ssd FROM dev GROUP BY label, dim),
lab AS (SELECT label, first(n) AS n, sum(ssd) AS ss, sqrt(sum((ssd / n) * (ssd / n))) AS var_norm,
               sqrt(sum(ssd / n)) AS std_norm FROM pdim GROUP BY label),
gdim AS (SELECT dim, count(*) AS n, sum((x - g) * (x - g)) AS ssd FROM dev GROUP BY dim),
gs AS (SELECT sum(ssd) AS sst, sqrt(sum((ssd / n) * (ssd / n))) AS var_norm, sqrt(sum(ssd / n)) AS std_norm FROM gdim),
cd AS (SELECT a.label AS label_a, b.label AS label_b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d
       FROM cen a JOIN cen b ON a.dim = b.dim AND a.label <> b.label GROUP BY a.label, b.label),
meta AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(max(label) + 1 AS DOUBLE) AS k,
                CAST(count(DISTINCT label) AS DOUBLE) AS kp, CAST(max(len(v)) AS DOUBLE) AS d FROM e),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(a.v, b.v) AS dist
          FROM e a JOIN e b ON a.vec_id <> b.vec_id),
lps AS (SELECT li AS label_i, lj AS label_j, sum(dist) AS sum_dist, count(*) AS n_pairs, max(dist) AS max_dist,
               min(CASE WHEN dist > 0 THEN dist END) AS min_nz_dist FROM pairs GROUP BY li, lj),
rcd AS (SELECT vec_id, label, sqrt(sum((x - c) * (x - c))) AS dist FROM dev GROUP BY vec_id, label),
knn AS (SELECT i, j, li, lj FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM pairs)
        WHERE rk <= 10)
"""

METRIC_SQL = {
    "rmsstd": "sqrt((SELECT sum(ss) FROM lab) / ((n - k) * d))",
    "r_squared": "((SELECT sst FROM gs) - (SELECT sum(ss) FROM lab)) / (SELECT sst FROM gs)",
    "hubert": "(SELECT sum(sum_dist * cd.d) FROM lps JOIN cd ON label_i = label_a AND label_j = label_b) * 2 "
              "/ (n * (n - 1))",
    "ch_index": "CASE WHEN (SELECT sum(ss) FROM lab) = 0 THEN 1.0 ELSE "
                "(SELECT sum(cen.n * (c - g) * (c - g)) FROM cen JOIN gm ON cen.dim = gm.dim) * (n - kp) "
                "/ ((SELECT sum(ss) FROM lab) * (kp - 1)) END",
    "i_index": "sqrt((SELECT sst FROM gs)) * (SELECT max(d) FROM cd) / (k * (SELECT sum(sqrt(ss)) FROM lab))",
    "dunn": "CASE WHEN (SELECT count(*) FROM lps WHERE label_i <> label_j AND min_nz_dist IS NULL) > 0 THEN NULL "
            "ELSE (SELECT min(min_nz_dist) FROM lps WHERE label_i <> label_j) / "
            "coalesce((SELECT max(max_dist) FROM lps WHERE label_i = label_j), 0) END",
    "silhouette": "CASE WHEN kp < 2 OR kp > n - 1 THEN NULL ELSE (SELECT avg(s) FROM sil) END",
    "davies_bouldin": "CASE WHEN kp < 2 THEN NULL WHEN (SELECT max(s) FROM dbs) = 0 OR "
                      "coalesce((SELECT max(d) FROM cd), 0) = 0 THEN 0.0 ELSE (SELECT avg(score) FROM dbper) END",
    "xie_beni": "(SELECT sum(ss) FROM lab) / (n * (SELECT min(d) FROM cd) * (SELECT min(d) FROM cd))",
    "sd": "(SELECT sum(var_norm) FROM lab) / ((SELECT var_norm FROM gs) * k) + (SELECT max(d) FROM cd) / "
          "(SELECT min(d) FROM cd) * (SELECT sum(1.0 / sd) FROM (SELECT sum(d) AS sd FROM cd GROUP BY label_a))",
    "s_dbw": "(SELECT CASE WHEN sum(CASE WHEN greatest(da, db) = 0 THEN 1 ELSE 0 END) > 0 THEN NULL "
             "ELSE sum((cnt + cnt_rev) / greatest(da, db)) END FROM sdbw_pair) / (k * (k - 1)) "
             "+ (SELECT sum(std_norm) FROM lab) / ((SELECT std_norm FROM gs) * k)",
    "cvnn": "(SELECT coalesce(sum(sum_dist / n_pairs), 0) FROM lps WHERE label_i = label_j AND n_pairs > 0) "
            "+ (SELECT max(coalesce(o.out, 0) / (s.n_l * 10)) FROM (SELECT label, count(*) AS n_l FROM e GROUP BY label) s "
            "LEFT JOIN (SELECT li AS label, sum(CASE WHEN li <> lj THEN 1 ELSE 0 END) AS out FROM knn GROUP BY li) o "
            "ON s.label = o.label)",
}

EXTRA = {
    "silhouette": """,
rls AS (SELECT i AS vec_id, li AS label, lj AS other_label, sum(dist) AS s, count(*) AS c FROM pairs GROUP BY i, li, lj),
per AS (SELECT vec_id, label, max(CASE WHEN other_label = label THEN s / c END) AS a,
               max(CASE WHEN other_label = label THEN c END) AS n_same,
               min(CASE WHEN other_label <> label THEN s / c END) AS b FROM rls GROUP BY vec_id, label),
sil AS (SELECT CASE WHEN coalesce(n_same, 0) = 0 THEN 0.0
                    ELSE coalesce(CASE WHEN isnan((b - a) / greatest(a, b)) THEN 0.0 ELSE (b - a) / greatest(a, b) END, 0.0)
               END AS s FROM per)""",
    "davies_bouldin": """,
dbs AS (SELECT label, avg(dist) AS s FROM rcd GROUP BY label),
dbper AS (SELECT label_a, max(CASE WHEN d = 0 THEN 0.0 ELSE (sa.s + sb.s) / d END) AS score
          FROM cd JOIN dbs sa ON sa.label = cd.label_a JOIN dbs sb ON sb.label = cd.label_b GROUP BY label_a)""",
    "s_dbw": """,
rad AS (SELECT sqrt((SELECT sum(std_norm) FROM lab)) / (SELECT k FROM meta) AS r),
own AS (SELECT label, sum(CASE WHEN dist <= (SELECT r FROM rad) THEN 1 ELSE 0 END) AS dens FROM rcd GROUP BY label),
mids AS (SELECT a.label AS label_a, b.label AS label_b, a.dim, (a.c + b.c) * 0.5 AS m
         FROM cen a JOIN cen b ON a.dim = b.dim AND a.label <> b.label),
nd AS (SELECT x.label AS label_a, m.label_b, x.vec_id, sqrt(sum((x.x - m.m) * (x.x - m.m))) AS dist
       FROM x JOIN mids m ON x.label = m.label_a AND x.dim = m.dim GROUP BY x.label, m.label_b, x.vec_id),
near AS (SELECT label_a, label_b, sum(CASE WHEN dist <= (SELECT r FROM rad) THEN 1 ELSE 0 END) AS cnt
         FROM nd GROUP BY label_a, label_b),
sdbw_pair AS (SELECT n1.label_a, n1.label_b, n1.cnt, n2.cnt AS cnt_rev, oa.dens AS da, ob.dens AS db
              FROM near n1 JOIN near n2 ON n1.label_a = n2.label_b AND n1.label_b = n2.label_a
              JOIN own oa ON oa.label = n1.label_a JOIN own ob ON ob.label = n1.label_b)""",
}


def cv_sql(metrics: list[str]) -> str:
    extra = "".join(EXTRA.get(m, "") for m in metrics)
    sel = "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, {sig_sql('coalesce(' + METRIC_SQL[m] + ', CAST(' + repr('nan') + ' AS DOUBLE))')} "
        f"AS value FROM meta" for m in metrics)
    return f"WITH {BASE}{extra}\n{sel}"


def _cv(spark, d, metrics):
    cv = va.ClusterValidity(emb(spark, d))
    out = None
    for m in metrics:
        r = getattr(cv, m)()
        out = r if out is None else out.unionByName(r)
    return out.select("metric", vx.sig("value").alias("value"))


def _register_cv(metric):
    @register("cv_ch" if metric == "ch_index" else f"cv_{metric}", cv_sql([metric]))
    def _q(spark, d):
        return _cv(spark, d, [metric])
    return _q


for _m in va.METRICS:
    _register_cv(_m)


@register("cv_run_all", cv_sql(va.METRICS))
def _cv_run_all(spark, d):
    return _cv(spark, d, va.METRICS)


@register("cv_silhouette_square", """
WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, a.label, b.label AS other, sum(pow(list_distance(a.v, b.v), 2)) AS s, count(*) AS n
      FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
m AS (SELECT vec_id, max(CASE WHEN label = other THEN s / n END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b
      FROM p GROUP BY vec_id)
SELECT 'silhouette_square' AS metric, """ + sig_sql("avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)") + """ AS value FROM m
""")
def _cv_silhouette_square(spark, d):
    """The approximate form: squared distances, from label sums in one scan."""
    rows = vv.square_silhouette(emb(spark, d))
    return rows.agg(F.avg("s").alias("s")).select(F.lit("silhouette_square").alias("metric"), vx.sig("s").alias("value"))


# --------------------------------------------------------------------------
# P3 vector statistics

@register("vector_mean", f"""
WITH {BASE}
SELECT CAST(dim AS BIGINT) AS dim, {sig_sql('avg(x)')} AS mean FROM x GROUP BY dim
""")
def _vector_mean(spark, d):
    return vv.vector_mean(emb(spark, d)).select("dim", vx.sig("mean").alias("mean"))


@register("row_mean_max", f"""
WITH {BASE}
SELECT {sig_sql('max(m)')} AS max_row_mean FROM (SELECT vec_id, avg(x) AS m FROM x GROUP BY vec_id)
""")
def _row_mean_max(spark, d):
    return vv.row_mean_max(emb(spark, d)).select(vx.sig("max_row_mean").alias("max_row_mean"))


@register("centroids", f"""
WITH {BASE}
SELECT label, CAST(dim AS BIGINT) AS dim, {sig_sql('c')} AS c, n FROM cen
""")
def _centroids(spark, d):
    c = vv.centroids_long(emb(spark, d).withColumn("label", F.col("label").cast("long")))
    return c.select("label", "dim", vx.sig("c").alias("c"), "n")


@register("vector_variance", f"""
WITH {BASE}
SELECT label, {sig_sql('var_norm')} AS var_norm, {sig_sql('std_norm')} AS std_norm FROM lab
UNION ALL SELECT -1, {sig_sql('var_norm')}, {sig_sql('std_norm')} FROM gs
""")
def _vector_variance(spark, d):
    e = emb(spark, d).withColumn("label", F.col("label").cast("long"))
    dev = vv.deviations(e)
    per = vv.label_scatter(dev).select("label", "var_norm", "std_norm")
    allr = vv.global_scatter(dev).select(F.lit(-1).cast("long").alias("label"), "var_norm", "std_norm")
    return per.unionByName(allr).select("label", vx.sig("var_norm").alias("var_norm"),
                                        vx.sig("std_norm").alias("std_norm"))


@register("cosine_distance", f"""
WITH {BASE},
cv AS (SELECT label, list(c ORDER BY dim) AS cvec FROM cen GROUP BY label)
SELECT vec_id, {sig_sql('1 - list_dot_product(v, cvec) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(cvec, cvec)))')}
       AS cos_dist FROM e JOIN cv ON e.label = cv.label
""")
def _cosine_distance(spark, d):
    r = vv.row_centroid_distance(emb(spark, d))
    return r.select("vec_id", vx.sig("cos_dist").alias("cos_dist"))


@register("rmse_distance", f"""
WITH {BASE}
SELECT vec_id, {sig_sql('sqrt(sum((x - c) * (x - c)) / count(*))')} AS rmse FROM dev GROUP BY vec_id
""")
def _rmse_distance(spark, d):
    r = vv.row_centroid_distance(emb(spark, d))
    return r.select("vec_id", vx.sig("rmse").alias("rmse"))


@register("nearest_centroid", f"""
WITH {BASE},
cv AS (SELECT label, list(c ORDER BY dim) AS cvec FROM cen GROUP BY label),
dd AS (SELECT e.vec_id, cv.label AS cl, list_distance(e.v, cv.cvec) AS dist FROM e JOIN cv ON true)
SELECT vec_id, arg_min(cl, struct_pack(d := dist, l := cl)) AS nearest, {sig_sql('min(dist)')} AS dist
FROM dd GROUP BY vec_id
""")
def _nearest_centroid(spark, d):
    e = emb(spark, d)
    cen = vv.centroid_arrays(e.withColumn("label", F.col("label").cast("long")))
    r = vv.nearest_centroid(e, cen)
    return r.select("vec_id", "nearest", vx.sig("dist").alias("dist"))


# --------------------------------------------------------------------------
# P4 pairs and kNN

@register("knn_join", f"""
WITH {BASE}
SELECT i AS vec_id, CAST(rk AS BIGINT) AS rank, j AS nbr_id, {sig_sql('dist')} AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM pairs) WHERE rk <= 10
""")
def _knn_join(spark, d):
    k = pr.knn(emb(spark, d), 10)
    return k.select("vec_id", "rank", "nbr_id", vx.sig("dist").alias("dist"))


@register("pairwise_distance", f"""
WITH {BASE}
SELECT label_i, label_j, {sig_sql('sum_dist')} AS sum_dist, n_pairs, {sig_sql('max_dist')} AS max_dist,
       {sig_sql('min_nz_dist')} AS min_nz_dist FROM lps
""")
def _pairwise_distance(spark, d):
    s = pr.label_pair_stats(emb(spark, d))
    return s.select("label_i", "label_j", vx.sig("sum_dist").alias("sum_dist"), "n_pairs",
                    vx.sig("max_dist").alias("max_dist"), vx.sig("min_nz_dist").alias("min_nz_dist"))


def _dk(spark, d, k):
    """``(vec_id, dk, rnk)``: k-th neighbour distance and the visiting rank
    (dk ascending, then id)."""
    from ..operators.ordering import global_index
    e = emb(spark, d)
    dk = pr.kth_distance(pr.knn(e, k), k)
    return global_index(dk, ["dk", "vec_id"], "rnk")


@register("radius_join", f"""
WITH e AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
dk AS MATERIALIZED (SELECT i, dist AS dk, row_number() OVER (ORDER BY dist, i) AS rnk
       FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk FROM pairs) WHERE rk = 3),
near AS MATERIALIZED (SELECT pairs.i, pairs.j, pairs.dist, dk.rnk FROM pairs JOIN dk ON pairs.i = dk.i WHERE pairs.dist <= dk.dk)
SELECT near.i AS vec_id, near.j AS nbr_id, {sig_sql('near.dist')} AS dist
FROM near JOIN dk other ON near.j = other.i WHERE other.rnk < near.rnk
""")
def _radius_join(spark, d):
    e = emb(spark, d).join(_dk(spark, d, 3), "vec_id")
    r = me.radius_join(e, "dk", "rnk")
    return r.select("vec_id", "nbr_id", vx.sig("dist").alias("dist"))


@register("ball_volume", f"""
WITH {BASE.replace("pairs AS (", "pairs AS MATERIALIZED (")},
dk AS MATERIALIZED (SELECT i AS vec_id, dist AS dk FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk
       FROM pairs) WHERE rk = 3)
SELECT vec_id, {sig_sql('(64 / 2.0) * ln(pi()) - lgamma(64 / 2.0 + 1) + 64 * ln(dk)')} AS log_volume FROM dk
""")
def _ball_volume(spark, d):
    e = emb(spark, d)
    dk = pr.kth_distance(pr.knn(e, 3), 3)
    return dk.select("vec_id", vx.sig(vx.log_ball_volume("dk", 64)).alias("log_volume"))


@register("knn_density", f"""
WITH {BASE.replace("pairs AS (", "pairs AS MATERIALIZED (")},
dk AS MATERIALIZED (SELECT i AS vec_id, dist AS dk FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk
       FROM pairs) WHERE rk = 2)
SELECT vec_id, {sig_sql('ln(3) - ((64 / 2.0) * ln(pi()) - lgamma(64 / 2.0 + 1) + 64 * ln(dk)) - ln((SELECT n FROM meta))')}
       AS log_density FROM dk
""")
def _knn_density(spark, d):
    """p = k / (V(d_k) n) with k = 3: d_k is the (k-1)-th other point, as in
    the reference (its list includes the point itself)."""
    e = emb(spark, d)
    dk = pr.kth_distance(pr.knn(e, 2), 2)
    n = e.agg(F.count("*").cast("double")).scalar()
    val = F.log(F.lit(3.0)) - vx.log_ball_volume("dk", 64) - F.log(n)
    return dk.select("vec_id", vx.sig(val).alias("log_density"))
