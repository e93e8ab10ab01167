"""P5-P6: per-cluster statistics, two-sample tests, corpus comparison, KDE,
and cluster-label utilities (SQL-checked)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..session import load
from ..functions import vectors as vx
from ..operators import clusterstats as cs
from ..operators import pairs as pr
from ..operators import sampling as sp
from ..operators import twosample as ts
from ..operators import validity as va
from ..operators import wishart as wi
from . import sqlgen as q
from .catalog import register
from .catalog_cluster import sig_sql


def emb(spark, d):
    return load(spark, d, "embeddings")


ALL_SRC = "SELECT 'all' AS sample, vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
HALVES_SRC = f"""
SELECT CASE WHEN r < floor(0.5 * n) THEN 'real' ELSE 'generated' END AS sample, vec_id, label, v FROM (
  SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v,
         row_number() OVER (ORDER BY {q.hash_key(42, 'vec_id')}, vec_id) - 1 AS r, count(*) OVER () AS n
  FROM embeddings)
"""


def cs_sql_cte(src: str) -> str:
    return f"""
e AS ({src}),
x AS (SELECT sample, vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS dim FROM e),
cen AS (SELECT sample, label, dim, avg(x) AS c, count(*) AS n FROM x GROUP BY sample, label, dim),
dev AS (SELECT x.sample, x.vec_id, x.label, x.dim, x.x, cen.c FROM x JOIN cen
        ON x.sample = cen.sample AND x.label = cen.label AND x.dim = cen.dim),
pdim AS (SELECT sample, label, dim, count(*) AS n, sum((x - c) * (x - c)) AS ssd FROM dev GROUP BY sample, label, dim),
lab AS (SELECT sample, label, sqrt(sum((ssd / n) * (ssd / n))) AS var_norm FROM pdim GROUP BY sample, label),
cd AS (SELECT a.sample, a.label AS label_a, b.label AS label_b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d
       FROM cen a JOIN cen b ON a.sample = b.sample AND a.dim = b.dim AND a.label <> b.label
       GROUP BY a.sample, a.label, b.label),
meta AS (SELECT sample, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT label) AS DOUBLE) AS kp,
                CAST(max(len(v)) AS DOUBLE) AS d FROM e GROUP BY sample),
pairs AS (SELECT a.sample, a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(a.v, b.v) AS dist
          FROM e a JOIN e b ON a.sample = b.sample AND a.vec_id <> b.vec_id),
lps AS (SELECT sample, li AS label_i, lj AS label_j, sum(dist) AS sum_dist, count(*) AS n_pairs, max(dist) AS max_dist
        FROM pairs GROUP BY sample, li, lj),
rcd AS (SELECT sample, vec_id, label, sqrt(sum((x - c) * (x - c))) AS dist FROM dev GROUP BY sample, vec_id, label),
sz AS (SELECT sample, label, count(*) AS n_l FROM e GROUP BY sample, label),
knn AS (SELECT sample, i, j, li, lj FROM (SELECT *, row_number() OVER (PARTITION BY sample, i ORDER BY dist, j) AS rk
        FROM pairs) WHERE rk <= 10),
rls AS (SELECT sample, i, li, lj, sum(dist) AS s, count(*) AS c FROM pairs GROUP BY sample, i, li, lj),
sil AS (SELECT sample, label, avg((b - a) / greatest(a, b)) AS m FROM (
          SELECT sample, i, li AS label, max(CASE WHEN lj = li THEN s / c END) AS a,
                 min(CASE WHEN lj <> li THEN s / c END) AS b FROM rls GROUP BY sample, i, li) GROUP BY sample, label),
dbs AS (SELECT sample, label, avg(dist) AS s, sum(dist) AS sum_cd FROM rcd GROUP BY sample, label),
dbper AS (SELECT cd.sample, label_a, max(CASE WHEN d = 0 THEN 0.0 ELSE (sa.s + sb.s) / d END) AS score
          FROM cd JOIN dbs sa ON sa.sample = cd.sample AND sa.label = cd.label_a
          JOIN dbs sb ON sb.sample = cd.sample AND sb.label = cd.label_b GROUP BY cd.sample, label_a),
outs AS (SELECT sample, li AS label, sum(CASE WHEN li <> lj THEN 1 ELSE 0 END) AS out FROM knn GROUP BY sample, li),
cs_raw AS (
  SELECT sample, 'sizes' AS stat, label, CAST(n_l AS DOUBLE) AS value FROM sz
  UNION ALL SELECT s.sample, 'mean_dist', s.label, CASE WHEN n_l < 2 THEN 0.0 ELSE 2 * sum_dist / n_pairs END
    FROM sz s LEFT JOIN lps w ON w.sample = s.sample AND w.label_i = s.label AND w.label_j = s.label
  UNION ALL SELECT s.sample, 'max_dist', s.label, max_dist
    FROM sz s JOIN lps w ON w.sample = s.sample AND w.label_i = s.label AND w.label_j = s.label WHERE n_l >= 2
  UNION ALL SELECT s.sample, 'centroid_dist', s.label, 2 * r.s
    FROM sz s JOIN dbs r ON r.sample = s.sample AND r.label = s.label WHERE n_l >= 2
  UNION ALL SELECT s.sample, 'rmsstd', s.label, sqrt(r.sum_cd / ((m.n - m.kp) * m.d))
    FROM sz s JOIN dbs r ON r.sample = s.sample AND r.label = s.label JOIN meta m ON m.sample = s.sample WHERE n_l >= 2
  UNION ALL SELECT s.sample, 'sd_scat', s.label, var_norm
    FROM sz s JOIN lab l ON l.sample = s.sample AND l.label = s.label WHERE n_l >= 2
  UNION ALL SELECT s.sample, 'silhouette', s.label, sil.m / m.kp
    FROM sz s JOIN sil ON sil.sample = s.sample AND sil.label = s.label JOIN meta m ON m.sample = s.sample WHERE n_l >= 2
  UNION ALL SELECT s.sample, 'db_score', s.label, greatest(coalesce(score, 0.0), 0.0)
    FROM sz s LEFT JOIN dbper p ON p.sample = s.sample AND p.label_a = s.label
  UNION ALL SELECT s.sample, 'cvnn_sep', s.label, coalesce(o.out, 0) / (n_l * 10)
    FROM sz s LEFT JOIN outs o ON o.sample = s.sample AND o.label = s.label),
cs AS (SELECT sample, stat, label, {sig_sql('value')} AS value FROM cs_raw)
"""


def spark_cluster_stats(frame, sample: str, stats=None):
    cv = va.ClusterValidity(frame)
    out = cs.cluster_stats(cv, stats)
    return out.select(F.lit(sample).alias("sample"), "stat", "label", vx.sig("value").alias("value"))


# registered key per statistic (the statistic names are the reference's report keys)
CS_KEYS = {"sizes": "cs_sizes", "mean_dist": "cs_mean_intracluster", "max_dist": "cs_max_intracluster",
           "centroid_dist": "cs_centroid_dist", "rmsstd": "cs_rmsstd", "sd_scat": "cs_sd_scat",
           "silhouette": "cs_silhouette", "db_score": "cs_db", "cvnn_sep": "cs_cvnn_sep"}


def _register_cs(stat):
    @register(CS_KEYS[stat], f"WITH {cs_sql_cte(ALL_SRC)}\nSELECT label, value FROM cs WHERE stat = '{stat}'")
    def _q(spark, d):
        return spark_cluster_stats(emb(spark, d), "all", [stat]).select("label", "value")
    return _q


for _s in cs.STATS:
    _register_cs(_s)


def halves(spark, d):
    e = emb(spark, d)
    return sp.split_fractions(e, {"real": 0.5, "generated": 0.5}, ["vec_id"], seed=42, out_col="sample")


def halves_stats(spark, d, stats=None):
    h = halves(spark, d)
    r = spark_cluster_stats(h.where(F.col("sample") == "real"), "real", stats)
    g = spark_cluster_stats(h.where(F.col("sample") == "generated"), "generated", stats)
    return r.unionByName(g)


def tests_sql(vals: str, group: str) -> str:
    z = "((s - n1 * (n1 + n2 + 1) / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0))"
    return f"""
rk AS (SELECT {group} AS g, sample, value, rank() OVER (PARTITION BY {group} ORDER BY value)
              + (count(*) OVER (PARTITION BY {group}, value) - 1) / 2.0 AS r FROM {vals}),
rs AS (SELECT g, sum(CASE WHEN sample = 'real' THEN r ELSE 0.0 END) AS s,
              sum(CASE WHEN sample = 'real' THEN 1.0 ELSE 0.0 END) AS n1,
              sum(CASE WHEN sample = 'generated' THEN 1.0 ELSE 0.0 END) AS n2 FROM rk GROUP BY g),
ec AS (SELECT {group} AS g, value,
              sum(CASE WHEN sample = 'real' THEN 1.0 ELSE 0.0 END) OVER w AS c1,
              sum(CASE WHEN sample = 'generated' THEN 1.0 ELSE 0.0 END) OVER w AS c2 FROM {vals}
       WINDOW w AS (PARTITION BY {group} ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dd AS (SELECT ec.g, rs.n1, rs.n2, max(abs(c1 / rs.n1 - c2 / rs.n2)) AS dstat FROM ec JOIN rs ON ec.g = rs.g
       GROUP BY ec.g, rs.n1, rs.n2),
res AS (SELECT g, 'ranksum' AS test, {z} AS statistic, {ts.erfc_sql(f'abs({z}) / {math.sqrt(2.0)!r}')} AS pvalue
        FROM rs
        UNION ALL SELECT g, 'ks', dstat, {ts.ks_pvalue_sql('dstat', 'n1', 'n2')} FROM dd)
SELECT g AS {group}, test, {sig_sql('statistic')} AS statistic, {sig_sql('pvalue')} AS pvalue FROM res
"""


def _tests_spark(vals, group, exact=False):
    """The oracle has the asymptotic p-value; ``ks_2samp_exact`` the exact one."""
    r = ts.two_sample_tests(vals, group_col=group, sample_col="sample", exact=exact)
    return r.select(group, "test", vx.sig("statistic").alias("statistic"), vx.sig("pvalue").alias("pvalue"))


@register("compare_corpora", f"WITH {cs_sql_cte(HALVES_SRC)},\n{tests_sql('cs', 'stat')}")
def _compare_corpora(spark, d):
    return _tests_spark(halves_stats(spark, d), "stat")


EVENTS_VALS = """
ev AS (SELECT event_type AS grp, 'generated' AS sample, value FROM events WHERE event_type <> 'view'
       UNION ALL SELECT t.grp, 'real', e.value FROM events e
       JOIN (SELECT DISTINCT event_type AS grp FROM events WHERE event_type <> 'view') t ON e.event_type = 'view')
"""


def events_vals(spark, d):
    ev = load(spark, d, "events")
    others = ev.where(F.col("event_type") != "view")
    types = others.agg(F.collect_set("event_type")).scalar()  # distinct event types: bounded
    gen = others.select(F.col("event_type").alias("grp"), F.lit("generated").alias("sample"), "value")
    real = ev.where(F.col("event_type") == "view").select(F.explode(types).alias("grp"), F.lit("real").alias("sample"),
                                                          "value")
    return gen.unionByName(real)


@register("ranksum_test", f"WITH {EVENTS_VALS},\n{tests_sql('ev', 'grp')}".replace(
    "SELECT g AS grp, test", "SELECT g AS grp, test").replace("FROM res", "FROM res WHERE test = 'ranksum'"))
def _ranksum_test(spark, d):
    return _tests_spark(events_vals(spark, d), "grp").where(F.col("test") == "ranksum")


@register("ks_2samp", f"WITH {EVENTS_VALS},\n{tests_sql('ev', 'grp')}".replace(
    "FROM res", "FROM res WHERE test = 'ks'"))
def _ks_2samp(spark, d):
    return _tests_spark(events_vals(spark, d), "grp").where(F.col("test") == "ks")


@register("ks_2samp_exact")
def _ks_2samp_exact(spark, d):
    return _tests_spark(halves_stats(spark, d), "stat", exact=True).where(F.col("test") == "ks")


@register("cluster_sizes", f"""
WITH {cs_sql_cte(HALVES_SRC)}
SELECT label, CAST(max(CASE WHEN sample = 'real' THEN n_l END) AS BIGINT) AS real_size,
       CAST(max(CASE WHEN sample = 'generated' THEN n_l END) AS BIGINT) AS generated_size
FROM sz GROUP BY label
""")
def _cluster_sizes(spark, d):
    h = halves(spark, d)
    c = h.groupBy("label").agg(
        F.sum((F.col("sample") == "real").cast("long")).alias("real_size"),
        F.sum((F.col("sample") == "generated").cast("long")).alias("generated_size"))
    return c.select(F.col("label").cast("long"), F.when(F.col("real_size") > 0, F.col("real_size")).alias("real_size"),
                    F.when(F.col("generated_size") > 0, F.col("generated_size")).alias("generated_size"))


@register("kde_curve", f"""
WITH {cs_sql_cte(HALVES_SRC)},
st AS (SELECT sample, stat, count(*) AS n, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx
       FROM cs GROUP BY sample, stat),
st2 AS (SELECT *, pow(n, -0.2) * sd AS bw FROM st),
st3 AS (SELECT *, mn - 3.0 * bw AS lo, mx + 3.0 * bw AS hi FROM st2 WHERE bw > 0),
g AS (SELECT cs.sample, cs.stat, cs.value, st3.n, st3.bw, st3.lo, st3.hi, unnest(range(200)) AS grid_no
      FROM cs JOIN st3 ON cs.sample = st3.sample AND cs.stat = st3.stat),
k AS (SELECT sample, stat, grid_no, lo + grid_no * (hi - lo) / 199 AS x, n, bw,
             sum(exp(-0.5 * ((lo + grid_no * (hi - lo) / 199 - value) / bw) * ((lo + grid_no * (hi - lo) / 199 - value) / bw))) AS k
      FROM g GROUP BY sample, stat, grid_no, lo, hi, n, bw)
SELECT sample, stat, CAST(grid_no AS BIGINT) AS grid_no, {sig_sql('x')} AS x,
       {sig_sql(f'k / (n * bw * {math.sqrt(2 * math.pi)!r})')} AS density FROM k
""")
def _kde_curve(spark, d):
    vals = halves_stats(spark, d)
    k = ts.kde_curve(vals, ["sample", "stat"], points=200)
    return k.select("sample", "stat", "grid_no", vx.sig("x").alias("x"), vx.sig("density").alias("density"))


@register("filter_noise", """
SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings
WHERE label <> (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
""")
def _filter_noise(spark, d):
    return wi.filter_noise(emb(spark, d).select("vec_id", F.col("label").cast("long").alias("label")))


@register("relabel_dense", """
WITH f AS (SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings
           WHERE label <> (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)),
r AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 + CASE WHEN (SELECT min(label) FROM f) = 0 THEN 0 ELSE 1 END
             AS new_label FROM (SELECT DISTINCT label FROM f))
SELECT f.vec_id, CAST(r.new_label AS BIGINT) AS label FROM f JOIN r ON f.label = r.label
""")
def _relabel_dense(spark, d):
    f = wi.filter_noise(emb(spark, d).select("vec_id", F.col("label").cast("long").alias("label")))
    return wi.relabel_dense(f).select("vec_id", "label")


@register("cluster_significance", f"""
WITH e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
dk AS (SELECT i AS vec_id, dist AS dk FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk
       FROM pairs) WHERE rk = 3),
g AS (SELECT label, min(dk) AS r_min, max(dk) AS r_max FROM dk JOIN e USING (vec_id) GROUP BY label),
s AS (SELECT label, r_min, r_max, (pow(r_min, -64) - pow(r_max, -64)) * 3 / (SELECT count(*) FROM e)
             * exp(lgamma(64 / 2.0 + 1) - (64 / 2.0) * ln(pi())) AS sig FROM g)
SELECT label, {sig_sql('r_min')} AS r_min, {sig_sql('r_max')} AS r_max, {sig_sql('sig')} AS significance,
       CASE WHEN isnan(sig) OR sig IS NULL THEN 0 ELSE CAST(sig >= 1.0 AS INTEGER) END AS significant FROM s
""")
def _cluster_significance(spark, d):
    e = emb(spark, d)
    dk = pr.kth_distance(pr.knn(e, 3), 3)
    lab = dk.join(e.select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")
    n = e.agg(F.count("*").cast("double")).scalar()
    r = wi.cluster_significance(lab, k=3, dim=64, h=1.0, n=n)
    return r.select("label", vx.sig("r_min").alias("r_min"), vx.sig("r_max").alias("r_max"),
                    vx.sig("significance").alias("significance"), "significant")


@register("cluster_density_gap", f"""
WITH e AS MATERIALIZED (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.vec_id <> b.vec_id),
dk AS (SELECT i AS vec_id, dist AS dk FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk
       FROM pairs) WHERE rk = 2),
p AS (SELECT label, exp(ln(3) - ((64 / 2.0) * ln(pi()) - lgamma(64 / 2.0 + 1) + 64 * ln(dk)) - ln((SELECT count(*) FROM e))) AS p
      FROM dk JOIN e USING (vec_id))
SELECT label, {sig_sql('max(p) - min(p)')} AS max_gap, CAST(max(p) - min(p) >= 1.0 AS INTEGER) AS significant FROM p GROUP BY label
""")
def _cluster_density_gap(spark, d):
    """The alternative significance: the largest density gap inside a label."""
    e = emb(spark, d)
    n = e.agg(F.count("*").cast("double")).scalar()
    dk = pr.kth_distance(pr.knn(e, 2), 2).join(e.select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")
    dens = dk.withColumn("p", F.exp(F.log(F.lit(3.0)) - vx.log_ball_volume("dk", 64) - F.log(n)))
    return wi.density_gap(dens).select("label", vx.sig("max_gap").alias("max_gap"),
                                       (F.col("max_gap") >= 1.0).cast("int").alias("significant"))
