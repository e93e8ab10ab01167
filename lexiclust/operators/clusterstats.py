"""Per-cluster statistics (one number per cluster) as ``(stat, label, value)``.

They reuse the shared passes of ``ClusterValidity`` (centroid pass, pair
pass, kNN pass).  Quirks kept from the reference: the mean intra-cluster
distance is twice the mean pair distance, the centroid distance is twice the
mean, rmsstd divides by the *global* n - K, silhouette is divided by the
number of clusters, clusters with fewer than two rows are skipped except
where noted (sizes, mean distance -> 0, Davies-Bouldin, CVNN separation).
Contract: labels present are iterated (equal to the reference whenever the
noise label exists).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import extremes
from . import pairs as pr
from . import vectors as vv
from .validity import ClusterValidity

STATS = ["sizes", "mean_dist", "max_dist", "centroid_dist", "rmsstd", "sd_scat", "silhouette",
         "db_score", "cvnn_sep"]


def _out(name: str, df: DataFrame, value) -> DataFrame:
    return df.select(F.lit(name).alias("stat"), F.col("label").cast("long").alias("label"),
                     value.cast("double").alias("value"))


def _within(cv: ClusterValidity, stats: list[str]) -> DataFrame | None:
    """``label, sum_dist, n_pairs, max_dist`` inside labels: from the pair pass if a
    statistic needs it anyway, else from pairs of equal labels, and for the
    largest distance alone from the rows that can reach it."""
    if "silhouette" in stats:
        cv.scan
    if "scan" in cv.__dict__ or "mean_dist" in stats:
        return cv.within()
    if "max_dist" in stats:
        return extremes.diameters(cv.df, block_rows=cv.block_rows).withColumnRenamed("diameter", "max_dist")
    return None


def cluster_stats(cv: ClusterValidity, stats: list[str] | None = None) -> DataFrame:
    stats = stats or STATS
    sizes = cv.df.groupBy("label").agg(F.count("*").alias("n_l"))
    if len(stats) > 1:  # a row a label, which most statistics read
        sizes = cut_lineage(sizes)
    within = _within(cv, stats)
    big = sizes.where(F.col("n_l") >= 2)
    rcd = vv.row_centroid_distance(cv.df).groupBy("label").agg(
        F.avg("dist").alias("mean_cd"), F.sum("dist").alias("sum_cd"))
    if "centroid_dist" in stats and "rmsstd" in stats:
        rcd = cut_lineage(rcd)
    k_unique = cv.k_present
    out = []
    for s in stats:
        if s == "sizes":
            out.append(_out(s, sizes, F.col("n_l")))
        elif s == "mean_dist":
            j = sizes.join(within, "label", "left")
            v = F.when(F.col("n_l") < 2, F.lit(0.0)).otherwise(F.try_divide(2 * F.col("sum_dist"), F.col("n_pairs")))
            out.append(_out(s, j, v))
        elif s == "max_dist":
            out.append(_out(s, big.join(within, "label"), F.col("max_dist")))
        elif s == "centroid_dist":
            out.append(_out(s, big.join(rcd, "label"), 2 * F.col("mean_cd")))
        elif s == "rmsstd":
            v = F.sqrt(F.try_divide(F.col("sum_cd"), (cv.n - k_unique) * cv.d))
            out.append(_out(s, big.join(rcd, "label"), v))
        elif s == "sd_scat":
            out.append(_out(s, big.join(cv.lab, "label"), F.col("var_norm")))
        elif s == "silhouette":
            per = pr.scanned_rows(cv.scan).withColumnsRenamed({"own_mean": "a", "near_mean": "b"})
            sil = per.groupBy("label").agg(F.avg(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("m"))
            out.append(_out(s, big.join(sil, "label"), F.try_divide(F.col("m"), k_unique)))
        elif s == "db_score":
            per, _, _ = cv._db_scores()
            j = sizes.join(per.select(F.col("label_a").alias("label"), "score"), "label", "left")
            out.append(_out(s, j, F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))))
        elif s == "cvnn_sep":
            labs = cv.df.select("vec_id", "label")
            nb = cv.knn.join(labs, "vec_id").join(
                labs.select(F.col("vec_id").alias("nbr_id"), F.col("label").alias("nbr_label")), "nbr_id")
            outside = nb.groupBy("label").agg(
                F.sum((F.col("label") != F.col("nbr_label")).cast("long")).alias("out"))
            j = sizes.join(outside, "label", "left")
            out.append(_out(s, j, F.try_divide(F.coalesce("out", F.lit(0)), F.col("n_l") * cv.n_neighbors)))
        else:
            raise ValueError(s)
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
