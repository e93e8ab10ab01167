"""Cluster validity indices as ``(metric, value)`` rows.

Three shared passes feed every index:

* centroid pass - long-form deviations -> per-label scatter (K rows),
  global scatter (1 row), extremes of the centroid distances (K rows; K^2 only
  for hubert);
* pair pass - blocked all-pairs engine -> label-pair distance aggregates
  and each row's own and nearest label mean (for silhouette); CVNN alone takes
  pairs of equal labels only;
* kNN pass - exact 10-NN (CVNN separation).

S_Dbw finds the midpoints near a row by a radius search over the centroids, and
Dunn alone needs no pair pass: ``extremes`` prunes to the rows that can matter.

Each pass result is small next to the input (K x d, K^2, n, n x k rows)
and is written once through a reliable checkpoint, so the dozen metrics read
it instead of re-running the pair engine.

Conventions follow the reference: K = max(label) + 1 counts the noise label 0
as a cluster; CH, DB and silhouette use the labels present.  A metric that
cannot be computed (zero density, one label) is NaN, not an error.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import cut_lineage
from . import extremes
from . import metric
from . import pairs as pr
from . import vectors as vv

METRICS = ["rmsstd", "r_squared", "hubert", "ch_index", "i_index", "dunn", "silhouette",
           "davies_bouldin", "xie_beni", "sd", "s_dbw", "cvnn"]


def _nan(c):
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


class ClusterValidity:
    def __init__(self, df: DataFrame, label_col: str = "label", id_col: str = "vec_id",
                 vec_col: str = "embedding", n_neighbors: int = 10,
                 block_rows: int = pr.DEFAULT_BLOCK_ROWS, neighbors: DataFrame | None = None):
        self.df = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                            vx.as_double(vec_col).alias("embedding"))
        self.n_neighbors = n_neighbors
        self.block_rows = block_rows
        self._neighbors = neighbors  # optional precomputed kNN (rank <= n_neighbors used)

    # -- one-row summaries, fetched once as literals (not data: four numbers)
    @cached_property
    def _meta(self):
        r = self.df.agg(F.count("*").cast("double").alias("n"), (F.max("label") + 1).cast("double").alias("k"),
                        F.countDistinct("label").cast("double").alias("kp"),
                        F.max(F.size("embedding")).cast("double").alias("d")).first()
        return {c: F.lit(r[c]) for c in ("n", "k", "kp", "d")}

    @property
    def n(self):
        return self._meta["n"]

    @property
    def k(self):
        return self._meta["k"]

    @property
    def k_present(self):
        return self._meta["kp"]

    @property
    def d(self):
        return self._meta["d"]

    @cached_property
    def _glob_vals(self):
        r = self.glob.first()
        return {c: F.lit(r[c]) for c in ("sst", "var_norm", "std_norm")}

    @cached_property
    def _ext(self):
        """Extremes of each centroid's distances to the others; K rows."""
        spread = vv.row_centroid_distance(self.df).groupBy("label").agg(F.avg("dist").alias("spread"))
        return cut_lineage(vv.centroid_extremes(self.cen_arr.join(spread, "label"), spread_col="spread",
                                                block_rows=self.block_rows).join(spread, "label"))

    @cached_property
    def _cd_vals(self):
        r = self._ext.agg(F.max("max_d").alias("maxd"), F.min("min_d").alias("mind"),
                          F.sum(F.try_divide(F.lit(1.0), F.col("sum_d"))).alias("inv")).first()
        return {c: F.lit(r[c]).cast("double") for c in ("maxd", "mind", "inv")}

    # -- centroid pass
    @cached_property
    def dev(self):
        return vv.deviations(self.df)

    @cached_property
    def lab(self):
        return cut_lineage(vv.label_scatter(self.dev))

    @cached_property
    def glob(self):
        return cut_lineage(vv.global_scatter(self.dev))

    @cached_property
    def cen(self):
        return cut_lineage(vv.centroids_long(self.df))

    @cached_property
    def cen_arr(self):
        return cut_lineage(vv.centroid_arrays(self.df))

    @cached_property
    def cd(self):
        return cut_lineage(vv.centroid_distances(self.cen))

    # -- pair and kNN passes
    @cached_property
    def lps(self):
        return cut_lineage(pr.scanned_pairs(self.scan))

    @cached_property
    def scan(self):
        return cut_lineage(pr.label_scan(self.df, block_rows=self.block_rows))

    @cached_property
    def knn(self):
        if self._neighbors is not None:
            return self._neighbors.where(F.col("rank") <= self.n_neighbors)
        return cut_lineage(pr.knn(self.df, self.n_neighbors, block_rows=self.block_rows))

    def within(self) -> DataFrame:
        """``label, sum_dist, n_pairs, max_dist`` inside labels: from the pair pass where
        it has run, else from the pairs of equal labels alone."""
        if "scan" in self.__dict__:
            return self.lps.where(F.col("label_i") == F.col("label_j")).select(
                F.col("label_i").alias("label"), "sum_dist", "n_pairs", "max_dist")
        return pr.own_label_sums(self.df, block_rows=self.block_rows).groupBy("label").agg(
            F.sum("sum_dist").alias("sum_dist"), F.sum("n_own").alias("n_pairs"), F.max("max_dist").alias("max_dist"))

    def _row(self, name: str, frame: DataFrame, value) -> DataFrame:
        return frame.agg(_nan(value).alias("value")).select(F.lit(name).alias("metric"), "value")

    # -- indices
    def rmsstd(self):
        return self._row("rmsstd", self.lab, F.sqrt(F.try_divide(F.sum("ss"), (self.n - self.k) * self.d)))

    def r_squared(self):
        sst = self._glob_vals["sst"]
        return self._row("r_squared", self.lab, F.try_divide(sst - F.sum("ss"), sst))

    def hubert(self):
        j = self.lps.join(self.cd, (F.col("label_i") == F.col("label_a")) & (F.col("label_j") == F.col("label_b")))
        return self._row("hubert", j, F.try_divide(F.sum(F.col("sum_dist") * F.col("d")) * 2, self.n * (self.n - 1)))

    def ch_index(self):
        glob_mean = self.dev.select("dim", "g").distinct()
        extra = self.cen.join(glob_mean, "dim").agg(F.sum(F.col("n") * (F.col("c") - F.col("g")) ** 2)).scalar()
        kp = self.k_present
        intra = F.sum("ss")
        val = F.when(intra == 0, F.lit(1.0)).otherwise(F.try_divide(extra * (self.n - kp), intra * (kp - 1)))
        return self._row("ch_index", self.lab, val)

    def i_index(self):
        sst = self._glob_vals["sst"]
        maxd = self._cd_vals["maxd"]
        return self._row("i_index", self.lab, F.try_divide(F.sqrt(sst) * maxd, self.k * F.sum(F.sqrt("ss"))))

    def dunn(self):
        """From the pair pass where it has run, else by pruned extremes."""
        if "scan" not in self.__dict__:
            return self._row("dunn", self._extremes, F.try_divide(F.max("gap"), F.coalesce(F.max("diameter"), F.lit(0.0))))
        cross = F.col("label_i") != F.col("label_j")
        num = F.when(F.sum(F.when(cross & F.col("min_nz_dist").isNull(), 1).otherwise(0)) > 0, F.lit(None)) \
            .otherwise(F.min(F.when(cross, F.col("min_nz_dist"))))
        den = F.coalesce(F.max(F.when(~cross, F.col("max_dist"))), F.lit(0.0))
        return self._row("dunn", self.lps, F.try_divide(num, den))

    @cached_property
    def _extremes(self):
        """One row: ``gap``, the least distance above 0 of rows of unlike labels (null
        where two labels have one point in common and no other), and ``diameter``."""
        diameter = extremes.diameters(self.df, block_rows=self.block_rows).agg(F.max("diameter")).scalar()
        gap = extremes.label_gap(self.df, block_rows=self.block_rows)
        return cut_lineage(gap.select("gap", diameter.alias("diameter")))

    def _silhouette_rows(self):
        per = pr.scanned_rows(self.scan).withColumnsRenamed({"own_mean": "a", "near_mean": "b"})
        s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(
            F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
        return per.withColumn("s", F.when(F.isnan(s), F.lit(0.0)).otherwise(s))

    def silhouette(self):
        rows = self._silhouette_rows()
        kp = self.k_present
        val = F.when((kp < 2) | (kp > self.n - 1), F.lit(None)).otherwise(F.avg("s"))
        return self._row("silhouette", rows, val)

    def _db_scores(self):
        per = self._ext.where(F.col("score").isNotNull()).select(F.col("label").alias("label_a"), "score")
        all_s_zero = self._ext.agg(F.max("spread") == 0).scalar()
        all_d_zero = self._ext.agg(F.coalesce(F.max("max_d"), F.lit(0.0)) == 0).scalar()
        return per, all_s_zero, all_d_zero

    def davies_bouldin(self):
        per, s0, d0 = self._db_scores()
        val = F.when(self.k_present < 2, F.lit(None)).when(s0 | d0, F.lit(0.0)).otherwise(F.avg("score"))
        return self._row("davies_bouldin", per, val)

    def xie_beni(self):
        mind = self._cd_vals["mind"]
        return self._row("xie_beni", self.lab, F.try_divide(F.sum("ss"), self.n * mind * mind))

    def sd(self):
        all_var = self._glob_vals["var_norm"]
        maxd = self._cd_vals["maxd"]
        mind = self._cd_vals["mind"]
        inv = self._cd_vals["inv"]
        scat = F.try_divide(F.sum("var_norm"), all_var * self.k)
        return self._row("sd", self.lab, scat + F.try_divide(maxd, mind) * inv)

    def s_dbw(self):
        std_sum = self.lab.agg(F.sum("std_norm")).scalar()
        radius = F.try_divide(F.sqrt(std_sum), self.k)
        cen = self.cen_arr
        v = self.df.select("vec_id", "label", "embedding")
        own = v.join(cen.select("label", "centroid"), "label") \
            .groupBy("label").agg(F.sum((vx.l2_dist("embedding", "centroid") <= radius).cast("long")).alias("dens"))
        # |x - (ca + cb) / 2| <= r means |(2 x - ca) - cb| <= 2 r: centroids within a radius of one point a row
        mirrored = v.join(cen.select("label", "centroid"), "label").select(
            "vec_id", "label", vx.sub(vx.scale("embedding", F.lit(2.0)), "centroid").alias("embedding"), (2 * radius).alias("r"))
        hits = metric.radius_search(mirrored, cen, "r", point_id="label", point_vec="centroid", apart=("label", "label"),
                                    block_rows=self.block_rows)
        counted = hits.join(v.select("vec_id", "label"), "vec_id").groupBy(
            F.col("label").alias("label_a"), F.col("nbr_id").alias("label_b")).agg(F.count(F.lit(1)).alias("cnt"))
        da = own.select(F.col("label").alias("label_a"), F.col("dens").alias("da"))
        db = own.select(F.col("label").alias("label_b"), F.col("dens").alias("db"))
        # the term (cnt_ab + cnt_ba) / max(da, db) of both orders: every count enters twice; pairs without hits add 0
        shares = counted.join(da, "label_a").join(db, "label_b").agg(
            F.sum(F.try_divide(F.col("cnt"), F.greatest("da", "db")))).scalar()
        all_std = self._glob_vals["std_norm"]
        scat = F.try_divide(self.lab.agg(F.sum("std_norm")).scalar(), all_std * self.k)
        # two labels of density 0 leave a term undefined
        undefined = (F.count(F.lit(1)) < 2) | (F.sum((F.col("dens") == 0).cast("int")) > 1)
        dens_bw = F.when(undefined, F.lit(None)).otherwise(
            F.try_divide(2.0 * F.coalesce(shares, F.lit(0.0)), self.k * (self.k - 1)))
        return self._row("s_dbw", own, dens_bw + scat)

    def cvnn(self):
        com = self.within().agg(F.coalesce(F.sum(F.try_divide(F.col("sum_dist"), F.col("n_pairs"))),
                                    F.lit(0.0))).scalar()
        labs = self.df.select("vec_id", "label")
        nb = self.knn.join(labs, "vec_id").join(
            labs.select(F.col("vec_id").alias("nbr_id"), F.col("label").alias("nbr_label")), "nbr_id")
        outside = nb.groupBy("label").agg(F.sum((F.col("label") != F.col("nbr_label")).cast("long")).alias("out"))
        sizes = labs.groupBy("label").agg(F.count("*").alias("n_l"))
        sep = sizes.join(outside, "label", "left").select(
            F.try_divide(F.coalesce("out", F.lit(0)), F.col("n_l") * self.n_neighbors).alias("sep"))
        return self._row("cvnn", sep, com + F.max("sep"))

    def run_all(self, calc_hubert: bool = True) -> DataFrame:
        names = [m for m in METRICS if calc_hubert or m != "hubert"]
        self.scan  # silhouette needs the pair pass anyway: Dunn and CVNN take their pairs from it
        out = None
        for m in names:
            r = getattr(self, m)()
            out = r if out is None else out.unionByName(r)
        return out
