"""Per-label vector statistics: means, centroids, variances, distances to centroids.

Per-dimension statistics use the long form ``(id, label, dim, x)`` built by
``posexplode`` inside the scan pipeline; ``groupBy(label, dim)`` then runs
map-side partial aggregation, so only ``partitions x K x d`` partial rows are
shuffled, however skewed the labels are.  Centroid arrays (K x d) are joined
back by label; Spark/AQE decide broadcast vs shuffle from measured size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from .blockscan import block_scan, matrix


def long_form(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
              label_col: str | None = "label") -> DataFrame:
    keep = [id_col] + ([label_col] if label_col else [])
    out = df.select(*keep, F.posexplode(vec_col).alias("dim", "x"))
    return out.withColumn("x", F.col("x").cast("double")).withColumn("dim", F.col("dim").cast("long"))


def vector_mean(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Column means ``(dim, mean)``."""
    return long_form(df, id_col, vec_col, None).groupBy("dim").agg(F.avg("x").alias("mean"))


def row_mean_max(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Max over rows of the row mean."""
    rm = F.try_divide(vx.vsum(vx.as_double(vec_col)), F.size(vec_col))
    return df.agg(F.max(rm).alias("max_row_mean"))


def centroids_long(df: DataFrame, label_col: str = "label", id_col: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """``(label, dim, c, n)``."""
    lf = long_form(df, id_col, vec_col, label_col)
    return lf.groupBy(label_col, "dim").agg(F.avg("x").alias("c"), F.count("*").alias("n"))


def centroid_arrays(df: DataFrame, label_col: str = "label", id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """``(label, centroid array<double>, n)``; one group per label holds d values."""
    cl = centroids_long(df, label_col, id_col, vec_col)
    arr = cl.groupBy(label_col).agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("_s"),
                                    F.first("n").alias("n"))
    return arr.select(label_col, F.transform("_s", lambda s: s["c"]).alias("centroid"), "n")


def deviations(df: DataFrame, label_col: str = "label", id_col: str = "vec_id",
               vec_col: str = "embedding") -> DataFrame:
    """Long form with the label centroid and the global mean per dimension:
    ``(id, label, dim, x, c, g)``."""
    lf = long_form(df, id_col, vec_col, label_col)
    cen = lf.groupBy(label_col, "dim").agg(F.avg("x").alias("c"))
    glob = lf.groupBy("dim").agg(F.avg("x").alias("g"))
    return lf.join(cen, [label_col, "dim"]).join(glob, "dim")


def label_scatter(dev: DataFrame, label_col: str = "label") -> DataFrame:
    """Per label: ``n, ss`` (within sum of squares), ``var_norm`` = ||var_k||,
    ``std_norm`` = ||std_k|| (population moments)."""
    per_dim = dev.groupBy(label_col, "dim").agg(
        F.count("*").alias("n"), F.sum((F.col("x") - F.col("c")) ** 2).alias("ssd"))
    per_dim = per_dim.withColumn("var", F.col("ssd") / F.col("n"))
    return per_dim.groupBy(label_col).agg(
        F.first("n").alias("n"), F.sum("ssd").alias("ss"),
        F.sqrt(F.sum(F.col("var") ** 2)).alias("var_norm"),
        F.sqrt(F.sum("var")).alias("std_norm"))


def global_scatter(dev: DataFrame) -> DataFrame:
    """``sst`` (total sum of squares), ``var_norm`` and ``std_norm`` of the
    whole set."""
    per_dim = dev.groupBy("dim").agg(F.count("*").alias("n"), F.sum((F.col("x") - F.col("g")) ** 2).alias("ssd"))
    per_dim = per_dim.withColumn("var", F.col("ssd") / F.col("n"))
    return per_dim.agg(F.sum("ssd").alias("sst"), F.sqrt(F.sum(F.col("var") ** 2)).alias("var_norm"),
                       F.sqrt(F.sum("var")).alias("std_norm"))


def centroid_distances(cen_long: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label_a, label_b, d)`` for ordered pairs of distinct labels (K^2 rows)."""
    a = cen_long.select(F.col(label_col).alias("label_a"), "dim", F.col("c").alias("ca"))
    b = cen_long.select(F.col(label_col).alias("label_b"), "dim", F.col("c").alias("cb"))
    j = a.join(b, "dim").where(F.col("label_a") != F.col("label_b"))
    return j.groupBy("label_a", "label_b").agg(F.sqrt(F.sum((F.col("ca") - F.col("cb")) ** 2)).alias("d"))


def row_centroid_distance(df: DataFrame, label_col: str = "label", id_col: str = "vec_id",
                          vec_col: str = "embedding") -> DataFrame:
    """``(id, label, dist, cos_dist, rmse)`` of every row to its label centroid."""
    cen = centroid_arrays(df, label_col, id_col, vec_col)
    v = df.select(id_col, label_col, vx.as_double(vec_col).alias("_v"))
    j = v.join(cen, label_col)
    return j.select(id_col, label_col, vx.l2_dist("_v", "centroid").alias("dist"),
                    vx.cosine_distance("_v", "centroid").alias("cos_dist"),
                    vx.rmse("_v", "centroid").alias("rmse"))


def nearest_centroid(df: DataFrame, centroids: DataFrame, label_col: str = "label",
                     id_col: str = "vec_id", vec_col: str = "embedding",
                     max_values: int = 50_000_000) -> DataFrame:
    """Assign each row to the closest centre: ``(id, nearest, dist)``; ties by
    the smaller label; ids are unique.  Centres are packed into one row and
    broadcast, at most ``max_values`` numbers at once; each row scans the packed
    centres in a JVM array loop - no n x K join output.  More centres are
    scanned in blocks, of whose minima the least counts."""
    kd = centroids.agg(F.sum(F.size("centroid"))).first()[0] or 0
    blocks = max(1, -(-kd // max_values))
    part = F.pmod(F.xxhash64(label_col), F.lit(blocks))
    v = df.select(id_col, vx.as_double(vec_col).alias("_v")).withColumn("_k", F.lit(1))
    found = None
    for b in range(blocks):
        packed = centroids.where(part == b).agg(F.array_sort(F.collect_list(F.struct(
            F.col(label_col).cast("long").alias("l"), F.col("centroid").alias("c")))).alias("_cs")) \
            .withColumn("_k", F.lit(1))
        j = v.join(F.broadcast(packed), "_k")
        dists = F.transform("_cs", lambda s: F.struct(vx.l2_dist(F.col("_v"), s["c"]).alias("d"), s["l"].alias("l")))
        scan = j.select(id_col, F.array_min(dists).alias("_best"))
        found = scan if found is None else found.unionByName(scan)
    if blocks > 1:
        found = found.groupBy(id_col).agg(F.min("_best").alias("_best"))
    return found.select(id_col, F.col("_best.l").alias("nearest"), F.col("_best.d").alias("dist"))


def centroid_extremes(centroids: DataFrame, label_col: str = "label", spread_col: str | None = None,
                      block_rows: int = 2048) -> DataFrame:
    """``(label, sum_d, max_d, min_d, score)`` of each centroid's distances to the
    others: blocks of packed centroids pass each other and keep running extremes,
    so K rows leave a block, never K x K.  ``score`` is the largest
    ``(spread + other spread) / distance`` (0 where the distance is 0)."""
    rows = centroids.select(F.col(label_col).cast("long").alias("label"), vx.as_double("centroid").alias("c"),
                            (F.col(spread_col) if spread_col else F.lit(0.0)).cast("double").alias("s"))

    class Extremes:
        def __init__(self, mine):
            self.label, self.c, self.s = mine["label"].to_numpy(), matrix(mine["c"]), mine["s"].to_numpy()
            self.sum, self.high = np.zeros(len(self.label)), np.full(len(self.label), -np.inf)
            self.low, self.score = np.full(len(self.label), np.inf), np.full(len(self.label), -np.inf)

        def add(self, rows):
            label, c, s = rows["label"].to_numpy(), matrix(rows["c"]), rows["s"].to_numpy()
            step = max(1, (1 << 22) // max(1, c.size))  # bounds the temporary
            for a in range(0, len(self.label), step):
                own = slice(a, a + step)
                diff = self.c[own, None, :] - c[None, :, :]
                d = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
                other = self.label[own, None] != label[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = np.where(d > 0, (self.s[own, None] + s[None, :]) / d, 0.0)
                self.sum[own] += np.where(other, d, 0.0).sum(axis=1)
                self.high[own] = np.maximum(self.high[own], np.where(other, d, -np.inf).max(axis=1))
                self.low[own] = np.minimum(self.low[own], np.where(other, d, np.inf).min(axis=1))
                self.score[own] = np.maximum(self.score[own], np.where(other, ratio, -np.inf).max(axis=1))

        def result(self):
            alone = ~np.isfinite(self.high)
            return pa.RecordBatch.from_arrays(
                [pa.array(self.label), *(pa.array(x, mask=alone) for x in (self.sum, self.high, self.low, self.score))],
                names=["label", "sum_d", "max_d", "min_d", "score"])

    return block_scan(rows, rows, "label", Extremes, "label long, sum_d double, max_d double, min_d double, score double", block_rows)


def square_silhouette(df: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
                      block_rows: int = 2048) -> DataFrame:
    """``(id, label, s)``: the silhouette of squared distances.  The mean squared
    distance of x to a label is ``|x|^2 - 2 x.mean + mean |y|^2``, so the labels'
    sums stand for their rows and no pair of rows is formed.  A row alone in its
    label has 0; null where there is no other label."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), vx.as_double(vec_col).alias("v"))
    squares = rows.groupBy("label").agg(F.avg(vx.dot("v", "v")).alias("square"), F.count(F.lit(1)).alias("n"))
    labels = centroid_arrays(rows, "label", "id", "v").drop("n").join(squares, "label")
    held = rows.select("id", "label", "v", F.lit(None).cast("double").alias("square"), F.lit(None).cast("long").alias("n"))
    passing = labels.select(F.lit(None).cast("long").alias("id"), "label", F.col("centroid").alias("v"), "square", "n")

    class Means:
        def __init__(self, mine):
            self.id, self.label, self.v = mine["id"].to_numpy(), mine["label"].to_numpy(), matrix(mine["v"])
            self.square = np.einsum("ij,ij->i", self.v, self.v)
            self.own, self.other = np.full(len(self.id), np.nan), np.full(len(self.id), np.inf)

        def add(self, rows):
            label, mean, square, n = rows["label"].to_numpy(), matrix(rows["v"]), rows["square"].to_numpy(), rows["n"].to_numpy()
            d = np.maximum(self.square[:, None] - 2.0 * (self.v @ mean.T) + square[None, :], 0.0)
            same = self.label[:, None] == label[None, :]
            i, j = np.nonzero(same)
            several = n[j] > 1
            self.own[i[several]] = d[i, j][several] * n[j][several] / (n[j][several] - 1)  # the row itself is at 0
            self.other = np.minimum(self.other, np.where(same, np.inf, d).min(axis=1))

        def result(self):
            high = np.maximum(self.own, self.other)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(high > 0, (self.other - self.own) / high, 0.0)
            s[np.isnan(self.own)] = 0.0
            return pa.RecordBatch.from_arrays([pa.array(self.id), pa.array(self.label), pa.array(s, mask=np.isinf(self.other))],
                                              names=["id", "label", "s"])

    return block_scan(held, passing, "id", Means, "id long, label long, s double", block_rows).withColumnRenamed("id", id_col)
