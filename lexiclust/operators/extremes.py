"""Farthest pairs within labels and nearest pairs across labels, by pruning.

* **Diameter.**  With distances ``r`` to the label's centroid and the largest of
  them R, a pair is at most ``r_i + r_j`` apart, so once some pair is L apart only
  rows with ``r >= L - R`` can form a longer one.  Two sweeps (the row farthest
  from the centroid, then the row farthest from that one) give a good L in linear
  work, and only the remaining rows are compared.
* **Gap.**  A bounded set of rows is held against all rows; the least distance
  above 0 to a row of another label bounds the answer, and the metric radius join
  finds all pairs of unlike labels within it.

Both are exact.  How much is pruned depends on the data: nearly all of it in few
dimensions or well separated labels, nothing where all distances are alike.

Defined results: a label of one row has diameter 0; the gap is null with fewer than
two labels, or where two labels hold copies of one point and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import cut_lineage
from . import metric
from . import pairs as pr
from . import vectors as vv
from .blockscan import block_scan, matrix

#: rows that bound the gap
PROBES = 512
SLACK = 1e-9


def _farthest(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``label, far, v``: in every label the row farthest from its end point (ties: the smaller id)."""
    d = rows.join(ends.select("label", F.col("v").alias("_end")), "label").select(
        "label", F.struct(vx.l2_dist("v", "_end").alias("d"), (-F.col("id")).alias("i"), F.col("v").alias("v")).alias("x"))
    return d.groupBy("label").agg(F.max("x").alias("x")).select("label", F.col("x.d").alias("far"), F.col("x.v").alias("v"))


def outer_rows(df: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding"):
    """The rows of each label that can belong to its farthest pair, and ``label, far``: a pair's distance that bounds it from below."""
    rows = df.select(F.col(label_col).cast("long").alias("label"), F.col(id_col).alias("id"), vx.as_double(vec_col).alias("v"))
    centres = vv.centroid_arrays(rows, "label", "id", "v").select("label", F.col("centroid").alias("v"))
    first = cut_lineage(_farthest(rows, centres))
    second = _farthest(rows, first)  # its distance is that of two rows
    bound = cut_lineage(second.select("label", "far").join(first.select("label", F.col("far").alias("reach")), "label"))
    r = vx.l2_dist("v", "_c")
    outer = rows.join(centres.select("label", F.col("v").alias("_c")), "label").join(bound, "label").where(
        r * (1 + SLACK) >= F.col("far") - F.col("reach") * (1 + SLACK)).select("label", "id", "v")
    return outer, bound.select("label", "far")


def diameters(df: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
              block_rows: int = pr.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``label, diameter``: the largest distance of two rows of each label."""
    outer, bound = outer_rows(df, label_col, id_col, vec_col)
    long = pr.own_label_sums(outer, "label", "id", "v", block_rows).groupBy("label").agg(F.max("max_dist").alias("d"))
    return bound.join(long, "label", "left").select("label", F.greatest("far", F.coalesce("d", F.lit(0.0))).alias("diameter"))


def label_gap(df: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
              block_rows: int = pr.DEFAULT_BLOCK_ROWS, probes: int = PROBES) -> DataFrame:
    """One row ``gap``: the least distance above 0 of two rows of unlike labels."""
    rows = cut_lineage(df.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("label"), vx.as_double(vec_col).alias("v")))

    class Nearest:
        def __init__(self, mine):
            self.id, self.label, self.v = mine["id"].to_numpy(), mine["label"].to_numpy(), matrix(mine["v"])
            self.least = np.full(len(self.id), np.inf)

        def add(self, rows):
            d = pr.distances(self.v, matrix(rows["v"]))
            d[(d == 0) | (self.label[:, None] == rows["label"].to_numpy()[None, :])] = np.inf
            self.least = np.minimum(self.least, d.min(axis=1))

        def result(self):
            return pa.RecordBatch.from_arrays([pa.array(self.id), pa.array(self.least)], names=["id", "least"])

    some = rows.orderBy(F.xxhash64("id"), "id").limit(probes)
    # small blocks of probes, so that many tasks share the scan
    bound = block_scan(some, rows, "id", Nearest, "id long, least double", 64).agg(F.min("least")).first()[0]
    if bound is None:
        return df.sparkSession.createDataFrame([(None,)], "gap double")
    near = metric.radius_join(rows.withColumn("r", F.lit(bound * (1 + SLACK))), "r", None, "id", "v", block_rows, apart_col="label")
    # labels of one point only, by that point: two of them at one place have no distance above 0
    single = rows.groupBy("label").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo = hi").groupBy("lo").count()
    twice = single.agg(F.coalesce(F.max("count"), F.lit(0)) > 1).scalar()
    return near.where("dist > 0").agg(F.min("dist").alias("gap")).select(F.when(~twice, F.col("gap")).alias("gap"))
