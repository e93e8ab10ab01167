"""Dense global positions without a one-partition window.

The reference works on ordered Python lists (token streams, first-N slices,
row-aligned arrays).  Spark rows have no order, so ordered operators take an
explicit order key and get a dense 0-based position from ``prefix_offsets``:

1. range-sort by the key (Spark samples boundaries, every task gets a slice),
2. reliable checkpoint (positions must not move if a task is re-run),
3. in-partition running sums (Arrow batches, one pass),
4. one row per partition of totals -> exclusive prefix (bounded by the
   partition count, so it is broadcast) -> joined back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def prefix_sums(df: DataFrame, order_cols: list[str], weights: dict[str, str | None]) -> DataFrame:
    """For each ``out_col: weight_col`` add the exclusive running sum of the
    weight (``None`` = 1) in the total order ``order_cols`` (must be unique)."""
    outs = list(weights)
    wcols = [f"_w{i}" for i in range(len(outs))]
    base = df
    for wc, out in zip(wcols, outs):
        src = weights[out]
        base = base.withColumn(wc, F.col(src).cast("long") if src else F.lit(1).cast("long"))
    # the range sort reads its input twice (boundary sampling, then the sort):
    # keep the input so an expensive upstream plan runs once
    base = base.persist()
    ordered = cut_lineage(base.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id()))
    base.unpersist()
    locs = [f"_loc{i}" for i in range(len(outs))]
    schema = T.StructType(ordered.schema.fields + [T.StructField(lc, T.LongType()) for lc in locs])

    def local_cumsum(batches):
        running = [0] * len(wcols)
        for pdf in batches:
            for i, (wc, lc) in enumerate(zip(wcols, locs)):
                cs = pdf[wc].cumsum()
                pdf[lc] = (cs - pdf[wc] + running[i]).astype("int64")
                if len(pdf):
                    running[i] += int(cs.iloc[-1])
            yield pdf

    local = ordered.mapInPandas(local_cumsum, schema)
    totals = ordered.groupBy("_pid").agg(*[F.sum(wc).alias(f"_tot{i}") for i, wc in enumerate(wcols)])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select("_pid", *[F.coalesce(F.sum(f"_tot{i}").over(w), F.lit(0)).alias(f"_poff{i}")
                                   for i in range(len(wcols))])
    # one row per partition: size bounded by the partition count
    out = local.join(F.broadcast(offs), "_pid")
    for i, o in enumerate(outs):
        out = out.withColumn(o, F.col(f"_poff{i}") + F.col(locs[i]))
    return out.drop("_pid", *locs, *[f"_poff{i}" for i in range(len(outs))], *wcols)


def prefix_offsets(df: DataFrame, order_cols: list[str], weight_col: str | None,
                   out_col: str) -> DataFrame:
    """Add ``out_col`` = exclusive running sum of ``weight_col`` (or 1) in the
    total order ``order_cols`` (must be unique)."""
    return prefix_sums(df, order_cols, {out_col: weight_col})


def global_index(df: DataFrame, order_cols: list[str], out_col: str = "idx") -> DataFrame:
    """0-based dense row number in the order ``order_cols`` (unique key)."""
    return prefix_offsets(df, order_cols, None, out_col)


def hash_key(seed, *cols) -> F.Column:
    """Repeatable pseudo-random order key: md5 of ``seed:col1:col2...`` (hex)."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_int(seed, *cols, digits: int = 15) -> F.Column:
    """First ``digits`` hex digits of ``hash_key`` as a non-negative bigint."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, digits), 16, 10).cast("long")
