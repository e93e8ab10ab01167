"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: rows of one numbering bucket; bounds what a single task sorts for a hot group
ROWS_PER_BUCKET = 50_000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the number of uses."""
    return F.transform(F.array(value), body)[0]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: cuts
    the lineage, and a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str,
             rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``out``: a gapless 0-based number within each group.

    Rows of a group are dealt over buckets by a hash of ``order``, numbered
    per (group, bucket), and lifted by the sizes of the buckets before, so a
    group that holds most of the table is never gathered into one task.
    Rows that tie on ``order`` are numbered in any order.
    """
    bucket, row, size, lift = unused(df, "_bucket", "_row", "_size", "_lift")
    buckets = max(1, -(-df.count() // rows_per_bucket))
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    within = Window.partitionBy(*groups, bucket).orderBy(*order)
    local = dealt.withColumn(row, F.row_number().over(within) - 1)
    before = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    lifts = (dealt.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias(size))
             .withColumn(lift, F.coalesce(F.sum(size).over(before), F.lit(0))).drop(size))
    on = [local[c].eqNullSafe(lifts[c]) for c in [*groups, bucket]]
    joined = local.join(lifts, on)
    return joined.select(*[local[c] for c in df.columns], (F.col(row) + F.col(lift)).cast("long").alias(out))


def text_slices(batches, size: int = 4_000_000):
    """Lists of (id, text) of an Arrow batch stream, cut so that one list holds
    about ``size`` bytes of text; null text comes as an empty string."""
    held, n = [], 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i, t in zip(ids.to_pylist(), (x.as_py() for x in texts)):
            t = t or ""
            held.append((i, t))
            n += len(t)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held
