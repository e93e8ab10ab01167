"""One scan of all rows of a table past blocks of another.

Rows of ``held`` are dealt over blocks of about ``block_rows`` by a hash of their
key; a task holds one block while every row of ``passing`` streams by in Arrow
batches.  What a fold keeps (running sums, extremes) is all that leaves a task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column) -> np.ndarray:
    """An Arrow list column (array or chunked array) as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a row without a vector has no distances")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def block_scan(held: DataFrame, passing: DataFrame, key: str, fold, schema: str, block_rows: int = 2048,
               order: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """``fold(rows)`` is called with the rows of a block (an Arrow table); its
    ``add(rows)`` gets each batch of passing rows, and may return a record batch, and
    ``result()`` returns the record batch of the block.  Both tables have the same
    columns.  Rows arrive sorted by ``order``; there are ``least`` blocks at least."""
    n = held.count()
    blocks = max(1, min(n, max(math.ceil(n / block_rows), least)))
    names = held.columns
    x = held.select(*names, F.lit(0).alias("_role"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"))
    y = passing.select(*names, F.lit(1).alias("_role"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    # a block is a partition: hashed, some partitions would hold several blocks and others none
    met = x.unionByName(y).repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", "_role", *order)

    def run(batches):
        block, mine, state = None, [], None
        for batch in batches:
            role, of = batch.column(len(names)).to_numpy(), batch.column(len(names) + 1).to_numpy()
            cuts = np.flatnonzero((role[1:] != role[:-1]) | (of[1:] != of[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(role)]):
                if a == b:
                    continue
                if of[a] != block:
                    if state is not None:
                        yield state.result()
                    block, mine, state = of[a], [], None
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    mine.append(part)
                elif mine or state is not None:
                    if state is None:
                        state, mine = fold(pa.Table.from_batches(mine)), []
                    out = state.add(part)
                    if out is not None:
                        yield out
        if state is not None:
            yield state.result()

    return met.mapInArrow(run, schema)
