"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's shard follows from its key and the number of shards alone; there is no
ring table.  With one more shard, a row either stays or moves to the new one.

Defined results: all rows with a null key share the shard of the null key's
hash; repeated rows are kept and numbered separately; null text has size 1;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key among ``shards`` shards."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        s = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = s
        jump = ((at[live] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        go = jump < shards
        live = live[go]
        at[live] = jump[go]
    return at


def shard_column(key: Column, shards: int) -> Column:
    """Column form: ``key`` is any column; its 64-bit hash jumps."""
    @F.pandas_udf("int")
    def jump(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: slots are
    gapless from 0 within a shard, ``grown_shard`` is the shard among
    ``shards + 1``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       shard_column(key, shards).alias("shard"), shard_column(key, shards + 1).alias("grown_shard"))
    placed = numbered(written(rows, "shards"), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id",
                 files_per_shard: int = 1) -> None:
    """Write the rows below ``path``, one folder per shard, each shard as
    ``files_per_shard`` files."""
    split = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(files_per_shard))
    (docs.withColumn("shard", shard_column(F.col(id_col).cast("long"), shards))
     .repartition(shards * files_per_shard, "shard", split)
     .write.partitionBy("shard").parquet(path))
