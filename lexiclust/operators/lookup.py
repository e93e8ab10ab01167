"""Keyed-vector lookups and positional alignment.

Lookups are equi-joins on the word; Spark picks broadcast vs shuffle join at
run time (AQE measures the vector table), so a vocabulary of millions of
vectors is shuffled rather than broadcast.  Hot tokens ("the") are one
key holding many rows: the vector side has one row per key, so the join
does not multiply and AQE's skew-join split applies to the token side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import global_index


def zip_by_position(left: DataFrame, left_order: list[str], right: DataFrame,
                    right_order: list[str]) -> DataFrame:
    """Python ``zip`` of two ordered row sets: join on dense positions; the
    longer side is truncated."""
    li = global_index(left, left_order, "_zip")
    ri = global_index(right, right_order, "_zip")
    return li.join(ri, "_zip").withColumnRenamed("_zip", "idx")


def embed_tokens_default(tokens_df: DataFrame, vectors: DataFrame, default_word: str,
                         token_col: str = "token", word_col: str = "word",
                         value_cols: tuple[str, ...] = ("vec_id",), lowercase: bool = True) -> DataFrame:
    """Every token gets a vector: its own, else the vector of ``default_word``
    (one row, broadcast).  ``is_oov`` marks the fallback rows."""
    key = F.lower(token_col) if lowercase else F.col(token_col)
    v = vectors.select(F.col(word_col).alias("_w"), *value_cols)
    dflt = vectors.where(F.col(word_col) == default_word)
    j = tokens_df.withColumn("_w", key).join(v, "_w", "left")
    j = j.withColumn("is_oov", F.col(value_cols[0]).isNull().cast("int"))
    for c in value_cols:  # scalar subquery: the default word's value, run once
        j = j.withColumn(c, F.coalesce(F.col(c), dflt.agg(F.first(c)).scalar()))
    return j.drop("_w")


def embed_tokens_skip(tokens_df: DataFrame, vectors: DataFrame, token_col: str = "token",
                      word_col: str = "word", value_cols: tuple[str, ...] = ("vec_id",),
                      lowercase: bool = True) -> DataFrame:
    """Tokens without a vector are dropped (inner join)."""
    key = F.lower(token_col) if lowercase else F.col(token_col)
    v = vectors.select(F.col(word_col).alias("_w"), *value_cols)
    return tokens_df.withColumn("_w", key).join(v, "_w", "inner").drop("_w")


def oov_report(tokens_df: DataFrame, vectors: DataFrame, token_col: str = "token",
               word_col: str = "word", lowercase: bool = True) -> DataFrame:
    """Missing-word counts and the two ratios the reference prints:
    ``bad / all`` (fallback rows included) and ``bad / kept``."""
    key = F.lower(token_col) if lowercase else F.col(token_col)
    v = vectors.select(F.col(word_col).alias("_w")).distinct().withColumn("_hit", F.lit(1))
    j = tokens_df.withColumn("_w", key).join(v, "_w", "left")
    bad = F.col("_hit").isNull()
    r = j.agg(F.count("*").alias("n_tokens"),
              F.sum(bad.cast("long")).alias("n_oov"),
              F.countDistinct(F.when(bad, F.col("_w"))).alias("n_oov_distinct"))
    return r.select(F.col("n_tokens").cast("long"), F.col("n_oov").cast("long"),
                    F.col("n_oov_distinct").cast("long"),
                    F.round(F.try_divide(F.col("n_oov"), F.col("n_tokens")), 6).alias("ratio_all"),
                    F.round(F.try_divide(F.col("n_oov"), F.col("n_tokens") - F.col("n_oov")), 6).alias("ratio_kept"))


def token_weights(vocab: DataFrame, freq: DataFrame, word_col: str = "word",
                  token_col: str = "token", cnt_col: str = "cnt") -> DataFrame:
    """Vocabulary left-join frequency; missing = 0; divided by the total."""
    f = freq.select(F.col(token_col).alias(word_col), cnt_col)
    j = vocab.select(word_col).join(f, word_col, "left").withColumn(cnt_col, F.coalesce(cnt_col, F.lit(0)))
    tot = j.agg(F.sum(cnt_col)).scalar()
    return j.select(word_col, F.col(cnt_col).cast("long").alias(cnt_col),
                    F.round(F.try_divide(F.col(cnt_col), tot), 6).alias("weight"))
