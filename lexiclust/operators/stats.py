"""Corpus aggregations: frequencies, top-k, quantiles, histograms, group counts.

All of them are ``groupBy``/``agg`` plans, so Spark runs partial aggregation
map-side before the shuffle; a hot key (one token holding a third of the rows)
is collapsed per partition first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage


def token_freq(tokens_df: DataFrame, col: str = "token") -> DataFrame:
    return tokens_df.groupBy(col).agg(F.count("*").alias("cnt"))


def most_common(freq: DataFrame, k: int, col: str = "token", cnt_col: str = "cnt") -> DataFrame:
    """Top-k by count; ties by the key ascending (byte order).  Spark plans
    this as a per-partition top-k followed by one merge of k rows each."""
    return freq.orderBy(F.desc(cnt_col), F.asc(col)).limit(k)


def head_mass(freq: DataFrame, share: float = 0.01, cnt_col: str = "cnt", col: str = "token") -> DataFrame:
    """Share of all occurrences held by the top ``int(share * V)`` entries.

    The top entries are found by a count threshold (the k-th largest count),
    computed from a count histogram, so nothing is sorted in one task."""
    hist = freq.groupBy(cnt_col).agg(F.count("*").alias("n_with"))
    w = Window.orderBy(F.desc(cnt_col)).rowsBetween(Window.unboundedPreceding, 0)
    # one row per distinct count value: bounded by sqrt(2 * total occurrences)
    cum = hist.withColumn("rank_hi", F.sum("n_with").over(w)) \
              .withColumn("mass_hi", F.sum(F.col(cnt_col) * F.col("n_with")).over(w))
    vocab = freq.agg(F.count("*")).scalar()
    total = freq.agg(F.sum(cnt_col)).scalar()
    j = cum.withColumn("vocab", vocab).withColumn("total", total) \
           .withColumn("top_n", F.floor(F.col("vocab") * F.lit(share)).cast("long"))
    # entries ranked 1..top_n: full count classes above, part of the boundary class
    j = j.withColumn("rank_lo", F.col("rank_hi") - F.col("n_with"))
    take = F.greatest(F.lit(0), F.least(F.col("n_with"), F.col("top_n") - F.col("rank_lo")))
    res = j.groupBy("vocab", "total", "top_n").agg(F.sum(take * F.col(cnt_col)).alias("top_mass"))
    return res.select(F.col("vocab").cast("long"), F.col("total").cast("long"), "top_n",
                      F.coalesce(F.col("top_mass"), F.lit(0)).cast("long").alias("top_mass"),
                      F.round(F.try_divide(F.coalesce(F.col("top_mass"), F.lit(0)), F.col("total")), 6).alias("share"))


QUANTILE_GRID_10 = [i / 10 for i in range(11)]
QUANTILE_GRID_5 = [i / 5 for i in range(6)]


def corpus_size_stats(sizes: DataFrame, size_col: str = "n_words") -> DataFrame:
    """Total, count, mean and two exact quantile grids (linear interpolation,
    truncated to int like ``np.quantile(...).astype(int)``), as a long table."""
    qs10 = F.percentile(F.col(size_col), F.array(*[F.lit(q) for q in QUANTILE_GRID_10]))
    qs5 = F.percentile(F.col(size_col), F.array(*[F.lit(q) for q in QUANTILE_GRID_5]))
    row = sizes.agg(F.sum(size_col).cast("double").alias("total"),
                    F.count("*").cast("double").alias("n_docs"),
                    F.avg(size_col).alias("mean"), qs10.alias("q10"), qs5.alias("q5"))
    items = [F.struct(F.lit("total").alias("stat"), F.col("total").alias("value")),
             F.struct(F.lit("n_docs").alias("stat"), F.col("n_docs").alias("value")),
             F.struct(F.lit("mean").alias("stat"), F.col("mean").alias("value"))]
    for i, q in enumerate(QUANTILE_GRID_10):
        items.append(F.struct(F.lit(f"q10_{q:.1f}").alias("stat"),
                              F.floor(F.col("q10")[i]).cast("double").alias("value")))
    for i, q in enumerate(QUANTILE_GRID_5):
        items.append(F.struct(F.lit(f"q5_{q:.1f}").alias("stat"),
                              F.floor(F.col("q5")[i]).cast("double").alias("value")))
    out = row.select(F.explode(F.array(*items)).alias("s"))
    return out.select("s.stat", F.round("s.value", 6).alias("value"))


def histogram(values: DataFrame, col: str, bins: int = 100) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin right-closed), all bins
    reported: ``(bin, lo, hi, cnt)``.  The source is scanned once, into counts of
    its distinct values; range and bins follow from those."""
    counts = cut_lineage(values.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x"))
                         .agg(F.count(F.lit(1)).alias("n")))
    edges = counts.agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
    mn, mx = edges.select("mn").scalar(), edges.select("mx").scalar()
    idx = F.when(mx == mn, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(F.col("x") - mn, mx - mn) * bins), F.lit(bins - 1)))
    counted = counts.groupBy(idx.cast("long").alias("bin")).agg(F.sum("n").alias("cnt"))
    grid = edges.select("mn", "mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("mx") - F.col("mn")) / bins
    grid = grid.select(F.col("bin").cast("long").alias("bin"),
                       F.round(F.col("mn") + F.col("bin") * width, 6).alias("lo"),
                       F.round(F.col("mn") + (F.col("bin") + 1) * width, 6).alias("hi"))
    return grid.join(counted, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def group_counts(df: DataFrame, key: str, out: str = "n_docs") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").cast("long").alias(out))


def group_sums(df: DataFrame, key: str, col: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(col).cast("long").alias(out))


def distinct_count(df: DataFrame, col: str, out: str = "n_distinct", approx: bool = False) -> DataFrame:
    agg = F.approx_count_distinct(col) if approx else F.countDistinct(col)
    return df.agg(agg.cast("long").alias(out))


def distinct_bigrams(docs: DataFrame, text_col: str = "text", drop_last: bool = True) -> DataFrame:
    """Distinct adjacent word pairs over all documents.  With ``drop_last``
    the final pair of every document is not counted (as in the reference)."""
    # materialise the word array once: referenced inside a lambda it would be
    # re-split for every element
    ws = docs.select(tx.words(text_col).alias("_ws"))
    w = F.col("_ws")
    n_pairs = F.size(w) - (2 if drop_last else 1)
    pairs = F.transform(F.sequence(F.lit(0), n_pairs - 1),
                        lambda i: F.concat_ws(" ", F.element_at(w, i + 1), F.element_at(w, i + 2)))
    arr = ws.select(F.when(n_pairs > 0, pairs).otherwise(F.array()).alias("bg"))
    return tx.explode_rows(arr, F.col("bg"), "bigram").agg(F.countDistinct("bigram").cast("long").alias("n_bigrams"))


def split_stats(sentences: DataFrame, split_col: str = "split", text_col: str = "sentence") -> DataFrame:
    """Per split: total words (space count + 1 per sentence, i.e. ``len(s.split(' '))``),
    max words in a sentence, max characters."""
    nw = F.size(F.split(F.col(text_col), " ", -1))
    return sentences.groupBy(split_col).agg(
        F.sum(nw).cast("long").alias("total_words"),
        F.max(nw).cast("long").alias("max_words"),
        F.max(F.length(text_col)).cast("long").alias("max_chars"),
        F.count("*").cast("long").alias("n_sentences"))


def top_n_sorted(df: DataFrame, sort_col: str, tie_col: str, n: int = 30) -> DataFrame:
    return df.orderBy(F.desc(sort_col), F.asc(tie_col)).limit(n)
