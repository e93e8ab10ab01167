"""Layer-output pooling and small vector utilities over long tables.

Input layer vectors come as rows ``(sent_id, pos, layer, embedding)`` - the
output of the user's transformer run (layer 0 = input embeddings).  Pooling
is an element-wise sum of the selected layers per token, with the first and
last position of every sentence (the special tokens) dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import pairs as pr
from .ordering import global_index


def layer_long(layers: DataFrame) -> DataFrame:
    return layers.select("sent_id", "pos", "layer", F.posexplode("embedding").alias("dim", "x")) \
        .withColumn("x", F.col("x").cast("double")).withColumn("dim", F.col("dim").cast("long"))


def _drop_edges(df: DataFrame) -> DataFrame:
    edges = df.groupBy("sent_id").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    return df.join(edges, "sent_id").where((F.col("pos") > F.col("_lo")) & (F.col("pos") < F.col("_hi"))) \
             .drop("_lo", "_hi")


def pool_layers(layers: DataFrame, last: int = 4) -> DataFrame:
    """Per token ``(sent_id, pos, dim, value)``: sum of the last ``last``
    layers, edge positions dropped."""
    top = layers.agg(F.max("layer")).scalar()
    sel = layers.where(F.col("layer") > top - last)
    summed = layer_long(sel).groupBy("sent_id", "pos", "dim").agg(F.sum("x").alias("value"))
    return _drop_edges(summed)


def pool_last(layers: DataFrame) -> DataFrame:
    return pool_layers(layers, 1)


def vocab_embeddings(pooled: DataFrame) -> DataFrame:
    """One vector per vocabulary entry encoded alone: its first sub-token
    (the first position left after the edge drop)."""
    first = pooled.groupBy("sent_id").agg(F.min("pos").alias("_p"))
    return pooled.join(first, "sent_id").where(F.col("pos") == F.col("_p")).select("sent_id", "dim", "value")


def normalize_minmax(images: DataFrame, id_cols: list[str], arr_col: str, scale: float = 255.0) -> DataFrame:
    """Scale byte-valued arrays to [0, 1] and flatten nested arrays to rows."""
    a = F.col(arr_col)
    flat = a if not str(images.schema[arr_col].dataType.elementType).startswith("ArrayType") else F.flatten(a)
    return images.select(*id_cols, F.transform(flat, lambda x: x.cast("double") / scale).alias(arr_col))


def context_drift(tokens: DataFrame, word_col: str, ctx_col: str, id_col: str = "tok_id",
                  vec_col: str = "embedding", block_rows: int = pr.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Spread of contextual vectors: per word, distances between its vectors
    in different contexts; per context, distances between different words.
    Only pairs of one key are formed and they are aggregated in the tasks:
    ``(kind, key, mean_dist, max_dist, n_pairs)``."""
    out = None
    for kind, key in (("same_word", word_col), ("same_context", ctx_col)):
        own = pr.own_label_sums(tokens, key, id_col, vec_col, block_rows).where("n_own > 0")
        s = own.groupBy(F.col(key).alias("key")).agg(
            F.try_divide(F.sum("sum_dist"), F.sum("n_own")).alias("mean_dist"), F.max("max_dist").alias("max_dist"),
            F.sum("n_own").alias("n_pairs")).select(F.lit(kind).alias("kind"), "key", "mean_dist", "max_dist", "n_pairs")
        out = s if out is None else out.unionByName(s)
    return out


def analogy_distance(vectors: DataFrame, quads: DataFrame, a: str, b: str, c: str, d: str,
                     word_col: str = "word", vec_col: str = "embedding") -> DataFrame:
    """Distance of ``a - b + c`` to ``d`` (Euclidean and cosine) per quadruple."""
    v = vectors.select(F.col(word_col).alias("_w"), vx.as_double(vec_col).alias("_v"))
    j = quads
    for col in (a, b, c, d):
        j = j.join(v.withColumnRenamed("_w", col).withColumnRenamed("_v", f"_v_{col}"), col)
    guess = vx.add(vx.sub(f"_v_{a}", f"_v_{b}"), f"_v_{c}")
    return j.select("qid", vx.l2_dist(guess, f"_v_{d}").alias("l2"),
                    vx.cosine_distance(guess, f"_v_{d}").alias("cos_dist"))


def layer_table_from_vectors(df: DataFrame, n_layers: int, group_col: str = "label", id_col: str = "vec_id",
                             vec_col: str = "embedding") -> DataFrame:
    """Layer rows from a vector table: sentence = group, position = rank of
    the id inside the group, layer l = the l-th equal slice of the vector."""
    idx = global_index(df.select(group_col, id_col, vec_col), [group_col, id_col], "_g")
    first = idx.groupBy(group_col).agg(F.min("_g").alias("_g0"))
    d = df.agg(F.max(F.size(vec_col))).first()[0]
    width = d // n_layers
    pos = idx.join(first, group_col).select(F.col(group_col).cast("long").alias("sent_id"),
                                            (F.col("_g") - F.col("_g0")).alias("pos"), vec_col)
    lay = pos.select("sent_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(n_layers - 1))).alias("layer"), vec_col)
    return lay.select("sent_id", "pos", F.col("layer").cast("long"),
                      F.slice(vec_col, F.col("layer") * width + 1, width).alias("embedding"))
