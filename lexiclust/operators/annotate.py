"""Annotation-driven text normalisation.

Tagging, lemmatising and entity recognition are the user's model (run it
with ``embedding.embed_corpus``-style ``mapInPandas`` or bring its output);
these operators take its output as tables:

* ``annotations(doc_id, sent_no, tok_no, text, pos, lemma, ent_type)``
* ``entities(doc_id, sent_no, ent_no, ent_text, label, n_tokens)``

and apply the reference's rules with column expressions.  Per-sentence
assembly gathers one sentence's tokens (bounded by the sentence) in token
order.  ``lexicon_annotations`` is a small closed-class tagger used to feed
the operators from the driver's tables (a stand-in model, not a
reproduction of any statistical tagger).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Stand-in tagger lexicon (our own closed class, not a reference value).
PRONOUNS = ["i", "me", "my", "mine", "you", "your", "yours", "he", "him", "his", "she", "her", "hers",
            "it", "its", "we", "us", "our", "ours", "they", "them", "their", "theirs"]


def lexicon_annotations(sentences: DataFrame, id_col: str = "doc_id", sent_col: str = "sent_no",
                        text_col: str = "sentence") -> tuple[DataFrame, DataFrame]:
    toks = tx.posexplode_rows(sentences, F.split(text_col, " "), "tok_no", "text", id_col, sent_col)
    t = F.col("text")
    first = F.substring(t, 1, 1)
    pos = (F.when(F.lower(t).isin(PRONOUNS), "PRON").when(t.rlike("^[0-9]+$"), "NUM")
           .when((F.col("tok_no") > 0) & (F.upper(first) == first) & (F.lower(first) != first), "PROPN")
           .otherwise("X"))
    ann = toks.withColumn("pos", pos) \
        .withColumn("lemma", F.when(F.col("pos") == "PRON", "-PRON-").otherwise(F.lower(t))) \
        .withColumn("ent_type", F.when(F.col("pos") == "NUM", "CARDINAL")
                    .when(F.col("pos") == "PROPN", "PERSON").otherwise(""))
    ents = ann.where(F.col("ent_type") != "").select(
        id_col, sent_col, F.col("tok_no").alias("ent_no"), F.col("text").alias("ent_text"),
        F.col("ent_type").alias("label"), F.lit(1).alias("n_tokens"))
    return ann, ents


def _pos_map(col, mapping: dict) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out


def normalize_tokens(ann: DataFrame, id_col: str = "doc_id", sent_col: str = "sent_no") -> DataFrame:
    """Per sentence: entity tokens keep their text, punctuation is dropped,
    PRON/NUM become their class word (also via a ``-PRON-``-style lemma),
    anything else its lower-cased lemma; joined by spaces."""
    inner = F.expr("substring(lemma, 2, length(lemma) - 2)")
    word = (F.when(F.col("ent_type") != "", F.col("text"))
            .when(F.col("pos") == "PUNCT", F.lit(None))
            .when(F.col("pos").isin(*tx.POS_WORDS), _pos_map(F.col("pos"), tx.POS_WORDS))
            .when(inner.isin(*tx.POS_WORDS), _pos_map(inner, tx.POS_WORDS))
            .otherwise(F.lower("lemma")))
    w = ann.select(id_col, sent_col, "tok_no", word.alias("w"))  # a sentence without kept tokens stays, empty
    g = w.groupBy(id_col, sent_col).agg(F.array_sort(F.collect_list(F.struct("tok_no", "w"))).alias("_t"))
    return g.select(id_col, sent_col, F.array_join(F.transform("_t", lambda s: s["w"]), " ").alias("sentence"))  # nulls drop out


def substitute_entities(normalized: DataFrame, ents: DataFrame, id_col: str = "doc_id",
                        sent_col: str = "sent_no") -> DataFrame:
    """Replace ``' ' + entity + ' '`` by ``' ' + CLASS + ' '`` for entities by
    token count descending (stable), squeeze whitespace runs, strip."""
    cls = _pos_map(F.col("label"), tx.ENTITY_WORDS)
    e = ents.select(id_col, sent_col, F.struct((-F.col("n_tokens")).alias("k"), F.col("ent_no").alias("o"),
                                               F.col("ent_text").alias("t"), cls.alias("c")).alias("e"))
    eg = e.groupBy(id_col, sent_col).agg(F.array_sort(F.collect_list("e")).alias("_e"))
    j = normalized.join(eg, [id_col, sent_col], "left")
    folded = F.aggregate(F.coalesce(F.col("_e"), F.array().cast(eg.schema["_e"].dataType)), F.col("sentence"),
                         lambda acc, x: F.replace(acc, F.concat(F.lit(" "), x["t"], F.lit(" ")),
                                                  F.concat(F.lit(" "), F.coalesce(x["c"], x["t"]), F.lit(" "))))
    return j.select(id_col, sent_col, F.trim(F.regexp_replace(folded, tx.SPACE_JVM + tx.SPACE_JVM + "+", " ")).alias("sentence"))


def substitute_entities_suffix1(text_df: DataFrame, ents: DataFrame, id_col: str = "doc_id",
                                sent_col: str = "sent_no", text_col: str = "sentence") -> DataFrame:
    """Older variant: entity -> ``LABEL1`` (also its lower-cased form when the
    entity is not all lower-case), longest first."""
    e = ents.select(id_col, sent_col, F.struct((-F.col("n_tokens")).alias("k"), F.col("ent_no").alias("o"),
                                               F.col("ent_text").alias("t"),
                                               F.concat(F.col("label"), F.lit("1")).alias("c")).alias("e"))
    eg = e.groupBy(id_col, sent_col).agg(F.array_sort(F.collect_list("e")).alias("_e"))
    j = text_df.join(eg, [id_col, sent_col], "left")

    def step(acc, x):
        a = F.replace(acc, F.concat(F.lit(" "), x["t"], F.lit(" ")), F.concat(F.lit(" "), x["c"], F.lit(" ")))
        low = F.lower(x["t"])
        not_lower = ~((x["t"] == low) & (x["t"] != F.upper(x["t"])))
        return F.when(not_lower, F.replace(a, F.concat(F.lit(" "), low, F.lit(" ")),
                                           F.concat(F.lit(" "), x["c"], F.lit(" ")))).otherwise(a)

    folded = F.aggregate(F.coalesce(F.col("_e"), F.array().cast(eg.schema["_e"].dataType)), F.col(text_col), step)
    return j.select(id_col, sent_col, folded.alias(text_col))


def tag_tokens_suffix1(ann: DataFrame, id_col: str = "doc_id", sent_col: str = "sent_no") -> DataFrame:
    """One output token per input token (annotations of the substituted
    text): tokens ending in ``1`` are kept, PROPN/PRON/NUM become their
    suffix-1 class word, punctuation is dropped, else the lower-cased lemma."""
    t = F.col("text")
    out = (F.when(F.substring(t, -1, 1) == "1", t)
           .when(F.col("pos").isin(*tx.POS_WORDS_SUFFIX1), _pos_map(F.col("pos"), tx.POS_WORDS_SUFFIX1))
           .when(F.col("pos") != "PUNCT", F.lower("lemma")))
    return ann.select(id_col, sent_col, "tok_no", out.alias("token")).where(F.col("token").isNotNull())
