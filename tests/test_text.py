"""Text expressions on inline rows with traits the driver tables lack."""

import re

import pytest
from pyspark.sql import functions as F

from lexiclust.functions import text as tx


def py_decontract(s):
    """Plain-Python statement of the cleaning rules (test oracle)."""
    for pat, rep in tx.CONTRACTION_RULES:
        s = re.sub(pat, rep, s)
    s = re.sub(r"[^\w.?!;]", " ", s)
    return re.sub(" +", " ", s)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def test_contractions_all_quote_kinds(spark):
    for q in ["'", "’", "‘", "`"]:
        s = f"I won{q}t go, you can{q}t stay, it ain{q}t so. They{q}re here{q}s what I{q}d do; we{q}ll see. I{q}ve I{q}m don{q}t"
        assert one(spark, tx.expand_contractions, s) == (
            "I will not go, you can not stay, it am not so. They are here is what I would do; we will see. "
            "I have I am do not")
        assert one(spark, tx.decontract, s) == py_decontract(s)


def test_strip_keeps_unicode_letters(spark):
    s = "Café — naïve façade!! Ünïcödé…  x"
    assert one(spark, tx.strip_symbols, s) == py_decontract(s)


def test_sentence_array_order_and_blanks(spark):
    s = "One. Two;  three!? Four..  "
    got = one(spark, lambda c: tx.sentence_array(tx.decontract(c)), s)
    exp = [x.strip() for x in re.split(r"[.;!?]\s*", py_decontract(s)) if x.strip()]
    assert got == exp


RULE_CASES = [  # written by hand: text, and the sentences a reader would mark; an open end is dropped
    ("Mr. Smith came. He left!", ["Mr. Smith came.", "He left!"]),
    ("See cheapsite.com now. It costs 1.5 million.", ["See cheapsite.com now.", "It costs 1.5 million."]),
    ("Did he mind? Adam Jones Jr. thinks so. Yes.", ["Did he mind?", "Adam Jones Jr. thinks so.", "Yes."]),
    ('She said "stop." Then went.', ['She said "stop".', "Then went."]),
    ("J. R. R. Tolkien wrote it. Good.", ["J. R. R. Tolkien wrote it.", "Good."]),
    ("Acme Inc. They left.", ["Acme Inc", "They left."]),
    ("Ph.D. students work.", ["Ph.D. students work."]),
    ("One.\nTwo. an open end", ["One.", "Two."]),
    ("no mark at all", []),
]


@pytest.mark.parametrize("text, sentences", RULE_CASES)
def test_rule_sentence_split(spark, text, sentences):
    assert one(spark, tx.rule_sentence_split, text) == sentences


@pytest.mark.parametrize("space", ["\u00a0", "\u0085", "\u2003", "\u3000", "\u202f", "\x1c", "\x1f", "\u1680", "\t\n"])
def test_white_space_is_pythons(spark, space):
    s = f"{space}one{space}two {space} three{space}"
    assert one(spark, tx.words, s) == s.split()
    assert one(spark, tx.pystrip, s) == s.strip()
    assert one(spark, tx.wc_regex_split, s) == len(re.split(r"\s+", s))
    assert one(spark, tx.normalize_filters, s) == s.split()


def test_normalize_filters(spark):
    s = "<p>Hello, World!</p> It's 2021 -- the_end? <b>x1y</b>"
    got = one(spark, tx.normalize_filters, s)
    t = s.lower()
    t = re.sub(r"<([^>]+)>", "", t)
    t = re.sub(r"([!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])+", " ", t)
    t = re.sub(r"(\s)+", " ", t)
    t = re.sub(r"[0-9]+", "", t)
    assert got == t.split()


def test_word_counts(spark):
    s = "  a b\tc  "
    df = spark.createDataFrame([(s,)], "t string")
    r = df.select(tx.wc_regex_split("t").alias("a"), tx.wc_split("t").alias("b"), tx.wc_spaces("t").alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (len(re.split(r"\s+", s)), len(s.split()), s.count(" "))


def test_is_not_lower(spark):
    words = ["abc", "Abc", "ABC", "123", "a1", "PERSON", "é", "É"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"] for r in df.where(tx.is_not_lower("w")).collect()}
    assert got == {w for w in words if not w.islower()}


def test_cyrillic_filter(spark):
    from lexiclust.operators.corpus import filter_script
    df = spark.createDataFrame([(1, "Привет мир"), (2, "hello"), (3, "mixed Ж")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in filter_script(df).collect()) == [1, 3]
