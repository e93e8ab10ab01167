import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiclust.llm import license_scan, periodic_runs, ranked_search

random.seed(11)
EXTRA = "doc_id long, text string, runs int, unit string, detections string, query int, n int, term string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, 1, "u", "d", 2, 3, "t") for i, t in pairs], EXTRA)


# -------------------------------------------------------------- periodic runs

def runs_by_hand(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def digests_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = runs_by_hand(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = None
    for s, length, q in runs:
        if top is None or length * top[2] > top[1] * q:
            top = (s, length, q)
    start, length, period = top or (None, None, None)
    return (doc_id, len(runs), start, length, period, 1000 * length // period if top else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest())


def periodic_texts(many):
    for _ in range(many):
        letters = random.choice(["a", "ab", "abc", "abcde"])
        unit = [random.choice(letters) for _ in range(random.randint(1, 13))]
        words = [random.choice(letters) for _ in range(random.randint(0, 30))]
        words += [unit[i % len(unit)] for i in range(random.randint(0, 75))]
        words += [random.choice(letters) for _ in range(random.randint(0, 10))]
        yield words * random.choice([1, 1, 2, 5])


def test_runs_of_small_alphabets():
    for words in periodic_texts(900):
        codes = np.array([ord(w) for w in words] + [0], np.int64)
        start, length, period = periodic_runs.find_runs(codes, len(words))
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == runs_by_hand(words), words


def test_range_successor():
    values = np.random.default_rng(3).permutation(700)
    tree = periodic_runs.WaveletTree(values)
    lo = np.random.default_rng(4).integers(0, 700, 400)
    hi = np.minimum(700, lo + np.random.default_rng(5).integers(0, 60, 400))
    bound = np.random.default_rng(6).integers(0, 702, 400)
    want = [min((v for v in values[a:b].tolist() if v >= x), default=periodic_runs.NONE) for a, b, x in zip(lo, hi, bound)]
    assert tree.successor(lo, hi, bound).tolist() == want


def test_digests_against_brute_force(spark):
    texts = [" ".join(w) for w in periodic_texts(150)]
    pairs = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \t\n "), (503, "one"), (None, "a " * 40), (None, None)]
    pairs += [(7, texts[7])] * 3 + [(504, "é x é x " * 9), (505, "the the the the the"), (506, "the " * 6), (507, "k l m " * 4000)]
    got = periodic_runs.digests(frame(spark, pairs).repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(digests_by_hand(i, t) for i, t in pairs)


def test_digests_of_documents(spark, sf_small="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    want = Counter(digests_by_hand(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert Counter(map(tuple, periodic_runs.digests(docs).collect())) == want


def test_collapse_and_edges(spark):
    docs = frame(spark, [(1, "x y " * 10 + "end"), (2, "no  runs\there"), (3, None)])
    out = {r.doc_id: r for r in periodic_runs.collapse(docs.drop("runs")).collect()}
    assert out[1].text == "x y end" and out[2].text == "no  runs\there" and out[3].text is None and out[1].unit == "u"
    found = periodic_runs.with_runs(docs).where("doc_id = 1").first()
    assert [tuple(r) for r in found.runs] == [(0, 20, 2)] and found.n_words == 21
    assert periodic_runs.digests(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.arange(5), 5, powers=3)


def test_runs_do_not_cross_slices_or_documents(spark):
    docs = spark.createDataFrame([(i, "same words ") for i in range(40)], "doc_id long, text string").coalesce(1)
    assert periodic_runs.with_runs(docs, slice_bytes=50).where(F.size("runs") > 0).count() == 0


# -------------------------------------------------------------------- licenses

LICENSES = [
    (1, "Licensed under the MIT License. cc by nc; CC-BY-NC 4.0"), (2, None), (3, ""), (4, "..."),
    (5, "Apache License, Version 2.0 and Licensed under the Apache License Version 2.0"),
    (6, "SPDX-License-Identifier: GPL-3.0-or-later. GNU GPL v2 license"), (6, "émit under the mit licenseé"),
    (7, "Copyright 2020 foo bar. All rights reserved, cc by nc sa cc by nc, cc0 1.0 universal license"),
    (8, "under the mit license " * 500), (None, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (9, "Kelvin under the MİT license under\x01the\x02mit\x7flicense"), (10, "plain words of no license at all"),
    (11, "licensed under the terms of the gnu lesser general public license version 2.1 license"),
]


def test_licenses_against_sql(spark):
    documents = pd.DataFrame(LICENSES, columns=["doc_id", "text"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = Counter(con.sql(license_scan.SQL).fetchall())
    got = license_scan.labelled(frame(spark, LICENSES))
    assert Counter(map(tuple, got.collect())) == want
    assert got.columns == [c[0] for c in con.sql(license_scan.SQL).description]
    assert license_scan.labelled(frame(spark, LICENSES).limit(0)).count() == 0


def test_license_places_and_suppression(spark):
    rows = {(r.doc_id, r.text): r for r in license_scan.detect(frame(spark, LICENSES)).collect()}
    row = rows[LICENSES[4][0], LICENSES[4][1]]
    base = [(d.first, d.last) for d in row.detections if d.priority == 0]
    assert base == [(0, 3), (9, 12)] and row.unit == "u" and row.n_words == 14
    for r in rows.values():
        for d in r.detections:
            for e in r.detections:  # none that stands is held by one of a better priority
                assert not (e.priority < d.priority and e.first <= d.first and e.last >= d.last)
    assert rows[LICENSES[1]].detections == [] and rows[LICENSES[1]].n_words == 0
    assert len(rows[LICENSES[8]].detections) == 500
    assert rows[LICENSES[11]].n_words == 7 and rows[LICENSES[11]].detections == []


def test_every_license_rule_holds_its_keyword_and_compiles():
    table = license_scan.rules()
    assert len(table) > 300 and len({r["rule"] for r in table}) == len(table)
    for r in table:
        re.compile(r["pattern"])
        assert r["keyword"] in r["pattern"]


def test_license_query_is_native(spark):
    plan = license_scan.labelled(frame(spark, LICENSES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------------- search

def ranked_by_hand(docs, items, k=10):
    term = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def cut(text):
        return [w.lower() for w in term.findall((text or "").encode())]

    known = [(i, Counter(w), len(w)) for i, w in ((i, cut(t)) for i, t in docs) if w]
    n, total = len(known), sum(x[2] for x in known)
    df = Counter(t for _, c, _ in known for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c, size in known:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(cut(text)) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        for rank, (score, some, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, i if some else None, -score))
    return Counter(out)


def corpus(many, words=60):
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(random.choices(vocabulary, weights, k=random.randint(1, 60)))) for i in range(many)]


def test_search_against_brute_force(spark):
    docs = corpus(700) + [(800, None), (801, ""), (802, "--"), (803, "W1 W2é w1"), (None, "w7 w50 w50"), (5, "w40 w41"), (5, "w40 w41")]
    items = [(i, t) for i, t in corpus(25)] + [(90, None), (91, ""), (92, "unheard of"), (93, "w59"), (94, "w40 W41"), (94, "w40 W41"), (94, "w0")]
    queries = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, score int")
    for shard_docs, block in ((64, 200_000), (10_000, 100)):
        got = ranked_search.search(frame(spark, docs).repartition(3), queries, shard_docs=shard_docs, block_terms=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == ranked_by_hand(docs, items)


def test_search_of_nothing(spark):
    queries = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert ranked_search.search(frame(spark, corpus(5)).limit(0), queries).count() == 0
    assert ranked_search.search(frame(spark, corpus(5)), queries.limit(0)).count() == 0


def test_pair_bounds_skip_documents():
    """Two rare terms that never meet: no document can hold both, so their bound is one maximum."""
    lengths = np.full(400, 10, np.int64)
    rows = [[0, 2] if i % 2 else [1, 2] for i in range(400)]
    rows[0] = [0, 1, 2]
    term = np.concatenate(rows).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    df = np.bincount(term, minlength=3)
    weight = ranked_search.weights(400, df)
    query = np.arange(3)
    pairs = ranked_search.term_pairs([query], df)
    apart = ranked_search.build_shard(lengths[1:], term[3:], np.ones(len(term) - 3, np.int64), bounds[1:] - 3, pairs, weight, 400, 4000, 3)
    units = ranked_search.matched_units(query, apart, {tuple(p): i for i, p in enumerate(pairs.tolist())}, 3, df)
    assert units[0][0] == max(apart.top[0], apart.top[1]) < apart.top[0] + apart.top[1]
    docs, scores = ranked_search.search_shard(apart, 399, units, 3, int(apart.top[:3].sum()))
    assert len(docs) == 0
