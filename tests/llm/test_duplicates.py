import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexiclust.llm import components, fingerprints, line_chunks, simhash, suffix_dedup

random.seed(5)
EXTRA = "doc_id long, text string, fp string, root int, key int, mark int, digest string, doc int, no int"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4, 5) for i, t in pairs], EXTRA)


def simhash_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def unions(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_simhash_against_all_pairs(spark):
    base = [" ".join(random.choice(["alpha", "Beta", "gamma", "delta", "éps"]) for _ in range(40)) for _ in range(30)]
    pairs = [(i, t) for i, t in enumerate(base + base[:5] + [b + " end" for b in base] + ["", None, "one", "one two", "A\x0bB\x0cc", "x " * 9000])]
    pairs += [(3, base[3]), (None, base[4]), (None, None)]
    got = simhash.near_duplicates(frame(spark, pairs)).collect()
    prints = {(i, t): simhash_by_hand(t) for i, t in pairs}
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{prints[i, t]:016x}") for i, t in pairs)
    values = sorted(set(prints.values()))
    root = unions(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for (i, _), v in prints.items():
        if i is not None:
            least[root[v]] = min(i, least.get(root[v], i))
    for r in got:
        assert r.component_id == least.get(root[int(r.fingerprint, 16)])
    kept = simhash.deduplicate(frame(spark, pairs))
    assert kept.columns == frame(spark, pairs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    nameless = simhash.deduplicate(frame(spark, [(None, "a b c d"), (None, "a b c d"), (None, "q r s t u v")])).collect()
    assert len(nameless) == 2
    assert simhash.near_duplicates(frame(spark, pairs).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_links_equal_brute_force_also_when_split(spark, bits):
    seeds = [random.getrandbits(64) for _ in range(6)]
    values = {s ^ sum(1 << random.randrange(64) for _ in range(random.randrange(5))) & (2 ** 64 - 1) for s in seeds for _ in range(12)}
    signed = sorted(v - 2 ** 64 if v >= 2 ** 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits}
    for hot in (simhash.HOT_SEGMENT, 1, 3):
        got = simhash.links(fps, bits, hot).collect()
        assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_a_crowded_segment_is_split(spark, bits):
    n = 1500
    for s, (shift, width) in enumerate(simhash._segments(bits)):
        own = (1 << width) - 1 << shift
        values = {random.getrandbits(64) & ~own | own // 3 & own for _ in range(n)}
        rows = spark.createDataFrame([(v - 2 ** 64 if v >= 2 ** 63 else v, s) for v in values], "fp long, seg int")
        sizes = rows.select(F.inline(simhash.outside_pieces(bits))).groupBy("piece", "same").count().collect()
        assert sum(r["count"] for r in sizes) == len(values) * (bits + 1)
        assert sum(r["count"] ** 2 for r in sizes) < n * n / 20  # joined pairs


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 199)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = unions({x for e in edges if e[0] != e[1] for x in e}, edges)
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


LINES = ["first line of it", "second line", "third one", "and the fourth", "fifth", "sixth here", "seventh"]


def test_line_chunks_against_sql(spark):
    passage = "\n".join(LINES * 2)
    texts = [passage, "intro\n" + passage, passage + "\ntail", "other\nlines\nhere", "", "\n\n\n", "x", passage, "a\nb\nc\nd\n" * 300]
    pairs = list(enumerate(texts)) + [(50, None)]
    docs = frame(spark, pairs)
    got = line_chunks.deduplicate(docs)
    assert set(docs.columns) <= set(got.columns)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.execute(line_chunks.SQL).fetchall()
    rows = [(r.doc_id, r.text, r._chunk_lines, r._chunk_removed_lines, r._chunk_removed) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(((a, b if a != 50 else None, c, d, e) for a, b, c, d, e in want), key=str)
    assert sum(r[4] for r in rows) > 0
    shifted = [r for r in rows if r[0] == 1][0]
    assert shifted[3] >= 6  # an inserted line moves boundaries only nearby
    clash = docs.withColumn("_chunk_doc", F.lit(1)).withColumn("_chunk_gone", F.lit(2))
    assert line_chunks.deduplicate(clash).count() == len(pairs)
    assert line_chunks.deduplicate(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_in_line_chunks(spark):
    text = "\n".join(LINES)
    rows = line_chunks.deduplicate(frame(spark, [(None, text), (1, text), (1, text)])).collect()
    assert [r._chunk_removed for r in rows if r.doc_id is None] == [0]
    assert len({r._chunk_removed for r in rows if r.doc_id == 1}) == 1 and all(r._chunk_removed for r in rows if r.doc_id == 1)


def test_repeated_passages_wherever_chunks_end(spark):
    own = lambda d, k: [f"own line {d} {i}" for i in range(k)]
    line = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    pair, long, short = [line(1, 30), line(2, 30)], [line(3, 60)], [line(4, 5), line(5, 5)]
    run = [line(10 + k, 12) for k in range(6)]
    texts = [own(0, 3) + pair + own(1, 3) + long + own(2, 2) + short + own(3, 1) + run]
    texts += [own(10 + k, k % 4 + 1) + p + own(20 + k, 2) for k, p in enumerate([pair, long, run] * 5)]
    docs = frame(spark, [(k, "\n".join(t)) for k, t in enumerate(texts)] + [(90, None), (91, ""), (92, "\n\n")])
    got = {r.doc_id: r for r in line_chunks.deduplicate(docs, passage_words=50).collect()}
    assert got[0].text == "\n".join(texts[0]) and got[90].text is None and got[91].text == "" and got[92].text == "\n\n"
    for k, t in enumerate(texts[1:], 1):
        kept = [x for x in t if x.startswith("own")]
        assert got[k].text == "\n".join(kept) and got[k]._chunk_removed_lines == len(t) - len(kept)
    # what chunks alone remove goes in any case
    chunks = {r.doc_id: r for r in line_chunks.deduplicate(docs).collect()}
    assert all(chunks[k]._chunk_removed_lines <= got[k]._chunk_removed_lines for k in got)
    assert sum(r._chunk_removed_lines for r in chunks.values()) < sum(r._chunk_removed_lines for r in got.values())


def test_fingerprints(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(random.choices(words, k=random.choice([0, 1, 3, 5, 200, 900]))) for _ in range(120)]
    pairs = [(i * 3, t) for i, t in enumerate(texts)] + [(3, texts[1]), (9999, None), (None, "no id at all"), (10_000, "long " * 30000)]
    got = fingerprints.with_edits(frame(spark, pairs), range_rows=7).collect()
    ordered = sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0))
    assert len(got) == len(pairs)
    want = Counter()
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1]):
        t, nxt = t or "", nxt or ""
        want[(i, len(t), hashlib.sha256((t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    text_of = dict(pairs)
    for r in got:
        assert by_text.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    single = fingerprints.with_edits(frame(spark, [(1, "a b c d e f g h")])).collect()
    assert single[0].near_next == 1.0
    assert fingerprints.with_edits(frame(spark, pairs).limit(0)).count() == 0


def test_likeness_is_unbiased():
    shingles = lambda t: {tuple(w) for w in zip(*(t.split()[i:] for i in range(5)))}
    errors = []
    for size in (30, 300, 3000):
        for _ in range(40):
            a = [f"t{random.randrange(10**6)}" for _ in range(size)]
            b = a[:int(size * random.random())] + [f"t{random.randrange(10**6)}" for _ in range(size // 2)]
            a, b = " ".join(a), " ".join(b)
            true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
            errors.append(fingerprints.likeness(fingerprints.fingerprint(a), fingerprints.fingerprint(b)) - true)
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.35
    f = fingerprints.fingerprint("some words that make a text of shingles")
    assert (fingerprints.unpacked(fingerprints.packed(f)) == f).all()


def windows_by_hand(texts, n):
    seen = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
    return [[i for i in range(len(t) - n + 1) if seen[t[i:i + n]] > 1] for t in texts]


def test_interval_expansion_and_segments():
    for _ in range(150):
        n = random.choice([3, 5, 8, 12])
        letters = random.choice([b"ab", b"abcd", bytes(range(97, 117))])
        texts = [bytes(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(random.randint(1, 8))]
        if len(texts) > 2:
            texts[1] = texts[0][3:] + texts[2]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(texts, n)] == windows_by_hand(texts, n)
        for gram in (2, n):
            text, start, windows, key, inner = suffix_dedup.segments(texts, gram, n)
            keys = {}
            places = [(t, p, k) for t, s, w, k in zip(text, start, windows, key) for p in range(s, s + w)]
            assert sorted((t, p) for t, p, _ in places) == [(t, p) for t, x in enumerate(texts) for p in range(len(x) - n + 1)]
            for t, p, k in places:
                assert keys.setdefault(texts[t][p:p + n], k) == k
            for t, s, w, i in zip(text, start, windows, inner):
                assert i or len({texts[t][p:p + n] for p in range(s, s + w)}) == w


def removed_by_hand(texts, n):
    out = []
    for t, hits in zip(texts, windows_by_hand(texts, n)):
        gone = np.zeros(len(t) + 1, bool)
        for p in hits:
            gone[p:p + n] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK_BYTES, 1000])
def test_suffix_dedup(spark, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    word = lambda: "".join(random.choice("aéiou tnsr") for _ in range(7))
    noise = lambda k: " ".join(word() for _ in range(k))
    passage = noise(25)
    texts = [noise(20) + passage + noise(20) for _ in range(12)]
    texts += [texts[0], texts[0], "ab" * 200, "", "short", noise(60), passage[:90], "z" * 500]
    pairs = list(enumerate(texts)) + [(2, texts[2]), (None, texts[5]), (77, None)]
    for n in (100,):
        spans = suffix_dedup.repeated_spans
        monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda d, m, spans=spans: spans(d, m, gram=16, block_bytes=block))
        got = suffix_dedup.deduplicate(frame(spark, pairs), n, keep_bytes=True).collect()
        want = removed_by_hand([(t or "").encode() for _, t in pairs], n)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(
            (i, *w) for (i, _), w in zip(pairs, want))
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.deduplicate(frame(spark, pairs).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 32, 33])
def test_suffix_dedup_of_short_windows(spark, n):
    base = "".join(random.choice("abcé ") for _ in range(70))
    texts = [base, "x" + base[20:60] + "y", "q" * 50, "", "ab" * 30, base[:18] + "é" * 40]
    pairs = list(enumerate(texts)) + [(9, None)]
    got = suffix_dedup.deduplicate(frame(spark, pairs), n, keep_text=True).collect()
    want = removed_by_hand([(t or "").encode() for _, t in pairs], n)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(
        (i, *w) for (i, _), w in zip(pairs, want))
    whole = [r for r in got if r.n_removed == 0]
    assert all(r.text == (dict(pairs)[r.doc_id] or "") for r in whole)


def test_suffix_sort_and_expansion_start_early(monkeypatch):
    """A block is sorted in a few rounds of several letters each, and intervals are
    expanded from one of them; texts that end alike keep the order of their ends."""
    rng = random.Random(7)
    shared = bytes(rng.choice(b"abcd") for _ in range(900))
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 300))) + shared[rng.randint(0, 450):] for _ in range(40)]
    texts += [shared[:420], shared[-60:], shared[-60:], b"", b"a" * 900, b"\0" * 401]
    sorts = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **b: sorts.append(1) or argsort(*a, **b))
    found = [x.tolist() for x in suffix_dedup.repeated_windows(texts, 400)]
    assert len(sorts) < 12  # one for each length before
    assert found == windows_by_hand(texts, 400)
    for n in (1, 2, 9, 60, 61, 100):
        assert [x.tolist() for x in suffix_dedup.repeated_windows(texts[30:], n)] == windows_by_hand(texts[30:], n)


def test_variants_are_never_broadcast(spark):
    """Each fingerprint becomes 64 rows, which Spark's estimate leaves out."""
    def plan(df):
        return df._jdf.queryExecution().sparkPlan().toString()

    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    small = spark.createDataFrame(fps.collect(), "fp long")  # far below Spark's threshold
    cold = simhash.links(small, 2)
    assert "SortMergeJoin" in plan(cold) and "Broadcast" not in plan(cold)
    hot = plan(simhash.links(small.union(spark.range(50).select("id")), 2, hot_segment=10))
    assert hot.count("SortMergeJoin") == 2
