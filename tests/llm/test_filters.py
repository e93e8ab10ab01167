import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexiclust.llm import decontaminate, toxicity
from tests.conftest import SMALL

random.seed(9)
WORDS = ["".join(random.choice("aeiounrstlmdp") for _ in range(random.randint(2, 8))) for _ in range(400)]
INSULTS = ["grumblefoot", "slopperkin", "wretchling"]
EXTRA = "doc_id long, text string, score double, _bad_id int, digest string"


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def kernel_by_hand(s, t, order, decay):
    """Sum over pairs of index lists of equal letters, by enumeration."""
    from itertools import combinations
    total = 0.0
    for a in combinations(range(len(s)), order):
        for b in combinations(range(len(t)), order):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2)
    return total


def test_subsequence_kernel_against_enumeration():
    for _ in range(25):
        s, t = ("".join(random.choice("abc") for _ in range(random.randint(3, 7))) for _ in range(2))
        for order in (2, 3):
            chars, _ = toxicity.letters([s])
            mark = toxicity.letters([t])[0][0]
            got = float(toxicity.subsequence_kernel(chars, mark, order, 0.6)[0])
            assert abs(got - kernel_by_hand(s, t, order, 0.6)) < 1e-4


def test_common_letters_against_dynamic_program():
    words = sorted(("".join(random.choice("abcd") for _ in range(random.randint(1, 12))) for _ in range(60)), key=lambda w: -len(w))
    chars, sizes = toxicity.letters(words)
    for mark in ("abcd", "ddacb", "a"):
        got = toxicity.common_letters(chars, sizes, toxicity.letters([mark])[0][0])
        for w, g in zip(words, got):
            table = np.zeros((len(w) + 1, len(mark) + 1), int)
            for i, x in enumerate(w):
                for j, y in enumerate(mark):
                    table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
            assert g == table[-1, -1]


def corpus():
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = prose(40) + ". " + prose(30)
        if toxic:
            words = text.split()
            for _ in range(2):
                words.insert(random.randrange(len(words)), random.choice(INSULTS))
            text = " ".join(words)
        rows.append((i, text, 0.5, 1, "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows_and_disguised_words(spark):
    rows, labels = corpus()
    disguised = ["g.r.u.m.b.l.e.f.o.o.t", "slop-per*kin", "gxrumblefoot3", "g r u m b l e f o o t", "GRUMBLEFOOT!!"]
    more = [(1000 + k, prose(20) + " " + w + " " + prose(20), 0.0, 0, "") for k, w in enumerate(disguised)]
    odd = [(2000, "", 0.0, 0, ""), (2001, None, 0.0, 0, ""), (2002, "x" * 3000 + " " + prose(20000), 0.0, 0, ""), (None, prose(9), 0.0, 0, ""),
           (0, rows[0][1], 0.0, 0, "")]
    docs = spark.createDataFrame(rows + more + odd, EXTRA)
    lab = spark.createDataFrame([(*x, "en") for x in labels] + [(None, 1, "x"), (5, None, "x"), (99999, 1, "x")], "doc_id long, toxic int, lang string")
    got = toxicity.scores(docs, lab).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1000 + len(disguised))
    assert not any(r.predicted for r in got if r.doc_id in (2000, 2001, 2002))
    kept = toxicity.clean(docs, lab)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.predicted for r in got)
    one_class = toxicity.scores(docs, lab.where("toxic = 0")).collect()
    assert not any(r.predicted for r in one_class)
    assert toxicity.scores(docs.limit(0), lab).count() == 0
    assert toxicity.scores(docs, lab.limit(0)).count() == docs.count()


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, EXTRA)
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.scores(docs, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect() for x in (labels, flip))
    assert a == b


def align_by_hand(a, b):
    best, table = 0, np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            step = decontaminate.MATCH if x == y else decontaminate.MISMATCH
            table[i + 1, j + 1] = max(0, table[i, j] + step, table[i, j + 1] + decontaminate.GAP, table[i + 1, j] + decontaminate.GAP)
            best = max(best, table[i + 1, j + 1])
    return best


def test_alignment_against_the_table():
    for _ in range(60):
        item = np.array([random.randint(1, 4) for _ in range(random.randint(1, 9))])
        passages = np.array([[random.randint(0, 4) for _ in range(12)] for _ in range(5)])
        score, _, end = decontaminate.align(item, passages)
        assert score.tolist() == [align_by_hand(item, p) for p in passages]
        assert (end < 12).all()


def test_copies_are_found_and_clean_documents_left(spark):
    items = [(k, prose(random.choice([8, 40, 60]))) for k in range(12)]
    docs, leaked = [], {}
    for i in range(120):
        docs.append((i, prose(300)))
    for k, (item, text) in enumerate(items):
        words = text.split()
        edited = [w if random.random() > 0.12 else "changed" for w in words]
        for j, copy in enumerate((words, edited, words[:len(words) // 2] + ["well"] + words[len(words) // 2:])):
            i = 200 + 3 * k + j
            docs.append((i, prose(100) + " " + " ".join(copy).upper() + ". " + prose(100)))
            leaked[i] = item
    docs += [(1000, None), (1001, ""), (None, prose(50) + " " + items[3][1]), (200, docs[120][1]), (1002, prose(30000))]
    frame = spark.createDataFrame([(i, t, 0.0, 1, "x") for i, t in docs], EXTRA)
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "single"), (3, items[3][1])], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 60):
        found = decontaminate.contaminated(frame, bench, block_words=block).collect()
        pairs = {(r.doc_id, r.item_id) for r in found if r.item_id != 52}
        assert set(leaked.items()) <= pairs and (None, 3) in pairs
        assert {i for i, _ in pairs} == {*leaked, None}
    first = [r for r in found if r.doc_id == 200][0]
    text = decontaminate.words(docs[120][1])
    assert first.score == 1.0 and text[first.start_word:first.end_word] == decontaminate.words(items[0][1])
    kept = decontaminate.clean(frame, bench.where("item_id <> 52"))
    flagged = {r.doc_id for r in found if r.item_id != 52}
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(i for i, _ in docs if i not in flagged)
    assert kept.where("doc_id < 120 OR doc_id IN (1000, 1001)").count() >= 122
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), bench).count() == 0


def test_passage_under_half_of_a_long_item(spark):
    item = [f"q{k}" for k in range(250)]
    edited = [w if k % 12 else "changed" for k, w in enumerate(item[20:80])]
    texts = {1: item[100:200], 2: item[210:245], 3: edited, 4: item[50:70], 5: item[:120:2], 6: []}
    # a passage that many documents hold is more frequent than the rest of the item
    texts |= {10 + k: item[100:140] for k in range(5)}
    docs = spark.createDataFrame([(i, prose(80) + " " + " ".join(t) + " " + prose(80)) for i, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {1, 2, 3, 10, 11, 12, 13, 14} and got[1].score == 0.4
    assert (got[1].start_word, got[1].end_word) == (80, 180) and (got[2].start_word, got[2].end_word) == (80, 115)
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {4, 5, 6}


def test_short_items_take_no_clean_documents(spark):
    items = {1: "red fox jumps high", 2: "word", 3: "one two three four five six", 4: "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11 a12"}
    texts = {1: "the red fox ran and a dog jumps high", 2: "a word of it", 3: "one two three four five seven", 4: "so a1 a2 a3 a4 a5 a6 b",
             5: "Red fox, jumps high!", 6: "word", 7: "count one two three four five six now", 8: "so a3 a4 a5 a6 a7 a8 a9 a10 b",
             9: "the red fox jumps high today"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(5, 1), (6, 2), (7, 3), (8, 4)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {1, 2, 3, 4, 9}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert docs.columns == before
        assert docs.where("n_chars <> length(text)").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] == sizes[2] and sizes[3] < sizes[2]
    tokens = corpus_pipeline.into_windows(spark, docs, SMALL).agg(F.sum("length"), F.countDistinct("doc_id")).first()
    assert tokens[1] == sizes[-1]
    total = corpus_pipeline.run(spark, SMALL).agg(F.sum("length")).first()[0]
    assert total == tokens[0]
