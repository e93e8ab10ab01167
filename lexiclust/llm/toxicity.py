"""Toxicity scoring with a gap-weighted subsequence kernel machine.

Sentences are compared through their words: the sentence kernel is the sum of a
word kernel over all pairs of distinct words, and the word kernel is the gap-weighted
subsequence kernel of order ``ORDER`` (Lodhi et al., 2002) on the words'
letters, raised to a power.  Subsequences skip inserted characters, so an insult
keeps most of its value when letters are put into it.  Landmarks are words and
parts of words of the labelled sample that tell its classes apart; kernels with
them, scaled to one for a word that holds the landmark, give Nystroem features.
A linear support vector machine on these is trained on sentences, where a toxic
document counts by its most toxic sentence.
A document's score is the calibrated margin of its most toxic sentence.

By the kernel's additivity a trained model is one number for each distinct word,
so whole texts are scored at the cost of their distinct words.

Defined results: null text counts as empty and scores as a sentence without
evidence; only labels of rows whose CRC-32 of the id is not divisible by
``FOLDS`` are read; null labels and labels without document are ignored; of
several labels of an id the largest counts; without both classes in the labels
every score is the share of toxic ones (0 if there are none); repeated rows are
each scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, unused, written

FOLDS = 5
ORDER = 4
DECAY = 0.6
POWER = 2
#: share of a landmark's letters that a word must hold in order; the kernel of other words is taken as 0
SHARED = 0.6
#: bounds of the labelled sample: documents of each class, and sentences of a document
SAMPLE_DOCS = 3000
SAMPLE_SENTENCES = 12
LANDMARKS = 48
#: landmarks that mark no class
COMMON_LANDMARKS = 8
#: lengths of the parts of words that may become landmarks, and how many candidates are compared
PART_LENGTHS = (4, 5, 6, 8)
CANDIDATES = 3000
LONGEST = 24
SENTENCE = re.compile(r"[.!?]+\s|\n")
SPELLED = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){2,}(?!\S)")
NO_LETTER = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower case, with spelled-out words (``x y z``) joined."""
    return SPELLED.sub(lambda m: NO_LETTER.sub("", m.group()), text.lower())


def bare(word: str) -> str:
    """The word's letters."""
    return word if word.isalpha() else NO_LETTER.sub("", word)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Padded matrix of character codes (0 = none) and the lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4") % 255 + 1
    out = np.zeros((len(words), int(sizes.max(initial=1))), np.uint8)
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(len(words)), sizes)
    out[rows, np.arange(len(codes)) - starts[rows]] = codes
    return out, sizes


def common_letters(chars: np.ndarray, sizes: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each word (rows sorted by
    falling length) and one landmark, by the bit-parallel recurrence."""
    n = len(mark)
    places = np.zeros(256, np.uint32)
    for i, c in enumerate(mark):
        places[c] |= np.uint32(1 << i)
    state = np.full(len(chars), (1 << n) - 1, np.uint32)
    live = np.searchsorted(-sizes, -np.arange(chars.shape[1]), side="left")  # rows longer than i
    for i in range(chars.shape[1]):
        s = state[:live[i]]
        hit = s & places[chars[:live[i], i]]
        state[:live[i]] = (s + hit) | (s - hit)
    return n - np.bitwise_count(state & np.uint32((1 << n) - 1)).astype(np.int64)


def subsequence_kernel(chars: np.ndarray, mark: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of each row of ``chars`` and one landmark."""
    n, width = chars.shape
    total = np.zeros(n, np.float32)
    # prefix kernels of the landmark's prefixes (column 0: the empty one), per order
    above = [np.ones((len(mark) + 1, n), np.float32)]
    above += [np.zeros((len(mark) + 1, n), np.float32) for _ in range(order - 1)]
    for i in range(width):
        same = [(chars[:, i] == c) for c in mark]
        for k in range(order - 1, -1, -1):
            lower = above[k]
            if k == order - 1:
                for j, hit in enumerate(same):
                    total += np.where(hit, lower[j], 0) * np.float32(decay ** 2)
                continue
            run = np.zeros(n, np.float32)
            upper = above[k + 1]
            for j, hit in enumerate(same):
                run = run * np.float32(decay) + np.where(hit, lower[j], 0) * np.float32(decay ** 2)
                upper[j + 1] *= np.float32(decay)
                upper[j + 1] += run
    return total


def pieces(word: str) -> list[str]:
    """A word, or overlapping parts that cover a word longer than ``LONGEST``."""
    if len(word) <= LONGEST:
        return [word]
    return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class WordKernel:
    """Kernel values of words and fixed landmarks, each landmark scaled to one
    with itself."""

    def __init__(self, marks: list[str], order: int = ORDER, decay: float = DECAY, power: int = POWER):
        self.marks, self.order, self.decay, self.power = marks, order, decay, power
        self.codes = [letters([m])[0][0] for m in marks]
        self.own = [float(subsequence_kernel(c[None, :], c, order, decay)[0]) for c in self.codes]

    def values(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each landmark the numbers of the words it touches and their kernels."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        chars, sizes = letters([words[i] for i in order])
        hits = []
        for code in self.codes:
            least = max(self.order, int(np.ceil(SHARED * len(code))))
            some = int(np.searchsorted(-sizes, -least, side="right"))  # words that are long enough
            hits.append(np.flatnonzero(common_letters(chars[:some], sizes[:some], code) >= least))
        out = []
        for code, own, rows in zip(self.codes, self.own, hits):
            value = np.zeros(len(rows), np.float32)
            for a in range(0, len(rows), 16384):
                part = rows[a:a + 16384]
                value[a:a + 16384] = subsequence_kernel(chars[part, :int(sizes[part].max(initial=1))], code,
                                                        self.order, self.decay)
            out.append((order[rows], np.minimum(value / own, 1.0) ** self.power))
        return out

    def dense(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.marks)))
        for k, (rows, value) in enumerate(self.values(words)):
            out[rows, k] = value
        return out


@dataclass
class Model:
    """Landmarks with one weight each, the margin's bias, and the calibration."""
    marks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _words_of(texts: list[str]) -> tuple[list[list[set[str]]], list[str]]:
    """Sentences (sets of chunks) of each text, and all distinct chunks."""
    split = [[set(s.split()) for s in SENTENCE.split(normal(t))] for t in texts]
    return split, list(set().union(*(s for text in split for s in text)))


def _bare_pieces(chunks: list[str]) -> tuple[list[str], list[list[int]]]:
    """Distinct word pieces of the chunks, and the pieces of each chunk."""
    number: dict[str, int] = {}
    of_chunk = []
    for c in chunks:
        w = bare(c)
        of_chunk.append([number.setdefault(p, len(number)) for p in pieces(w)] if len(w) >= ORDER else [])
    return list(number), of_chunk


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    most: int = SAMPLE_DOCS) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most`` labelled documents of each class outside the held-out
    fold (first by a hash of the id), and how many labels each class has."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y")))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    ids = F.broadcast(chosen)  # 2 * most rows at most
    return (docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
                        .alias("text")).join(ids, "_id")), sizes


def _parts(text: str, without: tuple[str, ...] = ()) -> set[str]:
    """Landmark candidates of a text: its words, and parts of its words, of
    those words that hold none of the strings ``without``."""
    words = {p for c in set(normal(text).split()) for p in pieces(bare(c)) if len(p) >= ORDER}
    words = {w for w in words if not any(m in w for m in without)}
    return words.union(w[i:i + n] for w in words for n in PART_LENGTHS if n < len(w) for i in range(len(w) - n + 1))


def choose_landmarks(sample: DataFrame, n: int = LANDMARKS, common: int = COMMON_LANDMARKS) -> tuple[list[str], int]:
    """Words and parts of words that cover the sample's toxic documents with as
    few others as possible, chosen greedily, then a few common words; and how many
    are of the first kind.

    ``CANDIDATES`` strings are compared, those whose document frequencies differ
    most; of the sample's toxic documents their numbers come to the driver.
    """
    def parts(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 50):
                part = batch.slice(a, 50)
                ys, ws = [], []
                for t, y in zip(part.column("text").to_pylist(), part.column("_y").to_pylist()):
                    own = _parts(t)
                    ws.extend(own)
                    ys.extend([y] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array(ys, pa.int32())], names=["w", "y"])

    # equal texts would count as often as they were copied
    texts = sample.groupBy(F.col("text")).agg(F.max("_y").alias("_y"))
    counts = written(texts.mapInArrow(parts, "w string, y int").groupBy("w")
                     .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).where("toxic + clean > 1"), "parts")
    totals = {r["_y"]: r["n"] for r in texts.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = max(totals.get(1, 0), 1), max(totals.get(0, 0), 1)
    odds = F.log((F.col("toxic") + 0.5) / (pos + 1)) - F.log((F.col("clean") + 0.5) / (neg + 1))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    telling = counts.where("toxic >= 2").orderBy((odds / spread).desc(), F.length("w").desc(), "w").limit(CANDIDATES).collect()
    usual = [r["w"] for r in counts.where(F.length("w") <= LONGEST).orderBy(F.desc("clean"), "w").limit(common).collect()]
    number = {r["w"]: i for i, r in enumerate(telling)}
    clean = np.array([r["clean"] * pos / neg for r in telling])
    size = np.array([len(r["w"]) for r in telling])

    marks: list[str] = []
    while telling and len(marks) < n - common:
        def present(batches, chosen=tuple(marks)):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(
                    [sorted(number[w] for w in _parts(t.as_py(), chosen) if w in number) for t in batch.column("text")],
                    pa.list_(pa.int32()))], names=["held"])

        held = [r["held"] for r in texts.where("_y = 1").mapInArrow(present, "held array<int>").collect()]
        has = np.zeros((len(held), len(telling)), bool)
        for d, numbers in enumerate(held):
            has[d, numbers] = True
        # one landmark for each document; the next pass looks at words without these landmarks
        open_, before = np.ones(len(held), bool), len(marks)
        while len(marks) < n - common:
            gain = has[open_].sum(axis=0) - 3.0 * clean
            if gain.max(initial=0) < max(2, 0.03 * pos):
                break
            # of the nearly best the longest: it meets fewer other words
            best = int(np.lexsort((-gain, -size * (gain >= 0.95 * gain.max())))[0])
            marks.append(telling[best]["w"])
            open_ &= ~has[:, best]
        if len(marks) == before:
            break
    return marks + [w for w in usual if w not in marks], len(marks)


def sentence_vectors(sample: DataFrame, marks: list[str], telling: int, most: int = SAMPLE_SENTENCES) -> DataFrame:
    """``_id, _y, v``: kernel sums of the sample's sentences and the landmarks;
    of a document at most ``most`` sentences, those with the largest sums for
    the first ``telling`` landmarks, and one zero vector if none is touched."""
    def run(batches):
        kernel = WordKernel(marks)
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                split, chunks = _words_of(part.column("text").to_pylist())
                words, of_chunk = _bare_pieces(chunks)
                dense = kernel.dense(words).astype(np.float32) if words else np.zeros((0, len(marks)), np.float32)
                vector = {c: dense[p].max(axis=0) for c, p in zip(chunks, of_chunk) if p and dense[p].any()}
                ids, ys, vs = [], [], []
                for i, y, text in zip(part.column("_id").to_pylist(), part.column("_y").to_pylist(), split):
                    sums = [np.sum([vector[c] for c in sorted(s) if c in vector], axis=0) for s in text
                            if any(c in vector for c in s)]
                    sums.sort(key=lambda v: (-float(v[:telling].sum()), float(v.sum())))
                    for v in sums[:most] or [np.zeros(len(marks))]:
                        ids.append(i)
                        ys.append(y)
                        vs.append(np.asarray(v, float).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()),
                                                  pa.array(vs, pa.list_(pa.float64()))], names=["_id", "_y", "v"])

    return sample.select("_id", "_y", "text").mapInArrow(run, "_id long, _y int, v array<double>")


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Primal squared-hinge support vector machine by Newton steps; ``y`` is +-1."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        inside = y * (a @ w) < 1
        s, c = a[inside], cost * weight[inside]
        new = np.linalg.solve(ridge + s.T @ (s * c[:, None]), s.T @ (c * y[inside]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the margins."""
    a = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    target = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - target)) + 1e-3 * w
        h = a.T @ (a * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", rounds: int = 4) -> Model:
    """Fit on the bounded labelled sample; what comes to the driver is at most
    ``2 * SAMPLE_DOCS * SAMPLE_SENTENCES`` vectors of ``LANDMARKS`` numbers."""
    sample, sizes = labelled_sample(docs, labels, id_col, text_col, label_col)
    # a small sample would otherwise stay in the few tasks that found it
    sample = written(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism, "_id"), "labelled")
    if not sizes.get(1) or not sizes.get(0):
        share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    marks, telling = choose_landmarks(sample)
    rows = sentence_vectors(sample, marks, telling).orderBy("_id").collect()
    if not rows or not marks:
        share = sizes[1] / (sizes[0] + sizes[1])
        return Model([], np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))
    x = np.array([r["v"] for r in rows])
    ids, doc = np.unique(np.array([r["_id"] for r in rows]), return_inverse=True)
    y = np.zeros(len(ids))
    y[doc] = [1.0 if r["_y"] else -1.0 for r in rows]
    # Nystroem: the landmarks' own kernel whitens the sums
    own = WordKernel(marks).dense(marks)
    own = np.sqrt(own * own.T)
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-4 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    z = x @ whiten
    weight_of = {1.0: sizes[1] / max((y > 0).sum(), 1), -1.0: sizes[0] / max((y < 0).sum(), 1)}
    evidence = x[:, :telling].sum(axis=1)
    margin = evidence
    for _ in range(rounds):
        top = np.lexsort((margin, doc))  # the most toxic sentence of each document
        last = np.zeros(len(doc), bool)
        last[top[np.append(doc[top][1:] != doc[top][:-1], True)]] = True
        # of toxic documents that one and those that hold a telling landmark, of the others all
        use = last | (evidence > 0.9) | (y[doc] < 0)
        w, bias = svm(z[use], y[doc][use], np.where(y[doc][use] > 0, 2.0, 1.0))
        margin = z @ w + bias
    best = np.full(len(ids), bias)
    np.maximum.at(best, doc, margin)
    slope, offset = calibrate(best, y, np.where(y > 0, weight_of[1.0], weight_of[-1.0]))
    return Model(marks, whiten @ w, bias, slope, offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, digest``: score of the most toxic sentence of each whole
    text; ``digest`` is the text's MD5."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        from hashlib import md5
        kernel = WordKernel(model.marks) if model.marks else None
        for rows in text_slices(batches, 4_000_000):
            margins = np.full(len(rows), model.bias)
            if kernel:
                split, chunks = _words_of([t for _, t in rows])
                words, of_chunk = _bare_pieces(chunks)
                weight = np.zeros(len(words) + 1)
                if words:
                    for k, (hit, value) in enumerate(kernel.values(words)):
                        weight[hit] += model.weights[k] * value
                # of the parts of a long word the most toxic one counts
                of = {c: max(weight[i] for i in p) for c, p in zip(chunks, of_chunk) if p and any(weight[i] for i in p)}
                touched = of.keys()
                for r, text in enumerate(split):
                    for s in text:
                        if not touched.isdisjoint(s):
                            margins[r] = max(margins[r], model.bias + sum(map(of.__getitem__, sorted(touched & s))))
            digests = [md5(t.encode("utf-8"), usedforsecurity=False).digest() for _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array(model.probability(margins)),
                 pa.array(digests, pa.binary())], names=["doc_id", "score", "digest"])

    return source.mapInArrow(run, "doc_id long, score double, digest binary")


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that score under one half."""
    model = train(docs, labels, id_col, text_col, label_col)
    bad_id, bad_digest = unused(docs, "_bad_id", "_bad_digest")
    bad = written(score(docs, model, id_col, text_col).where("score >= 0.5").select(
        F.col("doc_id").alias(bad_id), F.col("digest").alias(bad_digest)).distinct(), "toxic")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(bad_id)) & (digest == F.col(bad_digest))
    return docs.join(bad, same, "left_anti")
